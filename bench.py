"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Session start is not timed. Road-network set-up (turns, routes, assignment) is
timed once as its own entry, because every counts query reuses it. The last two
entries scale the sample count up, in the units of the published figures.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from flowloom.operators import assignment as A
from flowloom.operators import scenarios as SC
from flowloom.operators import spatial as SP
from flowloom.operators.reshape import unflatten
from flowloom.plans import catalog, inputs
from flowloom.session import clear_scratch, local_session, materialise
from flowloom.sources import fixtures as fx

HEADLINE = (
    "m3_productions",
    "m4_table_metrics",
    "t5_turning_counts",
    "t6_vector_counts",
    "a1_turn_stats",
    "a3_pair_distance_mean",
    "q1_filter_features",
    "q5_diverse_subset",
    "p1_rake",
    "g9_gravity_table",
    "d2_normal",
    "o1_noise_poisson",
    "b1_ridge",
    "v4_all_scores",
    "x2_streamed_counts",
)
GENERATED = 50_000


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    times = {"network_setup": timed(lambda: inputs.assignment(spark, sf_dir))}
    for name in HEADLINE:
        times[name] = timed(lambda n=name: drain(catalog.REGISTRY[n].run(spark, sf_dir)))

    n = inputs.n_zones(spark, sf_dir)
    base = materialise(fx.base_od(spark, sf_dir), "base")
    p = materialise(SP.base_probability(base, SP.distances(fx.zones(spark, sf_dir), n)), "prior")
    made = SC.generate_from_base(base, p, n, GENERATED)
    kept = []
    times["generate_50k_tables"] = timed(lambda: kept.append(materialise(made, "generated")))
    turns = inputs.turns(spark, sf_dir).count()
    vectors = kept[0].select("sample_id", "y")
    assignment = inputs.assignment(spark, sf_dir)
    times["counts_50k_vectors"] = timed(lambda: drain(A.vector_counts(vectors, assignment, turns, n)))
    cells = unflatten(vectors, n).filter(F.col("flow") != 0)
    times["counts_50k_long"] = timed(lambda: drain(A.turning_counts(cells, assignment, n)))
    clear_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "tables_per_sec": round(GENERATED / times["generate_50k_tables"], 1),
                "count_samples_per_sec": round(GENERATED / times["counts_50k_vectors"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
