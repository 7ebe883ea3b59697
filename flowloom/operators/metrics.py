"""Per-table metrics against a base table, and their aggregates.

Absent cells are zeros. A measure over all cells is what an empty table would
score against the base, a constant, corrected at the stored cells only. So the
stored cells meet the broadcast base once and are summed per sample; nothing is
densified, outer-joined or shuffled by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import corr_from_sums
from ..session import join_small
from .sampling import sample_rows


def productions(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sample_id", "o").agg(F.sum("flow").alias("production"))


def attractions(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sample_id", "d").agg(F.sum("flow").alias("attraction"))


def analyse_base(base: DataFrame, n_zones: int) -> DataFrame:
    """One row: zone count, total, non-zero cells, sparsity over all cells."""
    cells = base.filter(F.col("o") != F.col("d"))
    nonzero = F.count_if(F.col("flow") != 0)
    return cells.agg(
        F.lit(n_zones).alias("num_zones"),
        F.coalesce(F.sum("flow"), F.lit(0.0)).alias("total_demand"),
        nonzero.alias("num_nonzero"),
        (1.0 - nonzero / F.lit(n_zones * n_zones)).alias("sparsity_fraction"),
    )


def base_marginals(base: DataFrame) -> DataFrame:
    """``zone, production, attraction``: every cell counts once for each end."""
    ends = F.array(
        F.struct(F.col("o").alias("zone"), F.col("flow").alias("p"), F.lit(0.0).alias("a")),
        F.struct(F.col("d").alias("zone"), F.lit(0.0).alias("p"), F.col("flow").alias("a")),
    )
    return (
        base.filter(F.col("o") != F.col("d"))
        .select(F.explode(ends).alias("e"))
        .groupBy("e.zone")
        .agg(F.sum("e.p").alias("production"), F.sum("e.a").alias("attraction"))
    )


def top_pairs(base: DataFrame, k: int) -> DataFrame:
    """The k largest positive flows."""
    return base.filter((F.col("flow") > 0) & (F.col("o") != F.col("d"))).orderBy(F.desc("flow"), "o", "d").limit(k)


def beside_base(cells: DataFrame, base: DataFrame) -> DataFrame:
    """``sample_id, o, d, s, b`` for the stored cells."""
    known = base.select("o", "d", F.col("flow").alias("b"))
    joined = join_small(cells.select("sample_id", "o", "d", F.col("flow").alias("s")), known, ["o", "d"], "left")
    return joined.withColumn("b", F.coalesce("b", F.lit(0.0)))


def base_sums(base: DataFrame) -> tuple[Column, Column]:
    """Sum and sum of squares of the base flows."""
    sums = base.agg(F.coalesce(F.sum("flow"), F.lit(0.0)).alias("b"), F.coalesce(F.sum(F.col("flow") * F.col("flow")), F.lit(0.0)).alias("bb"))
    return sums.select("b").scalar(), sums.select("bb").scalar()


def table_metrics(
    cells: DataFrame, base: DataFrame, n_zones: int, raking: DataFrame | None = None
) -> DataFrame:
    """One row of similarity, marginal and structural metrics per sample.

    ``raking(sample_id, iterations, final_error)`` is optional.
    """
    n_cells = F.lit(float(n_zones * n_zones))
    b1, b2 = base_sums(base)
    pair = beside_base(cells, base)
    s, b = F.col("s"), F.col("b")
    # stored cells exactly, plus what the base holds outside them
    apart = F.sum(F.abs(s - b)) + F.greatest(b1 - F.sum(b), F.lit(0.0))
    squared = F.sum((s - b) * (s - b)) + F.greatest(b2 - F.sum(b * b), F.lit(0.0))
    cell = pair.groupBy("sample_id").agg(
        (apart / n_cells).alias("mae"),
        F.sqrt(squared / n_cells).alias("rmse"),
        (apart / (b1 + 1e-12)).alias("relative_error"),
        corr_from_sums(n_cells, F.sum(s), b1, F.sum(s * s), b2, F.sum(s * b), 1e-12 * n_zones).alias("correlation"),
        F.count_if((b <= 0) & (s > 1e-6)).alias("new_connections"),
        F.sum(F.when(F.col("o") == F.col("d"), s).otherwise(0.0)).alias("diagonal_violation"),
        (1.0 - F.count_if(s != 0) / n_cells).alias("sparsity"),
        F.sum(s).alias("total_demand"),
    )

    def marginal(key: str, name: str) -> DataFrame:
        known = base.groupBy(key).agg(F.sum("flow").alias("b"))
        idle = lambda c: F.abs(c) / (c + 1e-9)  # noqa: E731 - drift of a zone without flow
        nothing = known.agg(F.sum(idle(F.col("b")))).scalar()
        per_zone = join_small(cells.groupBy("sample_id", key).agg(F.sum("flow").alias("s")), known, key, "left")
        at = F.coalesce("b", F.lit(0.0))
        drift = F.abs((F.col("s") - at) / (at + 1e-9)) - idle(at)
        return per_zone.groupBy("sample_id").agg(((nothing + F.sum(drift)) / F.lit(float(n_zones))).alias(name))

    out = cell.join(marginal("o", "production_error"), "sample_id").join(marginal("d", "attraction_error"), "sample_id")
    if raking is None:
        return out
    fields = raking.select(
        "sample_id",
        F.col("iterations").alias("ipf_iterations"),
        F.col("final_error").alias("ipf_final_error"),
        (F.col("final_error") < 1e-3).alias("ipf_converged"),
    )
    return out.join(fields, "sample_id", "left")


def sampled_metrics(cells: DataFrame, base: DataFrame, n_zones: int, size: int = 10_000, seed: int = 42) -> DataFrame:
    """Mean and spread of the metrics on a random subset of samples."""
    chosen = sample_rows(cells.select("sample_id").distinct(), size, "sample_id", seed, "metrics")
    m = table_metrics(cells.join(chosen, "sample_id", "left_semi"), base, n_zones)
    return m.agg(
        F.avg("mae").alias("mean_mae"),
        F.avg("rmse").alias("mean_rmse"),
        F.avg("relative_error").alias("mean_relative_error"),
        F.avg("correlation").alias("mean_correlation"),
        F.stddev_pop("correlation").alias("std_correlation"),
        F.max("new_connections").cast("double").alias("max_new_connections"),
        F.avg("total_demand").alias("mean_total_demand"),
        F.stddev_pop("total_demand").alias("std_total_demand"),
        F.count("*").cast("double").alias("eval_sample_size"),
    )


def aggregate_metrics(metrics: DataFrame) -> DataFrame:
    """Mean and deviation of measured columns, mean and maximum of counted ones,
    share of true for flags."""
    out = []
    for name, kind in metrics.dtypes:
        if name == "sample_id":
            continue
        if kind == "boolean":
            out.append(F.avg(F.col(name).cast("int")).alias(name))
        elif kind in ("int", "bigint"):
            out += [F.avg(name).alias(f"mean_{name}"), F.max(name).cast("double").alias(f"max_{name}")]
        else:
            out += [F.avg(name).alias(f"mean_{name}"), F.stddev_pop(name).alias(f"std_{name}")]
    return metrics.agg(*out)
