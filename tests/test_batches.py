"""K-means runs, rank facts of a grid of operators and batched counts against plain NumPy."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import assignment as A
from flowloom.operators import linear as L
from flowloom.operators import stats as ST
from flowloom.operators import stored as K
from flowloom.operators.scoring import all_scores


def plain_lloyd(x, centres, tol, max_iter=100):
    """Textbook rounds from given centres; empty clusters keep theirs."""
    for _ in range(max_iter):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        moved, centres = ((new - centres) ** 2).sum(), new
        if moved <= tol * x.var(axis=0).mean():
            break
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in ((0, 0, 0), (9, 0, 0), (0, 9, 0), (0, 0, 9))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "sample_id int, y array<double>").repartition(5)


def test_cluster_runs_equal_plain_rounds(spark, clouds):
    x, vectors = clouds
    found, centres = ST.cluster_runs(vectors, "y", (2, 4), 4)
    first = ST._cluster_starts(vectors.selectExpr("cast(sample_id as string) id", "y v"), 3, 4, 4, 42)
    assert {tuple(c) for c in first.reshape(-1, 3)} <= {tuple(r) for r in x}
    again = ST._cluster_starts(vectors.coalesce(1).selectExpr("cast(sample_id as string) id", "y v"), 3, 4, 4, 42)
    assert np.array_equal(first, again)
    for r in found.collect():
        assert np.isclose(r["inertia"], plain_lloyd(x, first[r["start"]][: r["k"]], 1e-4))
    best = {r["k"]: r["inertia"] for r in ST.cluster_inertia(vectors, "y", (2, 4), 4).collect()}
    assert best[4] < 60 < best[2]  # four clouds of 40 points with variance 0.09 in each of 3 entries


def test_cluster_runs_on_few_or_equal_rows(spark, clouds):
    _, vectors = clouds
    assert ST.cluster_inertia(vectors.limit(0), "y").count() == 0
    same = spark.range(6).select(F.col("id").alias("sample_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("y"))
    withnull = same.unionByName(spark.range(1).select(F.lit(9).cast("long").alias("sample_id"), F.lit(None).cast("array<double>").alias("y")))
    assert [r["inertia"] for r in ST.cluster_inertia(withnull, "y", (2, 5), 2).collect()] == [0.0, 0.0]


def test_rank_reports_of_a_grid(spark):
    rng = np.random.default_rng(8)
    tables = {(1, 0.5): rng.random((4, 9)), (3, 0.5): np.outer(rng.random(4), rng.random(9)), (3, 2.0): np.eye(4, 9)}
    rows = [(k, t, i, j, float(m[i, j])) for (k, t), m in tables.items() for i in range(4) for j in range(9) if m[i, j]]
    grid = spark.createDataFrame(rows, "k_paths int, theta double, turn_id int, od_index int, weight double").repartition(6)
    got = {(r["k_paths"], r["theta"]): r for r in L.rank_reports(grid, ["k_paths", "theta"], 4, 9).collect()}
    assert set(got) == set(tables)
    for key, m in tables.items():
        s = np.linalg.svd(m, compute_uv=False)
        r, rank = got[key], int(np.linalg.matrix_rank(m))
        assert (r["rank"], r["nullity"]) == (rank, 9 - rank) and np.isclose(r["energy"], (m**2).sum()) and np.isclose(r["max_entry"], m.max())
        if rank == 4:
            assert np.isclose(r["condition_number"], s[0] / s[-1])
        assert r["effective_rank_99"] == int((np.cumsum(s**2) / (s**2).sum() < 0.99).sum() + 1)
    assert L.rank_reports(grid.limit(0), ["k_paths", "theta"], 4, 9).count() == 0


def test_batch_counts(spark):
    rng = np.random.default_rng(1)
    flow, weight = rng.random((7, 3, 3)), rng.random((4, 9))
    weight[2] = 0.0
    cells = spark.createDataFrame(
        [(s, o + 1, d + 1, float(flow[s, o, d])) for s in range(7) for o in range(3) for d in range(3)], "sample_id int, o int, d int, flow double"
    )
    table = spark.createDataFrame([(t, j, float(weight[t, j])) for t in range(4) for j in range(9) if weight[t, j]], "turn_id int, od_index int, weight double")
    counts, stats, check = A.batch_counts(cells, table, 4, 3)
    want = flow.reshape(7, 9) @ weight.T
    rows = counts.collect()
    assert len(rows) == 28 and all(np.isclose(r["x"], want[r["sample_id"], r["turn_id"]]) and r["x"] == r["x_obs"] for r in rows)
    for r in stats.collect():
        assert r["n"] == 7 and np.isclose(r["mean"], want[:, r["turn_id"]].mean()) and np.isclose(r["std"], want[:, r["turn_id"]].std())
    c = check.first()
    assert (c["num_samples"], c["num_turns"], c["first_sample"], c["matrix_mult_consistent"]) == (7, 4, 0, True)
    assert c["max_reconstruction_error"] < 1e-9 and np.isclose(c["total"], want.sum())
    empty = A.batch_counts(cells.limit(0), table, 4, 3)
    assert empty[0].count() == 0 and empty[2].first()["matrix_mult_consistent"] is False
    noisy = A.batch_counts(cells, table, 4, 3, noise="gaussian")[1].filter("turn_id = 2").first()
    assert noisy["mean"] == 0 and noisy["mean_obs"] > 0  # turns without traffic get noise too


def test_a_second_run_scores_only_new_models(spark, tmp_path):
    rng = np.random.default_rng(6)
    cell = "split string, sample_id int, o int, d int"
    cells = [("test", s, o, d) for s in range(4) for o in (1, 2) for d in (1, 2)]
    truth = spark.createDataFrame([(*c, float(rng.random() + 1)) for c in cells], f"{cell}, flow double")
    made = spark.createDataFrame(
        [(m, *c, float(rng.random() + 1)) for m in ("007", "b", "c") for c in cells], f"model string, {cell}, y double"
    )
    table = spark.createDataFrame([(t, j, float(rng.random())) for t in range(3) for j in range(4)], "turn_id int, od_index int, weight double")
    counts = A.turning_counts(truth, table, 2).withColumn("split", F.lit("test"))
    samples = truth.select("split", "sample_id").distinct()
    rest = (truth, counts, table, samples, 2, 3)
    kept, scores = str(tmp_path / "kept"), str(tmp_path / "scores")

    def files():
        return {p.parent.name: p.name for p in Path(scores).glob("part=*/*.parquet")}

    def values(df):
        return {r["model"]: np.array([r[c] for c in sorted(df.columns) if c not in ("model", "split")], dtype=float) for r in df.collect()}

    K.put(made.filter("model = '007'"), kept)
    assert set(values(K.score_stored(kept, scores, *rest))) == {"007"}
    before = files()
    K.put(made.filter("model <> '007'"), kept)
    got, want = values(K.score_stored(kept, scores, *rest)), values(all_scores(made, *rest))
    assert set(got) == set(want) and all(np.allclose(got[m], want[m], equal_nan=True) for m in want)
    assert set(files()) == {"part=model-007", "part=model-b", "part=model-c"} and before.items() <= files().items()
    whole = files()
    K.score_stored(kept, scores, *rest)
    assert files() == whole
    better = truth.select(F.lit("b").alias("model"), "split", "sample_id", "o", "d", F.col("flow").alias("y"))
    K.put(better, kept)
    again = values(K.score_stored(kept, scores, *rest, again=["b"]))
    assert np.allclose(again["c"], want["c"], equal_nan=True) and not np.allclose(again["b"], want["b"], equal_nan=True)
    assert {k for k, v in files().items() if v != whole[k]} == {"part=model-b"}
