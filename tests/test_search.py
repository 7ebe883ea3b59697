"""The one-scan search against plain solves, one candidate at a time, scored by the full suite."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import assignment as A
from flowloom.operators import regression as B
from flowloom.operators import scoring as V
from flowloom.operators import search as Q

ZONES, TURNS = 3, 5
CELLS = ZONES * ZONES


@pytest.fixture(scope="module")
def problem(spark):
    rng = np.random.default_rng(11)
    a = rng.random((TURNS, CELLS)) * (rng.random((TURNS, CELLS)) < 0.5)
    a[4] = a[0]  # so that A A^T is singular
    y = rng.gamma(2.0, 3.0, (60, CELLS))
    x = y @ a.T + rng.normal(0, 0.1, (60, TURNS))
    rows = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(60)], "sample_id int, x array<double>, y array<double>").repartition(4)
    entries = [(int(t), int(c), float(a[t, c])) for t, c in zip(*np.nonzero(a), strict=True)]
    return a, x, y, rows, spark.createDataFrame(entries, "turn_id int, od_index int, weight double")


def suite(spark, a_table, x, y, made: dict[str, np.ndarray]) -> dict:
    """Composite of each model's written predictions by ``all_scores``."""
    ids = [int(i) for i in range(40, 60)]
    cells = [(m, "val", i, c // ZONES + 1, c % ZONES + 1, float(p[j, c])) for m, p in made.items() for j, i in enumerate(ids) for c in range(CELLS)]
    truth = [("val", i, c // ZONES + 1, c % ZONES + 1, float(y[i, c])) for i in ids for c in range(CELLS)]
    counts = [("val", i, t, float(x[i, t])) for i in ids for t in range(TURNS)]
    scores = V.all_scores(
        spark.createDataFrame(cells, "model string, split string, sample_id int, o int, d int, y double"),
        spark.createDataFrame(truth, "split string, sample_id int, o int, d int, flow double"),
        spark.createDataFrame(counts, "split string, sample_id int, turn_id int, x double"),
        a_table,
        spark.createDataFrame([("val", i) for i in ids], "split string, sample_id int"),
        ZONES,
        TURNS,
    )
    names = ("mae", "forward_mae", "production_mae", "attraction_mae")
    rows = scores.select("model", *names, V.composite().alias("score")).collect()
    return {r["model"]: [r[c] for c in (*names, "score")] for r in rows}


def test_search_against_single_fits(spark, problem):
    a, x, y, rows, table = problem
    train, val = rows.filter("sample_id < 40"), rows.filter("sample_id >= 40")
    sums = B.gather(train, TURNS, CELLS)[0]
    matrix = A.operator_matrix(table, "turn_id", "od_index", TURNS, CELLS)
    assert np.allclose(matrix, a)
    lambdas, alphas, parts, mus = [1e-3, 1.0, 100.0], [0.1, 50.0], [2, 4], [0.0, 0.5, 20.0]
    singles = [Q.tikhonov_family(table, matrix, lambdas), Q.ridge_family(sums, alphas), Q.pls_family(sums, parts)]
    got = Q.search_scores(val, singles, matrix, ZONES, (Q.ridge_family(sums, alphas), Q.refine_family(table, matrix, mus)))
    xv, eye = x[40:], np.eye(CELLS)
    apply = lambda m: xv @ m.coef + m.intercept
    made = {f"tikhonov {v} None": np.linalg.solve(a.T @ a + v * eye, a.T @ xv.T).T for v in lambdas}
    made |= {f"ridge {v} None": apply(B.ridge(sums, v)) for v in alphas}
    made |= {f"pls {float(k)} None": apply(B.pls(sums, k, True)) for k in parts}
    for v in alphas:
        y0 = apply(B.ridge(sums, v))
        made |= {f"physics_ridge {v} {mu}": np.linalg.solve(eye + mu * a.T @ a, (y0 + mu * xv @ a).T).T for mu in mus}
    want = suite(spark, table, x, y, made)
    found = {f"{r['model']} {r['value']} {r['value2']}": r for r in got.collect()}
    assert set(found) == set(want)
    for key, scores in want.items():
        names = ("mae", "forward_mae", "production_mae", "attraction_mae", "score")
        assert np.allclose([found[key][c] for c in names], scores, rtol=1e-7), key
    best = {r["model"]: r for r in Q.best_candidates(got).collect()}
    for model in ("tikhonov", "ridge", "pls", "physics_ridge"):
        assert np.isclose(best[model]["score"], min(v[-1] for k, v in want.items() if k.split()[0] == model))


def test_search_edges(spark, problem):
    *_, rows, table = problem
    matrix = A.operator_matrix(table, "turn_id", "od_index", TURNS, CELLS)
    families = [Q.tikhonov_family(table, matrix, [1.0])]
    assert Q.search_scores(rows.limit(0), families, matrix, ZONES).count() == 0
    tied = Q.search_scores(rows, [Q.tikhonov_family(table, matrix, [1.0, 1.0 + 1e-15])], matrix, ZONES)
    assert Q.best_candidates(tied.withColumn("score", F.lit(1.0))).first()["value"] == 1.0
    with pytest.raises(ValueError, match="positive"):
        Q.tikhonov_family(table, matrix, [0.0])
    with pytest.raises(ValueError, match="too large"):
        Q.tikhonov_family(table, np.zeros((5000, 1)), [1.0])
