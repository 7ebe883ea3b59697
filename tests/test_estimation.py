from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import regression as B
from flowloom.operators import splits as I
from flowloom.operators.stats import correlation_matrix


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(3.0, 2.0, (50, 6)) * np.array([1, 2, 3, 4, 5, 6])
    y = x @ rng.normal(size=(6, 4)) + rng.normal(size=(50, 4)) + 7.0
    rows = [(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "sample_id int, x array<double>, y array<double>").repartition(5)


def plain_ridge(x, y, alpha, scale):
    mu, sd = x.mean(axis=0), x.std(axis=0) if scale else np.ones(x.shape[1])
    z = (x - mu) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean(axis=0)))
    return lambda q: (q - mu) / sd @ w + y.mean(axis=0)


@pytest.mark.parametrize("alpha,scale", [(0.0, True), (10.0, True), (3.0, False)])
def test_ridge(spark, data, alpha, scale):
    x, y, rows = data
    model = B.ridge(B.gather(rows, 6, 4)[0], alpha, scale)
    want = plain_ridge(x, y, alpha, scale)(x)
    for r in B.predict(rows, model).collect():
        assert np.allclose(r["y"], want[r["sample_id"]], atol=1e-7)


def test_cv_matches_refitting_each_fold(spark, data):
    x, y, rows = data
    folds = np.repeat([0, 1, 2], [17, 17, 16])
    assert [r[0] for r in spark.range(50).select(B.fold_of("id", 50, 3)).collect()] == folds.tolist()
    got = {(r["alpha"], r["fold"]): r["mae"] for r in B.ridge_cv(rows.withColumn("fold", B.fold_of("sample_id", 50, 3)), 6, 4, [0.1, 100.0]).collect()}
    for a in (0.1, 100.0):
        for f in range(3):
            fit = plain_ridge(x[folds != f], y[folds != f], a, False)
            assert np.isclose(got[(a, f)], np.abs(fit(x[folds == f]) - y[folds == f]).mean())


def plain_pls(x, y, k):
    """Two-block PLS with deflation of the data itself."""
    xm, ym = x.mean(axis=0), y.mean(axis=0)
    e, f, ws, ps, qs = x - xm, y - ym, [], [], []
    for _ in range(k):
        w = np.linalg.svd(e.T @ f)[0][:, 0]
        t = e @ w
        p, q = e.T @ t / (t @ t), f.T @ t / (t @ t)
        e, f = e - np.outer(t, p), f - np.outer(t, q)
        ws.append(w), ps.append(p), qs.append(q)
    w, p, q = np.array(ws).T, np.array(ps).T, np.array(qs).T
    b = w @ np.linalg.inv(p.T @ w) @ q.T
    return (x - xm) @ b + ym


@pytest.mark.parametrize("k", [1, 3, 6])
def test_pls(spark, data, k):
    x, y, rows = data
    want = plain_pls(x, y, min(k, 4))  # never more components than targets
    for r in B.predict(rows, B.pls(B.gather(rows, 6, 4)[0], k)).collect():
        assert np.allclose(r["y"], want[r["sample_id"]], atol=1e-6)


def test_split_is_disjoint_complete_and_stable(spark):
    ids = spark.range(1000).withColumnRenamed("id", "sample_id")
    one = I.split_ids(ids)
    assert dict(one.groupBy("split").count().collect()) == {"train": 700, "val": 150, "test": 150}
    assert I.overlaps(one).count() == 0
    two = I.split_ids(ids.repartition(11))
    assert one.exceptAll(two).count() == 0
    report = I.leakage_report(one, 100_000).first()
    assert report["survey_excluded"] and report["splits_disjoint"]
    with pytest.raises(Exception, match="survey sample"):
        I.leakage_report(one, 5).collect()
    with pytest.raises(ValueError):
        I.split_ids(ids, 0.5, 0.1, 0.1)


def test_correlation_matrix(spark):
    rng = np.random.default_rng(4)
    v = rng.poisson(1.0, (60, 5)).astype(float)
    v[:, 4] = 2.0
    rows = [(i, j, float(v[i, j])) for i in range(60) for j in range(5) if v[i, j] != 0]
    long = spark.createDataFrame(rows, "sample_id int, f int, v double")
    got = {(r["f1"], r["f2"]): r["r"] for r in correlation_matrix(long, "f", "v", 60, long.select("f").distinct()).collect()}
    want = np.corrcoef(v[:, :4], rowvar=False)
    for i in range(4):
        for j in range(i + 1, 4):
            assert np.isclose(got[(i, j)], want[i, j])
        assert got[(i, 4)] is None


def test_running_stats_stream_equals_batch(spark, tmp_path):
    from flowloom.streaming.counts import COUNT_STREAM, run_running_stats, running_stats

    rows = [(i, [float(i), float(i * i % 7), 0.0]) for i in range(30)]
    df = spark.createDataFrame(rows, COUNT_STREAM)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    streamed = run_running_stats(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    rounded = lambda d: sorted((r["turn_id"], r["count"], round(r["mean"], 9), round(r["std"], 9)) for r in d.collect())
    assert rounded(streamed) == rounded(running_stats(df))


def test_small_side_is_checked(spark):
    from flowloom.session import is_small

    assert is_small(spark.range(10), 10) and not is_small(spark.range(11), 10)
    assert spark.range(1).select(F.lit(1)).count() == 1
