from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import raking as RK
from flowloom.operators import scenarios as SC
from flowloom.operators import spatial as SP
from flowloom.operators.constraints import apply_strategy
from flowloom.operators.metrics import attractions, productions
from flowloom.operators.quality import select_diverse
from flowloom.operators.reshape import flatten, unflatten
from flowloom.sources import fixtures as fx


def plain_ipf(m, tr, tc, tol, max_iter):
    """Textbook statement of the procedure, for one small table."""
    m = m.copy()
    err = np.inf
    for it in range(1, max_iter + 1):
        for axis, target in ((1, tr), (0, tc)):
            s = m.sum(axis=axis)
            f = np.array([t / v if v > 0 else 1.0 for t, v in zip(target, s)])
            m = m * (f[:, None] if axis == 1 else f[None, :])
        err = max(abs(m.sum(axis=1) - tr).max(), abs(m.sum(axis=0) - tc).max())
        if err < tol:
            break
    return m, it, err


@pytest.fixture(scope="module")
def problem(spark):
    rng = np.random.default_rng(5)
    n, rows, rt, ct, tables = 6, [], [], [], []
    for s in range(5):
        m = rng.gamma(0.7, 2.0, (n, n))
        np.fill_diagonal(m, 0.0)
        if s == 3:
            m[2, :] = 0.0  # a row without mass keeps factor one and never converges
        if s == 4:
            m = np.zeros((n, n))
            m[0, 1] = 3.0
        other = rng.gamma(0.7, 2.0, (n, n))
        np.fill_diagonal(other, 0.0)
        tr, tc = other.sum(axis=1), other.sum(axis=0)
        tables.append((m, tr, tc))
        rows += [(s, i + 1, j + 1, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j] > 0]
        rt += [(s, i + 1, float(tr[i])) for i in range(n)]
        ct += [(s, j + 1, float(tc[j])) for j in range(n)]
    cells = spark.createDataFrame(rows, "sample_id int, o int, d int, flow double")
    return (
        n,
        cells,
        spark.createDataFrame(rt, "sample_id int, o int, target double"),
        spark.createDataFrame(ct, "sample_id int, d int, target double"),
        tables,
    )


@pytest.mark.parametrize("colocate,chunk", [(True, 4), (False, 10), (True, 60)])
def test_window_form_equals_plain_ipf(spark, problem, colocate, chunk):
    n, cells, rt, ct, tables = problem
    out = RK.rake(cells, rt, ct, tol=1e-3, max_iter=60, chunk=chunk, colocate=colocate)
    got = {}
    for r in out.collect():
        entry = got.setdefault(r["sample_id"], (np.zeros((n, n)), r["iterations"], r["final_error"], r["converged"]))
        entry[0][r["o"] - 1, r["d"] - 1] = r["flow"]
    for s, (m, tr, tc) in enumerate(tables):
        want, it, err = plain_ipf(m, tr, tc, 1e-3, 60)
        flow, iterations, error, converged = got[s]
        assert np.allclose(flow, want, atol=1e-9)
        assert iterations == it and np.isclose(error, err, atol=1e-9) and converged == (err < 1e-3)
    assert got[0][3] and not got[3][3]


def test_factor_form_keeps_every_error_beside_the_cells(spark, problem):
    n, cells, rt, ct, tables = problem
    flows, errors = RK.rake_factors(cells, rt, ct, tol=1e-3, max_iter=6)
    assert flows.count() == cells.count()
    got = {}
    for r in errors.orderBy("iteration").collect():
        got.setdefault(r["sample_id"], []).append(r["error"])
    for s, (m, tr, tc) in enumerate(tables):
        want = [plain_ipf(m, tr, tc, 1e-3, k)[2] for k in range(1, len(got[s]) + 1)]
        assert np.allclose(got[s], want, atol=1e-9) and (len(want) == 6 or want[-1] < 1e-3)
    kept = RK.rake(cells, rt, ct, tol=1e-3, max_iter=6, colocate=False, keep_history=True)
    for r in RK.raking_history(kept).collect():
        assert np.isclose(r["error"], got[r["sample_id"]][r["iteration"] - 1])
    none = RK.rake_factors(cells.limit(0), rt, ct, max_iter=3)
    assert none[0].count() == 0 and none[1].count() == 0


def test_vector_form_equals_plain_ipf(spark, problem):
    n, cells, rt, ct, tables = problem
    array = lambda df, k: df.groupBy("sample_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(k, "target"))), lambda s: s["target"]).alias("t")
    )
    ready = flatten(cells, n).join(array(rt, "o").withColumnRenamed("t", "row_target"), "sample_id")
    ready = ready.join(array(ct, "d").withColumnRenamed("t", "col_target"), "sample_id")
    for r in RK.rake_vectors(ready, n, 1e-3, 60).collect():
        want, it, err = plain_ipf(*tables[r["sample_id"]], 1e-3, 60)
        assert np.allclose(np.array(r["y"]).reshape(n, n), want, atol=1e-9)
        assert r["iterations"] == it and np.isclose(r["final_error"], err, atol=1e-9)


def test_generated_tables_meet_their_invariants(spark, sf, base, dist):
    total = base.agg(F.sum("flow")).first()[0]
    p = SP.base_probability(base, dist)
    assert abs(p.agg(F.sum("p")).first()[0] - 1) < 1e-9
    made = SC.generate_from_base(base, p, 25, 40)
    cells = unflatten(made, 25)
    sums = cells.groupBy("sample_id").agg(F.sum("flow").alias("t"), F.min("flow").alias("low"))
    assert sums.filter((F.abs(F.col("t") - total) > 1e-2) | (F.col("low") < 0)).count() == 0
    assert cells.filter("o = d and flow <> 0").count() == 0
    assert made.filter("not converged").count() == 0
    again = SC.generate_from_base(base, p, 25, 10)
    head = made.filter("sample_id < 10").select("sample_id", F.expr("round(y[30], 6)").alias("v"))
    assert sorted(map(tuple, head.collect())) == sorted(map(tuple, again.select("sample_id", F.expr("round(y[30], 6)")).collect()))


def test_higher_alpha_stays_closer_to_the_base(spark, base, dist):
    p = SP.base_probability(base, dist)
    flows = flatten(base.withColumn("sample_id", F.lit(0)), 25).first()["y"]
    corr = {}
    for alpha in (50.0, 50_000.0):
        rows = SC.generate_from_base(base, p, 25, 20, alpha=alpha, apply_gamma=False).select("y").collect()
        corr[alpha] = np.mean([np.corrcoef(r["y"], flows)[0, 1] for r in rows])
    assert corr[50_000.0] > corr[50.0]


def test_first_principles_tables(spark, sf):
    made = SC.generate_first_principles(fx.zones(spark, sf), 25, 30, total=10_000.0)
    rows = made.collect()
    assert len(rows) == 30 and all(r["converged"] for r in rows)
    for r in rows:
        y = np.array(r["y"]).reshape(25, 25)
        assert abs(y.sum() - 10_000) < 0.1 and (y >= 0).all() and (np.diag(y) == 0).all()
    tail = np.mean([np.sort(r["y"])[-31:].sum() / 10_000 for r in rows])
    assert tail > 0.25


def test_parallel_equals_sequential(spark, base, dist):
    """The same draws come out under another number of partitions."""
    p = SP.base_probability(base, dist)
    one = SC.generate_from_base(base, p, 25, 12).select("sample_id", F.expr("round(y[100], 6)").alias("v")).collect()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        two = SC.generate_from_base(base, p, 25, 12).select("sample_id", F.expr("round(y[100], 6)").alias("v")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_reciprocity_one_half_is_symmetric(spark, od):
    mixed = SP.reciprocity(od, 0.5)
    back = mixed.select("sample_id", F.col("d").alias("o"), F.col("o").alias("d"), F.col("flow").alias("b"))
    assert mixed.join(back, ["sample_id", "o", "d"], "full").filter("abs(coalesce(flow, -1) - coalesce(b, -2)) > 1e-9").count() == 0


def test_parameters_are_checked(spark, base, dist):
    with pytest.raises(ValueError):
        SP.distance_epsilon(dist, beta=-1.0)
    with pytest.raises(ValueError):
        SP.impedance(dist, "other")
    with pytest.raises(ValueError):
        SC.generate_from_base(base, None, 25, 1, alpha=0.0)
    with pytest.raises(ValueError):
        apply_strategy(base.withColumn("sample_id", F.lit(0)), "other")


@pytest.mark.parametrize("block", [3, 7, 64])
@pytest.mark.parametrize("target", [4, 100])
def test_diverse_subset_equals_greedy_walk(spark, block, target):
    rng = np.random.default_rng(1)
    n = 3
    tables = rng.uniform(0, 1, (40, n * n))
    tables[10:22] = tables[3]  # a third are copies of one table
    tau = 0.9
    rows = [(100 + r, r + 1, [float(v) for v in t]) for r, t in enumerate(tables)]
    ranked = spark.createDataFrame(rows, "sample_id int, rank int, y array<double>")
    want, blocked = [], {}
    for r in range(40):
        if len(want) == target:
            break
        close = [w for w in want if np.linalg.norm(tables[w] - tables[r]) < tau]
        if close:
            blocked[r + 1] = min(close) + 1
        else:
            want.append(r)
    got = select_diverse(ranked, n, target, tau, block).collect()
    assert sorted(g["rank"] for g in got if g["accepted"]) == [w + 1 for w in want]
    assert {g["rank"]: g["blocked_by"] for g in got if not g["accepted"]} == blocked


def test_productions_and_attractions_share_the_total(od):
    p = productions(od).agg(F.sum("production")).first()[0]
    a = attractions(od).agg(F.sum("attraction")).first()[0]
    assert p == a == od.agg(F.sum("flow")).first()[0]
