"""Forms without size bounds, and factored or batched forms against their plain statements."""

from __future__ import annotations

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import assignment as A
from flowloom.operators import linear as L
from flowloom.operators import network as N
from flowloom.operators import regression as B
from flowloom.operators import scenarios as SC
from flowloom.operators import spatial as SP
from flowloom.operators.quality import select_diverse
from flowloom.operators.sampling import sample_within
from flowloom.plans import inputs
from flowloom.session import materialise


def wide_zones(spark, n):
    rows = [(i + 1, 90.0 * (i % 13), 70.0 * (i // 13)) for i in range(n)]
    return spark.createDataFrame(rows, "zone int, x double, y double")


def test_base_generator_beyond_the_vector_form(spark):
    n = 150
    zones = wide_zones(spark, n)
    base = spark.createDataFrame([(i + 1, (i * 7 + k) % n + 1, 5.0 + i % 11) for i in range(n) for k in (1, 3, 8)], "o int, d int, flow double")
    base = base.filter("o != d")
    p = materialise(SP.base_probability(base, SP.distances(zones, n)), "p")
    with pytest.raises(ValueError):
        SC.generate_from_base(base, p, n, 1)
    made = materialise(SC.generate_from_base_cells(base, p, 2, max_iter=200), "made")
    total = base.agg(F.sum("flow")).first()[0]
    for r in made.groupBy("sample_id").agg(F.sum("flow").alias("t"), F.count("*").alias("n"), F.bool_and("converged").alias("c")).collect():
        assert r["n"] == n * (n - 1) and r["c"] and abs(r["t"] - total) < 1e-2 * total
    assert made.filter("o = d").count() == 0 and made.filter("flow < 0").count() == 0


def test_first_principles_beyond_the_vector_form(spark):
    n = 135
    made = materialise(SC.generate_first_principles_cells(wide_zones(spark, n), n, 2, 1000.0, max_iter=5), "made")
    assert {r["n"] for r in made.groupBy("sample_id").agg(F.count("*").alias("n")).collect()} == {n * (n - 1)}
    sums = {r["sample_id"]: r["t"] for r in made.groupBy("sample_id").agg(F.sum("flow").alias("t")).collect()}
    assert all(abs(t - 1000.0) < 20.0 for t in sums.values())


@pytest.mark.parametrize("penalty,ratio", [(0.3, 0.5), (2.0, 1.0)])
def test_elastic_net_is_optimal_for_every_target(spark, penalty, ratio):
    rng = np.random.default_rng(2)
    x = rng.normal(3.0, 2.0, (50, 6)) * np.arange(1, 7)
    y = x @ rng.normal(size=(6, 9)) + rng.normal(size=(50, 9)) + 7.0
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "sample_id int, x array<double>, y array<double>")
    model = B.from_rows(B.sparse_fit(spark, B.gather(rows, 6, 9)[0], penalty, ratio, tol=1e-9))
    r = y - x @ model.coef - model.intercept
    assert np.allclose(r.mean(axis=0), 0, atol=1e-6)
    slope = (x - x.mean(axis=0)).T @ r / len(x) - penalty * (1 - ratio) * model.coef
    assert (np.abs(slope) <= penalty * ratio + 1e-5).all()
    live = model.coef != 0
    assert np.allclose(slope[live], penalty * ratio * np.sign(model.coef[live]), atol=1e-5)
    assert live.any() and not live.all() or penalty < 1


@pytest.mark.parametrize("window", [1, 3, None])
def test_diversity_window(spark, window):
    rng = np.random.default_rng(4)
    tables = rng.uniform(0, 1, (40, 9))
    tables[10:22] = tables[3]
    tau, taken, blocked = 1.0, [], {}
    for r in range(40):
        close = [w for w in (taken if window is None else taken[-window:]) if np.linalg.norm(tables[w] - tables[r]) < tau]
        if close:
            blocked[r + 1] = min(close) + 1
        else:
            taken.append(r)
    ranked = spark.createDataFrame([(r, r + 1, t.tolist()) for r, t in enumerate(tables)], "sample_id int, rank int, y array<double>")
    got = select_diverse(ranked, 3, 100, tau, 7, window).collect()
    assert sorted(g["rank"] for g in got if g["accepted"]) == [w + 1 for w in taken]
    assert {g["rank"]: g["blocked_by"] for g in got if not g["accepted"]} == blocked


def test_diversity_beyond_the_vector_form(spark):
    """130 zones, tables in tiles of a few rows; no vector leaves the tasks."""
    rng = np.random.default_rng(2)
    tables = rng.uniform(0, 1, (12, 130 * 130))
    tables[7] = tables[2]
    rows = [(r, r + 1, t.tolist()) for r, t in enumerate(tables)]
    ranked = spark.createDataFrame(rows, "sample_id int, rank int, y array<double>")
    for window in (None, 256):
        got = {g["rank"]: g["blocked_by"] for g in select_diverse(ranked, 130, 20, 5.0, 5, window).collect()}
        assert got == {r: 3 if r == 8 else None for r in range(1, 13)}


def test_block_product_equals_the_join(spark, sf, od):
    """Compressed blocks against the join: scattered samples, unknown and missing cells, zero flows, no rows."""
    a = inputs.assignment(spark, sf)
    odd = [(7, 1, 1, 5.0), (8, None, 2, 1.0), (None, 1, 2, 3.0), (9, 1, 2, 0.0), (9, 40, 40, 1.0), (10, 1, 3, None)]
    more = od.unionByName(spark.createDataFrame(odd, od.schema))
    for cells in (od, od.repartition(7, "o", "d"), od.limit(0), more.repartition(3)):
        rows = cells.filter("sample_id IS NOT NULL AND flow IS NOT NULL")
        want = A.apply_operator(rows.withColumn("od_index", (F.col("o") - 1) * 25 + F.col("d") - 1), a, "od_index", "turn_id")
        want = {(r["sample_id"], r["turn_id"]): r["x"] for r in want.collect()}
        got = {(r["sample_id"], r["turn_id"]): r["x"] for r in A.turning_counts(cells, a, 25).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 1e-9 * (1 + abs(want[k])) for k in want)


def test_factored_estimators_equal_their_operators(spark, sf, od):
    a = inputs.assignment(spark, sf)
    x = materialise(A.turning_counts(od, a, 25), "x")
    for fast, slow in (
        (L.tikhonov_estimate(x, a, 188, 0.5), L.estimate(x, L.tikhonov_operator(a, 188, 0.5))),
        (L.minimum_norm_estimate(x, a, 188), L.estimate(x, L.pseudo_inverse(a, 188))),
    ):
        gap = fast.withColumnRenamed("y", "a").join(slow, ["sample_id", "od_index"])
        worst = gap.agg(F.max(F.abs(F.col("a") - F.col("y"))), F.max(F.abs("y")), F.count("*")).first()
        assert worst[0] < 1e-4 * worst[1] and worst[2] > 0


def test_conjugate_gradients_equal_the_factored_form(spark, sf, od):
    a = inputs.assignment(spark, sf)
    x = materialise(A.turning_counts(od, a, 25), "x").filter("sample_id < 9")
    gap = L.conjugate_estimate(x, a, 0.5).withColumnRenamed("y", "a").join(L.tikhonov_estimate(x, a, 188, 0.5), ["sample_id", "od_index"], "full")
    worst = gap.agg(F.max(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))), F.max(F.abs("y")), F.count("*")).first()
    assert worst[0] < 1e-6 * worst[1] and worst[2] > 0
    none = L.conjugate_estimate(x, a.limit(0), 0.5)
    assert none.collect() == [] and L.conjugate_estimate(x.limit(0), a, 0.5).collect() == []


def test_tikhonov_beyond_square_kernels(spark):
    """10 000 turns: the normal equations hold, and a refinement by the counts is no longer refused."""
    rng = np.random.default_rng(8)
    entries = {(int(t), int(c)): float(rng.uniform(0.1, 1)) for c in range(12_000) for t in rng.integers(0, 10_000, 3)}
    a = spark.createDataFrame([(t, c, w) for (t, c), w in entries.items()], "turn_id int, od_index int, weight double")
    x = spark.createDataFrame([(s, t, float(rng.uniform(0, 9))) for s in (1, 2) for t in range(0, 10_010, 3)], "sample_id int, turn_id int, x double")
    y = materialise(L.tikhonov_estimate(x, a, 10_000, 0.7), "y")
    known = x.filter("turn_id < 10000")
    assert L.normal_equation_residual(y, known, a, 0.7).agg(F.max("residual")).first()[0] < 1e-6
    assert L.physics_refine(y, known, a, 10_000, 0.3).count() >= y.count()


def test_long_path_by_doubling(spark):
    """A chain longer than several doublings of one job, and its ties by node name."""
    links = [(f"J{i}", f"J{i + 1}", f"e{i}", 1.0) for i in range(1, 40)] + [("J1", "JA", "x", 0.5), ("JA", "J3", "y", 1.5)]
    df = spark.createDataFrame(links, "node string, next string, edge_id string, w double")
    got = N.cheapest_paths(df, spark.createDataFrame([(40, "J40")], "root int, node string")).filter("node = 'J1'").first()
    assert got["cost"] == 39.0 and got["nodes"] == [f"J{i}" for i in range(1, 41)] and got["edges"] == [f"e{i}" for i in range(1, 40)]
    with pytest.raises(ValueError, match="positive"):
        N.cheapest_paths(df.withColumn("w", F.lit(0.0)), spark.createDataFrame([(40, "J40")], "root int, node string"))


def test_sample_within_groups(spark):
    ids = spark.range(300).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("split"))
    got = sample_within(ids, 40, "split", "sample_id", 3).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"a": 40, "b": 30}


def plain_routes(links, o, d, k):
    """k cheapest simple paths by a heap over partial paths."""
    out, heap = [], [(0.0, [o])]
    while heap and len(out) < k:
        cost, path = heapq.heappop(heap)
        if path[-1] == d:
            out.append((cost, path))
            continue
        for to, w in links.get(path[-1], []):
            if to not in path:
                heapq.heappush(heap, (cost + w, [*path, to]))
    return out


def test_routes_against_a_heap(spark):
    rng = np.random.default_rng(7)
    rows, links = [], {}
    for i in range(16):
        for j in (i + 1, i + 4):
            if j < 16 and not (j == i + 1 and j % 4 == 0):
                for a, b in ((i, j), (j, i)):
                    w = float(rng.integers(100, 140))
                    rows.append((f"E{a}_{b}", f"J{a}", f"J{b}", w, 10.0, w / 10.0))
                    links.setdefault(f"J{a}", []).append((f"J{b}", w))
    edges = spark.createDataFrame(rows, "edge_id string, from_j string, to_j string, length double, speed double, time double")
    pairs = [(0, 15), (3, 12), (5, 6), (0, 3), (10, 9)]
    got = N.k_shortest_paths(edges, spark.createDataFrame(pairs, "o int, d int"), 5).collect()
    for o, d in pairs:
        mine = sorted((r["rank"], r["cost"]) for r in got if (r["o"], r["d"]) == (o, d))
        want = plain_routes(links, f"J{o}", f"J{d}", 5)
        assert np.allclose([c for _, c in mine], [c for c, _ in want])


def test_routes_on_a_larger_grid(spark):
    n = 20
    edges = spark.range(n * n).select(F.col("id").alias("a"), F.explode(F.array(F.lit(1), F.lit(-1), F.lit(n), F.lit(-n))).alias("s"))
    edges = edges.withColumn("b", F.col("a") + F.col("s")).filter((F.col("b") >= 0) & (F.col("b") < n * n))
    edges = edges.filter((F.abs("s") == n) | (F.floor(F.col("a") / n) == F.floor(F.col("b") / n)))
    length = (100 + F.pmod(F.xxhash64("a", "b"), F.lit(37))).cast("double")
    edges = edges.select(
        F.concat(F.lit("E"), "a", F.lit("_"), "b").alias("edge_id"), F.concat(F.lit("J"), "a").alias("from_j"),
        F.concat(F.lit("J"), "b").alias("to_j"), length.alias("length"), F.lit(10.0).alias("speed"), (length / 10).alias("time"),
    )
    got = N.k_shortest_paths(edges, spark.createDataFrame([(0, 399), (19, 380), (210, 30)], "o int, d int"), 4)
    assert got.groupBy("o", "d").count().filter("count = 4").count() == 3
