"""Bit-plane clustering against plain integer arithmetic."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from flowloom.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, q string, norm string, planes string"


def slow(rows, k=8, rounds=10, components=64):
    """Lloyd's rounds over Python integers: list of (vec_id, cluster, distance), and the final centroids."""
    kept = []
    for i, e in rows:
        if e is not None and len(e) == components and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in e]))
    name = lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [q for _, q in sorted(kept, key=name)[:k]]

    def place(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = [[] for _ in cents]
        for _, q in kept:
            groups[place(q)[1]].append(q)
        cents = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else c for g, c in zip(groups, cents, strict=True)]
    return [(i, *reversed(place(q))) for i, q in kept], cents


def check(got, want, cents):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["inertia"] == sum(d for _, _, d in want)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest()


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for width in (1, 63, 64, 65, 200):
        for top in (0, 1, 1000, 1 << 26):
            a, b = (rng.integers(-top, top + 1, (n, width)) for n in (37, 5))
            bits = lambda x: ce.bits_needed(int(x.min()), int(x.max()))
            planes = ce.pack(a, bits(a))
            assert (ce.products(planes, ce.pack(b, bits(b))) == a @ b.T).all()
            at = rng.integers(0, 5, 37)
            assert (ce.bit_sums(planes, at, 5, width) == [a[at == c].sum(axis=0) for c in range(5)]).all()


def test_bits_needed():
    assert [ce.bits_needed(a, b) for a, b in ((0, 0), (-1, 0), (0, 1), (-2, 1), (-4, 3), (-5, 0))] == [1, 1, 2, 2, 3, 4]


def test_given_table(spark, sf):
    from flowloom.llm.queries import QUERIES

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(QUERIES["op13_centroids"](spark, sf).collect(), *slow(rows))


def planted(seed=3):
    """Clumps, copies, a clump holding half of all rows, rows that can't be used, ids twice and missing."""
    rng = random.Random(seed)
    middles = [[rng.uniform(-2, 2) for _ in range(64)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, 0.1) for m in middles[0 if i % 2 else rng.randrange(6)]]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 340)] + [rows[5]] * 3 + [(None, middles[1]), (None, middles[2]), (None, None)]
    rows += [(400, []), (401, middles[3][:63]), (402, [*middles[3], 0.0]), (403, [None, *middles[3][1:]])]
    rows += [(404, [float("nan"), *middles[3][1:]]), (405, [float("inf"), *middles[3][1:]]), (406, [0.0] * 64), (407, [-1e-9] * 64)]
    return rows


def test_planted(spark):
    rows = planted()
    df = spark.createDataFrame([(i, e, 1, "x", "x", "x", "x") for i, e in rows], SCHEMA).repartition(5)
    check(ce.cluster(df).collect(), *slow(rows))
    few = spark.createDataFrame([(i, e, 1, "x", "x", "x", "x") for i, e in rows[:3]], SCHEMA)
    check(ce.cluster(few).collect(), *slow(rows[:3]))


def test_ties_and_empty_clusters(spark):
    """Equal starting vectors leave the later centroids empty; they stay where they are."""
    rows = [(i, [0.5] * 64) for i in range(20)] + [(100, [0.25] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(ce.cluster(df).collect(), *slow(rows))


def test_nothing_and_too_large(spark):
    assert ce.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(1, [1.0] * 3)], "vec_id long, embedding array<float>")
    assert ce.cluster(only).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert ce.cluster(only).collect() == []
    with pytest.raises(ValueError, match="fit a long"):
        ce.cluster(spark.createDataFrame([(1, [1e6] * 64)], "vec_id long, embedding array<float>"))
