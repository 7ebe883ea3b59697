from __future__ import annotations

import hashlib
import random
from collections import Counter

import xxhash
from fixtures import RAW, documents
from pyspark.sql import functions as F

from flowloom.llm import simhash
from flowloom.llm.components import components
from flowloom.llm.exact_dedup import exact_dedup, frequent
from flowloom.llm.queries import QUERIES


def test_exact_dedup_messy(messy):
    got = exact_dedup(messy).collect()
    assert len(got) == len(RAW)
    sizes = Counter(t or "" for _, t, *_ in RAW)
    for r in got:
        texts = [t or "" for i, t, *_ in RAW if i == r["doc_id"]]
        t = texts[0]
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert r["group_size"] == sizes[t]
        assert r["keep_id"] == max((i for i, x, *_ in RAW if (x or "") == t and i is not None), default=None)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(sizes)  # ties too leave exactly one


def test_exact_dedup_heavy_and_rare(spark):
    """More distinct heavy texts than the summary returns: the rest takes the ordinary way with the same result."""
    docs = [(i, f"t{i % 40}" if i % 3 else f"u{i}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert frequent(df.select(F.unhex(F.sha2("text", 256)).alias("_digest")), 8, 64).count() <= 8
    got = exact_dedup(df, heavy=8, tracked=64).collect()
    size, last = Counter(t for _, t in docs), {t: i for i, t in docs}
    text = dict(docs)
    assert len(got) == 3000
    for r in got:
        t = text[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (last[t], size[t], last[t] == r["doc_id"])


def test_exact_dedup_empty(empty):
    assert exact_dedup(empty).collect() == []


def slow_fingerprint(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps: list[int], ids: list[int], distance: int) -> list[int]:
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(fps))]


def test_op6_against_brute_force(spark, sf):
    docs = documents(sf)
    got = {r["doc_id"]: r for r in QUERIES["op6_simhash_near_dedup"](spark, sf).collect()}
    fps = [slow_fingerprint(t) for _, t, *_ in docs]
    assert [got[d]["fingerprint"] for d, *_ in docs] == [f"{f:016x}" for f in fps]
    assert [got[d]["component_id"] for d, *_ in docs] == slow_components(fps, [d for d, *_ in docs], 2)


def test_fingerprint_edges():
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n ") == 0
    for t in ("one", "one two", "One two THREE four", "a b a b a b a b", "Ä ä x"):
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


def crowd(seed: int = 1) -> list[int]:
    """Chains and stars of close fingerprints, and strangers."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(60)]
    for start in out[:3]:
        at = start
        for _ in range(60):  # a chain: ends are far apart, neighbours close
            at ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            out.append(at)
    out += [out[5] ^ 1 << i for i in range(64)]  # a star of one-bit neighbours
    out += [out[6] ^ 7 << i for i in range(0, 60, 3)]  # three bits away: no link to the centre
    return list(dict.fromkeys(out))


def test_links_small_and_crowded_buckets(spark):
    fps = crowd()
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    for distance in (0, 1, 2):
        want = slow_components(fps, list(range(len(fps))), distance)
        for bucket in (1, 6, 10_000):
            got = {r["fp"]: r["component_id"] for r in simhash.classes(df, distance, bucket=bucket).collect()}
            assert [got[f] for f in signed] == want, (distance, bucket)
    assert {simhash.classes(df, 2, pieces=5).count()} == {len(fps)}


def test_near_duplicates_messy(messy, empty):
    got = simhash.near_duplicates(messy)
    assert got.count() == len(RAW)
    by = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == by[6] == 4 and by[None] is None
    assert simhash.near_duplicates(empty).collect() == []


def test_keep_one(messy, empty):
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    ids = sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()))
    assert ids == [(False, 1), (False, 4), (False, 7), (False, 8), (False, 9), (False, 10), (True, 0)]
    assert simhash.keep_one(empty).collect() == []


def test_components_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1001), (5, 5)] + [(2000, 2000 + i) for i in range(1, 90)]
    random.Random(3).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000, **{2000 + i: 2000 for i in range(90)}}
