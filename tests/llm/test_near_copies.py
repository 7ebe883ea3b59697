"""Near copies against brute-force Jaccard similarity of five-word shingles."""

from __future__ import annotations

import random
import sys
from collections import defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from fixtures import RAW, documents

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from flowloom.llm import near_copies as nc  # noqa: E402


def slow_set(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def slow_roots(docs: list[tuple], least: Fraction = Fraction(4, 5)) -> dict[int, int]:
    """Least id of each document's component, over all pairs that share a shingle or have none."""
    sets = [slow_set(t) for _, t in docs]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or [None]:
            holders[x].append(i)
    root = list(range(len(docs)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k]}:
        if sets[a] == sets[b] or Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= least:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: docs[find(i)][0] for i, (d, _) in enumerate(docs)}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_stage_against_brute_force(spark, folder):
    """The stage keeps the least document of each component; copies beyond two bits of op6's fingerprint go too."""
    sf = f"/root/testdata/{folder}"
    docs = [(d, t) for d, t, *_ in documents(sf)]
    df = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, df, sf)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(slow_roots(docs).values()))


def planted(seed: int = 4) -> list[tuple[int, str]]:
    """A crowd of edited copies of one text, pairs just at, above and below 0.8, short texts and strangers."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(120)] = word()
        texts.append(w)
    for changed in range(1, 12):  # a text and one whose first words are others
        w = [word() for _ in range(44)]
        texts += [w, [word() for _ in range(changed)] + w[changed:]]
    for _ in range(20):
        w = [word() for _ in range(8)]
        texts += [w, [*w, word()], w[:4], w[:3]]
    texts += [["A", "b"], ["a", "B"], ["a"], []]
    rng.shuffle(texts)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


def test_planted_against_brute_force(spark):
    docs = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in nc.near_copies(df).collect()}
    assert got == slow_roots(docs)


def test_bands_and_sets():
    assert (1 - 0.8**nc.ROWS) ** nc.bands(0.8) < nc.MISS and nc.bands(1.0) == 1
    a, b = nc.shingle_set(b"a b c d e f g h i"), nc.shingle_set(b"A B c d e f g h i j")
    assert nc.similarity_of(a, b) == 5 / 6 and nc.similarity_of(a[:0], b[:0]) == 1
    rng = np.random.default_rng(1)
    same = []
    for _ in range(100):  # the share of common keys is the similarity to the power of a band's rows
        h = rng.integers(0, 2**63, 90).astype(np.uint64)
        x, y = (nc.band_keys(np.sort(p), nc.multipliers(40), 1) for p in (h[:80], h[10:]))
        same.append(np.mean(np.array(x, np.uint64) == np.array(y, np.uint64)))
    assert abs(np.mean(same) - 7 / 9) < 0.03


def test_near_copies_messy(messy, empty):
    got = nc.near_copies(messy).collect()
    assert len(got) == len(RAW)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == by[6] == 4 and by[None] is None
    kept = nc.keep_one_copy(messy)
    assert kept.columns == messy.columns
    ids = sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()))
    assert ids == [(False, 1), (False, 4), (False, 7), (False, 8), (False, 9), (False, 10), (True, 0)]
    assert nc.near_copies(empty).collect() == [] and nc.keep_one_copy(empty).collect() == []


def test_close_prints_are_candidates(spark):
    """Sets within two bits of SimHash are linked by their prints alone, also where prints are equal."""
    rows = [(1, 0), (2, 0), (5, 3), (6, 0xFFFF << 20), (7, (0xFFFF << 20) | 8), (9, -1)]
    got = nc._close(spark.createDataFrame(rows, "node long, fp long")).collect()
    assert {(r["a"], r["b"]) for r in got} == {(1, 2), (1, 5), (6, 7)}


def test_set_print():
    """The print of a set is op6's SimHash of a text whose shingles are all different."""
    text = " ".join(f"w{i}" for i in range(300)).encode()
    assert nc.set_print(nc.shingle_set(text)) == nc.majority(nc.digests(text, 5)) and nc.set_print(nc.shingle_set(b"")) == 0
