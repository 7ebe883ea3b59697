from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from fixtures import PLAIN, RAW

from flowloom.llm import decontaminate as D
from flowloom.llm import mixing as M


def slow_hits(text: str | None, items: dict[str, list[list[str]]], n: int):
    fold = {c: c + 32 for c in range(65, 91)}
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    w = terms(text)
    hit, found = set(), set()
    for item, texts in items.items():
        for t in texts:
            b = terms(t)
            size = min(n, len(b))
            for i in range(len(b) - size + 1 if b else 0):
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == b[i : i + size]:
                        hit.update(range(j, j + size))
                        found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_messy(messy, benchmark, block_bytes):
    """One block, and several whose findings are merged."""
    items: dict[str, list] = {}
    for r in benchmark.collect():
        items.setdefault("" if r["item_id"] is None else str(r["item_id"]), []).append(r["text"])
    got = D.contamination(messy, benchmark, block_bytes=block_bytes).collect()
    assert len(got) == len(RAW)
    for r in got:
        if r["doc_id"] == 8:
            continue  # long; brute force is too slow
        text = next(t for i, t, *_ in RAW if i == r["doc_id"])
        n, hit, found = slow_hits(text, items, 10)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0), r
        names = ",".join(x for x in found if x)  # an item without an id has no name
        assert r["items_sha256"] == hashlib.sha256(names.encode()).hexdigest()
    assert next(r for r in got if r["doc_id"] is None)["n_hit"] == 5


def test_contamination_without_items(messy, benchmark, empty):
    none = D.contamination(messy, benchmark.limit(0)).collect()
    assert len(none) == len(RAW) and not any(r["contaminated"] or r["n_hit"] for r in none)
    assert D.contamination(empty, benchmark).collect() == []


def test_drop_and_cut(messy, benchmark):
    left = D.drop_contaminated(messy, benchmark)
    assert left.columns == messy.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter({4: 1, 5: 1, 6: 1, 8: 1, 9: 1, 10: 1})
    cut = {r["doc_id"]: r for r in D.remove_spans(messy, benchmark).collect()}
    assert cut[7]["text"] == "" and cut[4]["text"] is None and cut[9]["text"] == RAW[10][1]
    assert cut[1]["text"] == "The river ." and PLAIN.endswith("letters.")
    assert cut[1]["_text"] == "x"  # a column of the input with a name used inside


def slow_targets(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        rest = sum(w[s] for s in order if s not in capped)
        t = {s: most * sizes[s] if s in capped else left * w[s] / rest for s in order}
        over = {s for s in order if s not in capped and t[s] > most * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mixture_messy(messy, empty):
    got = M.mixture(messy).collect()
    size = lambda t: len((t or "").encode().split())
    sizes: dict = {}
    for _, t, _, s in RAW:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = slow_targets(sizes)
    by = {}
    for i, t, _, s in RAW:
        by[i] = (size(t), sizes[s], want[s])
    assert len(got) == len(RAW)
    for r in got:
        n, whole, target = by[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, whole) and abs(r["target"] - target) < 1e-6
        assert r["taken"] in {k * n for k in range(4)}
    assert M.mixture(empty).collect() == []


def test_mixture_reaches_targets(spark):
    docs = [(i, "w " * (1 + i % 9), f"s{min(i % 40, 7)}") for i in range(8000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = M.mixture(df).collect()
    taken, target = Counter(), {}
    source = {i: s for i, _, s in docs}
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert abs(sum(target.values()) - sum(1 + i % 9 for i, *_ in docs)) < 1e-3
    for s, t in target.items():
        assert abs(taken[s] - t) < 0.12 * t, s
    again = {r["doc_id"]: r["taken"] for r in M.mixture(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_mix_repeats_rows(messy, empty):
    want = {r["doc_id"]: r for r in M.mixture(messy).collect()}
    got = M.mix(messy)
    assert got.columns == messy.columns
    n = Counter(r["doc_id"] for r in got.collect())
    for i, count in Counter(i for i, *_ in RAW).items():
        if want[i]["size"]:
            assert n[i] * want[i]["size"] == want[i]["taken"] * count
    assert M.mix(empty).collect() == []
