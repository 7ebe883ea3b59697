"""The pipeline's stages against their operators and against brute force on a small folder of tables."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from fixtures import documents
from test_mix_and_decontaminate import slow_hits
from test_near_copies import slow_roots

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from flowloom.session import materialise  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), name)
        out[name] = docs
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_and_order(stages, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixture", "token_files"]
    assert all(stages[k].columns == columns for k in list(stages)[:-1])


def test_quality_stage_keeps_clean_documents(stages, sf):
    kept = texts(stages["quality"])
    labels = pq.read_table(f"{sf}/labels.parquet").to_pylist()
    good = [x["doc_id"] for x in labels if x["quality"]]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert len(kept) < len(documents(sf))


def test_near_duplicate_stage(stages):
    before, after = texts(stages["quality"]), texts(stages["near_duplicates"])
    assert set(after) == set(slow_roots(sorted(before.items())).values())


def test_decontamination_stage(stages, sf):
    before, after = texts(stages["near_duplicates"]), texts(stages["decontamination"])
    items: dict[str, list] = {}
    for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist():
        items.setdefault(str(r["item_id"]), []).append(r["text"])
    grams = {}
    import re

    fold = {c: c + 32 for c in range(65, 91)}
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    for item, [t] in items.items():
        w = terms(t)
        for i in range(max(0, len(w) - 9)):
            grams[tuple(w[i : i + 10])] = item
    for i, t in before.items():
        w = terms(t)
        assert (i in after) == (not any(tuple(w[k : k + 10]) in grams for k in range(len(w) - 9))), i
    gone = sorted(set(before) - set(after))[:3]
    assert all(slow_hits(before[i], items, 10)[1] for i in gone)


def test_mixture_and_token_stages(stages):
    before = texts(stages["decontamination"])
    mixed = Counter(r["doc_id"] for r in stages["mixture"].collect())
    assert set(mixed) <= set(before) and max(mixed.values()) <= 3
    rows = stages["token_files"].collect()
    assert Counter(r["doc_id"] for r in rows) == mixed
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ids == sorted(ids)
