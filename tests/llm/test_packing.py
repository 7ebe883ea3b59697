"""Harmonic packing: every id in one piece, sequences without gaps, bounded padding."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import RAW, documents
from tokenizers import Tokenizer

from flowloom.llm import packing, tokens
from flowloom.llm.queries import QUERIES

PATH = tokens.vocabulary_path()


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_sequences(rows, capacity):
    """Gapless from 0, numbered from 0, within the capacity; returns their sizes."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(held) == list(range(len(held)))
    sizes = []
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        sizes.append(at)
    return sizes


def check_documents(rows, docs, ids_of):
    """The pieces of each document put together are its ids; of rows with one id, as a multiset of documents."""
    want = Counter()
    for i, t in docs:
        want[i, len(ids_of(t))] += 1
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["doc_tokens"]].append(r)
    assert set(got) == set(want)
    texts = {(i, len(ids_of(t))): t for i, t in docs}
    for key, pieces in got.items():
        ids = ids_of(texts[key])
        cover = Counter()
        for r in pieces:
            assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
            cover.update(range(r["start"], r["start"] + r["length"]))
        assert cover == Counter({i: want[key] for i in range(key[1])})


def padding(sizes, capacity):
    return sum(0 if s & (s - 1) == 0 else capacity - s for s in sizes)


def test_cuts():
    for capacity in (1, 7, 100, 1024):
        take = packing.takes(capacity)
        for n in range(3 * capacity):
            pieces = packing.cut(n, capacity, take)
            assert sum(pieces) == n
            assert all(capacity // p * p >= (1 - packing.SLACK) * capacity for p in pieces)
    assert [sum(packing.tail(n)) for n in range(300)] == list(range(300))
    assert packing.tail(700) == [512, 128, 32, 16, 8, 4]


def test_op11(spark, sf, ids_of):
    rows = QUERIES["op11_packing"](spark, sf).collect()
    docs = [(d, t) for d, t, *_ in documents(sf)]
    check_documents(rows, docs, ids_of)
    sizes = check_sequences(rows, 1024)
    assert padding(sizes, 1024) <= packing.SLACK * 1024 * len(sizes)


@pytest.mark.parametrize("capacity,parts", [(1024, 1), (64, 7), (10, 3), (1, 2)])
def test_messy(messy, empty, ids_of, capacity, parts):
    rows = packing.pieces_of(messy.repartition(parts), PATH, capacity=capacity).collect()
    check_documents(rows, [(i, t) for i, t, *_ in RAW], ids_of)
    check_sequences(rows, capacity)
    assert packing.pieces_of(empty, PATH, capacity=capacity).collect() == []


def test_classes_fill_over_tasks(spark, ids_of):
    """Single words from many tasks: a class's pieces of all tasks meet, and hardly anything is padded."""
    docs = [(i, "a" if i % 3 else None) for i in range(5000)]
    rows = packing.pieces_of(spark.createDataFrame(docs, "doc_id long, text string").repartition(13), PATH).collect()
    sizes = check_sequences(rows, 1024)
    check_documents(rows, docs, ids_of)
    assert padding(sizes, 1024) == 0
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r["length"])
    assert sum(set(v) == {1} and len(v) == 1024 for v in by.values()) == 1  # 1667 ends: one full sequence of them
    assert sum(set(v) == {2} and len(v) == 512 for v in by.values()) == 6  # 3333 pairs


def test_sequences(messy, ids_of):
    pieces = packing.pack(messy, PATH, capacity=100)
    rows = packing.sequences(pieces, 100, pad=9).collect()
    held = defaultdict(list)
    for r in pieces.collect():
        held[r["sequence_id"]].append((r["offset"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert len(rows) == len(held)
    for r in rows:
        want = [x for _, p in sorted(held[r["sequence_id"]]) for x in p]
        n = len(want)
        assert r["n_tokens"] == n
        want += [] if n & (n - 1) == 0 else [9] * (100 - n)
        assert np.frombuffer(r["ids"], "<u4").tolist() == want


def test_parameters(messy):
    with pytest.raises(ValueError):
        packing.pack(messy, PATH, capacity=0)


def test_worker_stores_more_pieces_than_a_plain_encoder():
    """Words and pieces share the store; 550 000 of them fit the packing worker without dropping one."""
    enc = tokens.Encoder(PATH, packing.STORE)
    for i in range(550_000):
        enc.tails.put(f"{i}", b"")
    assert len(enc.tails.now) == 550_000 and not enc.tails.before
    texts = ["an old, old. older!\nOld text", "old old, a older."]
    assert [enc.encode(t) for t in texts] == [enc._whole(t) for t in texts]
    assert {"old", "old,", "older"} <= enc.tails.now.keys()
