from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from fixtures import RAW, documents
from tokenizers import Tokenizer

from flowloom.llm import token_files, tokens
from flowloom.llm.queries import QUERIES

PATH = tokens.vocabulary_path()


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_the_whole(whole):
    """Cutting at blanks must not be visible, whatever white space surrounds them."""
    rng, enc = random.Random(4), tokens.Encoder(PATH, store=50)
    signs = [" ", " ", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "B", "ß", "你", "7", "'s", "'", "!", "<|endoftext|>", "\U0001f600", "the"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
        assert np.frombuffer(enc.encode(text), "<u2").tolist() == whole(text), repr(text)


def test_plain_takes_added_tokens_for_text(whole):
    text = "to the <|endoftext|> of it<|endoftext|>"
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    plain = t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.Encoder(PATH).encode(text), "<u2").tolist() == whole(text)
    assert np.frombuffer(tokens.Encoder(PATH, plain=True).encode(text), "<u2").tolist() == plain
    assert 50256 in whole(text) and 50256 not in plain


def test_store_is_bounded_in_characters(whole):
    """Texts without blanks and words that never come again must not fill a worker."""
    enc = tokens.Encoder(PATH, store=100)
    for i in range(200):
        text = ("你好" * 500 + str(i)) + " " + "x" * 300 + str(i) + " " + " ".join(f"{'longer' * 9}{i}{j}" for j in range(20))
        assert np.frombuffer(enc.encode(text), "<u2").tolist() == whole(text)
        for store in (enc.tails, enc.heads, enc.words):
            kept = [*store.now, *store.before]
            assert max(map(len, kept), default=0) <= tokens.LONG
            assert sum(map(len, kept)) <= 2 * (tokens.MEAN * store.size + 30 * tokens.LONG)


def test_width():
    assert tokens.id_width(50257) == 2 and tokens.id_width(1 << 16) == 2 and tokens.id_width(70000) == 4


def expected(rows, whole):
    start = 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*whole(t), 2]
        yield i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids
        start += len(ids)


def in_order(df):
    return sorted(df.collect(), key=lambda r: (r["start"]))


def test_op3_against_the_library(spark, sf, whole):
    got = in_order(QUERIES["op3_token_files"](spark, sf))
    want = list(expected([(d, t) for d, t, *_ in documents(sf)], whole))
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == [w[:4] for w in want]


def test_files_round_trip(messy, empty, whole, tmp_path):
    folder = str(tmp_path / "set")
    got = in_order(token_files.write_tokens(messy, PATH, folder))
    want = list(expected([(i, t) for i, t, *_ in RAW], whole))
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == [w[:4] for w in want]
    ids, starts = [], []
    for shard in sorted({r["shard"] for r in got}):
        ids += np.fromfile(f"{folder}/{shard}.bin", "<u2").tolist()
        at = np.fromfile(f"{folder}/{shard}.idx", "<i8")
        assert at[-1] == len(ids)
        starts += at[:-1].tolist()
    assert ids == [x for w in want for x in w[4]] and starts == [w[1] for w in want]
    assert len(list((tmp_path / "set").iterdir())) == 2 * len({r["shard"] for r in got})  # no drafts left
    assert token_files.write_tokens(empty, PATH, str(tmp_path / "none")).collect() == []


def test_histogram(messy, empty, whole):
    got = {r["n_tokens"]: r for r in tokens.length_histogram(messy, PATH).collect()}
    sizes = [len(whole(t)) for _, t, *_ in RAW]
    assert set(got) == set(sizes)
    for n, r in got.items():
        assert r["docs"] == sizes.count(n) and r["tokens"] == n * sizes.count(n)
        assert r["docs_at_least"] == sum(x >= n for x in sizes)
        assert r["tokens_at_least"] == sum(x for x in sizes if x >= n)
        assert r["docs_at_most"] == sum(x <= n for x in sizes)
        assert r["truncated_total"] == sum(min(x, n) for x in sizes)
    assert tokens.length_histogram(empty, PATH).collect() == []


def test_limits_and_quantiles(messy, whole):
    histogram = tokens.length_histogram(messy, PATH)
    sizes = sorted(len(whole(t)) for _, t, *_ in RAW)
    for r in tokens.limit_report(histogram, [0, 7, 100, 10**7]).collect():
        k = r["context_limit"]
        assert r["kept_tokens"] == sum(min(x, k) for x in sizes) and r["longer_docs"] == sum(x > k for x in sizes)
        assert r["docs"] == len(sizes) and r["total_tokens"] == sum(sizes)
    for r in tokens.quantiles(histogram, [0.1, 0.5, 1.0]).collect():
        assert r["n_tokens"] == sizes[max(0, int(np.ceil(r["share"] * len(sizes) - 1e-9)) - 1)]


def test_op2_against_the_library(spark, sf, whole):
    sizes = [len(whole(t)) for _, t, *_ in documents(sf)]
    got = QUERIES["op2_token_counts"](spark, sf).collect()
    assert sorted((r["n_tokens"], r["docs"]) for r in got) == sorted((n, sizes.count(n)) for n in set(sizes))


def test_shards_grow_with_bytes(spark, whole, monkeypatch):
    rows = [(i, "some words " * (1 + i % 7)) for i in range(400)]
    monkeypatch.setattr(token_files, "SHARD_BYTES", 2000)
    got = in_order(token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH))
    assert len({r["shard"] for r in got}) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = list(expected(rows, whole))
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == [w[:4] for w in want]


def test_forget_drops_the_workers_encoders():
    """A stage that needs no encoder leaves none of an earlier one in the worker."""
    import numpy as np
    import pyarrow as pa

    from flowloom.llm import quality, tokens

    path = tokens.vocabulary_path()
    kept = tokens.encoder(path)
    assert tokens.encoder(path) is kept
    assert len(np.concatenate([x.to_numpy() for x in quality._patterns(iter([pa.array([b"a b c"])]))])) == 1
    assert tokens.encoder(path) is not kept
