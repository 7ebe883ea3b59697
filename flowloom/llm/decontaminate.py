"""Benchmark decontamination: hash set of test n-grams, scanned against every window of the training words.

The test n-grams are turned into word numbers and rolling hashes, and broadcast in blocks of bounded size. A scan
numbers the words of a document, hashes all its windows at once, looks the hashes up and verifies each hit word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import packed, share, shared, unpacked, utf8
from flowloom.llm.lm import release
from flowloom.session import materialise

NGRAM = 10
#: Bytes of benchmark text that one broadcast block holds at most; a larger benchmark is scanned in several blocks.
BLOCK_BYTES = 32 << 20

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_OTHER = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
#: Lower-cases A-Z and turns every ASCII byte that is neither a digit nor a letter into a blank.
_FOLD = bytes.maketrans(_UPPER + _OTHER, _UPPER.lower() + b" " * len(_OTHER))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` in the text with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every window of n word numbers."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + ids[k : k + len(out)]
    return out


def _sorted(items: set[str | None]) -> list[str | None]:
    return sorted(items - {None}) + [None] * (None in items)


class Grams:
    """Windows of a block of items, as arrays: word numbers end to end, and per window length the windows' hashes in
    order, each with the place of its first word and its item. About 20 bytes per word, and the block's distinct words."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.number: dict[bytes, int] = {}
        self.names: list[str | None] = []
        ids, starts = [], {}
        at = 0
        for item, text in items:
            found = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            size = min(n, len(found))
            if found:
                starts.setdefault(size, []).append((at, len(found) - size + 1, len(self.names)))
                self.names.append(item)
                ids.append(np.array(found, np.uint32))
                at += len(found)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        self.windows = {}
        for size, runs in starts.items():
            place = np.concatenate([np.arange(a, a + k) for a, k, _ in runs])
            owner = np.repeat([o for *_, o in runs], [k for _, k, _ in runs]).astype(np.uint32)
            hashes = _hashes(self.ids.astype(np.uint64), size)[place]
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = hashes[order], place[order], owner[order]

    def scan(self, found: list[bytes]) -> tuple[list[int], list[int], list[str | None]]:
        """Starts and ends (exclusive) of the merged hit runs, and the items with occurring windows, a null id last."""
        ids = np.fromiter((self.number.get(w, 0) for w in found), np.uint64, len(found))
        runs: list[tuple[int, int]] = []
        owners: set[int] = set()
        for size, (known, place, owner) in self.windows.items():
            if len(ids) < size:
                continue
            h = _hashes(ids, size)
            low = np.searchsorted(known, h)
            hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == h)
            for i, a, b in zip(hit.tolist(), low[hit].tolist(), np.searchsorted(known, h[hit], "right").tolist(), strict=True):
                # Verified: the words themselves.
                same = (self.ids[place[a:b, None] + np.arange(size)] == ids[i : i + size]).all(axis=1)
                if same.any():
                    runs.append((i, i + size))
                    owners.update(owner[a:b][same].tolist())
        items = {self.names[o] for o in owners}
        starts, ends = merged(runs)
        return starts, ends, _sorted(items)


def merged(runs: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Union of half-open runs, as sorted starts and ends."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(runs):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct(
    [("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
)


def _scanner(grams):
    """Arrow UDF that scans texts with a broadcast block of grams."""

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block: Grams = shared(grams)
        for batch in batches:
            out = []
            for text in batch:
                found = words(text.as_py())
                starts, ends, items = block.scan(found)
                out.append({"n_words": len(found), "starts": starts, "ends": ends, "items": items})
            yield pa.array(out, _ARROW)
        release()

    return F.arrow_udf(scan, _FOUND).asNondeterministic()  # evaluated once, not again in each filter above it


def scan(self, found: list[bytes]) -> tuple[list[int], list[int], list[str | None]]:
        """Starts and ends (exclusive) of the merged hit runs, and the items with occurring windows, a null id last."""
        ids = np.fromiter((self.number.get(w, 0) for w in found), np.uint64, len(found))
        runs: list[tuple[int, int]] = []
        owners: set[int] = set()
        for size, (known, place, owner) in self.windows.items():
            if len(ids) < size:
                continue
            h = _hashes(ids, size)
            low = np.searchsorted(known, h)
            hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == h)
            for i, a, b in zip(hit.tolist(), low[hit].tolist(), np.searchsorted(known, h[hit], "right").tolist(), strict=True):
                # Verified: the words themselves.
                same = (self.ids[place[a:b, None] + np.arange(size)] == ids[i : i + size]).all(axis=1)
                if same.any():
                    runs.append((i, i + size))
                    owners.update(owner[a:b][same].tolist())
        items = {self.names[o] for o in owners}
        starts, ends = merged(runs)
        return starts, ends, _sorted(items)


def merged(runs: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Union of half-open runs, as sorted starts and ends."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(runs):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct(
    [("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
)


def _scanner(grams):
    """Arrow UDF that scans texts with a broadcast block of grams."""

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block: Grams = shared(grams)
        for batch in batches:
            out = []
            for text in batch:
                found = words(text.as_py())
                starts, ends, items = block.scan(found)
                out.append({"n_words": len(found), "starts": starts, "ends": ends, "items": items})
            yield pa.array(out, _ARROW)
        release()

    return F.arrow_udf(scan, _FOUND).asNondeterministic()  # evaluated once, not again in each filter above it


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list[tuple[int, int]]:
    """The benchmark's items in blocks: bounds on the running byte count, only two numbers per block on the driver."""
    size = benchmark.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return [(i, n) for i in range(n)]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = NGRAM,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``_hit``: number of words, merged hit runs (word positions) and items with occurring windows.

    A benchmark beyond ``block_bytes`` is dealt into blocks by item hash. Each block is one more scan over the
    documents' texts, whose hits are written before the next block is read, so no task holds two blocks.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), utf8(F.col(item_text)).alias("text"))
    size = benchmark.agg(F.sum(F.octet_length(F.col(item_text)))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def hits(i: int) -> Column:
        block = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i).collect()
        return _scanner(share(spark, Grams([(r["item"], bytes(r["text"])) for r in block], n)))(utf8(F.col(text)))

    if blocks == 1:
        return docs.withColumn("_hit", hits(0))
    numbered = materialise(packed(docs, _row=F.monotonically_increasing_id(), **{text: F.col(text)}), "numbered")
    found = None
    for i in range(blocks):
        one = numbered.select("_row", hits(i).alias("_hit"))
        one = materialise(one if i == 0 else one.filter(F.size("_hit.items") > 0), "block-hits")
        found = one if found is None else found.unionByName(one)
    both = F.arrow_udf(_union, _FOUND).asNondeterministic()
    found = found.groupBy("_row").agg(F.collect_list("_hit").alias("_hits")).select("_row", both("_hits").alias("_hit"))
    joined = numbered.join(found, "_row")
    return joined.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns], "_hit")


def _union(batch: pa.Array) -> pa.Array:
    """Merged runs and items of several blocks' findings."""
    out = []
    for found in batch.to_pylist():
        starts, ends = merged([r for f in found for r in zip(f["starts"], f["ends"], strict=True)])
        out.append({"n_words": found[0]["n_words"], "starts": starts, "ends": ends, "items": _sorted({x for f in found for x in f["items"]})})
    return pa.array(out, _ARROW)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. A word inside any occurrence of a window
    is hit. Null or empty texts have no words; items without words have no windows, items shorter than ``n`` words are
    one window. Items without an id hit like others; all of them count as one item, which has no name in
    ``items_sha256``. Repeated documents are scanned singly, repeated items count once. Without items nothing is hit and ``items_sha256`` is that of the empty string. Columns other than id and text are not read.
    """
    hit = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), benchmark, n, "_text", **kw)
    width = F.aggregate(
        F.arrays_zip(F.col("_hit.starts").alias("a"), F.col("_hit.ends").alias("b")),
        F.lit(0).cast("long"),
        lambda s, r: s + (r["b"] - r["a"]).cast("long"),
    )
    return hit.select(
        "doc_id",
        F.col("_hit.n_words").alias("n_words"),
        width.alias("n_hit"),
        F.size("_hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hit.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_hit.items") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, text: str = "text", **kw) -> DataFrame:
    """``docs`` without the documents that hold a test window; columns, repeats and nulls stay as they are."""
    hit = scan(packed(docs, _text=F.col(text)), benchmark, n, "_text", **kw)
    return unpacked(hit.filter(F.size("_hit.items") == 0), docs)


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
    """Texts without their hit runs of words; a run goes with the text between its words."""
    out = []
    for text, hit in zip(texts, hits, strict=True):
        raw, found = text.as_py(), hit.as_py()
        if raw is not None and found["starts"]:
            data = raw.encode()
            at = [m.span() for m in _WORD.finditer(data.translate(_FOLD))]
            kept, last = [], 0
            for a, b in zip(found["starts"], found["ends"], strict=True):
                kept.append(data[last : at[a][0]])
                last = at[b - 1][1]
            raw = (b"".join(kept) + data[last:]).decode()
        out.append(raw)
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, text: str = "text", **kw) -> DataFrame:
    """``docs`` with the hit passages cut out of the text; documents without a hit keep their text as it is."""
    hit = scan(packed(docs, _text=F.col(text)), benchmark, n, "_text", **kw)
    cut = F.arrow_udf(_cut, T.StringType()).asNondeterministic()
    return unpacked(hit.withColumn("_text", cut(F.col("_text"), F.col("_hit"))), docs, **{text: F.col("_text")})
