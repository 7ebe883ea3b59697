"""Alignment of two tokenizers over the same bytes.

Each text is encoded by both, the tokens get byte offsets, and two ``pandas.merge_asof`` calls per batch, keyed by
document, find for each token start the other side's token that covers it. Both directions together give every pair of
tokens whose byte ranges overlap: of two that overlap, the later start lies in the other. Offsets at which tokens of both
sides end cut a document into groups.

How many documents hold a pair of ids linked is counted over the corpus. Each document writes its distinct pairs once;
these are counted with partial sums, and the counts go back to the documents: pairs in more than a ``1 / HOT`` share of
all rows, of which there can't be more than ``HOT``, by broadcast, and the others, none of them frequent, by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.lm import release
from flowloom.llm.tokens import _signs, encoder
from flowloom.session import materialise

#: Bytes of text aligned at a time; a longer text is aligned by itself.
CHUNK = 1 << 19
#: Rows of the table of counts that may be broadcast.
HOT = 1_000_000
#: Bits of a B id in a pair; A ids have the rest of a long.
_SHIFT = 32
_SPACE = "▁"


class Sides:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = encoder(path_a, plain=True), sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {sign: byte for byte, sign in _signs().items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        entries_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            entries_a[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        b, entries_b = self.b, []
        for i in range(b.get_piece_size()):
            piece = b.id_to_piece(i)
            entries_b.append(bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace(_SPACE, " ").encode())
        self.entries = entries_a, entries_b
        self.sizes = tuple(np.array([len(e) for e in side], np.int64) for side in self.entries)
        #: What a token adds to the text of the groups: its id, then what follows it within and at the end of its side.
        self.signs = tuple(
            [f"{i}{mark}".encode() for i in range(len(side)) for mark in (",", end)] for side, end in zip(self.entries, "|;", strict=True)
        )

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none if the bytes of one differ from a space and the text."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        whole = b" " + text.encode()
        b = np.array(self.b.encode(text, num_threads=1), np.int64)
        if b"".join(map(self.entries[1].__getitem__, b.tolist())) != whole:
            return none, none
        a = np.frombuffer(self.a.encode(" " + text), f"<u{self.a.width}").astype(np.int64)
        if b"".join(map(self.entries[0].__getitem__, a.tolist())) != whole:
            return none, none
        return a, b


def sides(path_a: str, path_b: str) -> Sides:
    """The worker's tokenizers, kept with the sentencepiece module as this one travels by value."""
    import sentencepiece

    kept = vars(sentencepiece).setdefault("_kept_sides", {})
    if (path_a, path_b) not in kept:
        kept[path_a, path_b] = Sides(path_a, path_b)
    return kept[path_a, path_b]


def _tokens(ids: list[np.ndarray], sizes: np.ndarray) -> pd.DataFrame:
    """One row per token of some documents laid end to end: ``doc, start, end, id, at`` (its place)."""
    doc = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    token = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    end = np.cumsum(sizes[token])
    return pd.DataFrame({"doc": doc, "start": end - sizes[token], "end": end, "id": token, "at": np.arange(len(token))})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of tokens of both sides that overlap, each once."""
    keep = ["doc", "start", "at"]
    over_a = pd.merge_asof(a[keep], b[keep], on="start", by="doc", suffixes=("_a", "_b"))
    over_b = pd.merge_asof(b[keep], a[keep], on="start", by="doc", suffixes=("_b", "_a"))
    # Equal starts are found from both sides; they stay in the first.
    start = a["start"].to_numpy()
    over_b = over_b[start[over_b["at_a"].to_numpy()] != over_b["start"].to_numpy()]
    return tuple(np.concatenate([over_a[c].to_numpy(), over_b[c].to_numpy()]) for c in ("at_a", "at_b"))


def _last(group: np.ndarray) -> np.ndarray:
    return np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)


def align(ids: list[tuple[np.ndarray, np.ndarray]], two: Sides) -> Iterator[tuple]:
    """For each document ``n_a, n_b, n_groups, n_links, groups, pairs, times``: the groups' text, and its distinct linked
    pairs of ids (A id shifted over B id, rising) with the number of links of each."""
    a, b = (_tokens([d[s] for d in ids], two.sizes[s]) for s in (0, 1))
    at_a, at_b = overlaps(a, b)
    link_doc = a["doc"].to_numpy()[at_a]
    pair = (a["id"].to_numpy()[at_a] << _SHIFT) | b["id"].to_numpy()[at_b]
    order = np.lexsort((pair, link_doc))
    link_doc, pair = link_doc[order], pair[order]
    first = np.flatnonzero(np.append(True, (link_doc[1:] != link_doc[:-1]) | (pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
    pair_doc, pair, times = link_doc[first], pair[first], np.diff(np.append(first, len(link_doc)))

    # A group is named by the number of common ends before it.
    ends = np.intersect1d(a["end"].to_numpy(), b["end"].to_numpy(), assume_unique=True)
    group = [np.searchsorted(ends, side["start"].to_numpy(), "right") for side in (a, b)]
    sign = [2 * side["id"].to_numpy() + _last(g) for side, g in zip((a, b), group, strict=True)]
    side_of = np.repeat([0, 1], [len(a), len(b)])
    order = np.argsort(2 * np.concatenate(group) + side_of, kind="stable")
    signs = two.signs[0] + two.signs[1]
    sign = np.concatenate([sign[0], sign[1] + len(two.signs[0])])[order]

    edges = np.arange(len(ids) + 1)
    n_a, n_b = (np.searchsorted(side["doc"].to_numpy(), edges) for side in (a, b))
    last_end = np.concatenate([[0], a["end"].to_numpy()])[n_a]
    n_groups = np.searchsorted(ends, last_end, "right")
    pair_at, link_at = np.searchsorted(pair_doc, edges), np.searchsorted(link_doc, edges)
    for i in range(len(ids)):
        lo, hi = n_a[i] + n_b[i], n_a[i + 1] + n_b[i + 1]
        text = b"".join(map(signs.__getitem__, sign[lo:hi].tolist()))[:-1]
        p = slice(pair_at[i], pair_at[i + 1])
        yield n_a[i + 1] - n_a[i], n_b[i + 1] - n_b[i], n_groups[i + 1] - n_groups[i], link_at[i + 1] - link_at[i], text, pair[p], times[p]


_LONGS = ("n_a", "n_b", "n_groups", "n_links")


def _aligner(path_a: str, path_b: str, keep_groups: bool) -> Callable:
    def chunk(docs: list, ids: list[tuple], kind: pa.DataType, two: Sides) -> pa.RecordBatch:
        rows = list(zip(*align(ids, two), strict=True))
        columns = {"doc_id": pa.array(docs, kind)}
        columns |= {n: pa.array(np.array(c, np.int64)) for n, c in zip(_LONGS, rows, strict=False)}
        columns["groups_sha256"] = pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in rows[4]])
        columns["groups"] = pa.array([t.decode() if keep_groups else None for t in rows[4]], pa.string())
        for name, values, item in (("pairs", rows[5], np.int64), ("times", rows[6], np.int32)):
            ends = pa.array(np.cumsum([0, *map(len, values)]).astype(np.int32))
            columns[name] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values).astype(item)))
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = sides(path_a, path_b)
        for batch in batches:
            docs, ids, held, kind = [], [], 0, batch["doc_id"].type
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = text.as_py() or ""
                if held and held + len(text) > CHUNK:
                    yield chunk(docs, ids, kind, two)
                    docs, ids, held = [], [], 0
                docs.append(doc_id)
                ids.append(two.encode(text))
                held += len(text)
            if docs:
                yield chunk(docs, ids, kind, two)
        release()

    return run


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", groups: bool = True) -> DataFrame:
    """One row per document, from its own tokens alone: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, pairs,
    times``.

    ``groups`` is the text ``a1,a2|b1;a3|b2,b3`` of the groups' ids (null if not wanted), ``pairs`` its distinct linked
    pairs as A id times 2**32 plus B id, ``times`` how many links each has. See ``alignment`` for texts without tokens.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{n} long' for n in _LONGS)}, groups_sha256 string, groups string, pairs array<long>, times array<int>"
    return docs.mapInArrow(_aligner(path_a, path_b, groups), schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair, held, best``: the number of rows that hold the pair, and whether no pair of its A id is held by more."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("held"))
    counts = materialise(counts, "pair-counts")
    most = counts.groupBy(F.shiftright("pair", _SHIFT).alias("a")).agg(F.max("held").alias("most"))
    joined = counts.withColumn("a", F.shiftright("pair", _SHIFT)).join(most, "a")
    return materialise(joined.select("pair", "held", (F.col("held") == F.col("most")).alias("best")), "pairs")


def alignment(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``path_a`` names a byte-level vocabulary of the tokenizers library, given a space and the text, ``path_b`` a
    sentencepiece model, given the text. Strings of special tokens are ordinary text. A pair's count is the number of
    documents that hold it linked; ``n_best`` are the links whose count is the highest of their A id, ties included, and
    ``count_sum`` is the sum of the counts over the links.

    Texts that are null, empty or whose bytes by either side differ from a space and the text have no tokens: zeros, and
    an empty ``groups_sha256``. Repeated rows count and come back as often as they are there; ids may be null or
    repeated. Other columns aren't read. An empty table gives no rows.
    """
    found = aligned(docs, path_a, path_b, doc_id, text, groups=False).drop("groups")
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(found)
    size, rows = counts.agg(F.count(F.lit(1)), F.sum("held")).first()
    frequent = F.lit(True) if size <= hot else F.col("held") * hot > (rows or 0)
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    near = links.join(F.broadcast(counts.filter(frequent)), "pair")  # at most `hot` rows
    parts = [near]
    if size > hot:
        seldom = counts.filter(~frequent)
        parts.append(links.join(F.broadcast(counts.filter(frequent)), "pair", "left_anti").join(seldom.hint("merge"), "pair"))
    sums = [
        p.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
            F.sum(F.col("times") * F.col("held")).alias("count_sum"),
        )
        for p in parts
    ]
    none = found.select("row", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    own = found.select("row", "doc_id", *_LONGS, "groups_sha256")
    total = none
    for s in sums:
        total = total.unionByName(s)
    total = total.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return own.join(total, "row").select("doc_id", *_LONGS, "n_best", "count_sum", "groups_sha256")
