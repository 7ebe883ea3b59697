"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Two fingerprints that differ in at most ``distance`` of 64 bits agree on at least ``pieces - distance`` of ``pieces``
equal pieces, so they share one of the keys made of that many pieces. Equal fingerprints are one node throughout; links
are sought between distinct fingerprints only. A key with more than ``bucket`` fingerprints isn't joined pair by pair:
its fingerprints are linked through every fingerprint that is one bit away, which two of them share exactly if they
differ in at most two bits. Such a group has at most 65 members, so no group is ever large.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import packed, unpacked, utf8
from flowloom.llm.components import components
from flowloom.session import materialise

SHINGLE = 3
SEED = 42
DISTANCE = 2
PIECES = 4
BUCKET = 24
#: Shingles whose bits are summed at a time; bounds the memory for a very long text.
_CHUNK = 1 << 16


def digests(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles in order, in big-endian blocks; nothing for a text without words."""
    words = text.lower().split()
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    joined, lengths = b" ".join(words), list(map(len, words))
    start = np.concatenate(([0], np.cumsum(np.array(lengths) + 1)))
    begin = start[:n].tolist()
    end = (start[min(shingle, len(words)) :][:n] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(begin[i : i + _CHUNK], end[i : i + _CHUNK], strict=True)], ">u8")


def majority(blocks: Iterable[np.ndarray]) -> int:
    """SimHash of blocks of big-endian hashes: a bit is set if it is set in over half of them."""
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash over all word shingles: a bit is set if it is set in over half of the shingles' XXH64."""
    return majority(digests(text, shingle))


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = np.fromiter((fingerprint(t.as_py()) for t in batch), np.uint64, len(batch))
        yield pa.array(out.view(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text") -> Column:
    """64-bit fingerprint of a text column, as a signed long; a text without words has fingerprint 0."""
    return F.arrow_udf(_fingerprints, T.LongType()).asNondeterministic()(utf8(F.col(text)))


def _keys(pieces: int, distance: int) -> Column:
    """Array of structs (which pieces, their bits), one for each choice of ``pieces - distance`` pieces."""
    width = [64 // pieces + (i < 64 % pieces) for i in range(pieces)]
    low = [sum(width[:i]) for i in range(pieces)]
    masks = [((1 << width[i]) - 1) << low[i] for i in range(pieces)]
    out = []
    for n, chosen in enumerate(combinations(range(pieces), pieces - distance)):
        mask = sum(masks[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(n).alias("part"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*out)


def links(prints: DataFrame, distance: int = DISTANCE, pieces: int = PIECES, bucket: int = BUCKET) -> DataFrame:
    """Links between the distinct fingerprints ``fp``: ``a, b``, connecting all pairs within ``distance`` bits (0 to 2).

    Pairs of small buckets come singly; within large ones each member is linked to the least of its neighbours'
    one-bit balls, which leaves the same components.
    """
    if not 0 <= distance <= 2 or pieces <= distance:
        raise ValueError("distance must be 0 to 2 and less than pieces")
    keyed = prints.select("fp", F.explode(_keys(pieces, distance)).alias("k")).select("fp", "k.part", "k.bits")
    sizes = keyed.groupBy("part", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialise(keyed.join(sizes, ["part", "bits"]), "buckets")
    small = shared.filter(F.col("n") <= bucket).select("part", "bits", "fp")
    pairs = (
        small.withColumnRenamed("fp", "a")
        .join(small.withColumnRenamed("fp", "b"), ["part", "bits"])
        .filter(F.col("a") < F.col("b"))
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        .select("a", "b")
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64)])
    crowded = shared.filter(F.col("n") > bucket).select("fp").distinct()
    ball = crowded.select("fp", F.explode(flips).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("point"))
    if distance < 2:  # a point one bit away from both tells nothing then; the member itself is the point
        ball = ball.filter(F.col("fp") == F.col("point")) if distance == 0 else ball
    met = ball.groupBy("point").agg(F.array_sort(F.collect_set("fp")).alias("fps")).filter(F.size("fps") > 1)
    if distance == 1:
        near = met.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b"))
        near = near.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) == 1)
    else:
        near = met.select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    return pairs.unionByName(near)


def classes(prints: DataFrame, distance: int = DISTANCE, pieces: int = PIECES, bucket: int = BUCKET) -> DataFrame:
    """``fp, component_id`` for ``doc_id, fp`` rows: the least doc_id of the component of each fingerprint."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(links(nodes, distance, pieces, bucket), "a", "b")
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    joined = materialise(joined, "joined")
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return joined.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Texts are folded to a-z, split at ASCII white space and shingled by three words (fewer words: one shingle of all).
    Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows come back as often
    as they went in. A null doc_id never names a component unless all ids in it are null. Other columns aren't read.
    """
    prints = materialise(docs.select(F.col(doc_id).alias("doc_id"), with_fingerprint(docs, text).alias("fp")), "fingerprints")
    named = classes(prints, distance, **kw)
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, distance: int = DISTANCE, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with one row of each component, that of its least doc_id; columns stay as they are.

    Of rows repeated with one doc_id one stays. Rows without a doc_id can't be told apart and all stay.
    """
    return keep_named(docs, near_duplicates(docs, distance, doc_id, text, **kw), doc_id)


def keep_named(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each doc_id that names its component in ``found``, and all rows without a doc_id."""
    stays = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    stays = materialise(stays, "kept")
    one = Window.partitionBy("_kept").orderBy("_kept")
    named = packed(docs, _key=F.col(doc_id)).join(stays, F.col("_key") == F.col("_kept"))
    first = unpacked(named.withColumn("_n", F.row_number().over(one)).filter("_n = 1"), docs)
    return first.unionByName(docs.filter(F.col(doc_id).isNull()))
