"""Near copies by Jaccard similarity of word shingles: SimHash finds the closest pairs, MinHash bands the texts that may
have others, a join on their rarest shingles those pairs; the exact similarity decides on all.

Texts with equal sets of shingles are one node throughout. The SimHash of a set links nodes within ``DISTANCE`` bits by
pigeonhole blocks, as in simhash.py; a pair of similarity 0.8 differs in about ten bits, so the rest is found by sets.
``rows`` minimum hashes make one band key, and there are as
many bands as keep the chance that a pair at the threshold shares no key below ``MISS``. Only nodes that share a key go
on. Their shingles are ordered by the number of nodes that hold them; two similar sets share one of the rarest of both
and from its place in both follows how many they can share at most, so texts that share only a common passage never
meet. All nodes at a shingle are first compared with the one that has it earliest. Pairs that this leaves in different
components are then compared each: all outside the shingle's largest component with all, so copies of one text cost
linear work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import utf8
from flowloom.llm.components import components
from flowloom.llm.lm import release
from flowloom.llm.simhash import DISTANCE, SEED, digests, keep_named, links, majority
from flowloom.llm.tokens import forget
from flowloom.session import materialise

SHINGLE = 5
SIMILARITY = 0.8
#: Minimum hashes of a band, and the chance to miss a pair at the threshold that fixes the number of bands.
ROWS = 5
MISS = 1e-7
#: Parts that the members compared with one text are dealt to; the text is sent once to each.
SALTS = 256
#: Shingles held by more than a 1 / HOT share of all rows are broadcast with their counts; there can't be more than HOT.
HOT = 1_000_000
#: Shingles hashed at a time; the table of their hashes stays in the processor's cache.
_CHUNK = 256
#: Shingles whose bits are summed at a time.
_PRINTED = 1 << 14


def bands(similarity: float, rows: int = ROWS) -> int:
    """Bands needed so that a pair of that similarity shares a key but for a chance of ``MISS``."""
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log1p(-(similarity**rows)))


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; empty for a text without words."""
    found = [np.unique(h) for h in digests(text, shingle)]
    return np.unique(np.concatenate(found)).astype(np.uint64) if found else np.zeros(0, np.uint64)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; that of two empty ones is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def set_print(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set of shingles; 0 for an empty one."""
    return majority(hashes[i : i + _PRINTED].astype(">u8") for i in range(0, len(hashes), _PRINTED))


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def multipliers(n: int) -> np.ndarray:
    """Odd factors that make ``n`` hash functions of one."""
    return np.array([xxhash.xxh64_intdigest(f"minhash {i}".encode(), SEED) | 1 for i in range(n)], np.uint64)


def band_keys(hashes: np.ndarray, factors: np.ndarray, rows: int = ROWS) -> list[int]:
    """One key for each band from the minimum hashes of a set; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        np.minimum(least, np.multiply.outer(factors, hashes[i : i + _CHUNK]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(least.reshape(-1, rows))]


_SIGNATURE = T.StructType(
    [T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
)


def _signature(text: Column, shingle: int, n_bands: int, rows: int) -> Column:
    factors = multipliers(n_bands * rows)

    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        for batch in batches:
            node, fp, keys = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64), []
            for i, t in enumerate(batch):
                hashes = shingle_set(t.as_py(), shingle)
                node[i], fp[i] = _node(hashes), set_print(hashes)
                keys.append(np.array(band_keys(hashes, factors, rows), np.uint64).view(np.int64))
            columns = [pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.StructArray.from_arrays(columns, ["node", "fp", "keys"])
        release()

    return F.arrow_udf(sign, _SIGNATURE).asNondeterministic()(utf8(text))


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``node, size, hashes`` for each of ``nodes`` (``node, first``), from the documents named by ``first``."""

    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle) for t in batch]
            node = np.array([_node(h) for h in found], np.uint64).view(np.int64)
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.StructArray.from_arrays([pa.array(node), pa.ListArray.from_arrays(ends, pa.array(flat))], ["node", "hashes"])
        release()

    kind = T.StructType([T.StructField("node", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))])
    ids = nodes.select("first").distinct()
    named = docs.join(ids, docs["doc_id"].eqNullSafe(ids["first"]), "left_semi")
    read = named.select(F.arrow_udf(hashes, kind).asNondeterministic()(utf8(F.col("text"))).alias("s")).select("s.node", "s.hashes")
    one = read.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])
    return materialise(one.select("node", F.size("hashes").cast("long").alias("size"), "hashes"), "sets")


def _shared(size_a: Column, size_b: Column, similarity: float) -> Column:
    """Shingles that two sets of these sizes must share to be similar."""
    return F.ceil((size_a + size_b) * (similarity / (1 + similarity)) - 1e-6)


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """``node, size, h, pos``: the shingles of a set, rarest first, one of which any similar set shares with it.

    The order is the number of sets that hold a shingle, then its hash, so two similar sets share one of the first
    ``size - ceil(similarity * size) + 1`` of both. Shingles of one set only come first; they take places but no rows.
    """
    rows = sets.select("node", "size", F.explode("hashes").alias("h"))
    held = materialise(rows.groupBy("h").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "held")
    total = held.agg(F.sum("held")).first()[0] or 0
    often = held.filter(F.col("held") * HOT > total)  # fewer than HOT rows, as their counts add up to at most the total
    seldom = held.filter(F.col("held") * HOT <= total)
    known = rows.join(F.broadcast(often), "h").unionByName(rows.join(seldom, "h"))
    by = Window.partitionBy("node")
    place = F.col("size") - F.count(F.lit(1)).over(by) + F.row_number().over(by.orderBy("held", "h")) - 1
    placed = known.select("node", "size", "h", place.alias("pos"))
    return materialise(placed.filter(F.col("pos") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-6)), "prefixes")


def _may_be(similarity: float) -> Column:
    """Whether sets ``size, pos`` and ``sx, px`` can be similar if this shingle is the first that they share."""
    need = _shared(F.col("size"), F.col("sx"), similarity)
    return (F.col("size") - F.col("pos") >= need) & (F.col("sx") - F.col("px") >= need)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of nodes that reach the similarity. A frequent ``a`` is dealt over parts with a copy of its set each."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = salted.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    both = salted.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b").join(left, ["a", "salt"])
    same = F.size(F.array_intersect("ha", "hb"))
    return materialise(both.filter(same / (F.size("ha") + F.size("hb") - same) >= similarity).select("a", "b"), "similar")


def _close(nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ``nodes`` (``node, fp``) that connect all within ``DISTANCE`` bits: equal prints by their least node."""
    least = materialise(nodes.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    same = nodes.join(least, "fp").filter("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    one, other = (least.select(F.col("fp").alias(k), F.col("least").alias(f"n{k}")) for k in "ab")
    near = links(least.select("fp"), DISTANCE).join(one, "a").join(other, "b")
    near = near.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    return materialise(same.unionByName(near).distinct(), "close")


def near_copies(
    docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text", rows: int = ROWS
) -> DataFrame:
    """One row per document: ``doc_id, component_id``, the least doc_id of all that are linked by near copies.

    Two texts are near copies if the Jaccard similarity of their sets of ``shingle`` words is at least ``similarity``;
    a pair that is exactly so similar is missed with a chance below ``MISS``, more similar ones with less, and no pair
    below it is taken. Texts are folded to a-z and split at ASCII white space; fewer words are one shingle of all. Null,
    empty and blank texts are copies of each other. Repeated rows come back as often as they went in. A null doc_id
    never names a component unless all ids in it are null. Other columns aren't read. An empty table gives an empty
    result.
    """
    if not 0 < similarity <= 1 or shingle < 1 or rows < 1:
        raise ValueError("similarity must be over 0 and at most 1, shingle and rows at least 1")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = docs.select("doc_id", _signature(F.col("text"), shingle, bands(similarity, rows), rows).alias("s"))
    prints = materialise(signed.select("doc_id", "s.node", "s.fp", "s.keys"), "signatures")
    # One row per node; print and keys are the same in all its rows.
    own = [F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")]
    nodes = materialise(prints.groupBy("node").agg(*own), "nodes")
    close = _close(nodes.select("node", "fp"))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    crowds = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    met = keyed.join(crowds.select("key"), "key", "left_semi").select("node")
    met = met.union(close.select("a")).union(close.select("b")).distinct().join(nodes.select("node", "first"), "node")
    sets = _sets(docs, materialise(met, "met"), shingle)
    prefixes = _prefixes(sets, similarity)

    # All sets that share a shingle are compared with the one that has it earliest, which has the fewest own shingles.
    leads = prefixes.groupBy("h").agg(F.min(F.struct("pos", "node", "size")).alias("l"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    leads = leads.select("h", F.col("l.node").alias("x"), F.col("l.size").alias("sx"), F.col("l.pos").alias("px"))
    stars = prefixes.join(leads, "h").filter((F.col("node") != F.col("x")) & _may_be(similarity))
    stars = stars.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b"))
    stars = materialise(stars.unionByName(close).distinct(), "stars")
    similar = _verified(stars, sets, similarity)
    roots = materialise(components(similar, "a", "b"), "roots")
    rest = _verified(_apart(prefixes, roots, stars, similarity), sets, similarity)
    if not rest.isEmpty():
        roots = materialise(components(similar.unionByName(rest), "a", "b"), "roots")
    named = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialise(named, "joined")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.select("doc_id", "node").join(named.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def _apart(prefixes: DataFrame, roots: DataFrame, seen: DataFrame, similarity: float) -> DataFrame:
    """Pairs of sets that share a shingle, are in different components, weren't compared and may be similar."""
    now = prefixes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    now = materialise(now, "rooted")
    main = now.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("h")
    main = main.agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    open_ = materialise(now.join(main.select("h", "main"), "h"), "open")
    few = open_.filter("root != main").select(
        "h", F.col("node").alias("x"), F.col("size").alias("sx"), F.col("pos").alias("px"), F.col("root").alias("rx")
    )
    pairs = open_.join(few, "h").filter((F.col("root") != F.col("rx")) & _may_be(similarity))
    pairs = pairs.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()
    return materialise(pairs.join(seen, ["a", "b"], "left_anti"), "pairs")


def keep_one_copy(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with one row of each component of near copies, that of its least doc_id; columns stay as they are.

    Of rows repeated with one doc_id one stays. Rows without a doc_id can't be told apart and all stay.
    """
    return keep_named(docs, near_copies(docs, similarity, shingle, doc_id, text, **kw), doc_id)
