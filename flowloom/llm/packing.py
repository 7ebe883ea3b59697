"""Harmonic packing of token ids into sequences of a fixed capacity.

A length belongs to class ``k`` if ``k`` pieces of it fit a sequence and ``k + 1`` don't, so a sequence of class ``k`` is
filled with any ``k`` pieces of that class. Documents are cut so that every piece nearly fills its share: a piece of
class ``k`` is at least ``(1 - slack) / k`` of the capacity, so no sequence is padded by more than ``slack``.

Every task fills the sequences of its classes by itself, as soon as the documents are encoded; nothing but the pieces
left in its open sequences (less than ``k`` for each class) is shuffled. Those are numbered by class over all tasks and
fill sequences in the same way. What is then left, again less than ``k`` pieces for each class and so less than one
sequence for each, is laid end to end and cut at the capacity, its tail at powers of two, which are not padded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import running
from flowloom.llm.tokens import encoder
from flowloom.session import materialise

CAPACITY = 1024
END = 0
SLACK = 1 / 64
#: Distinct pieces of text that a worker's encoder stores.
STORE = 600_000
#: Bytes of ids of a batch that a task hands on.
_FLUSH = 4 << 20


def takes(capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """For each rest of a document (index) the length of the next piece: the longest that nearly fills its share."""
    out = [0]
    for r in range(1, capacity + 1):
        out.append(r if capacity // r * r >= (1 - slack) * capacity else out[-1])
    return out


def cut(n: int, capacity: int, take: list[int]) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    out, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        out.append(take[rest])
        rest -= out[-1]
    return out


def tail(n: int) -> list[int]:
    """Powers of two that add up to ``n``, falling."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def _filler(path: str, end: int, capacity: int, slack: float) -> Callable:
    """Function for mapInArrow: cuts documents and fills sequences; ``bin`` is null for pieces of open ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, take, part = encoder(path, store=STORE), takes(capacity, slack), TaskContext.get().partitionId()
        last = end.to_bytes(enc.width, "little")
        open_: dict[int, list] = {}
        rows: list[tuple] = []
        held = done = 0
        kind = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            doc, ids, start, length, n, klass, number, offset, place = zip(*rows, strict=True)
            longs = {"start": start, "length": length, "doc_tokens": n, "klass": klass, "bin": number, "offset": offset, "place": place}
            columns = {k: pa.array(v, pa.int64()) for k, v in longs.items()}
            columns |= {"doc_id": pa.array(doc, kind), "part": pa.array([part] * len(rows), pa.int64()), "ids": pa.array(ids, pa.binary())}
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            kind = batch["doc_id"].type
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.frombuffer(enc.encode(text.as_py() or "") + last, f"<u{enc.width}").astype("<u4").tobytes()
                n, at = len(ids) // 4, 0
                for size in cut(n, capacity, take):
                    k = capacity // size
                    pieces = open_.setdefault(k, [])
                    pieces.append((doc_id, at, size, n, ids[4 * at : 4 * (at + size)]))
                    at += size
                    if len(pieces) == k:
                        offset = 0
                        for d, a, s, m, x in open_.pop(k):
                            rows.append((d, x, a, s, m, k, done, offset, None))
                            offset += s
                        done += 1
                        held += 4 * offset
                        if held >= _FLUSH:
                            yield batch_of(rows)
                            rows, held = [], 0
        for k, pieces in sorted(open_.items()):
            rows += [(d, x, a, s, m, k, None, None, i) for i, (d, a, s, m, x) in enumerate(pieces)]
        if rows:
            yield batch_of(rows)

    return run


_PIECE = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end: int = END,
    slack: float = SLACK,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    A document is the ids of its text by the vocabulary at ``path`` and the end id; ``start`` counts its ids before the
    piece, ``doc_tokens`` all of them, ``offset`` the ids before the piece in its sequence, and ``ids`` holds the piece as
    little-endian unsigned 32-bit integers. Each id is in exactly one piece. Sequences are numbered from 0 without gaps,
    their pieces lie side by side from offset 0 and hold at most ``capacity`` ids. All but a fixed number of sequences
    (one for each class at most) hold at least ``1 - slack`` of it, and those hold all of it or a power of two.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they are there; ids of documents may
    be null or repeated. Other columns aren't read. An empty table gives no rows. Which pieces share a sequence depends
    on how the rows lie in partitions; the cuts don't, but for the few of the last step.
    """
    if capacity < 1 or not 0 <= slack < 1:
        raise ValueError("capacity must be at least 1, slack from 0 to under 1")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"start long, length long, doc_tokens long, klass long, bin long, offset long, place long, doc_id {kind}, part long, ids binary"
    filled = materialise(docs.mapInArrow(_filler(path, end, capacity, slack), schema), "filled")

    # Sequences filled by the tasks: numbered through by a prefix sum over the tasks.
    made = filled.filter("bin IS NOT NULL")
    bins = made.groupBy("part").agg((F.max("bin") + 1).alias("bins"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(bins.select("part", "bins", F.coalesce(F.sum("bins").over(before), F.lit(0)).alias("base")), "bases")
    n_made = bases.agg(F.sum("bins")).first()[0] or 0
    own = made.join(F.broadcast(bases), "part").withColumn("sequence_id", F.col("base") + F.col("bin"))  # a row per task

    # Pieces left by the tasks: numbered by class, every k of class k are a sequence.
    left = filled.filter("bin IS NULL").drop("bin", "offset").withColumn("one", F.lit(1).cast("long"))
    left = materialise(running(left, ["klass", "part", "place"], {"before": "one"}, "left"), "left")
    classes = left.groupBy("klass").agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("least"))
    classes = classes.withColumn("full", F.floor(F.col("n") / F.col("klass"))).orderBy("klass").collect()  # at most `capacity` rows
    facts, n_full = [], 0
    for r in classes:
        facts.append((r["klass"], r["least"], r["full"], n_made + n_full))
        n_full += r["full"]
    facts = docs.sparkSession.createDataFrame(facts, "klass long, least long, full long, base long")
    ranked = left.join(F.broadcast(facts), "klass").withColumn("rank", F.col("before") - F.col("least"))
    ranked = ranked.withColumn("bin", F.expr("rank div klass"))
    inside = Window.partitionBy("klass", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    joint = ranked.filter("bin < full").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    joint = joint.withColumn("sequence_id", F.col("base") + F.col("bin"))

    # The rest, under one sequence for each class: end to end.
    order = Window.orderBy("klass", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = ranked.filter("bin >= full").withColumn("at", F.coalesce(F.sum("length").over(order), F.lit(0)))
    n_rest = rest.agg(F.sum("length")).first()[0] or 0
    bounds, low = [], 0
    for size in [capacity] * (n_rest // capacity) + tail(n_rest % capacity):
        bounds.append(F.struct(F.lit(low).alias("low"), F.lit(low + size).alias("high"), F.lit(n_made + n_full + len(bounds)).alias("id")))
        low += size
    pieces = own.select(*_PIECE).unionByName(joint.select(*_PIECE))
    if not bounds:
        return pieces
    crossed = F.filter(F.array(*bounds), lambda b: (b["low"] < F.col("at") + F.col("length")) & (b["high"] > F.col("at")))
    rest = rest.withColumn("b", F.explode(crossed))
    rest = rest.withColumn("skip", F.greatest(F.col("b.low") - F.col("at"), F.lit(0)).cast("long"))
    rest = rest.withColumn("size", (F.least(F.col("at") + F.col("length"), "b.high") - F.col("at") - F.col("skip")).cast("long"))
    rest = rest.select(
        "doc_id",
        (F.col("start") + F.col("skip")).alias("start"),
        F.col("size").alias("length"),
        "doc_tokens",
        F.col("b.id").cast("long").alias("sequence_id"),
        (F.col("at") + F.col("skip") - F.col("b.low")).alias("offset"),
        F.substring("ids", (4 * F.col("skip") + 1).cast("int"), (4 * F.col("size")).cast("int")).alias("ids"),
    )
    return pieces.unionByName(rest)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad: int = END) -> DataFrame:
    """``sequence_id, n_tokens, ids`` from packed pieces: padded to the capacity, except at a power of two."""
    laid = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    power = F.bit_count("n_tokens") == 1
    padded = F.rpad(ids, 4 * capacity, F.lit(pad.to_bytes(4, "little")))
    return laid.select("sequence_id", "n_tokens", F.when(power, ids).otherwise(padded).alias("ids"))


def pieces_of(docs: DataFrame, path: str, **kw) -> DataFrame:
    """Packed pieces with the CRC-32 of their ids in place of the ids."""
    columns = [c for c in _PIECE if c != "ids"]
    return pack(docs, path, **kw).select(*columns, F.crc32("ids").alias("ids_crc32"))
