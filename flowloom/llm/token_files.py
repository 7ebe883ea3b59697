"""Token-id files: flat unsigned ids, 64-bit document offsets, read back by memory map.

A data set is a folder of shards in doc_id order. ``N.bin`` holds the ids of its documents end to end as unsigned
little-endian integers of ``width`` bytes, ``N.idx`` the 64-bit index of each document's first id in the whole data set
and one more for the end. Documents are dealt by doc_id range, each task writes its shard, and the shards' bases are the
prefix sums of their sizes. A shard is written under a name of its attempt and renamed when complete, so a lost or
repeated task leaves the same files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import parts
from flowloom.llm.lm import release
from flowloom.llm.tokens import encoder
from flowloom.session import materialise, scratch_path

END = 2
#: Bytes of text that a shard is made for where the data set is large; one task writes a shard.
SHARD_BYTES = 256 << 20
_SHARD = "shard long, row long, doc_id long, n_tokens long, width int"
_DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long"
_FLUSH = 4 << 20


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder named by URI or plain path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _write_shard(folder: str, path: str, end: int):
    """Function for mapInArrow that writes its partition's ids and returns a row per document."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        last = end.to_bytes(enc.width, "little")
        store, root = _open(folder)
        shard, out, row = None, None, 0
        for batch in batches:
            ids, sizes = [], []
            for part, text in zip(batch["part"], batch["text"], strict=True):
                if out is None:
                    shard = part.as_py()
                    store.create_dir(root, recursive=True)
                    draft = f"{root}/{shard}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(draft, buffer_size=_FLUSH)
                data = enc.encode(text.as_py() or "") + last
                out.write(data)
                sizes.append(len(data) // enc.width)
            n = len(sizes)
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard] * n, pa.int64()),
                    "row": pa.array(range(row, row + n), pa.int64()),
                    "doc_id": batch["doc_id"].cast(pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "width": pa.array([enc.width] * n, pa.int32()),
                }
            )
            row += n
        if out is not None:
            out.close()
            store.move(draft, f"{root}/{shard}.bin")
        release()

    return write


def _finish_shard(folder: str):
    """Function for mapInArrow over a shard's documents in row order: writes offsets, reads ids back, sums them up."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        shard, index, data, base, draft, stop = None, None, None, 0, "", 0
        for batch in batches:
            starts, sizes, sums = batch["start"].to_numpy(), batch["n_tokens"].to_numpy(), []
            for part, start, n, width in zip(batch["shard"].to_pylist(), starts.tolist(), sizes.tolist(), batch["width"].to_pylist(), strict=True):
                if part != shard:
                    if index is not None:
                        _close(store, index, stop, draft, root, shard)
                    shard, base = part, start
                    draft = f"{root}/{shard}.{uuid.uuid4().hex}"
                    index, data = store.open_output_stream(draft), _reader(store, f"{root}/{shard}.bin")
                index.write(np.int64(start).tobytes())
                stop = start + n
                ids = np.frombuffer(data((start - base) * width, n * width), f"<u{width}")
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"],
                    "start": batch["start"],
                    "n_tokens": batch["n_tokens"],
                    "ids_crc32": pa.array(sums, pa.int64()),
                    "shard": batch["shard"],
                }
            )
        if index is not None:
            _close(store, index, stop, draft, root, shard)

    return finish


def _close(store: pafs.FileSystem, index, stop: int, draft: str, root: str, shard: int) -> None:
    index.write(np.int64(stop).tobytes())
    index.close()
    store.move(draft, f"{root}/{shard}.idx")


def _reader(store: pafs.FileSystem, path: str):
    """Function (offset, size) to bytes: a memory map where the store is a file system, ranged reads elsewhere."""
    if isinstance(store, pafs.LocalFileSystem):
        mapped = np.memmap(path, np.uint8, "r")
        return lambda at, size: mapped[at : at + size]
    opened = store.open_input_file(path)
    return lambda at, size: opened.read_at(size, at)


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as a data set in ``folder`` and return, read from its files, one row per document:

    ``doc_id, start, n_tokens, ids_crc32, shard``: ids of all documents before it, its ids with the end id, and the
    CRC-32 of those ids as little-endian unsigned 32-bit integers.

    Documents are in ascending doc_id order, null first; rows with one doc_id follow each other by text. Null and
    empty texts are the end id alone. ``path`` names the vocabulary file, ``folder`` a folder that all executors reach
    (by default a fresh one in the shared folder). There are as
    many shards as shuffle partitions, or more, so that one gets about SHARD_BYTES of text. An empty table writes no shard. Other columns aren't read.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), content.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = rows.repartitionByRange(max(parts(spark), -(-size // SHARD_BYTES)), "doc_id")
    ranged = ranged.sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id().cast("long"))
    written = materialise(ranged.mapInArrow(_write_shard(folder, path, end), _SHARD), "shards")

    # Bases: prefix sums over the shards, one row each.
    sizes = written.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = written.join(F.broadcast(bases), "shard").withColumn(
        "start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    )
    placed = placed.select("shard", "row", "doc_id", "start", "n_tokens", "width")
    return materialise(placed.mapInArrow(_finish_shard(folder), _DOCUMENT), "tokens-index")
