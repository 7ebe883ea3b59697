"""Centroid clustering of integer vectors by bit planes.

A vector of integers is kept as bit planes in two's complement: plane ``i`` holds bit ``i`` of every component, 64
components to an unsigned word. With the weight ``2**i`` of a plane (negative for the highest), the product of two
vectors is the weighted sum of the popcounts of the ANDs of their planes, so distances are exact integers. A cluster's
component sums are the weighted counts of the bits of its members.

The packed table is written once. A round reads it, sends the centroids' planes to every task and takes back one row
per task, cluster and component sum; only the final sums (centroids x components) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.session import materialise

COMPONENTS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3
#: Integers must stay below this, so that the squared distance of two vectors of 64 components fits a long.
LIMIT = 1 << 27
#: Entries of the table of ANDs that a task holds at a time.
_CELLS = 1 << 21


def bits_needed(least: int, most: int) -> int:
    """Planes that hold all integers from ``least`` to ``most`` in two's complement."""
    return 1 + max(least.bit_length() if least >= 0 else (-least - 1).bit_length(), most.bit_length() if most >= 0 else (-most - 1).bit_length())


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Planes of integer vectors: rows x ``bits`` x words of 64 components (missing ones are 0)."""
    rows, width = values.shape
    words = -(-width // 64)
    shifted = (values.astype(np.int64)[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    spread = np.zeros((rows, bits, words * 64), np.uint8)
    spread[:, :, :width] = shifted
    return np.packbits(spread, axis=2, bitorder="little").view("<u8")


def weights(bits: int) -> np.ndarray:
    """Value of a set bit in each plane."""
    w = np.int64(1) << np.arange(bits, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def products(planes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows with all centroids, both given as planes."""
    rows, bits, words = planes.shape
    k, other, _ = centroids.shape
    weight = np.multiply.outer(weights(bits), weights(other)).reshape(-1)
    out = np.zeros((rows, k), np.int64)
    step = max(1, _CELLS // max(1, bits * other * k))
    right = centroids.transpose(2, 0, 1)[:, None, :, None, :]  # words, -, centroids, -, planes
    for i in range(0, rows, step):
        left = planes[i : i + step].transpose(2, 0, 1)[:, :, None, :, None]
        for w in range(words):
            ones = np.bitwise_count(left[w] & right[w])
            out[i : i + step] += ones.reshape(-1, k, bits * other) @ weight
    return out


def nearest(planes: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; of equally near ones the smaller number."""
    low, high = int(centroids.min()), int(centroids.max())
    apart = products(planes, pack(centroids, bits_needed(low, high)))
    far = norms[:, None] - 2 * apart + (centroids * centroids).sum(axis=1)[None, :]
    at = far.argmin(axis=1)
    return at, far[np.arange(len(far)), at]


def bit_sums(planes: np.ndarray, cluster: np.ndarray, k: int, width: int) -> np.ndarray:
    """Component sums of each cluster, from the number of set bits in each plane."""
    rows, bits, words = planes.shape
    out = np.zeros((k, width), np.int64)
    for c in range(k):
        mine = planes[cluster == c]
        for i in range(0, len(mine), 4096):
            ones = np.unpackbits(mine[i : i + 4096].view(np.uint8), axis=2, bitorder="little")
            out[c] += weights(bits) @ ones.sum(axis=0, dtype=np.int64)[:, :width]
    return out


def usable(vector: Column, components: int) -> Column:
    """True for vectors of exactly so many components, none of them null, NaN or infinite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == components) & fine, F.lit(False))


def _packer(bits: int, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch["q"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            planes = pack(values, bits)
            flat = pa.array(planes.reshape(-1).view(np.int64))
            ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * (planes.shape[1] * planes.shape[2]))
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array((values * values).sum(axis=1)), pa.ListArray.from_arrays(ends, flat)],
                ["vec_id", "norm", "planes"],
            )

    return run


def _planes(batch: pa.RecordBatch, bits: int) -> np.ndarray:
    return batch["planes"].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, bits, -1)


def _partial_sums(bits: int, centroids: np.ndarray) -> Callable:
    """Function for mapInArrow: one row per cluster with its members in this task and their component sums."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                planes = _planes(batch, bits)
                at, _ = nearest(planes, batch["norm"].to_numpy(), centroids)
                n += np.bincount(at, minlength=k)
                sums += bit_sums(planes, at, k, width)
        ends = pa.array(np.arange(k + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(sums.reshape(-1)))],
            ["cluster", "n", "sums"],
        )

    return run


def _assigner(bits: int, centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, far = nearest(_planes(batch, bits), batch["norm"].to_numpy(), centroids)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(at.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return run


def _moved(packed: DataFrame, bits: int, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor of the mean of the members, or as before where there are none."""
    part = packed.select("norm", "planes").mapInArrow(_partial_sums(bits, centroids), "cluster int, n long, sums array<long>")
    summed = part.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = centroids.copy()
    for r in summed.filter("n > 0").collect():  # centroids x components rows
        out[r["cluster"], r["at"]] = r["s"] // r["n"]
    return out


def cluster(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    seed: int = SEED,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """One row per usable vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    A vector is usable if it has exactly ``components`` components, none null, NaN or infinite; others give no row. Each
    component x becomes the integer floor(scale * x). Centroids start as the ``k`` vectors whose ``seed:vec_id`` has the
    least SHA-256, in that order (a null id counts as the text ``null``; of equal ids the lesser vector comes first), or
    as all vectors if they are fewer. After ``rounds`` of assignment and floored means, all vectors are assigned once
    more. Distances are squared and exact; ``cluster_inertia`` and ``inertia`` are their sums over the cluster and over
    all. Repeated rows count and come back as often as they are there; equally near centroids give the smaller number.
    An empty table, or one without usable vectors, gives no rows. Integers of 2**27 or more raise an error, as their
    squared distances would not fit a long. Other columns aren't read.
    """
    if k < 1 or rounds < 0 or components < 1:
        raise ValueError("k and components must be at least 1, rounds at least 0")
    spark, vector = vectors.sparkSession, F.col(embedding)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)))
    found = vectors.filter(usable(vector, components)).select(F.col(vec_id).alias("vec_id"), whole.alias("q"))
    id_type = found.schema["vec_id"].dataType.simpleString()
    low, high = found.agg(F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    if low is None:
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if max(-low, high) >= LIMIT:
        raise ValueError(f"integers from {low} to {high}; squared distances would not fit a long")
    bits = bits_needed(low, high)
    packed = materialise(found.mapInArrow(_packer(bits, components), f"vec_id {id_type}, norm long, planes array<long>"), "planes")

    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = found.select(name.alias("name"), "q").orderBy("name", "q").limit(k).collect()
    centroids = np.array([r["q"] for r in first], np.int64)
    for _ in range(rounds):
        centroids = _moved(packed, bits, centroids)

    placed = materialise(packed.mapInArrow(_assigner(bits, centroids), f"vec_id {id_type}, cluster int, distance long"), "placed")
    inertia = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    total = sum(inertia.values())
    named = [
        (c, d, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sorted(inertia.items())
    ]
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = placed.join(F.broadcast(facts), "cluster")  # at most k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
