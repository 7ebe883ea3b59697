"""Cell tables, index arithmetic and dense vectors.

A cell table is long and sparse (``sample_id, o, d, flow``; an absent cell is
zero). A vector table has one row per sample with ``y ARRAY<DOUBLE>`` of
``n_zones ** 2`` entries in row-major order. Zones are numbered from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def od_index(n_zones: int) -> Column:
    return ((F.col("o") - 1) * n_zones + (F.col("d") - 1)).cast("int")


def origin_of(index: Column, n_zones: int) -> Column:
    return (F.floor(index / n_zones) + 1).cast("int")


def destination_of(index: Column, n_zones: int) -> Column:
    return (index % n_zones + 1).cast("int")


def od_pairs(spark: SparkSession, n_zones: int) -> DataFrame:
    """``od_index, o, d`` for all ordered pairs, counted off by a range."""
    idx = F.col("id")
    return spark.range(n_zones * n_zones).select(
        idx.cast("int").alias("od_index"),
        origin_of(idx, n_zones).alias("o"),
        destination_of(idx, n_zones).alias("d"),
    )


def with_od_index(cells: DataFrame, n_zones: int) -> DataFrame:
    return cells.withColumn("od_index", od_index(n_zones))


def pack(rows: DataFrame, index: Column, value: str, size: int, name: str = "y") -> DataFrame:
    """``sample_id, name``: long rows to dense vectors of ``size`` entries.

    Only stored entries are shuffled; the zeros between them are filled in per
    row. A row holds at most ``size`` entries by the data model.
    """
    entry = F.struct(index.alias("i"), F.col(value).alias("v"))
    packed = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    before = lambda pos: F.when(pos == 0, F.lit(-1)).otherwise(F.get("e", pos - 1)["i"])
    runs = F.transform(
        "e", lambda x, pos: F.concat(F.array_repeat(F.lit(0.0), x["i"] - before(pos) - 1), F.array(x["v"]))
    )
    tail = F.array_repeat(F.lit(0.0), F.lit(size - 1) - F.element_at("e", -1)["i"])
    return packed.select("sample_id", F.concat(F.flatten(runs), tail).alias(name))


def flatten(cells: DataFrame, n_zones: int, value: str = "flow") -> DataFrame:
    """Cell table to vector table."""
    return pack(cells, od_index(n_zones), value, n_zones * n_zones)


def unflatten(vectors: DataFrame, n_zones: int, vector: str = "y", value: str = "flow", keep: tuple = ()) -> DataFrame:
    """Vector table to a dense cell table."""
    return vectors.select("sample_id", *keep, F.posexplode(vector).alias("od_index", value)).select(
        "sample_id",
        *keep,
        origin_of(F.col("od_index"), n_zones).alias("o"),
        destination_of(F.col("od_index"), n_zones).alias("d"),
        value,
    )


def densify(cells: DataFrame, n_zones: int, samples: DataFrame | None = None) -> DataFrame:
    """Every cell of every sample, zeros included.

    Each sample explodes its own zero cells and a group-by merges them with the
    stored ones, so nothing is joined.
    """
    ids = cells.select("sample_id").distinct() if samples is None else samples
    zero = ids.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n_zones * n_zones - 1))).alias("i")).select(
        "sample_id",
        origin_of(F.col("i"), n_zones).alias("o"),
        destination_of(F.col("i"), n_zones).alias("d"),
        F.lit(0.0).alias("flow"),
    )
    return (
        zero.unionByName(cells.select("sample_id", "o", "d", "flow"))
        .groupBy("sample_id", "o", "d")
        .agg(F.sum("flow").alias("flow"))
    )


def sparsify(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("flow") != 0)


def transpose(cells: DataFrame) -> DataFrame:
    others = [c for c in cells.columns if c not in ("o", "d")]
    return cells.select(*others, F.col("d").alias("o"), F.col("o").alias("d"))


def off_diagonal(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("o") != F.col("d"))


def mask_to_support(cells: DataFrame, support: DataFrame) -> DataFrame:
    """Keep only cells listed in ``support(o, d)``."""
    return cells.join(support.select("o", "d"), ["o", "d"], "left_semi")


def zero_diagonal(cells: DataFrame) -> DataFrame:
    return cells.withColumn("flow", F.when(F.col("o") != F.col("d"), F.col("flow")).otherwise(0.0))
