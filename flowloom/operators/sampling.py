"""Exact-size random subsets, pair samples and distributed ranks.

All randomness comes from hashes of keys, so a result does not depend on how
the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..session import materialise

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def sample_rows(df: DataFrame, size: int, key: str, seed: int = 42, stream: str = "rows") -> DataFrame:
    """``size`` rows without replacement, by smallest hash of ``key``."""
    return df.orderBy(uniform(seed, stream, F.col(key)), key).limit(size)


def sample_within(df: DataFrame, size: int, group: str, key: str, seed: int = 42, stream: str = "rows") -> DataFrame:
    """At most ``size`` rows of each group, by smallest hash of ``key``.

    The smallest are kept per task first, so a group as large as the table costs ``size`` rows a task.
    """
    ranked = df.withColumn("_u", uniform(seed, stream, F.col(key)))
    order = [F.col("_u"), F.col(key)]
    local = W.partitionBy(group, F.pmod(F.xxhash64(key), F.lit(64))).orderBy(*order)
    some = ranked.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= size)
    return some.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= size).drop("_u", "_r")


def row_numbers(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Global row number from 1 without a single-task sort.

    Range-sorts on the full ordering (ties are split by its last key, so a
    heavy value spreads over tasks), writes the sorted rows once, and adds each
    sorted partition's offset. Pass narrow tables: keys and the sort columns.
    """
    placed = materialise(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", _LOCAL_BITS)
    # one row per sorted partition, so this window is as small as the number of tasks
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_offset"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND((1 << _LOCAL_BITS) - 1) + 1)
        .drop("_at", "_part", "_offset")
    )


def shuffled_ranks(ids: DataFrame, key: str, seed: int, stream: str, name: str = "rank") -> DataFrame:
    """A random permutation of the ids as ranks from 1."""
    keyed = ids.select(key, uniform(seed, stream, F.col(key)).alias("_u"))
    return row_numbers(keyed, ["_u", key], name).drop("_u")


def sample_pairs(spark: SparkSession, n: int, n_pairs: int, seed: int = 42, stream: str = "pairs") -> DataFrame:
    """``pair_id, i, j``: positions in 0..n-1, with replacement, never i = j."""
    p = F.col("pair_id")
    i = F.floor(uniform(seed, stream + ".i", p) * n)
    j = F.floor(uniform(seed, stream + ".j", p) * (n - 1))
    return (
        spark.range(n_pairs if n >= 2 else 0)
        .withColumnRenamed("id", "pair_id")
        .select("pair_id", i.cast("int").alias("i"), j.cast("int").alias("j0"))
        .select("pair_id", "i", (F.col("j0") + (F.col("j0") >= F.col("i")).cast("int")).alias("j"))
    )


def sample_features(features: DataFrame, key: str, size: int = 50, seed: int = 42, stream: str = "features") -> DataFrame:
    """At most ``size`` feature ids."""
    return sample_rows(features.select(key).distinct(), size, key, seed, stream)
