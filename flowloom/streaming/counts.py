"""Structured Streaming twins of the chunked count generation.

The sources are folders of Parquet files with one row per sample. There is no
event time: a sample is complete when it arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assignment import apply_operator
from ..session import is_small, scratch_path

OD_STREAM = "sample_id INT, y ARRAY<DOUBLE>"
COUNT_STREAM = "sample_id INT, x ARRAY<DOUBLE>"


def read_vectors(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_stats(counts: DataFrame) -> DataFrame:
    """``turn_id, count, mean, std, cv`` so far; state is one row per turn.

    Works on a stream (complete or update mode) and on a batch alike.
    """
    n, s, ss = F.count("*"), F.sum("x"), F.sum(F.col("x") * F.col("x"))
    mean = s / n
    std = F.sqrt(F.greatest(ss / n - mean * mean, F.lit(0.0)))
    return (
        counts.select(F.posexplode("x").alias("turn_id", "x"))
        .groupBy("turn_id")
        .agg(n.alias("count"), mean.alias("mean"), std.alias("std"), (std / (mean + 1e-9)).alias("cv"))
    )


def run_running_stats(spark: SparkSession, source: str, target: str | None = None) -> DataFrame:
    """Drain the source folder and return the final statistics.

    Each trigger rewrites ``batch=<id>``; the last one holds the totals.
    """
    target = target or scratch_path(spark, "stats")

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = running_stats(read_vectors(spark, source, COUNT_STREAM))
    query = (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", scratch_path(spark, "stream"))
        .foreachBatch(put)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    done = spark.read.parquet(target)
    return done.filter(F.col("batch") == done.agg(F.max("batch")).scalar()).drop("batch")


def run_counts(spark: SparkSession, source: str, assignment: DataFrame, target: str | None = None) -> DataFrame:
    """Turn arriving demand vectors into turning counts, each sample once.

    Every micro-batch is a plain sparse product with the static assignment; its
    output folder is named by the batch id, so a replayed batch overwrites itself.
    """
    target = target or scratch_path(spark, "counts")
    small = is_small(assignment)  # once, not in every micro-batch

    def put(batch: DataFrame, batch_id: int) -> None:
        cells = batch.select("sample_id", F.posexplode("y").alias("od_index", "flow")).filter(F.col("flow") != 0)
        counts = apply_operator(cells, assignment, "od_index", "turn_id", small=small)
        counts.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        read_vectors(spark, source, OD_STREAM)
        .writeStream.option("checkpointLocation", scratch_path(spark, "stream"))
        .foreachBatch(put)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(target).drop("batch")
