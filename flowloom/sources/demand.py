"""Demand-table scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OD_BATCH_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.IntegerType()),
        T.StructField("o", T.IntegerType()),
        T.StructField("d", T.IntegerType()),
        T.StructField("flow", T.DoubleType()),
    ]
)


def clean_demand(df: DataFrame, clip: bool = True) -> DataFrame:
    """Drop the diagonal and, unless told otherwise, lift negative flows to zero."""
    kept = df.filter(F.col("o") != F.col("d"))
    return kept.withColumn("flow", F.greatest("flow", F.lit(0.0))) if clip else kept


def read_base_od(spark: SparkSession, path: str, clip: bool = True) -> DataFrame:
    return clean_demand(spark.read.parquet(path), clip)


def read_od_batch(spark: SparkSession, path: str, max_samples: int | None = None) -> DataFrame:
    """Lazy scan of an OD batch; the sample bound is pushed into the scan."""
    df = spark.read.parquet(path)
    missing = {f.name for f in OD_BATCH_SCHEMA} - set(df.columns)
    if missing:
        raise ValueError(f"not an OD batch, columns missing: {sorted(missing)}")
    return df if max_samples is None else df.filter(F.col("sample_id") < max_samples)


def paired(od: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut both tables to the shorter one, comparing their last sample ids."""
    last = F.least(
        od.agg(F.max("sample_id")).scalar(),
        counts.agg(F.max("sample_id")).scalar(),
    )
    return od.filter(F.col("sample_id") <= last), counts.filter(F.col("sample_id") <= last)


def write_od_batch(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_catalog_csv(df: DataFrame, path: str) -> None:
    """One header CSV. Meant for catalogues (turns, per-turn statistics), which
    have one row per network element."""
    df.coalesce(1).write.option("header", True).csv(path)


def write_summary_json(df: DataFrame, path: str) -> None:
    """A one-row metrics table as a single JSON line."""
    df.coalesce(1).write.json(path)
