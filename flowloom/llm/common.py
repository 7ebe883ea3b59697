"""Text and ordering helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.operators import vectors  # noqa: F401  makes functions of this package travel by value
from flowloom.session import materialise

#: A word is a run of anything but ASCII white space. On UTF-8 bytes this is what ``bytes.split()`` yields.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: Column) -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast of a bounded object, sent with its class, so that executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(sent: Broadcast):
    return cloudpickle.loads(sent.value)


def packed(docs: DataFrame, **named: Column) -> DataFrame:
    """The rows of ``docs`` as one struct ``_doc`` beside the named columns, so that no names can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *[c.alias(k) for k, c in named.items()])


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` back from packed rows, those named in ``changed`` replaced."""
    return rows.select(*[changed.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: list[str], sums: dict[str, str], label: str = "running") -> DataFrame:
    """Add exclusive prefix sums over the total order of ``order``: ``{new column: summed column}``.

    Rows are dealt by range, summed inside each range, and shifted by the sums of the ranges before it.
    The table of ranges has one row per shuffle partition, so its own running sum is small by construction.
    The order must be total (ties share a range but have no order of their own).
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(parts(spark), *order).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, label)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{new}") for new, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "_range", *[F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_b_{new}") for new in sums]
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{new}") for new, c in sums.items()])
    out = out.join(F.broadcast(bases), "_range")
    return out.select(*df.columns, *[(F.col(f"_i_{new}") + F.col(f"_b_{new}")).alias(new) for new in sums])
