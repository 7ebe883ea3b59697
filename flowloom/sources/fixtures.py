"""Example demand and network tables derived from the star-schema parquet files.

Zones sit on a 5-wide grid, 250 m apart, one per nation; one demand sample per
order month; flow between supplier zone and customer zone is shipped quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import is_small, join_dealt

GRID_STEP = 250.0
GRID_WIDTH = 5
FIRST_YEAR = 1995
#: The one sample treated as the observed survey in hold-out queries.
SURVEY_SAMPLE = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``zone INT, x DOUBLE, y DOUBLE``."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        (key + 1).cast("int").alias("zone"),
        (GRID_STEP * (key % GRID_WIDTH)).cast("double").alias("x"),
        (GRID_STEP * F.floor(key / GRID_WIDTH)).cast("double").alias("y"),
    )


def _attach(rows: DataFrame, n_rows: int, dimension: DataFrame, on: str) -> DataFrame:
    """Join with a table of one row per key: broadcast while it is small, else dealt over tasks."""
    if is_small(dimension):
        return rows.join(F.broadcast(dimension), on)
    return join_dealt(rows, dimension, on, n_rows + dimension.count())


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, o, d, l_quantity``, one row per line item.

    Orders get their customer's zone first, so line items are sorted once, in
    tasks of a bounded number of rows.
    """
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_suppkey").alias("supplier"), "l_quantity")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order"),
        F.col("o_custkey").alias("customer"),
        ((F.year("o_orderdate") - FIRST_YEAR) * 12 + F.month("o_orderdate") - 1).cast("int").alias("sample_id"),
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), (F.col("c_nationkey") + 1).cast("int").alias("d"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), (F.col("s_nationkey") + 1).cast("int").alias("o"))
    n_items, n_orders = items.count(), orders.count()
    placed = _attach(orders, n_orders, customers, "customer").select("order", "sample_id", "d")
    shipped = join_dealt(items, placed, "order", n_items + n_orders)
    return _attach(shipped, n_items, suppliers, "supplier").select("sample_id", "o", "d", "l_quantity")


def raw_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncleaned demand: diagonal cells present, some flows negative."""
    return (
        _shipments(spark, sf_dir)
        .groupBy("sample_id", "o", "d")
        .agg(F.sum(F.col("l_quantity") - 25.0).alias("flow"))
    )


def od_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id INT, o INT, d INT, flow DOUBLE``, off-diagonal, sparse."""
    return (
        _shipments(spark, sf_dir)
        .filter(F.col("o") != F.col("d"))
        .groupBy("sample_id", "o", "d")
        .agg(F.sum("l_quantity").alias("flow"))
    )


def base_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o INT, d INT, flow DOUBLE``: all samples summed."""
    return (
        _shipments(spark, sf_dir)
        .filter(F.col("o") != F.col("d"))
        .groupBy("o", "d")
        .agg(F.sum("l_quantity").alias("flow"))
    )


def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones(spark, sf_dir).select(F.concat(F.lit("J"), "zone").alias("id"), "x", "y")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed grid links; neighbours found by an equi-join on shifted coordinates."""
    z = zones(spark, sf_dir)
    step = F.lit(GRID_STEP)
    shifts = F.array(
        F.struct(step.alias("dx"), F.lit(0.0).alias("dy")),
        F.struct((-step).alias("dx"), F.lit(0.0).alias("dy")),
        F.struct(F.lit(0.0).alias("dx"), step.alias("dy")),
        F.struct(F.lit(0.0).alias("dx"), (-step).alias("dy")),
    )
    near = z.select(F.col("zone").alias("za"), "x", "y", F.explode(shifts).alias("s")).select(
        "za", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")
    )
    pairs = near.join(z.withColumnRenamed("zone", "zb"), ["x", "y"])
    length = (250 + ((F.col("za") * 7 + F.col("zb") * 13) % 41)).cast("double")
    speed = (10 + 5 * ((F.col("za") + F.col("zb")) % 3)).cast("double")
    return pairs.select(
        F.concat(F.lit("E"), "za", F.lit("_"), "zb").alias("edge_id"),
        F.concat(F.lit("J"), "za").alias("from_j"),
        F.concat(F.lit("J"), "zb").alias("to_j"),
        length.alias("length"),
        speed.alias("speed"),
        (length / speed).alias("time"),
    )


def connections(edge_table: DataFrame) -> DataFrame:
    """Consecutive links, U-turns left out."""
    e = edge_table.select(F.col("edge_id").alias("from_edge"), "from_j", F.col("to_j").alias("via"))
    f = edge_table.select(F.col("edge_id").alias("to_edge"), F.col("from_j").alias("via"), "to_j")
    return e.join(f, "via").filter(F.col("from_j") != F.col("to_j")).select("from_edge", "to_edge")
