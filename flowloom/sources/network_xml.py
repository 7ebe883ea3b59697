"""Road-network XML ingest through Spark's built-in XML source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

JUNCTION_XML = "_id STRING, _x DOUBLE, _y DOUBLE"
EDGE_XML = (
    "_id STRING, _from STRING, _to STRING, _function STRING, "
    "lane ARRAY<STRUCT<_length: DOUBLE, _speed: DOUBLE>>"
)
CONNECTION_XML = "_from STRING, _to STRING"


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def read_junctions(spark: SparkSession, path: str) -> DataFrame:
    """Real junctions only: ids with a leading colon are internal."""
    return (
        _rows(spark, path, "junction", JUNCTION_XML)
        .filter(~F.col("_id").startswith(":"))
        .select(
            F.col("_id").alias("id"),
            F.coalesce("_x", F.lit(0.0)).alias("x"),
            F.coalesce("_y", F.lit(0.0)).alias("y"),
        )
    )


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Regular edges with the first lane's length and speed.

    An edge without a lane or with a speed that is not positive fails the job.
    """
    lane = F.get("lane", F.lit(0))
    bad_lane = F.raise_error(F.concat(F.lit("edge without lane: "), "_id"))
    bad_speed = F.raise_error(F.concat(F.lit("edge with non-positive speed: "), "_id"))
    length = F.when(lane.isNull(), bad_lane.cast("double")).otherwise(lane["_length"])
    speed = (
        F.when(lane.isNull(), bad_lane.cast("double"))
        .when(lane["_speed"] <= 0, bad_speed.cast("double"))
        .otherwise(lane["_speed"])
    )
    return (
        _rows(spark, path, "edge", EDGE_XML)
        .filter(F.coalesce(F.col("_function") != "internal", F.lit(True)))
        .select(
            F.col("_id").alias("edge_id"),
            F.col("_from").alias("from_j"),
            F.col("_to").alias("to_j"),
            length.alias("length"),
            speed.alias("speed"),
        )
        .withColumn("time", F.col("length") / F.col("speed"))
    )


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    return (
        _rows(spark, path, "connection", CONNECTION_XML)
        .filter((F.col("_from") != "") & (F.col("_to") != ""))
        .select(F.col("_from").alias("from_edge"), F.col("_to").alias("to_edge"))
    )


def routable_edges(edges: DataFrame, order: str = "edge_id") -> DataFrame:
    """One edge per junction pair; of parallel edges the last by ``order`` stays."""
    w = W.partitionBy("from_j", "to_j").orderBy(F.desc(order))
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def write_network_xml(junctions: DataFrame, edges: DataFrame, connections: DataFrame, path: str) -> None:
    """Write the three element kinds as XML files below one folder."""

    def put(df: DataFrame, tag: str) -> None:
        df.write.format("xml").option("rootTag", "net").option("rowTag", tag).save(f"{path}/{tag}")

    put(junctions.select(F.col("id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y")), "junction")
    lane = F.array(F.struct(F.col("length").alias("_length"), F.col("speed").alias("_speed")))
    put(
        edges.select(
            F.col("edge_id").alias("_id"),
            F.col("from_j").alias("_from"),
            F.col("to_j").alias("_to"),
            lane.alias("lane"),
        ),
        "edge",
    )
    put(connections.select(F.col("from_edge").alias("_from"), F.col("to_edge").alias("_to")), "connection")
