"""Small tables derived once per session and data folder.

Distances, the base table and the road network with its routes have the size of
the zone system. They are written once and shared, which also gives the planner
their true size. So are the demand batch and its counts, which every score and
statistic starts from: four joins over the line items are run once, not in each
branch of each plan. A change of the input files makes new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import assignment as A
from ..operators import network as N
from ..operators.reshape import od_pairs
from ..operators.spatial import distances
from ..session import materialise
from ..sources import fixtures as fx
from .sql_parts import K_PATHS, THETA

_MADE: dict[tuple, DataFrame] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the input tables, as the file system of the folder lists them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in listed))


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir), name)
    if key not in _MADE:
        _MADE[key] = materialise(build(), name)
    return _MADE[key]


def n_zones(spark: SparkSession, sf_dir: str) -> int:
    return fx.zones(spark, sf_dir).count()


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return od_pairs(spark, n_zones(spark, sf_dir))


def demand_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs routes are searched for: those with demand."""
    return base(spark, sf_dir).select("o", "d")


def dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone distances."""
    return _once(spark, sf_dir, "dist", lambda: distances(fx.zones(spark, sf_dir), n_zones(spark, sf_dir)))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base table, one row per demanded pair."""
    return _once(spark, sf_dir, "base", lambda: fx.base_od(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "edges", lambda: fx.edges(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return _once(spark, sf_dir, "turns", lambda: N.turning_movements(e, fx.connections(e)))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return _once(spark, sf_dir, "routes", lambda: N.k_shortest_paths(e, demand_pairs(spark, sf_dir), K_PATHS))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.logit_shares(routes(spark, sf_dir), THETA)


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = turns(spark, sf_dir), n_zones(spark, sf_dir)
    return _once(spark, sf_dir, "assignment", lambda: A.fractional_assignment(shares(spark, sf_dir), t, n))


def od(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demand batch."""
    return _once(spark, sf_dir, "od", lambda: fx.od_batch(spark, sf_dir))


def n_samples(spark: SparkSession, sf_dir: str) -> int:
    return od(spark, sf_dir).select("sample_id").distinct().count()


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turning counts of the demand batch."""
    make = lambda: A.turning_counts(od(spark, sf_dir), assignment(spark, sf_dir), n_zones(spark, sf_dir))
    return _once(spark, sf_dir, "counts", make)
