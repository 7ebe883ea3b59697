"""Session set-up, lineage cutting and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Row bound below which a table may be broadcast. The tables that qualify
#: (zones, turns, operator entries) have short, fixed-width rows.
BROADCAST_ROWS = 1_000_000

#: Rows of both sides that a task of ``join_dealt`` sorts.
TASK_ROWS = 1_500_000


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the local benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("flowloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; on a cluster
    a missing setting is an error, because a machine-local folder would be lost
    with the executor that wrote it.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a shared folder")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/flowloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder. Call it when no table made so far is needed again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage durably (a lost executor costs a re-read, not a recompute)
    and gives Catalyst real file sizes for its own broadcast decisions.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` provably has at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``small`` only after its size was checked.

    Beyond the bound the planner shuffles both sides, with its adaptive
    skew-join split for heavy keys.
    """
    return big.join(F.broadcast(small) if is_small(small, max_rows) else small, on, how)


def join_dealt(left: DataFrame, right: DataFrame, on: str, rows: int) -> DataFrame:
    """Join of two large tables in as many tasks as ``rows``, the rows of both, need.

    With the session's shuffle partitions, fixed or merged up to a size, what a
    task sorts would grow with the tables. For keys with few rows each: the rows
    of one key meet in one task, whose sort spills.
    """
    n = max(1, -(-rows // TASK_ROWS))
    return left.repartition(n, on).join(right.repartition(n, on), on)
