"""The join over line items: whole, and in tasks of a bounded number of rows."""

import pytest
from pyspark.sql import functions as F

from flowloom import session
from flowloom.sources import fixtures as fx


@pytest.mark.parametrize("small", [True, False])
def test_tasks_of_the_line_item_join_stay_bounded(spark, sf, monkeypatch, small):
    """Each task of the join gets about TASK_ROWS rows, however few shuffle partitions the session has."""
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    if not small:  # customers and suppliers too large for a broadcast
        monkeypatch.setattr(fx, "is_small", lambda _: False)
    shipped = fx._shipments(spark, sf)
    per_task = [r["n"] for r in shipped.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    items = fx.table(spark, sf, "lineitem")
    assert sum(per_task) == items.count()
    if small:  # else the ten suppliers decide
        assert len(per_task) > 8 and max(per_task) < 2_000
    want = (
        items.join(fx.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(fx.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(fx.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            ((F.year("o_orderdate") - fx.FIRST_YEAR) * 12 + F.month("o_orderdate") - 1).cast("int"),
            F.col("s_nationkey") + 1, F.col("c_nationkey") + 1, "l_quantity",
        )
    )
    assert shipped.exceptAll(want).isEmpty() and want.exceptAll(shipped).isEmpty()


def test_dealt_join_of_empty_tables_and_null_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    other = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "k int, w string")
    assert sorted(map(tuple, session.join_dealt(rows, other, "k", 6).collect())) == [(1, "a", "x"), (1, "b", "x")]
    assert session.join_dealt(rows.limit(0), other.limit(0), "k", 0).isEmpty()
