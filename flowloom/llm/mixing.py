"""Mixing sources to target weights: size per source, capped targets, repetition rates, hash-seeded copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import WORD, packed, running, unpacked
from flowloom.session import materialise

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 7


def words_in(text: str) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``weight`` and ``target`` to rows ``source, source_size`` (one per source).

    Sources by code point, null last, take the weights in turn. All sizes are shared by weight; a target stops at
    ``most`` times its source's size and the excess is shared by weight among the rest, until none is above. With a
    common level L = (what is left) / (weights left) that means target = min(most * size, L * weight), so each round
    is one sum over the sources, and the driver sees two numbers.
    """
    order = ["_null", "source"]
    ranked = running(
        sources.withColumn("_null", F.col("source").isNull()).withColumn("_one", F.lit(1)), order, {"_rank": "_one"}, "sources"
    )
    turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = materialise(ranked.select("source", "source_size", turn.alias("weight")), "weights")
    cap = F.col("source_size") * most

    def level(capped: Column) -> tuple[int, int]:
        row = table.agg(
            F.sum("source_size"),
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
        ).first()
        return (row[0] or 0) - row[1], row[2]

    def above(left: int, weight: int) -> Column:
        """The source's share at this level reaches its cap; compared in whole numbers."""
        wide = "decimal(38,0)"
        return cap.cast(wide) * F.lit(weight).cast("decimal(18,0)") <= F.lit(left).cast(wide) * F.col("weight").cast("decimal(18,0)")

    left, weight = level(F.lit(False))
    while True:
        now = level(above(left, weight))
        if now == (left, weight) or not now[1]:
            break
        left, weight = now
    share = (F.lit(left) * F.col("weight")).cast("double") / F.lit(max(weight, 1)).cast("double")
    return table.withColumn("target", F.when(above(left, weight), cap.cast("double")).otherwise(share))


def uniform(key: Column, seed: int = SEED) -> Column:
    """Draw in [0, 1) that depends on seed and key alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(rate: Column, key: Column, seed: int = SEED) -> Column:
    """floor(rate) copies plus one with probability equal to the fraction."""
    whole = F.floor(rate)
    return (whole + F.when(uniform(key, seed) < rate - whole, 1).otherwise(0)).cast("long")


def _rates(sized: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return materialise(targets(sources, weights, most), "targets")


def _with_rates(sized: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """Documents with their source's target and their copies. The planner broadcasts the sources only if they are
    small; else it shuffles both sides and splits a hot source."""
    on = F.col("source").eqNullSafe(F.col("_source"))
    joined = sized.join(rates.withColumnRenamed("source", "_source"), on)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return joined.withColumn("_copies", copies(rate, F.col("_key"), seed))


def mixture(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``; taken counts repeats.

    Null and empty texts have size 0 and take nothing. A null source is a source of its own, the last. Documents
    without a doc_id share one draw, rows repeated with one doc_id too. An empty table gives no rows. The draws depend
    on seed and doc_id alone, so reruns agree. Other columns aren't read.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(text).alias("size"))
    sized = materialise(sized.withColumn("_key", F.col("doc_id")), "sizes")
    mixed = _with_rates(sized, _rates(sized, weights, most), seed)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``docs`` with each row as many times as the mixture takes it; columns stay as they are."""
    sized = docs.select(F.col(source).alias("source"), words_in(text).alias("size"))
    rates = _rates(sized, weights, most).select(F.col("source").alias("_s"), "source_size", "target")
    kept = packed(docs, source=F.col(source), _key=F.col(doc_id))
    mixed = _with_rates(kept, rates.withColumnRenamed("_s", "source"), seed).filter("_copies > 0")
    again = mixed.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_i"))
    return unpacked(again, docs)
