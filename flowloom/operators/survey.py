"""Inference on the held-out survey table and how far it lies from training data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import uniform
from .linear import estimate
from .reshape import destination_of, origin_of


def estimate_cells(counts: DataFrame, operator: DataFrame, n_zones: int, by: tuple = ("sample_id",)) -> DataFrame:
    """``by..., o, d, y`` for every sample."""
    y = estimate(counts, operator, by)
    return y.select(*by, origin_of(F.col("od_index"), n_zones).alias("o"), destination_of(F.col("od_index"), n_zones).alias("d"), "y")


def _moments(rows: DataFrame, value: str, n: float) -> DataFrame:
    mean = F.sum(value) / n
    std = F.sqrt(F.greatest(F.sum(F.col(value) * F.col(value)) / n - mean * mean, F.lit(0.0)))
    return rows.agg(mean.alias("mean"), std.alias("std"))


def scale_shift(survey: DataFrame, train: DataFrame, value: str, n_survey: int, n_train: int) -> DataFrame:
    """Survey moments against training moments; absent entries are zeros."""
    s, t = _moments(survey, value, float(n_survey)), _moments(train, value, float(n_train))
    return s.select(
        "mean",
        "std",
        (F.col("mean") - t.select("mean").scalar()).alias("mean_shift_vs_train"),
        (F.col("std") / F.greatest(t.select("std").scalar(), F.lit(1e-6))).alias("std_ratio_vs_train"),
    )


def wasserstein(survey: DataFrame, train: DataFrame, keys: list, value: str, draws: int = 5_000, seed: int = 0) -> DataFrame:
    """Approximate Wasserstein-1 distance of two dense value sets.

    ``draws`` training values are chosen by hash and the survey's values are
    repeated in key order (or drawn by hash when it has more); both are sorted
    and compared rank by rank. Only these few values are ranked in one window.
    """
    order = lambda cols: W.orderBy(*cols)
    n = min(draws, train.count())
    picked = train.orderBy(uniform(seed, "w1.train", *(F.col(k) for k in keys)), *keys).limit(n)
    a = picked.select(F.row_number().over(order([value])).alias("r"), F.col(value).alias("a"))
    size = survey.count()
    if size < n:
        placed = survey.withColumn("i", F.row_number().over(order(keys)) - 1)
        times = F.lit(n // size) + (F.col("i") < n % size).cast("int")
        repeated = placed.select(value, F.explode(F.array_repeat(F.lit(1), times)))
    else:
        repeated = survey.orderBy(uniform(seed, "w1.survey", *(F.col(k) for k in keys)), *keys).limit(n)
    b = repeated.select(F.row_number().over(order([value])).alias("r"), F.col(value).alias("b"))
    return a.join(b, "r").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("wasserstein1"))
