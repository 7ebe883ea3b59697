"""Train/validation/test splits, leakage checks, scaling and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import shuffled_ranks


def split_ids(ids: DataFrame, train: float = 0.70, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """``sample_id, split``: random exact-size split; the remainder goes to test."""
    if abs(train + val + test - 1.0) > 1e-9:
        raise ValueError("fractions must sum to 1")
    ranked = shuffled_ranks(ids.select("sample_id"), "sample_id", seed, "split")
    n = ids.count()
    n_train, n_val = round(n * train), round(n * val)
    if n - n_train - n_val < 0:
        raise ValueError("invalid split sizes")
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return ranked.select("sample_id", split.alias("split"))


def overlaps(splits: DataFrame) -> DataFrame:
    """Ids that occur more than once; empty for a proper split."""
    return splits.groupBy("sample_id").agg(F.count("*").alias("n")).filter("n > 1")


def leakage_report(splits: DataFrame, survey_id: int, fingerprint: str | None = None, forward: DataFrame | None = None) -> DataFrame:
    """Split sizes, disjointness, and that the survey is in none of them (else the job fails).

    ``fingerprint`` names the operator; ``forward`` is the one row of ``forward_check``, of which the samples checked,
    the largest error and the verdict are reported.
    """
    size = lambda s: F.count_if(F.col("split") == s).alias(f"n_{s}")
    inside = F.count_if(F.col("sample_id") == survey_id) > 0
    checked = F.when(inside, F.raise_error(F.lit("survey sample found in a development split")).cast("boolean")).otherwise(True)
    return splits.agg(
        size("train"),
        size("val"),
        size("test"),
        (F.count("*") == F.count_distinct("sample_id")).alias("splits_disjoint"),
        F.lit(survey_id).alias("survey_id"),
        checked.alias("survey_excluded"),
        F.lit(fingerprint).cast("string").alias("operator_sha256"),
        *(forward.select(c).scalar().alias(f"forward_{c}") for c in ("n_checked", "max_abs_err", "allclose") if forward is not None),
    )


def table_fingerprint(rows: DataFrame, columns: list) -> DataFrame:
    """``rows, sha256``: order-free fingerprint of a table.

    Row digests are grouped by their first six hex digits, sorted and hashed;
    the group digests are grouped by four, two and no digits in turn. A group
    then holds a sixteen-millionth of the rows, or at most 256 digests.
    """
    level = rows.select(F.sha2(F.concat_ws("|", *columns), 256).alias("h"), F.lit(1).cast("long").alias("n"))
    for digits in (6, 4, 2, 0):
        level = (
            level.groupBy(F.substring("h", 1, digits).alias("p"))
            .agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
            .select(F.concat("p", "d").alias("h"), "n")
        )
    return level.select(F.col("n").alias("rows"), F.col("h").alias("sha256"))


def fit_scaler(rows: DataFrame, feature: str, value: str, n_samples: int) -> DataFrame:
    """``feature, mean, scale`` from training rows: population deviation, 1 where
    it is zero. Absent rows count as zeros."""
    n = F.lit(float(n_samples))
    mean = F.sum(value) / n
    var = F.greatest(F.sum(F.col(value) * F.col(value)) / n - mean * mean, F.lit(0.0))
    # below the rounding noise of the sums a feature counts as constant
    flat = var <= 1e-13 * (F.sum(F.col(value) * F.col(value)) / n)
    return rows.groupBy(feature).agg(mean.alias("mean"), F.when(flat, 1.0).otherwise(F.sqrt(var)).alias("scale"))


def scale(rows: DataFrame, scaler: DataFrame, feature: str, value: str) -> DataFrame:
    """Standardise dense rows."""
    return rows.join(scaler, feature).withColumn(value, (F.col(value) - F.col("mean")) / F.col("scale")).drop("mean", "scale")


def unscale(rows: DataFrame, scaler: DataFrame, feature: str, value: str) -> DataFrame:
    return rows.join(scaler, feature).withColumn(value, F.col(value) * F.col("scale") + F.col("mean")).drop("mean", "scale")


def capped_holdout(ids: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """``sample_id, part``: at most ``cap`` random ids, of which the last
    max(32, a tenth) are held out."""
    kept = shuffled_ranks(ids.select("sample_id"), "sample_id", seed, "cap").filter(F.col("rank") <= cap)
    n = min(ids.count(), cap)
    hold = max(32, int(0.1 * n))
    return kept.select("sample_id", F.when(F.col("rank") > n - hold, "hold").otherwise("fit").alias("part"))
