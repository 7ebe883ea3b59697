"""Predictions and scores kept by model, so that a later run scores only what is new.

Both are folders of Parquet files with one partition per model. A write replaces
the partitions of the models it holds and no others.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scoring import all_scores

PART = "part"


def _part(model: Column) -> Column:
    """Folder value of a model; the prefix keeps names such as ``007`` from being read as numbers."""
    return F.concat(F.lit("model-"), model)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def put(rows: DataFrame, path: str) -> None:
    """Write ``rows(model, ...)`` under ``path``; models that are there already are replaced. Names are not null."""
    by_model = rows.withColumn(PART, _part(F.col("model"))).write.partitionBy(PART)
    by_model.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def stored_predictions(spark: SparkSession, path: str, id_type: str = "int") -> DataFrame:
    schema = f"model string, split string, sample_id {id_type}, o int, d int, y double, {PART} string"
    return spark.read.schema(schema).parquet(path)


def score_stored(
    predictions_path: str, scores_path: str, truth: DataFrame, counts: DataFrame, assignment: DataFrame,
    samples: DataFrame, n_zones: int, n_turns: int, again: Iterable[str] = (), **options,
) -> DataFrame:
    """Scores of all stored models, as ``all_scores`` gives them; only models without scores are computed.

    Finished models are left out by an anti-join of names, one row a model, and the rest prune the partitions that are
    read. ``again`` names models to score anew, such as those whose predictions were replaced. A run that is cut off
    leaves no scores of the models it was at, so the next one takes them up. Without stored rows there are no scores.
    """
    spark = truth.sparkSession
    stored = stored_predictions(spark, predictions_path, dict(truth.dtypes)["sample_id"])
    names = stored.select(PART).distinct()
    if _exists(spark, scores_path):
        redo = [f"model-{m}" for m in again]
        done = spark.read.parquet(scores_path).select(PART).distinct().filter(~F.col(PART).isin(redo))
        names = names.join(done, PART, "left_anti")
    new = [r[PART] for r in names.collect()]
    scores = all_scores(stored.filter(F.col(PART).isin(new)).drop(PART), truth, counts, assignment, samples, n_zones, n_turns, **options)
    if new:
        put(scores, scores_path)
    if not _exists(spark, scores_path):
        return scores
    return spark.read.parquet(scores_path).drop(PART)
