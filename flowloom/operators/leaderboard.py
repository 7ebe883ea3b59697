"""Model references, families, rankings and the leaderboard table.

These tables have one row per model and split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scoring import composite

# The family each model name belongs to.
FAMILIES = {
    "moore_penrose": "operator",
    "tikhonov": "operator",
    "ridge": "classical",
    "physics_ridge": "classical",
    "pls": "classical",
    "mlp": "neural",
    "residual_mlp": "neural",
    "physics_residual_mlp": "neural",
    "ae_32": "autoencoder",
    "ae_64": "autoencoder",
    "ae_128": "autoencoder",
    "ae_64_finetune": "autoencoder",
    "nullspace_mlp": "neural",
}

# Leaderboard columns in output order.
TEXT_COLUMNS = ("model", "family", "best_hyperparameters", "constraint_strategy")
LEADERBOARD_COLUMNS = (
    "model",
    "family",
    "parameters",
    "train_samples",
    "val_samples",
    "test_samples",
    "best_hyperparameters",
    "constraint_strategy",
    "train_time",
    "inference_time",
    "mae",
    "rmse",
    "r2",
    "pearson",
    "spearman",
    "relative_error",
    "forward_mae",
    "forward_rmse",
    "forward_r2",
    "production_mae",
    "production_rmse",
    "attraction_mae",
    "attraction_rmse",
    "total_demand_error",
    "negative_cells",
    "diagonal_violation",
    "sparsity_error",
    "composite_score",
)
REFERENCE_COLUMNS = ("mae", "forward_mae", "production_mae", "attraction_mae")


def validation_references(scores: DataFrame) -> DataFrame:
    """One row: the mean of each reference metric over the validation rows, 1 if undefined."""
    val = scores.filter(F.col("split") == "val")
    return val.agg(*(F.coalesce(F.avg(c), F.lit(1.0)).alias(c) for c in REFERENCE_COLUMNS))


def with_composite(scores: DataFrame, references: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.5, gamma: float = 0.5) -> DataFrame:
    """Add ``composite_score`` and ``family``."""
    refs = None if references is None else {c: references.select(c).scalar() for c in REFERENCE_COLUMNS}
    families = scores.sparkSession.createDataFrame(list(FAMILIES.items()), "model string, family string")
    out = scores.withColumn("composite_score", composite(alpha, beta, gamma, refs))
    return out.join(F.broadcast(families), "model", "left").withColumn("family", F.coalesce("family", F.lit("other")))


def rankings(scores: DataFrame, split: str = "test") -> DataFrame:
    """Four rank columns: cells, forward, marginals, overall."""
    rows = scores.filter(F.col("split") == split).withColumn("marginal_mae", F.col("production_mae") + F.col("attraction_mae"))
    rank = lambda c: F.row_number().over(W.partitionBy("split").orderBy(F.asc_nulls_last(c), "model"))
    return rows.select(
        "model",
        rank("mae").alias("od_rank"),
        rank("forward_mae").alias("forward_rank"),
        rank("marginal_mae").alias("marginal_rank"),
        rank("composite_score").alias("overall_rank"),
    )


def leaderboard(scores: DataFrame) -> DataFrame:
    """Test rows with the fixed columns, missing ones NULL, by cell error."""
    rows = scores.filter(F.col("split") == "test")

    def column(name: str):
        if name in rows.columns:
            return F.col(name)
        return F.lit(None).cast("string" if name in TEXT_COLUMNS else "double").alias(name)

    return rows.select(*(column(c) for c in LEADERBOARD_COLUMNS)).orderBy(F.asc_nulls_last("mae"), "model")


def best_model(scores: DataFrame, split: str = "test", prefix: str | None = None) -> DataFrame:
    """The model with the smallest cell error, optionally among names with a prefix."""
    rows = scores.filter(F.col("split") == split)
    if prefix is not None:
        rows = rows.filter(F.col("model").startswith(prefix))
    return rows.agg(F.min_by("model", "mae").alias("model"), F.min("mae").alias("mae"))
