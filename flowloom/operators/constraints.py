"""Projection of estimated cells onto the feasible demand set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import softplus
from .raking import rake

#: Names of the constraint strategies, in reporting order (fixed values).
STRATEGIES = ("none", "relu", "softplus", "clip", "clip_ipf")


def constrain(cells: DataFrame, support: DataFrame | None = None, zero_diagonal: bool = True, value: str = "flow") -> DataFrame:
    """Clip at zero, zero the diagonal, zero everything outside ``support(o, d)``."""
    clipped = F.greatest(F.col(value), F.lit(0.0))
    out = cells.withColumn(value, F.when(F.col("o") != F.col("d"), clipped).otherwise(0.0) if zero_diagonal else clipped)
    return out if support is None else _mask(out, support, value)


def _mask(cells: DataFrame, support: DataFrame, value: str) -> DataFrame:
    flagged = cells.join(support.select("o", "d").distinct().withColumn("_in", F.lit(True)), ["o", "d"], "left")
    return flagged.withColumn(value, F.when(F.col("_in"), F.col(value)).otherwise(0.0)).drop("_in")


def apply_strategy(
    cells: DataFrame,
    strategy: str,
    support: DataFrame | None = None,
    row_target: DataFrame | None = None,
    col_target: DataFrame | None = None,
    tol: float = 1e-2,
    max_iter: int = 50,
) -> DataFrame:
    """``sample_id, o, d, flow`` plus what was done: ``strategy, clipped, ipf_applied``."""
    kept = cells.select("sample_id", "o", "d", "flow")
    raked = False
    if strategy == "none":
        out = kept
    elif strategy == "softplus":
        smooth = kept.withColumn("flow", F.when(F.col("o") != F.col("d"), softplus(F.col("flow"))).otherwise(0.0))
        out = smooth if support is None else _mask(smooth, support, "flow")
    elif strategy in ("relu", "clip", "clip_ipf"):
        out = constrain(kept, support)
        if strategy == "clip_ipf" and row_target is not None and col_target is not None:
            out, raked = rake(out, row_target, col_target, tol, max_iter).select("sample_id", "o", "d", "flow"), True
    else:
        raise ValueError(f"unknown constraint strategy: {strategy}")
    return out.withColumns(
        {
            "strategy": F.lit(strategy),
            "clipped": F.lit(strategy in ("clip", "clip_ipf")),
            "ipf_applied": F.lit(raked),
        }
    )


def ablation_cells(
    predictions: DataFrame, truth: DataFrame, support: DataFrame | None = None, tol: float = 1e-2, max_iter: int = 50
) -> DataFrame:
    """All strategies applied to one model's cells; raking targets are the true marginals.

    ``predictions`` and ``truth`` hold ``sample_id, o, d, flow``; predictions dense.
    """
    rows = truth.groupBy("sample_id", "o").agg(F.sum("flow").alias("target"))
    cols = truth.groupBy("sample_id", "d").agg(F.sum("flow").alias("target"))
    out = None
    for s in STRATEGIES:
        part = apply_strategy(predictions, s, support, rows, cols, tol, max_iter)
        out = part if out is None else out.unionByName(part)
    return out
