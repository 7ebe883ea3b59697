"""Scalar formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_weight(metric: str) -> Column:
    """Routing weight of an edge row: ``length`` or ``time``."""
    if metric not in ("length", "time"):
        raise ValueError(f"unknown edge weight: {metric}")
    return F.col(metric)


def distance_impedance(
    dist: Column, decay: str = "exponential", lambda_decay: float = 500.0, power_gamma: float = 1.5
) -> Column:
    """Decreasing weight of a distance, before the diagonal is zeroed."""
    if decay == "exponential":
        if lambda_decay <= 0:
            raise ValueError("lambda_decay must be positive")
        return F.exp(-dist / F.lit(float(lambda_decay)))
    if decay == "power":
        if power_gamma <= 0:
            raise ValueError("power_gamma must be positive")
        return F.pow(dist + 1.0, F.lit(-float(power_gamma)))
    raise ValueError(f"unknown decay: {decay}")


def off_diagonal(value: Column) -> Column:
    """``value`` off the diagonal, zero on it."""
    return F.when(F.col("o") != F.col("d"), value).otherwise(0.0)


def noise_scale(percent: Column) -> Column:
    """Poisson scale for a nominal noise percentage."""
    return F.when(percent <= 0, 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - percent / 100.0))


def softplus(y: Column) -> Column:
    """log(1 + e^y) without overflow."""
    return F.when(y > 20, y).otherwise(F.log1p(F.exp(F.greatest(F.least(y, F.lit(20.0)), F.lit(-20.0)))))


def guarded_corr(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """Aggregate Pearson correlation, NULL when either side is constant."""
    return F.when((F.stddev_pop(a) >= floor) & (F.stddev_pop(b) >= floor), F.corr(a, b))


def corr_from_sums(n: Column, sa: Column, sb: Column, saa: Column, sbb: Column, sab: Column, floor: float) -> Column:
    """Pearson correlation from raw sums, NULL when a centred norm is below ``floor``.

    Lets absent (zero) cells count through ``n`` without being stored.
    """
    va = F.greatest(saa - sa * sa / n, F.lit(0.0))
    vb = F.greatest(sbb - sb * sb / n, F.lit(0.0))
    return F.when((F.sqrt(va) > floor) & (F.sqrt(vb) > floor), (sab - sa * sb / n) / F.sqrt(va * vb))


def fixed(value: Column, places: int = 6) -> Column:
    """Round for reporting; adding zero turns a negative zero into zero."""
    return F.round(value, places) + F.lit(0.0)
