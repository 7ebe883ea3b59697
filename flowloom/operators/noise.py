"""Observation noise on turning counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import normal, with_poisson


def observation_noise(
    counts: DataFrame, model: str = "poisson", sigma: float = 0.05, scale: float = 1.0, seed: int = 42, family: str = "xx"
) -> DataFrame:
    """Add ``x_obs``: no noise, proportional Gaussian, or Poisson.

    A Poisson ``scale`` below one draws around ``scale * x`` and so lowers the mean.
    """
    x = F.greatest(F.col("x"), F.lit(0.0))
    keys = (F.col("sample_id"), F.col("turn_id"))
    if model == "none" or (model == "gaussian" and sigma <= 0):
        noisy = x
    elif model == "gaussian":
        z = normal(seed, "noise", *keys, sigma=sigma, family=family)
        noisy = F.greatest(x + z * F.greatest(x, F.lit(1.0)), F.lit(0.0))
    elif model == "poisson":
        rate = x if scale >= 1.0 - 1e-12 else x * F.lit(float(scale))
        drawn = with_poisson(counts, "x_obs", rate, seed, "noise", keys, family=family)
        return drawn.withColumn("x_obs", F.col("x_obs").cast("double"))
    else:
        raise ValueError(f"unknown noise model: {model}")
    return counts.withColumn("x_obs", noisy)
