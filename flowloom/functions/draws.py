"""Random columns seeded by keys.

Every draw is a pure function of (seed, stream, keys), so a row gets the same
number under any partitioning, retry or executor loss. Two hash families:

* ``md5``: portable, the same integer can be computed in plain SQL elsewhere;
* ``xx``: 64-bit xxhash, far cheaper, for bulk generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = float(2**52)


def _as_column(key) -> Column:
    return key if isinstance(key, Column) else F.lit(key)


def uniform(seed: int, stream: str, *keys, family: str = "md5") -> Column:
    """Uniform in (0, 1), never exactly 0 or 1."""
    parts = [F.lit(seed), F.lit(stream), *(_as_column(k) for k in keys)]
    if family == "md5":
        digest = F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 13)
        whole = F.conv(digest, 16, 10).cast("double")
    elif family == "xx":
        whole = F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double")
    else:
        raise ValueError(f"unknown hash family: {family}")
    return (whole + 0.5) / F.lit(_BITS)


def normal(seed: int, stream: str, *keys, mu: float = 0.0, sigma: float = 1.0, family: str = "md5") -> Column:
    """Normal draw by the Box-Muller transform of two uniforms."""
    u1 = uniform(seed, stream + ".r", *keys, family=family)
    u2 = uniform(seed, stream + ".a", *keys, family=family)
    z = F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return F.lit(float(mu)) + F.lit(float(sigma)) * z


def half_gamma(seed: int, stream: str, *keys, scale: float = 1.0, floor: float = 1e-30, family: str = "md5") -> Column:
    """Gamma(1/2, scale): exactly half a squared normal times the scale."""
    z = normal(seed, stream, *keys, family=family)
    return F.greatest(F.lit(float(scale)) * z * z / 2.0, F.lit(floor))


def _gamma_try(i, seed: int, stream: str, keys: tuple, family: str) -> tuple[Column, Column]:
    """Normal and log-uniform of try ``i`` (a number or a column)."""
    return (
        normal(seed, stream + ".n", *keys, i, family=family),
        F.log(uniform(seed, stream + ".u", *keys, i, family=family)),
    )


def with_log_gamma(
    df: DataFrame,
    name: str,
    shape: Column,
    seed: int,
    stream: str,
    keys: tuple,
    quick: int = 3,
    tries: int = 16,
    family: str = "xx",
) -> DataFrame:
    """Add the logarithm of a Gamma(shape, 1) draw, for any positive shape.

    Marsaglia-Tsang rejection. A try is accepted with probability above 0.95, so
    the first ``quick`` tries are compiled one projection per step and the rest
    run as an array expression that only the few refused rows evaluate; sixteen
    tries leave less than 1e-20. Shapes below one are boosted by U^(1/shape),
    added in log space so that tiny shapes do not underflow.
    """
    kept = df.columns
    d, c = F.col("_d"), F.col("_c")
    out = df.withColumn("_shape", shape)
    out = out.withColumn("_d", F.when(F.col("_shape") < 1.0, F.col("_shape") + 1.0).otherwise(F.col("_shape")) - 1.0 / 3.0)
    out = out.withColumn("_c", 1.0 / F.sqrt(9.0 * d)).withColumn("_g", F.lit(None).cast("double"))

    def log_v(x: Column) -> Column:
        return F.when(1.0 + c * x > 0, 3.0 * F.log(1.0 + c * x))

    def fits(x: Column, lv: Column, log_u: Column) -> Column:
        return F.coalesce(log_u < 0.5 * x * x + d * (1.0 - F.exp(lv) + lv), F.lit(False))

    for i in range(quick):
        open_row = F.col("_g").isNull()
        x, log_u = _gamma_try(i, seed, stream, keys, family)
        out = out.withColumn("_x", F.when(open_row, x))
        out = out.withColumn("_lv", F.when(open_row, log_v(F.col("_x"))))
        out = out.withColumn(
            "_g", F.when(open_row, F.when(fits(F.col("_x"), F.col("_lv"), log_u), F.col("_lv"))).otherwise(F.col("_g"))
        )

    def later(i: Column) -> Column:
        x, log_u = _gamma_try(i, seed, stream, keys, family)
        return F.when(fits(x, log_v(x), log_u), log_v(x))

    rest = F.filter(F.transform(F.sequence(F.lit(quick), F.lit(tries - 1)), later), lambda g: g.isNotNull())
    out = out.withColumn("_g", F.when(F.col("_g").isNull(), F.coalesce(F.get(rest, F.lit(0)), F.when(F.col("_shape").isNotNull(), F.raise_error(F.lit("no gamma draw within the tries; raise `tries`")).cast("double")))).otherwise(F.col("_g")))
    boost = F.log(uniform(seed, stream + ".b", *keys, family=family)) / F.col("_shape")
    drawn = F.log(d) + F.col("_g") + F.when(F.col("_shape") < 1.0, boost).otherwise(0.0)
    return out.select(*kept, drawn.alias(name))


def with_gamma(
    df: DataFrame,
    name: str,
    seed: int,
    stream: str,
    keys: tuple,
    shape: float = 0.5,
    scale: float = 1.0,
    floor: float = 1e-30,
    family: str = "md5",
) -> DataFrame:
    """Add a Gamma(shape, scale) draw, floored away from zero."""
    if shape <= 0 or scale <= 0:
        raise ValueError("gamma shape and scale must be positive")
    if shape == 0.5:
        return df.withColumn(name, half_gamma(seed, stream, *keys, scale=scale, floor=floor, family=family))
    drawn = with_log_gamma(df, name, F.lit(float(shape)), seed, stream, keys, family=family)
    return drawn.withColumn(name, F.greatest(F.lit(float(scale)) * F.exp(name), F.lit(floor)))


def _log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series; within 1e-8 from k = 5 on."""
    x = k + 1.0
    series = 1.0 / (12.0 * x) - 1.0 / (360.0 * x * x * x) + 1.0 / (1260.0 * x * x * x * x * x)
    return (x - 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2.0 * math.pi)) + series


def _poisson_walk(mean: Column, u: Column, limit: float) -> Column:
    """Inverse CDF for rates up to ``limit``; the tail left out is below 1e-25."""
    top = int(limit + 12 * math.sqrt(limit) + 20)
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        inside = acc["cdf"] < u
        return F.struct(
            p.alias("p"),
            F.when(inside, acc["cdf"] + p).otherwise(acc["cdf"]).alias("cdf"),
            (acc["k"] + F.when(inside, 1).otherwise(0)).alias("k"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(top)), start, step, lambda acc: acc["k"]).cast("long")


def with_poisson(
    df: DataFrame,
    name: str,
    rate: Column,
    seed: int,
    stream: str,
    keys: tuple,
    walk_below: float = 25.0,
    quick: int = 2,
    tries: int = 24,
    family: str = "xx",
) -> DataFrame:
    """Add a Poisson draw.

    Small rates walk the inverse CDF. Large ones use Hoermann's transformed
    rejection (1993): a try is accepted with probability above 0.8, the first
    ``quick`` are compiled and the rest run as an array expression for the rows
    refused so far. A row that all 24 tries refuse (below 1e-16) is an error, as any
    stand-in value would bend the distribution.
    """
    kept = df.columns
    r, a, b = F.col("_rate"), F.col("_a"), F.col("_b")
    out = df.withColumn("_rate", F.greatest(rate, F.lit(0.0)))
    out = out.withColumn("_w", uniform(seed, stream + ".w", *keys, family=family))
    walked = F.when(F.col("_rate") < walk_below, _poisson_walk(F.col("_rate"), F.col("_w"), walk_below))
    out = out.withColumn("_k", walked)
    out = out.withColumn("_b", F.when(F.col("_k").isNull(), 0.931 + 2.53 * F.sqrt("_rate")))
    out = out.withColumn("_a", -0.059 + 0.02483 * F.col("_b"))

    def candidate(u: Column) -> Column:
        return F.floor((2.0 * a / (0.5 - F.abs(u)) + b) * u + r + 0.43)

    def accepted(u: Column, v: Column, t: Column) -> Column:
        us, k = 0.5 - F.abs(u), F.greatest(t, F.lit(0))
        inside = (us >= 0.07) & (v <= 0.9277 - 3.6224 / (b - 2.0))
        refused = (t < 0) | ((us < 0.013) & (v > us))
        left = F.log(v * (1.1239 + 1.1328 / (b - 3.4)) / (a / (us * us) + b))
        return inside | (~refused & (left <= k * F.log(r) - r - _log_factorial(k)))

    def draws(i) -> tuple[Column, Column]:
        u = uniform(seed, stream + ".u", *keys, i, family=family) - 0.5
        return u, uniform(seed, stream + ".v", *keys, i, family=family)

    for i in range(quick):
        open_row = F.col("_k").isNull()
        u, v = draws(i)
        out = out.withColumn("_u", F.when(open_row, u)).withColumn("_v", F.when(open_row, v))
        out = out.withColumn("_t", F.when(open_row, candidate(F.col("_u"))))
        hit = F.when(accepted(F.col("_u"), F.col("_v"), F.col("_t")), F.col("_t"))
        out = out.withColumn("_k", F.when(open_row, hit).otherwise(F.col("_k")))

    def later(i: Column) -> Column:
        u, v = draws(i)
        return F.when(accepted(u, v, candidate(u)), candidate(u))

    rest = F.filter(F.transform(F.sequence(F.lit(quick), F.lit(tries - 1)), later), lambda k: k.isNotNull())
    last = F.coalesce(F.get(rest, F.lit(0)), F.raise_error(F.lit("no Poisson draw within the tries; raise `tries`")).cast("long"))
    out = out.withColumn("_k", F.when(F.col("_k").isNull(), last).otherwise(F.col("_k")))
    return out.select(*kept, F.col("_k").alias(name))
