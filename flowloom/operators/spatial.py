"""Distances, decay priors, gravity interaction and latent zone factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import normal, uniform, with_gamma
from ..functions.scalars import distance_impedance
from ..session import join_small
from .reshape import od_pairs


def zone_coordinates(junctions: DataFrame) -> DataFrame:
    """Zone k sits at junction ``Jk``."""
    return junctions.filter(F.col("id").rlike("^J[0-9]+$")).select(
        F.substring("id", 2, 10).cast("int").alias("zone"), "x", "y"
    )


def distances(zones: DataFrame, n_zones: int) -> DataFrame:
    """``o, d, dist`` for all ordered pairs: two equi-joins on the pair index."""
    pairs = od_pairs(zones.sparkSession, n_zones).select("o", "d")
    a = zones.select(F.col("zone").alias("o"), F.col("x").alias("xo"), F.col("y").alias("yo"))
    b = zones.select(F.col("zone").alias("d"), F.col("x").alias("xd"), F.col("y").alias("yd"))
    dx, dy = F.col("xo") - F.col("xd"), F.col("yo") - F.col("yd")
    joined = join_small(join_small(pairs, a, "o"), b, "d")
    return joined.select("o", "d", F.sqrt(dx * dx + dy * dy).alias("dist"))


def distance_epsilon(dist: DataFrame, beta: float = 1.0, lambda_decay: float = 500.0) -> DataFrame:
    """``o, d, dist, eps``: additive prior mass, zero on the diagonal."""
    if beta < 0:
        raise ValueError("beta must be non-negative")
    if lambda_decay <= 0:
        raise ValueError("lambda_decay must be positive")
    eps = F.lit(float(beta)) * F.exp(-F.col("dist") / F.lit(float(lambda_decay)))
    return dist.withColumn("eps", F.when(F.col("o") != F.col("d"), eps).otherwise(0.0))


def prior_od(base: DataFrame, dist: DataFrame, beta: float = 1.0, lambda_decay: float = 500.0) -> DataFrame:
    """``o, d, dist, eps, prior``: observed flow plus epsilon, diagonal zero."""
    eps = distance_epsilon(dist, beta, lambda_decay)
    flow = base.filter(F.col("o") != F.col("d")).select("o", "d", "flow")
    return eps.join(flow, ["o", "d"], "left").select(
        "o", "d", "dist", "eps", (F.coalesce("flow", F.lit(0.0)) + F.col("eps")).alias("prior")
    )


def base_probability(base: DataFrame, dist: DataFrame, beta: float = 1.0, lambda_decay: float = 500.0) -> DataFrame:
    """``o, d, dist, eps, p, total_demand``: prior normalised over the support.

    Fails when the demand or the prior has no mass, or a support cell no probability.
    """
    prior = prior_od(base, dist, beta, lambda_decay)
    mass = prior.agg(F.sum("prior")).scalar()
    demand = base.filter(F.col("o") != F.col("d")).agg(F.coalesce(F.sum("flow"), F.lit(0.0))).scalar()
    p = F.when(mass > 0, F.col("prior") / mass).otherwise(F.raise_error(F.lit("prior has no mass")).cast("double"))
    total = F.when(demand > 0, demand).otherwise(F.raise_error(F.lit("base demand is zero")).cast("double"))
    checked = F.when((F.col("o") != F.col("d")) & (F.col("p") <= 0), F.raise_error(F.lit("support cell without probability")).cast("double"))
    return (
        prior.select("o", "d", "dist", "eps", p.alias("p"), total.alias("total_demand"))
        .withColumn("p", checked.otherwise(F.col("p")))
    )


def seed_to_probability(seed: DataFrame, value: str = "flow") -> DataFrame:
    """Normalise each sample over the off-diagonal cells; uniform when it has no mass.

    ``seed`` must hold every support cell of a sample.
    """
    cells = seed.filter(F.col("o") != F.col("d"))
    w = W.partitionBy("sample_id")
    total = F.sum(value).over(w)
    share = F.when(total > 0, F.col(value) / total).otherwise(1.0 / F.count("*").over(w))
    return cells.withColumn("p", share)


def impedance(
    dist: DataFrame, decay: str = "exponential", lambda_decay: float = 500.0, power_gamma: float = 1.5
) -> DataFrame:
    """``o, d, f``."""
    f = distance_impedance(F.col("dist"), decay, lambda_decay, power_gamma)
    return dist.select("o", "d", F.when(F.col("o") != F.col("d"), f).otherwise(0.0).alias("f"))


def gravity_seed(factors: DataFrame, friction: DataFrame) -> DataFrame:
    """``sample_id, o, d, flow`` = u_o * v_d * f_od off the diagonal.

    ``factors(sample_id, zone, u, v)``; each origin row meets its own row of
    ``friction`` (equi-join on o), then picks up v (equi-join on sample and d).
    """
    u = factors.select("sample_id", F.col("zone").alias("o"), "u")
    v = factors.select("sample_id", F.col("zone").alias("d"), "v")
    support = friction.filter(F.col("o") != F.col("d"))
    out = join_small(u, support, "o").join(v, ["sample_id", "d"])
    return out.select("sample_id", "o", "d", F.greatest(F.col("u") * F.col("v") * F.col("f"), F.lit(0.0)).alias("flow"))


def reciprocity(seed: DataFrame, rho: float) -> DataFrame:
    """(1 - rho) S + rho S^T per sample, rho held within [0, 0.5].

    Each cell contributes to itself and to its mirror, and one group-by adds
    the two parts, so no self-join is needed.
    """
    rho = min(max(float(rho), 0.0), 0.5)
    if rho <= 0:
        return seed
    part = lambda o, d, w: F.struct(F.col(o).alias("o"), F.col(d).alias("d"), (F.col("flow") * w).alias("w"))
    return (
        seed.filter(F.col("o") != F.col("d"))
        .select("sample_id", F.explode(F.array(part("o", "d", 1.0 - rho), part("d", "o", rho))).alias("c"))
        .groupBy("sample_id", F.col("c.o").alias("o"), F.col("c.d").alias("d"))
        .agg(F.greatest(F.sum("c.w"), F.lit(0.0)).alias("flow"))
    )


def gravity(
    factors: DataFrame,
    dist: DataFrame,
    decay: str = "exponential",
    lambda_decay: float = 500.0,
    power_gamma: float = 1.5,
    rho: float = 0.35,
) -> DataFrame:
    return reciprocity(gravity_seed(factors, impedance(dist, decay, lambda_decay, power_gamma)), rho)


def spatial_kernel(dist: DataFrame, length: float) -> DataFrame:
    """``o, d, k``: Gaussian weights, each origin's summing to one; identity when length <= 0."""
    if length <= 0:
        return dist.select("o", "d", F.when(F.col("o") == F.col("d"), 1.0).otherwise(0.0).alias("k"))
    raw = F.when(F.col("o") == F.col("d"), 1.0).otherwise(
        F.exp(-(F.col("dist") * F.col("dist")) / F.lit(2.0 * float(length) ** 2))
    )
    total = F.sum("raw").over(W.partitionBy("o"))
    return dist.select("o", "d", raw.alias("raw")).select(
        "o", "d", (F.col("raw") / F.greatest(total, F.lit(1e-15))).alias("k")
    )


def smooth_factors(
    factors: DataFrame, dist: DataFrame, columns: tuple = ("u", "v"), length: float = 400.0, strength: float = 0.5
) -> DataFrame:
    """Blend each zone's factors with their kernel average; floor at 1e-12."""
    s = min(max(float(strength), 0.0), 1.0)
    floor = lambda c: F.greatest(c, F.lit(1e-12))
    if s <= 0 or length <= 0:
        return factors.select("sample_id", "zone", *(floor(F.col(c)).alias(c) for c in columns))
    kernel = spatial_kernel(dist, length).filter(F.col("k") > 0)
    spread = join_small(factors.withColumnRenamed("zone", "d"), kernel, "d")
    own = lambda c: F.when(F.col("o") == F.col("d"), F.lit(1.0 - s) * F.col(c)).otherwise(0.0)
    return spread.groupBy("sample_id", F.col("o").alias("zone")).agg(
        *(floor(F.sum(own(c) + F.lit(s) * F.col("k") * F.col(c))).alias(c) for c in columns)
    )


def type_centres(samples: DataFrame, zones: DataFrame, n_zones: int, latent: int, seed: int, jitter: float = 50.0) -> DataFrame:
    """``sample_id, t, cx, cy``: a random zone plus normal jitter per type."""
    t = F.explode(F.sequence(F.lit(0), F.lit(latent - 1))).alias("t")
    s = F.col("sample_id")
    pick = (F.floor(uniform(seed, "centre", s, F.col("t"), family="xx") * n_zones) + 1).cast("int")
    placed = join_small(samples.select("sample_id", t).withColumn("zone", pick), zones, "zone")
    return placed.select(
        "sample_id",
        "t",
        (F.col("x") + normal(seed, "centre.x", s, F.col("t"), sigma=jitter, family="xx")).alias("cx"),
        (F.col("y") + normal(seed, "centre.y", s, F.col("t"), sigma=jitter, family="xx")).alias("cy"),
    )


def memberships(centres: DataFrame, zones: DataFrame, n_zones: int, carry: tuple = ()) -> DataFrame:
    """``sample_id, zone, t, m``: row softmax of -dist^2 / temperature.

    The temperature is a quarter of the sample's median squared distance, at
    least 1. Each centre lists the zones by itself, then joins their coordinates.
    """
    listed = centres.withColumn("zone", F.explode(F.sequence(F.lit(1), F.lit(n_zones))))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    d2 = join_small(listed, zones, "zone").select("sample_id", "zone", "t", *carry, (dx * dx + dy * dy).alias("d2"))
    by_sample, by_row = W.partitionBy("sample_id"), W.partitionBy("sample_id", "zone")
    temp = F.greatest(F.median("d2").over(by_sample) * 0.25, F.lit(1.0))
    logit = d2.withColumn("z", -F.col("d2") / temp)
    e = logit.withColumn("e", F.exp(F.col("z") - F.max("z").over(by_row)))
    return e.select("sample_id", "zone", "t", *carry, (F.col("e") / F.greatest(F.sum("e").over(by_row), F.lit(1e-15))).alias("m"))


def zone_factors(member: DataFrame, intensities: DataFrame) -> DataFrame:
    """``sample_id, zone, u, v`` from ``intensities(sample_id, t, prod, attr)``."""
    return (
        member.join(intensities, ["sample_id", "t"])
        .groupBy("sample_id", "zone")
        .agg(F.sum(F.col("m") * F.col("prod")).alias("u"), F.sum(F.col("m") * F.col("attr")).alias("v"))
    )


def type_intensities(samples: DataFrame, latent: int, seed: int, shape: float = 2.0, scale: float = 1.0) -> DataFrame:
    t = F.explode(F.sequence(F.lit(0), F.lit(latent - 1))).alias("t")
    keys = (F.col("sample_id"), F.col("t"))
    out = samples.select("sample_id", t)
    for name in ("prod", "attr"):
        out = with_gamma(out, name, seed, name, keys, shape=shape, scale=scale, family="xx")
    return out


def latent_factors(
    samples: DataFrame,
    zones: DataFrame,
    dist: DataFrame,
    n_zones: int,
    latent: int = 4,
    seed: int = 42,
    shape: float = 2.0,
    scale: float = 1.0,
    length: float = 400.0,
    strength: float = 0.5,
) -> DataFrame:
    """``sample_id, zone, u, v`` for every sample at once."""
    member = memberships(type_centres(samples, zones, n_zones, latent, seed), zones, n_zones)
    raw = zone_factors(member, type_intensities(samples, latent, seed, shape, scale))
    return smooth_factors(raw, dist, ("u", "v"), length, strength)


def mean_trip_length(cells: DataFrame, dist: DataFrame) -> DataFrame:
    """``sample_id, trip_length``: flow-weighted mean distance, NULL without mass."""
    mass = F.sum("flow")
    joined = join_small(cells, dist, ["o", "d"])
    return joined.groupBy("sample_id").agg(
        F.when(mass > 0, F.try_divide(F.sum(F.col("flow") * F.col("dist")), mass)).alias("trip_length")
    )


