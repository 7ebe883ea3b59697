from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import draws as D
from flowloom.operators import sampling as SA
from flowloom.operators import scenarios as SC
from flowloom.operators import spatial as SP


def _moments(df, col):
    r = df.agg(F.avg(col), F.var_pop(col), F.min(col)).first()
    return r[0], r[1], r[2]


@pytest.mark.parametrize("family", ["md5", "xx"])
def test_uniform_is_uniform_and_ignores_partitioning(spark, family):
    ids = spark.range(40_000)
    u = D.uniform(1, "t", F.col("id"), family=family)
    mean, var, low = _moments(ids.select(u.alias("u")), "u")
    assert abs(mean - 0.5) < 0.01 and abs(var - 1 / 12) < 0.005 and low > 0
    a = ids.repartition(1).select(F.sum(F.round(u * 1e6).cast("long"))).first()[0]
    b = ids.repartition(13).select(F.sum(F.round(u * 1e6).cast("long"))).first()[0]
    assert a == b


@pytest.mark.parametrize("shape", [0.05, 0.5, 2.0, 30.0])
def test_gamma_moments(spark, shape):
    df = D.with_gamma(spark.range(60_000), "g", 3, "t", (F.col("id"),), shape=shape, scale=1.5, family="xx")
    mean, var, low = _moments(df, "g")
    assert low > 0
    assert abs(mean - 1.5 * shape) < 6 * 1.5 * math.sqrt(shape / 60_000)
    assert abs(var / (2.25 * shape) - 1) < 0.25


def test_gamma_later_tries_agree_in_distribution(spark):
    """With no quick tries every row goes through the array expression."""
    df = D.with_log_gamma(spark.range(30_000), "g", F.lit(2.0), 3, "t", (F.col("id"),), quick=1)
    mean = df.select(F.avg(F.exp("g"))).first()[0]
    assert abs(mean - 2.0) < 0.05


@pytest.mark.parametrize("rate", [0.0, 0.3, 7.0, 24.9, 25.1, 400.0, 1e5])
def test_poisson_moments(spark, rate):
    df = D.with_poisson(spark.range(40_000), "k", F.lit(rate), 5, "t", (F.col("id"),))
    mean, var, low = _moments(df, "k")
    assert low >= 0
    assert abs(mean - rate) <= 6 * math.sqrt(max(rate, 1e-9) / 40_000)
    assert rate == 0.0 or abs(var / rate - 1) < 0.08


def test_draws_reject_bad_parameters(spark):
    with pytest.raises(ValueError):
        D.with_gamma(spark.range(1), "g", 1, "t", (F.col("id"),), shape=0.0)
    with pytest.raises(ValueError):
        D.uniform(1, "t", F.col("id"), family="other")


def test_dirichlet_sums_to_one_and_concentrates(spark, od):
    p = SP.seed_to_probability(od)
    gap = {}
    for alpha in (50.0, 5_000.0):
        drawn = SC.dirichlet(p, alpha, 42)
        sums = drawn.groupBy("sample_id").agg(F.sum("p").alias("s"))
        assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0
        both = drawn.join(p.select("sample_id", "o", "d", F.col("p").alias("q")), ["sample_id", "o", "d"])
        gap[alpha] = both.agg(F.avg(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert gap[5_000.0] < gap[50.0]


def test_row_sample_has_exact_size_and_pairs_differ(spark):
    ids = spark.range(1000).withColumnRenamed("id", "k")
    one = {r[0] for r in SA.sample_rows(ids, 37, "k").collect()}
    two = {r[0] for r in SA.sample_rows(ids.repartition(7), 37, "k").collect()}
    assert len(one) == 37 and one == two
    pairs = SA.sample_pairs(spark, 5, 2000)
    assert pairs.filter("i = j or i < 0 or i > 4 or j < 0 or j > 4").count() == 0
    assert pairs.select("i", "j").distinct().count() == 20
    assert SA.sample_pairs(spark, 1, 10).count() == 0


def test_row_numbers_are_a_permutation_despite_one_heavy_value(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") < 4000, 1.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = {r["id"]: r["rank"] for r in SA.row_numbers(df, ["v", "id"]).collect()}
    want = {i: n + 1 for n, i in enumerate(sorted(range(5000), key=lambda i: (1.0 if i < 4000 else float(i), i)))}
    assert got == want


def test_noise(spark):
    from flowloom.operators.noise import observation_noise

    x = spark.range(3000).select(F.col("id").alias("sample_id"), F.lit(0).alias("turn_id"), F.lit(200.0).alias("x"))
    assert observation_noise(x, "none").filter("x_obs <> x").count() == 0
    assert observation_noise(x, "gaussian", 0.0).filter("x_obs <> x").count() == 0
    noisy = observation_noise(x, "gaussian", 0.05).agg(F.stddev("x_obs"), F.min("x_obs")).first()
    assert abs(noisy[0] - 10.0) < 1.0 and noisy[1] >= 0
    lowered = observation_noise(x, "poisson", scale=0.7).agg(F.avg("x_obs")).first()[0]
    assert abs(lowered - 140.0) < 2.0
    with pytest.raises(ValueError):
        observation_noise(x, "other")
    assert np.isfinite(lowered)
