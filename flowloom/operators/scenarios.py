"""Scenario generation: draws on every cell of every sample, then raking.

One plan covers all samples, and every draw is a function of (seed, sample, cell
or position), so the result does not depend on partitioning.

Both generators come in two forms. The vector form holds a sample's table in one
row, for zone systems up to ``MAX_VECTOR_CELLS``; the ``*_cells`` form composes
the same steps cell by cell (Dirichlet draw, gamma weights, floor, shocked
marginals, raking) for zone systems of any size. Draws differ between the forms,
distributions don't.

The base-table vector form is a narrow map over a range of sample ids: Spark has
no gamma sampler, so each Arrow batch draws and rakes its own samples, with
nothing to join or shuffle. The first-principles generator builds its latent
factors and gravity cells with joins and windows. Samples come from
``spark.range``, whose known partitioning by ``sample_id`` carries through the
explodes and broadcast joins, so the per-sample windows and group-bys need no
exchange; cells become one vector row per sample just before raking.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..functions.draws import uniform, with_gamma, with_log_gamma
from ..session import join_small, materialise
from .raking import _balance, rake
from .reshape import od_index
from .spatial import (
    distances,
    gravity,
    impedance,
    latent_factors,
    memberships,
    seed_to_probability,
    smooth_factors,
    type_centres,
)
from .vectors import check_vector_size, map_batches, to_lists


def _by_sample() -> WindowSpec:
    return W.partitionBy("sample_id")


# ---------------------------------------------------------------- building blocks


def _with_totals(cells: DataFrame, wide: bool, **totals: Column) -> DataFrame:
    """Add aggregates over each sample as columns.

    By window, or for tables that outgrow a task (``wide``) by partial sums and a
    join, after writing the cells so that they aren't drawn twice.
    """
    if not wide:
        return cells.withColumns({k: c.over(_by_sample()) for k, c in totals.items()})
    kept = materialise(cells, "cells")
    return kept.join(kept.groupBy("sample_id").agg(*[c.alias(k) for k, c in totals.items()]), "sample_id")


def reweight(cells: DataFrame, seed: int, shape: float = 0.5, scale: float = 1.0, normalise: bool = True, family: str = "md5", wide: bool = False) -> DataFrame:
    """Multiply ``p`` by gamma weights; renormalise each sample to one unless told not to."""
    keys = (F.col("sample_id"), F.col("o"), F.col("d"))
    drawn = with_gamma(cells, "_w", seed, "weight", keys, shape=shape, scale=scale, family=family)
    weighted = drawn.withColumn("p", F.col("p") * F.col("_w")).drop("_w")
    if not normalise:
        return weighted
    no_mass = F.raise_error(F.lit("no probability is left after the gamma weights")).cast("double")
    summed = _with_totals(weighted, wide, _total=F.sum("p"))
    return summed.withColumn("p", F.when(F.col("_total") > 0, F.col("p") / F.col("_total")).otherwise(no_mass)).drop("_total")


def dirichlet(cells: DataFrame, alpha: float, seed: int, prior_floor: float = 0.0, concentration_floor: float = 0.0, family: str = "xx", wide: bool = False) -> DataFrame:
    """Replace ``p`` by a Dirichlet(alpha * p) draw per sample.

    Log-gamma draws are shifted by their maximum before the exponential, so tiny
    concentrations survive.
    """
    if alpha <= 0:
        raise ValueError(f"alpha is {alpha}; it has to be above zero")
    kept = cells.columns
    prior = cells
    if prior_floor > 0:
        lifted = _with_totals(prior.withColumn("p", F.greatest("p", F.lit(prior_floor))), wide, _total=F.sum("p"))
        prior = lifted.withColumn("p", F.col("p") / F.col("_total")).drop("_total")
    a = F.greatest(F.lit(float(alpha)) * F.col("p"), F.lit(concentration_floor))
    keys = (F.col("sample_id"), F.col("o"), F.col("d"))
    drawn = with_log_gamma(prior, "_g", a, seed, "dirichlet", keys, family=family)
    e = _with_totals(drawn, wide, _top=F.max("_g")).withColumn("_e", F.exp(F.col("_g") - F.col("_top")))
    return _with_totals(e, wide, _sum=F.sum("_e")).withColumn("p", F.col("_e") / F.col("_sum")).select(*kept)


def sampled_demand(cells: DataFrame, alpha: float, total: float, seed: int, apply_gamma: bool = True, shape: float = 0.5, scale: float = 1.0, family: str = "xx") -> DataFrame:
    """Dirichlet draw, optional gamma reweighting, scaled to the total demand."""
    p = dirichlet(cells, alpha, seed, family=family)
    if apply_gamma:
        p = reweight(p, seed, shape, scale, family=family)
    return p.withColumn("flow", F.col("p") * F.lit(float(total)))


def raking_seed(cells: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Support cells with a small floor added; the diagonal is dropped."""
    return cells.filter(F.col("o") != F.col("d")).withColumn("flow", F.col("flow") + F.lit(floor))


def perturbed_targets(marginal: DataFrame, key: str, total, delta: float, seed: int, stream: str, family: str = "md5") -> DataFrame:
    """``sample_id, key, target``: marginals times 1 + U(-delta, delta), rescaled to ``total``.

    ``marginal(sample_id, key, m)``; ``total`` is a number or a column of it.
    """
    if not 0 <= delta < 1:
        raise ValueError("perturbation must be in [0, 1)")
    shock = (2.0 * uniform(seed, stream, F.col("sample_id"), F.col(key), family=family) - 1.0) * F.lit(float(delta))
    total = total if not isinstance(total, (int, float)) else F.lit(float(total))
    shocked = marginal.withColumn("_t", F.col("m") * (1.0 + shock))
    target = total * F.try_divide(F.col("_t"), F.sum("_t").over(_by_sample()))
    return shocked.select("sample_id", key, target.alias("target"))


def marginal_targets(factors: DataFrame, total: float, latent: bool = True) -> DataFrame:
    """``sample_id, zone, row_target, col_target`` from factors, or equal shares."""
    g = F.lit(float(total))
    if latent:
        share = lambda c: F.col(c) / F.sum(c).over(_by_sample())
        return factors.select("sample_id", "zone", (share("u") * g).alias("row_target"), (share("v") * g).alias("col_target"))
    equal = g / F.count("*").over(_by_sample())
    return factors.select("sample_id", "zone", equal.alias("row_target"), equal.alias("col_target"))


def split_targets(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = targets.select("sample_id", F.col("zone").alias("o"), F.col("row_target").alias("target"))
    cols = targets.select("sample_id", F.col("zone").alias("d"), F.col("col_target").alias("target"))
    return rows, cols


def reference_seed(factors: DataFrame, dist: DataFrame, total: float, floor: float = 1e-6, **gravity_args) -> DataFrame:
    """Gravity table scaled to the total demand, ready for raking, without noise."""
    p = seed_to_probability(gravity(factors, dist, **gravity_args))
    return raking_seed(p.withColumn("flow", F.col("p") * F.lit(float(total))), floor).select("sample_id", "o", "d", "flow")


def perturbed_seed(cells: DataFrame, seed: int, low: float = 0.8, high: float = 1.2, floor: float = 1e-6, family: str = "md5") -> DataFrame:
    """Observed flows on their own positive support times U(low, high), plus the floor."""
    u = uniform(seed, "factor", F.col("sample_id"), F.col("o"), F.col("d"), family=family)
    factor = F.lit(low) + F.lit(high - low) * u
    support = cells.filter((F.col("flow") > 0) & (F.col("o") != F.col("d")))
    return support.withColumn("flow", F.col("flow") * factor + F.lit(floor))


# ---------------------------------------------------------------- whole-batch generators


#: Samples per task, and per pass of the batch kernel (kept small for the CPU caches).
_PER_TASK, _PER_PASS = 20_000, 256


def _sample_ids(spark: SparkSession, n_samples: int) -> DataFrame:
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_samples // _PER_TASK))
    return spark.range(0, n_samples, 1, tasks).withColumnRenamed("id", "sample_id")


def _balanced(cells: DataFrame, n_zones: int, total: float, floor: float, tol: float, max_iter: int) -> DataFrame:
    """Pack log weights into vectors and rake them.

    ``cells(sample_id, od_index, z, zone, pt, at)`` holds a log weight on the
    support cells and the unscaled targets on the diagonal cells.
    """
    size = n_zones * n_zones
    check_vector_size(size)
    packed = cells.groupBy("sample_id").agg(
        F.collect_list(F.when(F.col("z").isNotNull(), F.col("od_index"))).alias("cell"),
        F.collect_list("z").alias("z"),
        F.collect_list("zone").alias("zone"),
        F.collect_list("pt").alias("pt"),
        F.collect_list("at").alias("at"),
    )

    def run(batch):
        count = batch.num_rows

        def spread(values: str, positions: str, width: int, shift: int, fill: float) -> np.ndarray:
            column = batch.column(positions)
            row = np.repeat(np.arange(count), np.diff(column.offsets.to_numpy()))
            out = np.full((count, width), fill)
            out[row, column.flatten().to_numpy() - shift] = batch.column(values).flatten().to_numpy()
            return out

        z = spread("z", "cell", size, 0, -np.inf)
        weight = np.exp(z - z.max(axis=1, keepdims=True))
        flow = weight / weight.sum(axis=1, keepdims=True) * total + floor * np.isfinite(z)
        targets = [spread(t, "zone", n_zones, 1, 0.0) for t in ("pt", "at")]
        targets = [t / t.sum(axis=1, keepdims=True) * total for t in targets]
        raked, iterations, error = _balance(flow.reshape(count, n_zones, n_zones), *targets, tol, max_iter)
        return {
            "sample_id": batch.column("sample_id"),
            "y": to_lists(raked.reshape(count, size)),
            "iterations": iterations.astype(np.int32),
            "final_error": error,
            "converged": error < tol,
        }

    schema = "sample_id bigint, y array<double>, iterations int, final_error double, converged boolean"
    return map_batches(packed, run, schema)


def _base_vectors(base: DataFrame, base_p: DataFrame, n_zones: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prior, productions and attractions as arrays: zone-system sized, checked."""
    check_vector_size(n_zones * n_zones)
    prior, flow = np.zeros((n_zones, n_zones)), np.zeros((n_zones, n_zones))
    for table, out, value in ((base_p, prior, "p"), (base, flow, "flow")):
        cells = table.filter(F.col("o") != F.col("d")).select("o", "d", value).toPandas()
        out[cells["o"].to_numpy() - 1, cells["d"].to_numpy() - 1] = cells[value].to_numpy()
    if flow.sum() <= 0:
        raise ValueError("base table has no demand")
    return prior.reshape(-1), flow.sum(axis=1), flow.sum(axis=0)


def _draw_around(
    samples: DataFrame, vectors: tuple, n_zones: int, seed: int, shape: float, scale: float, apply_gamma: bool,
    floor: float, tol: float, max_iter: int,
) -> DataFrame:
    """Dirichlet and gamma draws, shocked marginals and raking per Arrow batch.

    ``samples(sample_id, alpha, delta)``. Each sample has its own counter-based
    generator keyed by (seed, sample_id). Gamma draws are kept as logarithms.
    """
    prior, prod, attr = vectors
    support = np.flatnonzero(prior > 0)
    p, total = prior[support], float(prod.sum())

    def draw(sample: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.Generator(np.random.Philox(key=[seed, sample]))
        a = alpha * p
        z = np.log(rng.standard_gamma(a + 1.0)) + np.log(1.0 - rng.random(len(p))) / a
        if apply_gamma:
            z += np.log(np.maximum(rng.gamma(shape, scale, len(p)), 1e-30))
        return z, rng.uniform(-1.0, 1.0, 2 * n_zones)

    def run(batch):
        ids = batch.column("sample_id").to_numpy()
        alphas, deltas = batch.column("alpha").to_numpy(), batch.column("delta").to_numpy()
        flows, iterations, errors = [], [], []
        for start in range(0, len(ids), _PER_PASS):
            part = slice(start, start + _PER_PASS)
            drawn = [draw(int(i), a) for i, a in zip(ids[part], alphas[part])]
            z = np.array([d[0] for d in drawn])
            weight = np.exp(z - z.max(axis=1, keepdims=True))
            seeded = np.zeros((len(z), n_zones * n_zones))
            seeded[:, support] = weight / weight.sum(axis=1, keepdims=True) * total + floor
            shock = 1.0 + deltas[part, None] * np.array([d[1] for d in drawn])
            targets = [prod * shock[:, :n_zones], attr * shock[:, n_zones:]]
            targets = [t / t.sum(axis=1, keepdims=True) * total for t in targets]
            out = _balance(seeded.reshape(-1, n_zones, n_zones), *targets, tol, max_iter)
            for held, got in zip((flows, iterations, errors), out):
                held.append(got)
        error = np.concatenate(errors)
        return {
            "sample_id": batch.column("sample_id"),
            "y": to_lists(np.concatenate(flows).reshape(len(ids), -1)),
            "iterations": np.concatenate(iterations).astype(np.int32),
            "final_error": error,
            "converged": error < tol,
        }

    schema = "sample_id bigint, y array<double>, iterations int, final_error double, converged boolean"
    return map_batches(samples, run, schema)


def generate_from_base(
    base: DataFrame,
    base_p: DataFrame,
    n_zones: int,
    n_samples: int,
    alpha: float = 500.0,
    perturbation: float = 0.20,
    tol: float = 1e-3,
    max_iter: int = 1000,
    floor: float = 1e-6,
    shape: float = 0.5,
    scale: float = 1.0,
    apply_gamma: bool = True,
    seed: int = 42,
) -> DataFrame:
    """``sample_id, y, iterations, final_error, converged`` around a base table.

    ``base_p`` comes from ``spatial.base_probability`` on ``base``.
    """
    _check_base(alpha, perturbation, shape, scale)
    samples = _sample_ids(base.sparkSession, n_samples).withColumns(
        {"alpha": F.lit(float(alpha)), "delta": F.lit(float(perturbation))}
    )
    vectors = _base_vectors(base, base_p, n_zones)
    return _draw_around(samples, vectors, n_zones, seed, shape, scale, apply_gamma, floor, tol, max_iter)


def _check_base(alpha: float, perturbation: float, shape: float, scale: float) -> None:
    if alpha <= 0:
        raise ValueError(f"alpha is {alpha}; it has to be above zero")
    if not 0 <= perturbation < 1:
        raise ValueError(f"perturbation is {perturbation}; it has to be from 0 to below 1")
    if shape <= 0 or scale <= 0:
        raise ValueError("shape and scale of the gamma weights have to be above zero")


def _raked_cells(seeded: DataFrame, rows: DataFrame, cols: DataFrame, floor: float, tol: float, max_iter: int) -> DataFrame:
    return rake(
        raking_seed(seeded, floor).select("sample_id", "o", "d", "flow"), rows, cols, tol=tol, max_iter=max_iter, colocate=False
    )


def generate_from_base_cells(
    base: DataFrame,
    base_p: DataFrame,
    n_samples: int,
    alpha: float = 500.0,
    perturbation: float = 0.20,
    tol: float = 1e-3,
    max_iter: int = 1000,
    floor: float = 1e-6,
    shape: float = 0.5,
    scale: float = 1.0,
    apply_gamma: bool = True,
    seed: int = 42,
    family: str = "xx",
) -> DataFrame:
    """``sample_id, o, d, flow, iterations, final_error, converged``: the long form, without a bound on the zones."""
    _check_base(alpha, perturbation, shape, scale)
    support = base_p.filter((F.col("o") != F.col("d")) & (F.col("p") > 0)).select("o", "d", "p")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_samples - 1).cast("long"))).alias("sample_id")
    p = dirichlet(support.select(each, "o", "d", "p"), alpha, seed, family=family, wide=True)
    if apply_gamma:
        p = reweight(p, seed, shape, scale, family=family, wide=True)
    flows = base.filter(F.col("o") != F.col("d"))
    total = flows.agg(F.sum("flow")).first()[0]
    if not total or total <= 0:
        raise ValueError("the base table holds no demand")

    def shocked(key: str, stream: str) -> DataFrame:
        marginal = flows.groupBy(key).agg(F.sum("flow").alias("m")).select(each, key, "m")
        return perturbed_targets(marginal, key, total, perturbation, seed, stream, family=family)

    return _raked_cells(p.withColumn("flow", F.col("p") * F.lit(float(total))), shocked("o", "row"), shocked("d", "col"), floor, tol, max_iter)


def generate_grid(
    base: DataFrame,
    base_p: DataFrame,
    n_zones: int,
    samples_per_config: int,
    alphas: list[float],
    perturbations: list[float],
    tol: float = 1e-3,
    max_iter: int = 1000,
    floor: float = 1e-6,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Every (alpha, perturbation) pair in one job.

    Returns ``(vectors, configs)``; config c owns the sample ids from
    ``c * samples_per_config`` on.
    """
    spark = base.sparkSession
    grid = [(i, float(a), float(p)) for i, (a, p) in enumerate((a, p) for a in alphas for p in perturbations)]
    configs = spark.createDataFrame(grid, "config_id int, alpha double, perturbation double")
    pick = lambda i: F.element_at(F.array(*(F.lit(g[i]) for g in grid)), F.col("config_id") + 1)
    samples = (
        _sample_ids(spark, len(grid) * samples_per_config)
        .withColumn("config_id", F.floor(F.col("sample_id") / samples_per_config).cast("int"))
        .select("sample_id", pick(1).alias("alpha"), pick(2).alias("delta"))
    )
    made = _draw_around(samples, _base_vectors(base, base_p, n_zones), n_zones, seed, 0.5, 1.0, True, floor, tol, max_iter)
    return made, configs


def generate_first_principles(
    zones: DataFrame,
    n_zones: int,
    n_samples: int,
    total: float = 365_475.0,
    latent: int = 4,
    factor_shape: float = 2.0,
    factor_scale: float = 1.0,
    smooth_length: float = 400.0,
    smooth_strength: float = 0.5,
    decay: str = "exponential",
    lambda_decay: float = 500.0,
    power_gamma: float = 1.5,
    rho: float = 0.35,
    shape: float = 0.5,
    scale: float = 1.0,
    apply_gamma: bool = True,
    alpha: float = 200.0,
    tol: float = 1e-3,
    max_iter: int = 1000,
    floor: float = 1e-6,
    latent_marginals: bool = True,
    seed: int = 42,
) -> DataFrame:
    """Latent factors, gravity with reciprocity, heavy tails, Dirichlet noise, raking."""
    if alpha <= 0:
        raise ValueError(f"alpha is {alpha}; it has to be above zero")
    rho = min(max(float(rho), 0.0), 0.5)
    dist = distances(zones, n_zones)
    samples = _sample_ids(zones.sparkSession, n_samples)

    # latent factors; the type intensities ride along with their centres
    centres = type_centres(samples, zones, n_zones, latent, seed)
    type_keys = (F.col("sample_id"), F.col("t"))
    for name in ("prod", "attr"):
        centres = with_gamma(centres, name, seed, name, type_keys, shape=factor_shape, scale=factor_scale, family="xx")
    member = memberships(centres, zones, n_zones, ("prod", "attr"))
    raw = member.groupBy("sample_id", "zone").agg(
        F.sum(F.col("m") * F.col("prod")).alias("u"), F.sum(F.col("m") * F.col("attr")).alias("v")
    )
    factors = smooth_factors(raw, dist, ("u", "v"), smooth_length, smooth_strength)

    # one row per sample with its factors, exploded again into cells: no self-join
    packed = factors.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("zone", "u", "v"))).alias("f"))
    origins = packed.withColumn("o", F.explode(F.sequence(F.lit(1), F.lit(n_zones))))
    there = impedance(dist, decay, lambda_decay, power_gamma)
    back = there.select(F.col("d").alias("o"), F.col("o").alias("d"), F.col("f").alias("f_back"))
    friction = there.withColumnRenamed("f", "f_there").join(back, ["o", "d"])
    own, other = F.element_at("f", F.col("o")), F.element_at("f", F.col("d"))
    mixed = (1.0 - rho) * own["u"] * other["v"] * F.col("f_there") + rho * other["u"] * own["v"] * F.col("f_back")
    diag = F.col("o") == F.col("d")
    cells = join_small(origins, friction, "o").select(
        "sample_id",
        "o",
        "d",
        F.when(diag, 0.0).otherwise(mixed).alias("s"),
        F.when(diag, own["u"] if latent_marginals else F.lit(1.0)).alias("pt"),
        F.when(diag, own["v"] if latent_marginals else F.lit(1.0)).alias("at"),
    )

    keys = (F.col("sample_id"), F.col("o"), F.col("d"))
    if apply_gamma:
        cells = with_gamma(cells, "_w", seed, "weight", keys, shape=shape, scale=scale, family="xx")
        cells = cells.withColumn("s", F.col("s") * F.col("_w")).drop("_w")
    # prior on the support, floored and renormalised, then Dirichlet concentrations
    mass = F.sum("s").over(_by_sample())
    uniform_share = 1.0 / F.lit(float(n_zones * (n_zones - 1)))
    lifted = F.greatest(F.when(mass > 0, F.col("s") / mass).otherwise(uniform_share), F.lit(1e-18))
    cells = cells.withColumn("p", F.when(~diag, lifted)).withColumn("p", F.col("p") / F.sum("p").over(_by_sample()))
    concentration = F.greatest(F.lit(float(alpha)) * F.col("p"), F.lit(1e-12))
    drawn = with_log_gamma(cells, "z", F.when(~diag, concentration), seed, "dirichlet", keys)
    ready = drawn.select(
        "sample_id", od_index(n_zones).alias("od_index"), "z", F.when(diag, F.col("o")).alias("zone"), "pt", "at"
    )
    return _balanced(ready, n_zones, total, floor, tol, max_iter)


def generate_first_principles_cells(
    zones: DataFrame,
    n_zones: int,
    n_samples: int,
    total: float = 365_475.0,
    latent: int = 4,
    factor_shape: float = 2.0,
    factor_scale: float = 1.0,
    smooth_length: float = 400.0,
    smooth_strength: float = 0.5,
    shape: float = 0.5,
    scale: float = 1.0,
    apply_gamma: bool = True,
    alpha: float = 200.0,
    tol: float = 1e-3,
    max_iter: int = 1000,
    floor: float = 1e-6,
    latent_marginals: bool = True,
    seed: int = 42,
    **gravity_args,
) -> DataFrame:
    """``sample_id, o, d, flow, iterations, final_error, converged``: the long form, without a bound on the zones."""
    if alpha <= 0:
        raise ValueError(f"alpha is {alpha}; it has to be above zero")
    dist = materialise(distances(zones, n_zones), "dist")
    samples = _sample_ids(zones.sparkSession, n_samples)
    factors = latent_factors(samples, zones, dist, n_zones, latent, seed, factor_shape, factor_scale, smooth_length, smooth_strength)
    factors = materialise(factors, "factors")
    cells = gravity(factors, dist, **gravity_args)
    if apply_gamma:
        cells = reweight(cells.withColumnRenamed("flow", "p"), seed, shape, scale, normalise=False, family="xx").withColumnRenamed("p", "flow")
    summed = _with_totals(cells, True, _total=F.sum("flow"), _n=F.count(F.lit(1)))
    share = F.when(F.col("_total") > 0, F.col("flow") / F.col("_total")).otherwise(1.0 / F.col("_n"))
    p = dirichlet(summed.select("sample_id", "o", "d", share.alias("p")), alpha, seed, 1e-18, 1e-12, wide=True)
    targets = split_targets(marginal_targets(factors, total, latent_marginals))
    return _raked_cells(p.withColumn("flow", F.col("p") * F.lit(float(total))), *targets, floor, tol, max_iter)


def recommendation_score(target_corr: float = 0.85):
    """Higher is better: diversity and spread, less correlation above the target."""
    diversity = F.col("mean_pairwise_distance") / 200.0 + F.col("mean_cell_cv")
    spread = F.col("pca_components_90pct") / 20.0
    penalty = 2.0 * F.greatest(F.col("mean_correlation") - target_corr, F.lit(0.0))
    return diversity + spread - penalty


def best_config(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score")).limit(1)
