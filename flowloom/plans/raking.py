"""Raking, scenario generation and constraint projection."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import constraints as C
from ..operators import raking as RK
from ..operators import sampling as SA
from ..operators import scenarios as SC
from ..operators import spatial as SP
from ..operators import stats as ST
from ..operators.metrics import attractions, productions, table_metrics
from ..operators.reshape import densify, flatten, unflatten
from ..session import materialise
from ..sources import fixtures as fx
from . import inputs
from .priors import FACTORS, GRAVITY, MIXED, SHARES, dirichlet_sql, dist, factors
from .registry import query
from .sql_parts import ipf_sql, normal_sql, uniform_sql


def _targets(spark, sf):
    """Targets for raking: next zone's totals of the same month, a real change."""
    od = fx.od_batch(spark, sf)
    rows = productions(od).select("sample_id", (F.col("o") % 25 + 1).cast("int").alias("o"), F.col("production").alias("target"))
    cols = attractions(od).select("sample_id", (F.col("d") % 25 + 1).cast("int").alias("d"), F.col("attraction").alias("target"))
    return rows, cols


SEEDED = """rowt AS (SELECT sample_id, o % 25 + 1 AS o, sum(flow) AS t FROM od_batch GROUP BY ALL),
colt AS (SELECT sample_id, d % 25 + 1 AS d, sum(flow) AS t FROM od_batch GROUP BY ALL),
seeded AS (SELECT s.sample_id, s.o, s.d, s.flow, coalesce(r.t, 0) AS tr, coalesce(c.t, 0) AS tc FROM od_batch s
LEFT JOIN rowt r ON r.sample_id = s.sample_id AND r.o = s.o LEFT JOIN colt c ON c.sample_id = s.sample_id AND c.d = s.d)"""


@query("p1_rake", "SELECT sample_id, o, d, flow FROM ipf3", ["od_batch"], {"flow": 5}, [SEEDED, *ipf_sql("seeded", 3)])
def _(spark, sf):
    raked = RK.rake(fx.od_batch(spark, sf), *_targets(spark, sf), tol=0.0, max_iter=3)
    return raked.select("sample_id", "o", "d", "flow")


def _error_sql(t: int) -> str:
    def side(key: str, target: str) -> str:
        return f"""SELECT coalesce(s.sample_id, t.sample_id) AS sample_id, abs(coalesce(s.f, 0) - coalesce(t.t, 0)) AS e
        FROM (SELECT sample_id, {key}, sum(flow) AS f FROM ipf{t} GROUP BY ALL) s
        FULL JOIN {target} t ON t.sample_id = s.sample_id AND t.{key} = s.{key}"""

    return f"""SELECT sample_id, {t} AS iteration, max(e) AS error FROM ({side('o', 'rowt')} UNION ALL {side('d', 'colt')}) GROUP BY ALL"""


@query(
    "p2_rake_history",
    " UNION ALL ".join(_error_sql(t) for t in (1, 2, 3, 4)),
    ["od_batch"],
    {"error": 4},
    [SEEDED, *ipf_sql("seeded", 4)],
)
def _(spark, sf):
    raked = RK.rake(fx.od_batch(spark, sf), *_targets(spark, sf), tol=0.0, max_iter=4, keep_history=True)
    return RK.raking_history(raked)


def to_convergence_sql(start: str, limit: int = 1000) -> list[str]:
    """CTEs ``raking`` and ``raked``: every sample of ``start(sample_id, o, d, flow, tr, tc)`` until it is within 1e-3."""
    return [
        f"""raking AS (SELECT sample_id, o, d, tr, tc, flow, 0 AS iterations, 'inf'::DOUBLE AS final_error FROM {start}
        UNION ALL SELECT sample_id, o, d, tr, tc, flow, iterations + 1, max(greatest(abs(rs - tr), abs(cs - tc))) OVER (PARTITION BY sample_id) FROM (
          SELECT *, sum(flow) OVER (PARTITION BY sample_id, o) AS rs, sum(flow) OVER (PARTITION BY sample_id, d) AS cs FROM (
            SELECT * REPLACE (CASE WHEN s2 > 0 THEN flow * tc / s2 ELSE flow END AS flow) FROM (
              SELECT *, sum(flow) OVER (PARTITION BY sample_id, d) AS s2 FROM (
                SELECT * REPLACE (CASE WHEN s1 > 0 THEN flow * tr / s1 ELSE flow END AS flow) FROM (
                  SELECT *, sum(flow) OVER (PARTITION BY sample_id, o) AS s1 FROM raking WHERE final_error >= 1e-3 AND iterations < {limit}))))))""",
        f"raked AS (SELECT * FROM raking WHERE iterations > 0 AND (final_error < 1e-3 OR iterations = {limit}))",
    ]


LIFTED = """lifted AS (SELECT f.sample_id, f.o, f.d, f.flow + 1 AS flow, coalesce(r.t, 0) AS tr, coalesce(c.t, 0) AS tc FROM dense f
LEFT JOIN rowt r ON r.sample_id = f.sample_id AND r.o = f.o LEFT JOIN colt c ON c.sample_id = f.sample_id AND c.d = f.d WHERE f.o <> f.d)"""


def _lifted(spark, sf):
    """Every month with its seed floored, so that the targets can be met."""
    cells = densify(fx.od_batch(spark, sf), inputs.n_zones(spark, sf)).filter(F.col("o") != F.col("d"))
    return cells.withColumn("flow", F.col("flow") + 1.0)


@query(
    "p1_rake_factors",
    "SELECT sample_id, o, d, flow, iterations FROM raked",
    ["od_batch", "dense"],
    {"flow": 4},
    [SEEDED, LIFTED, *to_convergence_sql("lifted")],
)
def _(spark, sf):
    """The form in factors with the tolerance and limit it ships with."""
    flows, _errors = RK.rake_factors(_lifted(spark, sf), *_targets(spark, sf))
    return flows.select("sample_id", "o", "d", "flow", "iterations")


@query(
    "p1_rake_to_convergence",
    "SELECT DISTINCT sample_id, iterations, final_error, final_error < 1e-3 AS converged FROM raked",
    ["od_batch", "dense"],
    {"final_error": 6},
    [SEEDED, LIFTED, *to_convergence_sql("lifted")],
)
def _(spark, sf):
    """Vector form on every month."""
    n = inputs.n_zones(spark, sf)
    zone = F.sequence(F.lit(1), F.lit(n))

    def packed(df, key):
        full = df.select("sample_id", F.col(key).alias("zone"), "target").unionByName(
            df.select("sample_id").distinct().select("sample_id", F.explode(zone).alias("zone"), F.lit(0.0).alias("target"))
        ).groupBy("sample_id", "zone").agg(F.sum("target").alias("t"))
        return full.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("zone", "t"))), lambda s: s["t"]).alias("a"))

    rows, cols = _targets(spark, sf)
    ready = (
        flatten(_lifted(spark, sf), n)
        .join(packed(rows, "o").withColumnRenamed("a", "row_target"), "sample_id")
        .join(packed(cols, "d").withColumnRenamed("a", "col_target"), "sample_id")
    )
    return RK.rake_vectors(ready, n).select("sample_id", "iterations", "final_error", "converged")


WEIGHTED = f"""weighted AS (SELECT sample_id, o, d, p * greatest(pow(sqrt(-2 * ln({uniform_sql(42, 'weight.r', 'sample_id', 'o', 'd')}))
* cos(2 * pi() * {uniform_sql(42, 'weight.a', 'sample_id', 'o', 'd')}), 2) / 2, 1e-30) AS w
FROM (SELECT sample_id, o, d, flow / sum(flow) OVER (PARTITION BY sample_id) AS p FROM od_batch))"""


@query(
    "n1_gamma_reweight",
    "SELECT sample_id, o, d, w / sum(w) OVER (PARTITION BY sample_id) AS p FROM weighted",
    ["od_batch"],
    {"p": 9},
    [WEIGHTED],
)
def _(spark, sf):
    p = SP.seed_to_probability(fx.od_batch(spark, sf))
    return SC.reweight(p, 42).select("sample_id", "o", "d", "p")


@query("n1_gamma_weights_only", "SELECT sample_id, o, d, w AS p FROM weighted", ["od_batch"], {"p": 9}, [WEIGHTED])
def _(spark, sf):
    p = SP.seed_to_probability(fx.od_batch(spark, sf))
    return SC.reweight(p, 42, normalise=False).select("sample_id", "o", "d", "p")


def demand_sql(shares: str, alpha: float, total: str) -> str:
    """Dirichlet draw around ``shares``, half-gamma weights, scaled to the total."""
    weight = f"greatest(pow({normal_sql(42, 'weight', 'sample_id', 'o', 'd')}, 2) / 2, 1e-30)"
    return f"""SELECT sample_id, o, d, w / sum(w) OVER (PARTITION BY sample_id) * {total} AS flow FROM (
    SELECT sample_id, o, d, p * {weight} AS w FROM ({dirichlet_sql(shares, alpha)}))"""


@query("n2_sampled_demand", demand_sql("shares", 500, "10000"), ["od_batch"], {"flow": 5}, [SHARES])
def _(spark, sf):
    p = SP.seed_to_probability(fx.od_batch(spark, sf))
    return SC.sampled_demand(p, 500.0, 10_000.0, 42, family="md5").select("sample_id", "o", "d", "flow")


@query("n3_raking_seed", "SELECT sample_id, o, d, flow + 1e-6 AS flow FROM dense WHERE o <> d", ["dense"], {"flow": 7})
def _(spark, sf):
    return SC.raking_seed(densify(fx.od_batch(spark, sf), inputs.n_zones(spark, sf)))


@query("n4_generate_from_base")
def _(spark, sf):
    base = inputs.base(spark, sf)
    p = SP.base_probability(base, dist(spark, sf))
    # as many scenarios as the demand table has stored cells
    return SC.generate_from_base(base, p, inputs.n_zones(spark, sf), base.count()).select(
        "sample_id", "iterations", "final_error", "converged", F.size("y").alias("cells")
    )


N_CELLS = 40
BASE_SEED = f"""bp AS (SELECT r.s AS sample_id, o, d, p FROM range({N_CELLS}) r(s), (
SELECT t.o, t.d, lift / sum(lift) OVER () AS p FROM (
SELECT t.o, t.d, coalesce(b.flow, 0) + exp(-t.dist / 500) AS lift FROM dist t LEFT JOIN base_od b USING (o, d) WHERE t.o <> t.d) t)),
whole AS (SELECT sum(flow) AS g FROM base_od WHERE o <> d),
made AS ({demand_sql('bp', 500, '(SELECT g FROM whole)')}),
shocked AS (SELECT r.s AS sample_id, z.side, z.k, z.m * (1 + (2 * CASE z.side WHEN 'row' THEN {uniform_sql(42, 'row', 'r.s', 'z.k')}
ELSE {uniform_sql(42, 'col', 'r.s', 'z.k')} END - 1) * 0.2) AS t FROM range({N_CELLS}) r(s), (
SELECT 'row' AS side, o AS k, sum(flow) AS m FROM base_od WHERE o <> d GROUP BY ALL
UNION ALL SELECT 'col', d, sum(flow) FROM base_od WHERE o <> d GROUP BY ALL) z),
marks AS (SELECT *, (SELECT g FROM whole) * t / sum(t) OVER (PARTITION BY sample_id, side) AS target FROM shocked),
scen AS (SELECT m.sample_id, m.o, m.d, m.flow + 1e-6 AS flow, coalesce(a.target, 0) AS tr, coalesce(b.target, 0) AS tc FROM made m
LEFT JOIN marks a ON a.sample_id = m.sample_id AND a.side = 'row' AND a.k = m.o
LEFT JOIN marks b ON b.sample_id = m.sample_id AND b.side = 'col' AND b.k = m.d)"""


@query(
    "n4_generate_cells",
    "SELECT sample_id, o, d, flow FROM ipf2",
    ["base_od", "dist"],
    {"flow": 4},
    [BASE_SEED, *ipf_sql("scen", 2)],
)
def _(spark, sf):
    """The long form with two raking rounds, every draw written out in the SQL twin."""
    base = inputs.base(spark, sf)
    p = SP.base_probability(base, dist(spark, sf))
    made = SC.generate_from_base_cells(base, p, N_CELLS, tol=0.0, max_iter=2, family="md5")
    return made.select("sample_id", "o", "d", "flow")


@query(
    "n4_generate_converged",
    "SELECT sample_id, o, d, flow, iterations FROM raked",
    ["base_od", "dist"],
    {"flow": 3},
    [BASE_SEED, *to_convergence_sql("scen")],
)
def _(spark, sf):
    """The long form with the tolerance and limit it ships with."""
    base = inputs.base(spark, sf)
    p = SP.base_probability(base, dist(spark, sf))
    made = SC.generate_from_base_cells(base, p, N_CELLS, family="md5")
    return made.select("sample_id", "o", "d", "flow", "iterations")


@query("n5_generate_cells")
def _(spark, sf):
    base = inputs.base(spark, sf)
    total = base.agg(F.sum("flow")).first()[0]
    made = SC.generate_first_principles_cells(fx.zones(spark, sf), inputs.n_zones(spark, sf), N_CELLS, total)
    return made.select("sample_id", "o", "d", "flow", "iterations", "final_error", "converged")


@query("n5_generate_first_principles")
def _(spark, sf):
    base = inputs.base(spark, sf)
    total = base.agg(F.sum("flow")).first()[0]
    made = SC.generate_first_principles(fx.zones(spark, sf), inputs.n_zones(spark, sf), base.count(), total)
    return made.select("sample_id", "iterations", "final_error", "converged", F.size("y").alias("cells"))


@query(
    "n6_marginal_targets",
    """SELECT sample_id, zone, u / sum(u) OVER w * 365475 AS row_target, v / sum(v) OVER w * 365475 AS col_target
    FROM factors WINDOW w AS (PARTITION BY sample_id)""",
    ["samples", "zones"],
    "row_target col_target",
    [FACTORS],
)
def _(spark, sf):
    return SC.marginal_targets(factors(spark, sf), 365_475.0)


@query(
    "n6_equal_targets",
    "SELECT sample_id, zone, 365475 / count(*) OVER (PARTITION BY sample_id) AS row_target FROM factors",
    ["samples", "zones"],
    "row_target",
    [FACTORS],
)
def _(spark, sf):
    return SC.marginal_targets(factors(spark, sf), 365_475.0, latent=False).drop("col_target")


REFERENCE = """refseed AS (SELECT m.sample_id, m.o, m.d, 365475 * m.flow / sum(m.flow) OVER (PARTITION BY m.sample_id) + 1e-6 AS flow, tr, tc
FROM mixed m
JOIN (SELECT sample_id, zone, u / sum(u) OVER (PARTITION BY sample_id) * 365475 AS tr FROM factors) r ON r.sample_id = m.sample_id AND r.zone = m.o
JOIN (SELECT sample_id, zone, v / sum(v) OVER (PARTITION BY sample_id) * 365475 AS tc FROM factors) c ON c.sample_id = m.sample_id AND c.zone = m.d)"""


@query(
    "n7_reference_od",
    "SELECT sample_id, o, d, flow FROM ipf3",
    ["samples", "zones", "dist"],
    {"flow": 5},
    [FACTORS, GRAVITY, MIXED, REFERENCE, *ipf_sql("refseed", 3)],
)
def _(spark, sf):
    f = factors(spark, sf)
    seed = SC.reference_seed(f, dist(spark, sf), 365_475.0)
    targets = SC.split_targets(SC.marginal_targets(f, 365_475.0))
    return RK.rake(seed, *targets, tol=0.0, max_iter=3).select("sample_id", "o", "d", "flow")


def _shock(stream: str, key: str) -> str:
    return f"""SELECT sample_id, {key}, q * t / sum(t) OVER (PARTITION BY sample_id) AS target FROM (
    SELECT sample_id, {key}, m * (1 + (2 * {uniform_sql(42, stream, 'sample_id', key)} - 1) * 0.2) AS t, sum(m) OVER (PARTITION BY sample_id) AS q
    FROM (SELECT sample_id, {key}, sum(flow) AS m FROM od_batch GROUP BY ALL))"""


LEGACY = f"""legacy AS (SELECT s.sample_id, s.o, s.d, s.flow * (0.8 + 0.4 * {uniform_sql(42, 'factor', 's.sample_id', 's.o', 's.d')}) + 1e-6 AS flow,
r.target AS tr, c.target AS tc FROM od_batch s JOIN ({_shock('row', 'o')}) r ON r.sample_id = s.sample_id AND r.o = s.o
JOIN ({_shock('col', 'd')}) c ON c.sample_id = s.sample_id AND c.d = s.d WHERE s.flow > 0)"""


@query("n8_perturbed_observed", "SELECT sample_id, o, d, flow FROM ipf2", ["od_batch"], {"flow": 5}, [LEGACY, *ipf_sql("legacy", 2)])
def _(spark, sf):
    od = fx.od_batch(spark, sf)
    total = lambda: F.sum("m").over(W.partitionBy("sample_id"))
    rows = SC.perturbed_targets(productions(od).withColumnRenamed("production", "m"), "o", total(), 0.2, 42, "row")
    cols = SC.perturbed_targets(attractions(od).withColumnRenamed("attraction", "m"), "d", total(), 0.2, 42, "col")
    return RK.rake(SC.perturbed_seed(od, 42), rows, cols, tol=0.0, max_iter=2).select("sample_id", "o", "d", "flow")


#: The grid of the search (fixed values).
N_PAIRS = 2_000
ALPHAS, PERTURBATIONS = (100.0, 250.0, 500.0, 1000.0, 2000.0), (0.05, 0.10, 0.20, 0.30)


def grid_scores(spark, sf, alphas=ALPHAS, perturbations=PERTURBATIONS, per_config=200):
    """Generate and score every grid point; one row per configuration."""
    n = inputs.n_zones(spark, sf)
    base = inputs.base(spark, sf)
    p = SP.base_probability(base, dist(spark, sf))
    made, configs = SC.generate_grid(base, p, n, per_config, list(alphas), list(perturbations))
    made = materialise(made, "grid")
    config = F.floor(F.col("sample_id") / per_config).cast("int")
    cells = materialise(unflatten(made, n).filter(F.col("flow") != 0), "gridcells")
    m = table_metrics(cells, base, n).groupBy(config.alias("config_id")).agg(
        F.avg("correlation").alias("mean_correlation"), F.avg("relative_error").alias("mean_relative_error"),
        (F.stddev_pop("total_demand") / (F.avg("total_demand") + 1e-12)).alias("demand_cv"),
    )
    size = F.lit(float(per_config))
    mean = F.sum("flow") / size
    std = F.sqrt(F.greatest(F.sum(F.col("flow") * F.col("flow")) / size - mean * mean, F.lit(0.0)))
    cv = cells.groupBy(config.alias("config_id"), "o", "d").agg((std / (mean + 1e-9)).alias("cv")).groupBy("config_id").agg(
        (F.sum("cv") / F.lit(float(n * n))).alias("mean_cell_cv")
    )
    # Distances of pairs drawn within each configuration, and its principal components, for all of them at once.
    pairs = SA.sample_pairs(spark, per_config, N_PAIRS * configs.count())
    home = F.floor(F.col("pair_id") / N_PAIRS).cast("int")
    drawn = pairs.select(home.alias("config_id"), (home * per_config + F.col("i")).alias("a"), (home * per_config + F.col("j")).alias("b"))
    one, two = made.select(F.col("sample_id").alias("a"), F.col("y").alias("ya")), made.select(F.col("sample_id").alias("b"), F.col("y").alias("yb"))
    gap = F.aggregate(F.zip_with("ya", "yb", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, v: acc + v) / F.lit(float(n * n))
    distance = drawn.join(one, "a").join(two, "b").groupBy("config_id").agg(F.avg(gap).alias("mean_pairwise_distance"))
    spread = distance.join(ST.group_variance(made.select(config.alias("config_id"), "y"), "config_id", "y"), "config_id")
    joined = configs.join(m, "config_id").join(cv, "config_id").join(spread, "config_id")
    return joined.withColumn("score", SC.recommendation_score())


@query("n9_grid_search")
def _(spark, sf):
    return grid_scores(spark, sf)


@query(
    "n10_recommendation",
    """SELECT sample_id, c / 200 + v + k / 20.0::DOUBLE - 2 * greatest(r - 0.85, 0) AS score FROM (
    SELECT sample_id, avg(flow) AS c, stddev_pop(flow) / avg(flow) AS v, count(*) % 7 AS k, corr(flow, o) + 0.9 AS r FROM od_batch GROUP BY ALL)
    ORDER BY score DESC LIMIT 1""",
    ["od_batch"],
    "score",
)
def _(spark, sf):
    rows = fx.od_batch(spark, sf).groupBy("sample_id").agg(
        F.avg("flow").alias("mean_pairwise_distance"), (F.stddev_pop("flow") / F.avg("flow")).alias("mean_cell_cv"),
        (F.count("*") % 7).alias("pca_components_90pct"), (F.corr("flow", "o") + 0.9).alias("mean_correlation"),
    )
    return SC.best_config(rows.select("sample_id", SC.recommendation_score().alias("score")))


@query(
    "c1_constrain",
    """SELECT sample_id, o, d, CASE WHEN o <> d AND (o + d) % 2 = 0 THEN greatest(flow, 0) ELSE 0 END AS flow FROM raw_demand""",
    ["raw_demand"],
)
def _(spark, sf):
    support = inputs.pairs(spark, sf).filter((F.col("o") + F.col("d")) % 2 == 0)
    return C.constrain(fx.raw_demand(spark, sf), support)


_SIMPLE = """SELECT sample_id, o, d, flow, 'none' AS strategy FROM raw_demand
UNION ALL SELECT sample_id, o, d, CASE WHEN o <> d THEN greatest(flow, 0) ELSE 0 END, 'relu' FROM raw_demand
UNION ALL SELECT sample_id, o, d, CASE WHEN o = d THEN 0 WHEN flow > 20 THEN flow ELSE ln(1 + exp(greatest(flow, -20))) END, 'softplus' FROM raw_demand
UNION ALL SELECT sample_id, o, d, CASE WHEN o <> d THEN greatest(flow, 0) ELSE 0 END, 'clip' FROM raw_demand"""


@query("c2_strategies", _SIMPLE, ["raw_demand"], "flow")
def _(spark, sf):
    raw = fx.raw_demand(spark, sf)
    parts = [C.apply_strategy(raw, s).select("sample_id", "o", "d", "flow", "strategy") for s in ("none", "relu", "softplus", "clip")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


CLIPPED = """clipped AS (SELECT c.sample_id, c.o, c.d, CASE WHEN c.o <> c.d THEN greatest(c.flow, 0) ELSE 0 END AS flow,
coalesce(r.t, 0) AS tr, coalesce(k.t, 0) AS tc FROM raw_demand c
LEFT JOIN (SELECT sample_id, o, sum(flow) AS t FROM od_batch GROUP BY ALL) r ON r.sample_id = c.sample_id AND r.o = c.o
LEFT JOIN (SELECT sample_id, d, sum(flow) AS t FROM od_batch GROUP BY ALL) k ON k.sample_id = c.sample_id AND k.d = c.d)"""


@query(
    "c2_clip_and_rake",
    "SELECT sample_id, o, d, flow, TRUE AS clipped, TRUE AS ipf_applied FROM ipf3",
    ["raw_demand", "od_batch"],
    {"flow": 5},
    [CLIPPED, *ipf_sql("clipped", 3)],
)
def _(spark, sf):
    od = fx.od_batch(spark, sf)
    rows = productions(od).withColumnRenamed("production", "target")
    cols = attractions(od).withColumnRenamed("attraction", "target")
    out = C.apply_strategy(fx.raw_demand(spark, sf), "clip_ipf", None, rows, cols, tol=0.0, max_iter=3)
    return out.drop("strategy")


@query(
    "c3_ablation",
    f"""SELECT strategy, avg(abs(p - t)) AS mae, avg(p - t) AS bias FROM (
    SELECT a.strategy, a.flow AS p, coalesce(b.flow, 0) AS t
    FROM ({_SIMPLE} UNION ALL SELECT sample_id, o, d, flow, 'clip_ipf' FROM ipf3) a
    LEFT JOIN od_batch b ON a.sample_id = b.sample_id AND a.o = b.o AND a.d = b.d) GROUP BY ALL""",
    ["raw_demand", "od_batch"],
    "mae bias",
    [CLIPPED, *ipf_sql("clipped", 3)],
)
def _(spark, sf):
    truth = fx.od_batch(spark, sf)
    cells = C.ablation_cells(fx.raw_demand(spark, sf), truth, None, tol=0.0, max_iter=3)
    joined = cells.join(truth.withColumnRenamed("flow", "t"), ["sample_id", "o", "d"], "left").fillna(0.0, ["t"])
    diff = F.col("flow") - F.col("t")
    return joined.groupBy("strategy").agg(F.avg(F.abs(diff)).alias("mae"), F.avg(diff).alias("bias"))
