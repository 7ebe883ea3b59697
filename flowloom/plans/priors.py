"""Distances, priors, gravity and seeded draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draws as D
from ..operators import sampling as SA
from ..operators import scenarios as SC
from ..operators import spatial as SP
from ..operators.metrics import attractions, productions
from ..operators.reshape import densify
from ..sources import fixtures as fx
from . import inputs
from .registry import query
from .sql_parts import log_gamma_sql, normal_sql, poisson_sql, uniform_sql


def dist(spark, sf):
    return inputs.dist(spark, sf)


def factors(spark, sf):
    """Zone factors from observed marginals: one more than each month's totals."""
    od = fx.od_batch(spark, sf)
    ids = od.select("sample_id").distinct().withColumn("zone", F.explode(F.sequence(F.lit(1), F.lit(inputs.n_zones(spark, sf)))))
    p = productions(od).withColumnRenamed("o", "zone")
    a = attractions(od).withColumnRenamed("d", "zone")
    one = F.lit(1.0)
    return (
        ids.join(p, ["sample_id", "zone"], "left")
        .join(a, ["sample_id", "zone"], "left")
        .select(
            "sample_id",
            "zone",
            (F.coalesce("production", F.lit(0.0)) + one).alias("u"),
            (F.coalesce("attraction", F.lit(0.0)) + one).alias("v"),
        )
    )


FACTORS = """factors AS (SELECT s.sample_id, z.zone, coalesce(p.t, 0) + 1 AS u, coalesce(a.t, 0) + 1 AS v
FROM samples s CROSS JOIN zones z
LEFT JOIN (SELECT sample_id, o, sum(flow) AS t FROM od_batch GROUP BY ALL) p ON p.sample_id = s.sample_id AND p.o = z.zone
LEFT JOIN (SELECT sample_id, d, sum(flow) AS t FROM od_batch GROUP BY ALL) a ON a.sample_id = s.sample_id AND a.d = z.zone)"""
GRAVITY = """grav AS (SELECT a.sample_id, t.o, t.d, a.u * b.v * exp(-t.dist / 500) AS flow
FROM factors a JOIN dist t ON t.o = a.zone JOIN factors b ON b.sample_id = a.sample_id AND b.zone = t.d WHERE t.o <> t.d)"""
MIXED = """mixed AS (SELECT a.sample_id, a.o, a.d, 0.65 * a.flow + 0.35 * b.flow AS flow
FROM grav a JOIN grav b ON a.sample_id = b.sample_id AND a.o = b.d AND a.d = b.o)"""
CENTRES = """centres AS (SELECT s.sample_id, t.t, z.x + 10 * t.t AS cx, z.y - 5 * t.t AS cy FROM samples s CROSS JOIN range(3) t(t)
JOIN zones z ON z.zone = (s.sample_id * 7 + t.t * 5) % 25 + 1)"""
MEMBERS = """d2 AS (SELECT c.sample_id, z.zone, c.t, (z.x - c.cx) * (z.x - c.cx) + (z.y - c.cy) * (z.y - c.cy) AS d2
FROM centres c CROSS JOIN zones z),
temp AS (SELECT sample_id, greatest(median(d2) * 0.25, 1) AS temp FROM d2 GROUP BY ALL),
members AS (SELECT sample_id, zone, t, exp(z - mz) / sum(exp(z - mz)) OVER (PARTITION BY sample_id, zone) AS m FROM (
SELECT *, max(z) OVER (PARTITION BY sample_id, zone) AS mz FROM (SELECT d2.sample_id, zone, t, -d2 / temp AS z FROM d2 JOIN temp USING (sample_id))))"""


def centres(spark, sf):
    ids = fx.od_batch(spark, sf).select("sample_id").distinct()
    listed = ids.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("zone", ((F.col("sample_id") * 7 + F.col("t") * 5) % 25 + 1).cast("int"))
    return listed.join(fx.zones(spark, sf), "zone").select(
        "sample_id", "t", (F.col("x") + F.lit(10.0) * F.col("t")).alias("cx"), (F.col("y") - F.lit(5.0) * F.col("t")).alias("cy")
    )


@query(
    "g1_zone_coordinates",
    "SELECT zone, x, y, coalesce(sum(flow), 0) AS outflow FROM zones LEFT JOIN base_od ON o = zone GROUP BY ALL",
    ["zones", "base_od"],
)
def _(spark, sf):
    at = SP.zone_coordinates(fx.junctions(spark, sf))
    out = fx.base_od(spark, sf).groupBy(F.col("o").alias("zone")).agg(F.sum("flow").alias("outflow"))
    return at.join(out, "zone", "left").fillna(0.0, ["outflow"])


@query("g2_distances", "SELECT o, d, dist, coalesce(flow, 0) AS flow FROM dist LEFT JOIN base_od USING (o, d)", ["dist", "base_od"], "dist")
def _(spark, sf):
    return dist(spark, sf).join(fx.base_od(spark, sf), ["o", "d"], "left").fillna(0.0, ["flow"])


@query("j1_pair_distances", "SELECT sample_id, o, d, flow * dist AS metres FROM od_batch JOIN dist USING (o, d)", ["dist", "od_batch"], "metres")
def _(spark, sf):
    return fx.od_batch(spark, sf).join(dist(spark, sf), ["o", "d"]).select(
        "sample_id", "o", "d", (F.col("flow") * F.col("dist")).alias("metres")
    )


@query(
    "g3_distance_epsilon",
    """SELECT sample_id, o, d, flow + 2 * exp(-dist / 400) AS lifted FROM od_batch JOIN dist USING (o, d)""",
    ["dist", "od_batch"],
    "lifted",
)
def _(spark, sf):
    eps = SP.distance_epsilon(dist(spark, sf), 2.0, 400.0)
    return fx.od_batch(spark, sf).join(eps, ["o", "d"]).select("sample_id", "o", "d", (F.col("flow") + F.col("eps")).alias("lifted"))


@query(
    "g4_prior_od",
    """SELECT o, d, CASE WHEN o <> d THEN coalesce(flow, 0) + exp(-dist / 500) ELSE 0 END AS prior
    FROM dist LEFT JOIN base_od USING (o, d)""",
    ["dist", "base_od"],
    "prior",
)
def _(spark, sf):
    return SP.prior_od(fx.base_od(spark, sf), dist(spark, sf)).select("o", "d", "prior")


@query(
    "g5_base_probability",
    """SELECT o, d, CASE WHEN o <> d THEN (coalesce(flow, 0) + exp(-dist / 500)) ELSE 0 END
    / (SELECT sum(coalesce(flow, 0) + exp(-dist / 500)) FROM dist LEFT JOIN base_od USING (o, d) WHERE o <> d) AS p,
    (SELECT sum(flow) FROM base_od) AS total_demand FROM dist LEFT JOIN base_od USING (o, d)""",
    ["dist", "base_od"],
    {"p": 10},
)
def _(spark, sf):
    return SP.base_probability(fx.base_od(spark, sf), dist(spark, sf)).select("o", "d", "p", "total_demand")


@query(
    "g6_seed_to_probability",
    """SELECT sample_id, o, d, CASE WHEN t > 0 THEN flow / t ELSE 1 / n END AS p FROM (
    SELECT sample_id, o, d, greatest(flow - 40, 0) AS flow, sum(greatest(flow - 40, 0)) OVER w AS t, count(*) OVER w AS n
    FROM dense WHERE o <> d WINDOW w AS (PARTITION BY sample_id))""",
    ["dense"],
    {"p": 9},
)
def _(spark, sf):
    cells = densify(fx.od_batch(spark, sf), inputs.n_zones(spark, sf))
    seed = cells.withColumn("flow", F.greatest(F.col("flow") - 40.0, F.lit(0.0)))
    return SP.seed_to_probability(seed).select("sample_id", "o", "d", "p")


@query("g7_gravity_seed", "SELECT sample_id, o, d, flow FROM grav", ["samples", "zones", "dist"], {"flow": 3}, [FACTORS, GRAVITY])
def _(spark, sf):
    return SP.gravity_seed(factors(spark, sf), SP.impedance(dist(spark, sf)))


@query(
    "g8_reciprocity",
    """SELECT sample_id, o, d, sum(flow) AS flow FROM (SELECT sample_id, o, d, 0.65 * flow AS flow FROM od_batch
    UNION ALL SELECT sample_id, d, o, 0.35 * flow FROM od_batch) GROUP BY ALL""",
    ["od_batch"],
    "flow",
)
def _(spark, sf):
    return SP.reciprocity(fx.od_batch(spark, sf), 0.35)


@query("g9_gravity_table", "SELECT sample_id, o, d, flow FROM mixed", ["samples", "zones", "dist"], {"flow": 3}, [FACTORS, GRAVITY, MIXED])
def _(spark, sf):
    return SP.gravity(factors(spark, sf), dist(spark, sf))


KERNEL = """kernel AS (SELECT o, d, k / sum(k) OVER (PARTITION BY o) AS k FROM (
SELECT o, d, exp(-dist * dist / (2 * 400 * 400)) AS k FROM dist))"""


@query(
    "g10_spatial_kernel",
    "SELECT sample_id, kernel.o, kernel.d, k * flow AS spread FROM kernel JOIN od_batch ON od_batch.o = kernel.d AND od_batch.d = kernel.o",
    ["dist", "od_batch"],
    "spread",
    [KERNEL],
)
def _(spark, sf):
    from ..operators.reshape import transpose

    k = SP.spatial_kernel(dist(spark, sf), 400.0)
    return transpose(fx.od_batch(spark, sf)).join(k, ["o", "d"]).select("sample_id", "o", "d", (F.col("k") * F.col("flow")).alias("spread"))


@query(
    "g11_smooth_factors",
    """SELECT f.sample_id, f.zone, greatest(0.5 * f.u + 0.5 * ku, 1e-12) AS u, greatest(0.5 * f.v + 0.5 * kv, 1e-12) AS v FROM factors f
    JOIN (SELECT sample_id, o, sum(k * u) AS ku, sum(k * v) AS kv FROM factors JOIN kernel ON zone = d GROUP BY ALL) s
    ON s.sample_id = f.sample_id AND s.o = f.zone""",
    ["samples", "zones", "dist"],
    "u v",
    [FACTORS, KERNEL],
)
def _(spark, sf):
    return SP.smooth_factors(factors(spark, sf), dist(spark, sf))


@query("g12_memberships", "SELECT sample_id, zone, CAST(t AS INT) AS t, m FROM members", ["samples", "zones"], {"m": 8}, [CENTRES, MEMBERS])
def _(spark, sf):
    return SP.memberships(centres(spark, sf), fx.zones(spark, sf), inputs.n_zones(spark, sf))


@query(
    "g13_zone_factors",
    """SELECT sample_id, zone, sum(m * (0.5 * (t + 1) + sample_id % 3)) AS u, sum(m * (2 - 0.5 * t + sample_id % 2)) AS v FROM members GROUP BY ALL""",
    ["samples", "zones"],
    "u v",
    [CENTRES, MEMBERS],
)
def _(spark, sf):
    member = SP.memberships(centres(spark, sf), fx.zones(spark, sf), inputs.n_zones(spark, sf))
    strengths = centres(spark, sf).select(
        "sample_id", "t", (F.lit(0.5) * (F.col("t") + 1) + F.col("sample_id") % 3).alias("prod"),
        (F.lit(2.0) - F.lit(0.5) * F.col("t") + F.col("sample_id") % 2).alias("attr"),
    )
    return SP.zone_factors(member, strengths)


@query("g14_latent_factors")
def _(spark, sf):
    ids = fx.od_batch(spark, sf).select("sample_id").distinct()
    return SP.latent_factors(ids, fx.zones(spark, sf), dist(spark, sf), inputs.n_zones(spark, sf))


@query(
    "g15_mean_trip_length",
    "SELECT sample_id, sum(flow * dist) / sum(flow) AS trip_length FROM od_batch JOIN dist USING (o, d) GROUP BY ALL",
    ["dist", "od_batch"],
    "trip_length",
)
def _(spark, sf):
    return SP.mean_trip_length(fx.od_batch(spark, sf), dist(spark, sf))


_KEYS = ("sample_id", "o", "d")


@query("d1_uniform", f"SELECT sample_id, o, d, {uniform_sql(7, 'demo', *_KEYS)} AS u FROM od_batch", ["od_batch"], {"u": 9})
def _(spark, sf):
    return fx.od_batch(spark, sf).select(*_KEYS, D.uniform(7, "demo", *(F.col(k) for k in _KEYS)).alias("u"))


@query("d2_normal", f"SELECT sample_id, o, d, 3 + 2 * {normal_sql(7, 'demo', *_KEYS)} AS z FROM od_batch", ["od_batch"], {"z": 8})
def _(spark, sf):
    return fx.od_batch(spark, sf).select(*_KEYS, D.normal(7, "demo", *(F.col(k) for k in _KEYS), mu=3.0, sigma=2.0).alias("z"))


@query(
    "d3_gamma_half",
    f"SELECT sample_id, o, d, greatest(1.5 * pow({normal_sql(7, 'demo', *_KEYS)}, 2) / 2, 1e-30) AS w FROM od_batch",
    ["od_batch"],
    {"w": 8},
)
def _(spark, sf):
    return D.with_gamma(fx.od_batch(spark, sf), "w", 7, "demo", tuple(F.col(k) for k in _KEYS), scale=1.5).select(*_KEYS, "w")


@query("d3_gamma_any_shape", f"SELECT sample_id, o, d, greatest(exp(lg), 1e-30) AS w FROM {log_gamma_sql('od_batch', '2::DOUBLE', 7, 'demo', *_KEYS)}", ["od_batch"], {"w": 8})
def _(spark, sf):
    return D.with_gamma(fx.od_batch(spark, sf), "w", 7, "demo", tuple(F.col(k) for k in _KEYS), shape=2.0).select(*_KEYS, "w")


def dirichlet_sql(source: str, alpha: float, floor: float = 0.0) -> str:
    """``keys, p`` from ``source(keys, p)``."""
    drawn = log_gamma_sql(source, f"greatest({alpha}::DOUBLE * p, {floor}::DOUBLE)", 42, "dirichlet", *_KEYS)
    return f"""SELECT sample_id, o, d, e / sum(e) OVER (PARTITION BY sample_id) AS p FROM (
    SELECT sample_id, o, d, exp(lg - max(lg) OVER (PARTITION BY sample_id)) AS e FROM {drawn})"""


SHARES = "shares AS (SELECT sample_id, o, d, flow / sum(flow) OVER (PARTITION BY sample_id) AS p FROM od_batch)"
LIFTED = """lifted AS (SELECT sample_id, o, d, p / sum(p) OVER (PARTITION BY sample_id) AS p FROM (
SELECT sample_id, o, d, greatest(flow / sum(flow) OVER (PARTITION BY sample_id), 1e-18::DOUBLE) AS p FROM dense WHERE o <> d))"""


@query("d4_dirichlet", dirichlet_sql("shares", 500), ["od_batch"], {"p": 9}, [SHARES])
def _(spark, sf):
    p = SP.seed_to_probability(fx.od_batch(spark, sf))
    return SC.dirichlet(p, 500.0, 42, family="md5").select(*_KEYS, "p")


@query("d4_dirichlet_floored", dirichlet_sql("lifted", 200, 1e-12), ["dense"], {"p": 9}, [LIFTED])
def _(spark, sf):
    cells = densify(fx.od_batch(spark, sf), inputs.n_zones(spark, sf))
    p = SP.seed_to_probability(cells)
    return SC.dirichlet(p, 200.0, 42, prior_floor=1e-18, concentration_floor=1e-12, family="md5", wide=True).select(*_KEYS, "p")


@query(
    "d5_perturbed_marginals",
    f"""SELECT sample_id, o, total * t / sum(t) OVER (PARTITION BY sample_id) AS target FROM (
    SELECT sample_id, o, m * (1 + (2 * {uniform_sql(42, 'row', 'sample_id', 'o')} - 1) * 0.2) AS t, sum(m) OVER (PARTITION BY sample_id) AS total
    FROM (SELECT sample_id, o, sum(flow) AS m FROM od_batch GROUP BY ALL))""",
    ["od_batch"],
    "target",
)
def _(spark, sf):
    m = productions(fx.od_batch(spark, sf)).withColumnRenamed("production", "m")
    from pyspark.sql import Window as W

    total = F.sum("m").over(W.partitionBy("sample_id"))
    return SC.perturbed_targets(m, "o", total, 0.2, 42, "row")


@query("d6_poisson", f"SELECT sample_id, o, d, k FROM {poisson_sql('od_batch', 'flow', 42, 'demo', *_KEYS)}", ["od_batch"])
def _(spark, sf):
    drawn = D.with_poisson(fx.od_batch(spark, sf), "k", F.col("flow"), 42, "demo", tuple(F.col(k) for k in _KEYS), family="md5")
    return drawn.select(*_KEYS, "k")


@query(
    "d7_row_sample",
    f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {uniform_sql(42, 'rows', 'o_orderkey')}, o_orderkey LIMIT 500",
)
def _(spark, sf):
    return SA.sample_rows(fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 500, "o_orderkey")


_I = f"CAST(floor({uniform_sql(42, 'pairs.i', 'pair_id')} * n) AS INT)"
_J = f"CAST(floor({uniform_sql(42, 'pairs.j', 'pair_id')} * (n - 1)) AS INT)"
PAIR_DRAW = (
    "drawn AS (SELECT pair_id, i, j0 + (j0 >= i)::INT AS j FROM ("
    f"SELECT pair_id, {_I} AS i, {_J} AS j0 FROM range(10000) r(pair_id), (SELECT count(*) AS n FROM samples)))"
)


@query("d8_pair_sample", "SELECT pair_id, i, j FROM drawn", ["samples"], extra=[PAIR_DRAW])
def _(spark, sf):
    n = fx.od_batch(spark, sf).select("sample_id").distinct().count()
    return SA.sample_pairs(spark, n, 10_000)


@query(
    "d9_feature_sample",
    f"""SELECT turn_id FROM (SELECT DISTINCT turn_id FROM counts) ORDER BY {uniform_sql(42, 'features', 'turn_id')}, turn_id LIMIT 50""",
    ["counts"],
)
def _(spark, sf):
    return SA.sample_features(inputs.counts(spark, sf), "turn_id", 50)


@query("j2_gravity_product", "SELECT sample_id, sum(flow) AS mass FROM grav GROUP BY ALL", ["samples", "zones", "dist"], {"mass": 2}, [FACTORS, GRAVITY])
def _(spark, sf):
    seed = SP.gravity_seed(factors(spark, sf), SP.impedance(dist(spark, sf)))
    return seed.groupBy("sample_id").agg(F.sum("flow").alias("mass"))


@query(
    "j3_mix_with_transpose",
    """SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(a.o, b.d) AS o, coalesce(a.d, b.o) AS d,
    0.5 * coalesce(a.flow, 0) + 0.5 * coalesce(b.flow, 0) AS flow
    FROM od_batch a FULL JOIN od_batch b ON a.sample_id = b.sample_id AND a.o = b.d AND a.d = b.o""",
    ["od_batch"],
)
def _(spark, sf):
    return SP.reciprocity(fx.od_batch(spark, sf), 0.5)
