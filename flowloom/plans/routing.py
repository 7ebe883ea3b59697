"""Turning movements, routes, assignment tables, counts and noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assignment as A
from ..operators import linear as L
from ..operators import network as N
from ..operators.noise import observation_noise
from ..session import materialise
from ..sources import fixtures as fx
from . import inputs
from .registry import query
from .sql_parts import normal_sql


@query("k1_turning_movements", "SELECT turn_id, incoming_edge, outgoing_edge, junction FROM turns", ["turns"])
def _(spark, sf):
    return inputs.turns(spark, sf)


@query("j4_turns_at_junction", "SELECT incoming_edge, outgoing_edge, junction FROM turns", ["turns"])
def _(spark, sf):
    e = inputs.edges(spark, sf)
    return N.allowed_turns(e, fx.connections(e))


@query(
    "k2_shortest_path",
    """SELECT o, d, list_aggregate(nodes, 'string_agg', '>') AS path, cost, cost * flow AS vehicle_metres
    FROM routes JOIN base_od USING (o, d) WHERE rank = 1""",
    ["routes"],
)
def _(spark, sf):
    found = N.shortest_paths(inputs.edges(spark, sf), inputs.demand_pairs(spark, sf))
    return found.join(fx.base_od(spark, sf), ["o", "d"]).select(
        "o", "d", F.array_join("nodes", ">").alias("path"), "cost", (F.col("cost") * F.col("flow")).alias("vehicle_metres")
    )


@query(
    "k3_path_turns",
    "SELECT o, d, rank, CAST(step AS INT) AS step, incoming_edge, outgoing_edge FROM route_steps",
    ["route_steps"],
)
def _(spark, sf):
    return N.path_turns(inputs.routes(spark, sf), ["o", "d", "rank"])


@query(
    "k4_k_shortest_paths",
    "SELECT o, d, rank, list_aggregate(nodes, 'string_agg', '>') AS path, cost FROM routes",
    ["routes"],
)
def _(spark, sf):
    return inputs.routes(spark, sf).select("o", "d", "rank", F.array_join("nodes", ">").alias("path"), "cost")


@query(
    "k5_catalog_stats",
    """SELECT (SELECT count(*) FROM routes) AS total_routes,
    (SELECT count(*) FROM pairs p WHERE o <> d AND NOT EXISTS (SELECT 1 FROM routes r WHERE r.o = p.o AND r.d = p.d)) AS unreachable_pairs,
    (SELECT count(*) FROM routes) / (SELECT count(*) FROM pairs) AS mean_routes_per_od""",
    ["routes", "pairs"],
    "mean_routes_per_od",
)
def _(spark, sf):
    return N.catalog_stats(inputs.routes(spark, sf), inputs.pairs(spark, sf))


@query("k6_logit_shares", "SELECT o, d, rank, cost, utility, probability FROM shares", ["shares"], "utility probability")
def _(spark, sf):
    return inputs.shares(spark, sf).select("o", "d", "rank", "cost", "utility", "probability")


@query("k7_route_probabilities", "SELECT probability FROM shares", ["shares"], "probability")
def _(spark, sf):
    return N.route_probabilities(inputs.shares(spark, sf))


@query(
    "j5_route_step_turns",
    """SELECT s.o, s.d, s.rank, CAST(s.step AS INT) AS step, t.turn_id
    FROM route_steps s JOIN turns t USING (incoming_edge, outgoing_edge)""",
    ["route_steps", "turns"],
)
def _(spark, sf):
    uses = A.turn_uses(inputs.routes(spark, sf), inputs.turns(spark, sf), ["o", "d", "rank"])
    return uses.select("o", "d", "rank", "step", "turn_id")


@query(
    "j5_dropped_steps",
    """SELECT s.o, s.d, s.rank, CAST(s.step AS INT) AS step FROM route_steps s
    WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.turn_id % 2 = 0
    AND t.incoming_edge = s.incoming_edge AND t.outgoing_edge = s.outgoing_edge)""",
    ["route_steps", "turns"],
)
def _(spark, sf):
    known = inputs.turns(spark, sf).filter(F.col("turn_id") % 2 == 0)
    return A.dropped_steps(inputs.routes(spark, sf), known, ["o", "d", "rank"]).select("o", "d", "rank", "step")


@query(
    "t1_binary_assignment",
    """SELECT DISTINCT turn_id, CAST((o - 1) * 25 + d - 1 AS INT) AS od_index, CAST(1 AS DOUBLE) AS weight
    FROM route_steps JOIN turns USING (incoming_edge, outgoing_edge) WHERE rank = 1""",
    ["route_steps", "turns"],
)
def _(spark, sf):
    best = inputs.routes(spark, sf).filter("rank = 1")
    return A.binary_assignment(best, inputs.turns(spark, sf), inputs.n_zones(spark, sf))


@query(
    "t1_weighted_assignment",
    """SELECT turn_id, CAST((o - 1) * 25 + d - 1 AS INT) AS od_index, CAST(count(*) AS DOUBLE) AS weight
    FROM route_steps JOIN turns USING (incoming_edge, outgoing_edge) GROUP BY ALL""",
    ["route_steps", "turns"],
)
def _(spark, sf):
    return A.binary_assignment(inputs.routes(spark, sf), inputs.turns(spark, sf), inputs.n_zones(spark, sf), weighted=True)


@query(
    "t2_route_turns",
    """SELECT o, d, rank, string_agg(turn_id::VARCHAR, ',' ORDER BY turn_id) AS turn_ids FROM (
    SELECT DISTINCT o, d, rank, turn_id FROM route_steps JOIN turns USING (incoming_edge, outgoing_edge)) GROUP BY ALL""",
    ["route_steps", "turns"],
)
def _(spark, sf):
    found = A.route_turns(inputs.routes(spark, sf), inputs.turns(spark, sf), ["o", "d", "rank"])
    return found.withColumn("turn_ids", F.array_join("turn_ids", ","))


@query("t3_fractional_assignment", "SELECT turn_id, od_index, weight FROM assignment", ["assignment"], "weight")
def _(spark, sf):
    return inputs.assignment(spark, sf)


@query(
    "t4_validate_assignment",
    """SELECT CAST(0 AS DOUBLE) AS min_entry, max(weight) AS max_entry, max(weight) <= 1 + 1e-9 AND min(weight) >= -1e-12 AS entries_in_01,
    (SELECT max(s) FROM (SELECT sum(weight) AS s FROM assignment GROUP BY od_index)) AS max_column_sum,
    (SELECT avg(s) FROM (SELECT sum(weight) AS s FROM assignment GROUP BY od_index) WHERE s > 0) AS mean_column_sum
    FROM assignment""",
    ["assignment"],
    "min_entry max_entry max_column_sum mean_column_sum",
)
def _(spark, sf):
    n_turns = inputs.turns(spark, sf).count()
    return A.assignment_checks(inputs.assignment(spark, sf), n_turns, inputs.n_zones(spark, sf))


@query("t5_turning_counts", "SELECT sample_id, turn_id, x FROM counts", ["counts"], "x")
def _(spark, sf):
    return A.turning_counts(inputs.od(spark, sf), inputs.assignment(spark, sf), inputs.n_zones(spark, sf))


@query("j6_sparse_product", "SELECT sample_id, turn_id, x FROM counts", ["counts"], "x")
def _(spark, sf):
    from ..operators.reshape import with_od_index

    cells = with_od_index(fx.od_batch(spark, sf), inputs.n_zones(spark, sf))
    return A.apply_operator(cells, inputs.assignment(spark, sf), "od_index", "turn_id")


@query("t6_vector_counts", "SELECT sample_id, turn_id, x FROM dense_counts", ["dense_counts"], "x")
def _(spark, sf):
    from ..operators.reshape import flatten

    n, n_turns = inputs.n_zones(spark, sf), inputs.turns(spark, sf).count()
    out = A.vector_counts(flatten(fx.od_batch(spark, sf), n), inputs.assignment(spark, sf), n_turns, n)
    return out.select("sample_id", F.posexplode("x").alias("turn_id", "x"))


@query(
    "a15_dataset_consistency",
    """SELECT max(abs(x - y)) AS max_reconstruction_error, max(abs(x - y)) <= 1e-6 AS matrix_mult_consistent
    FROM (SELECT x, CASE WHEN turn_id % 3 = 1 THEN x * 1.001::DOUBLE ELSE x END AS y FROM counts)""",
    ["counts"],
    "max_reconstruction_error",
)
def _(spark, sf):
    """Counts of a third of the turns are a thousandth too high, which the check must find to its size."""
    wrong = inputs.counts(spark, sf).withColumn("x", F.when(F.col("turn_id") % 3 == 1, F.col("x") * 1.001).otherwise(F.col("x")))
    return A.validate_counts(inputs.od(spark, sf), wrong, inputs.assignment(spark, sf), inputs.n_zones(spark, sf))


@query(
    "i4_forward_check",
    """SELECT count(DISTINCT sample_id) AS n_checked, max(abs(x - y)) AS max_abs_err, avg(abs(x - y)) AS mean_abs_err,
    max(abs(x - y) / greatest(abs(y), 1e-6)) AS max_rel_err, bool_and(abs(x - y) <= 1e-2 + 1e-3 * abs(x)) AS allclose
    FROM (SELECT sample_id, x, x + 0.25 * (turn_id % 3) AS y FROM counts WHERE sample_id < 32)""",
    ["counts"],
    "max_abs_err mean_abs_err max_rel_err",
)
def _(spark, sf):
    shifted = inputs.counts(spark, sf).withColumn("x", F.col("x") + F.lit(0.25) * (F.col("turn_id") % 3))
    return A.forward_check(fx.od_batch(spark, sf), shifted, inputs.assignment(spark, sf), inputs.n_zones(spark, sf))


@query(
    "t7_sensitivity_max_entry",
    """SELECT k AS k_paths, theta, max(weight) AS max_entry FROM (
    SELECT k, theta, turn_id, o, d, sum(p) AS weight FROM (
      SELECT DISTINCT s.k, s.theta, s.o, s.d, s.rank, s.p, t.turn_id FROM (
        SELECT k, theta, o, d, rank, edge_ids, exp(-theta * cost - m) / sum(exp(-theta * cost - m)) OVER (PARTITION BY k, theta, o, d) AS p FROM (
          SELECT k, theta, o, d, rank, edge_ids, cost, max(-theta * cost) OVER (PARTITION BY k, theta, o, d) AS m
          FROM routes, (VALUES (3), (5)) kk(k), (VALUES (0.005::DOUBLE), (0.02::DOUBLE)) tt(theta) WHERE rank <= k)) s
      JOIN route_steps r ON r.o = s.o AND r.d = s.d AND r.rank = s.rank
      JOIN turns t ON t.incoming_edge = r.incoming_edge AND t.outgoing_edge = r.outgoing_edge)
    GROUP BY ALL) GROUP BY ALL""",
    ["route_steps", "turns"],
    "max_entry",
)
def _(spark, sf):
    grid = A.sensitivity_assignments(
        inputs.edges(spark, sf), inputs.turns(spark, sf), inputs.demand_pairs(spark, sf), inputs.n_zones(spark, sf), [3, 5], [0.005, 0.02]
    )
    return grid.groupBy("k_paths", "theta").agg(F.max("weight").alias("max_entry"))


#: The grid of the analysis (fixed values).
K_GRID, THETA_GRID = [1, 3, 5, 10], [0.05, 0.1, 0.2, 0.5]


def sensitivity(spark, sf):
    """Rank facts of every grid point, written once."""

    def build():
        routes = inputs.edges(spark, sf), inputs.turns(spark, sf), inputs.demand_pairs(spark, sf)
        n = inputs.n_zones(spark, sf)
        grid = materialise(A.sensitivity_assignments(*routes, n, K_GRID, THETA_GRID), "grid")
        return L.rank_reports(grid, ["k_paths", "theta"], inputs.turns(spark, sf).count(), n * n)

    return inputs._once(spark, sf, "sensitivity", build)


@query(
    "t7_sensitivity_energy",
    f"""SELECT k AS k_paths, theta, max(weight) AS max_entry, sum(weight * weight) AS energy FROM (
    SELECT k, theta, turn_id, o, d, sum(p) AS weight FROM (
      SELECT DISTINCT s.k, s.theta, s.o, s.d, s.n, s.p, t.turn_id FROM (
        SELECT *, exp(-theta * cost - m) / sum(exp(-theta * cost - m)) OVER (PARTITION BY k, theta, o, d) AS p FROM (
          SELECT k, theta, o, d, n, edge_ids, cost, max(-theta * cost) OVER (PARTITION BY k, theta, o, d) AS m FROM (
            SELECT o, d, edge_ids, cost, row_number() OVER (PARTITION BY o, d ORDER BY cost, nodes) AS n FROM paths WHERE node = target),
          unnest({K_GRID}) kk(k), unnest({THETA_GRID}::DOUBLE[]) tt(theta) WHERE n <= k)) s, unnest(range(1, len(s.edge_ids))) u(i)
      JOIN turns t ON t.incoming_edge = s.edge_ids[i] AND t.outgoing_edge = s.edge_ids[i + 1])
    GROUP BY ALL) GROUP BY ALL""",
    ["paths", "turns"],
    "max_entry energy",
)
def _(spark, sf):
    """The sum of squared singular values of each operator, which is that of its entries."""
    return sensitivity(spark, sf).select("k_paths", F.col("theta").cast("double").alias("theta"), "max_entry", "energy")


@query("t7_sensitivity")
def _(spark, sf):
    """All outputs of the grid; ``best`` marks the first point of highest rank."""
    found = sensitivity(spark, sf).drop("energy")
    pick = found.agg(F.min_by(F.struct("k_paths", "theta"), F.struct(-F.col("rank"), "k_paths", "theta"))).scalar()
    return found.withColumn("best", F.struct("k_paths", "theta") == pick)


@query(
    "t6_batched_counts",
    f"""SELECT turn_id, count(*) AS n, avg(x) AS mean, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) AS std,
    sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) / (avg(x) + 1e-9) AS cv,
    avg(greatest(x + 0.05 * {normal_sql(42, 'noise', 'sample_id', 'turn_id')} * greatest(x, 1), 0)) AS mean_obs
    FROM dense_counts GROUP BY turn_id""",
    ["dense_counts"],
    {"mean": 6, "std": 4, "cv": 4, "mean_obs": 5},
)
def _(spark, sf):
    return _batched(spark, sf)[1]


@query(
    "t6_batch_check",
    """SELECT count(DISTINCT sample_id) AS num_samples, CAST((SELECT count(*) FROM turns) AS INT) AS num_turns,
    min(sample_id) AS first_sample, sum(x) AS total FROM counts""",
    ["counts"],
    {"total": 4},
)
def _(spark, sf):
    return _batched(spark, sf)[2].filter("matrix_mult_consistent").select("num_samples", "num_turns", "first_sample", "total")


def _batched(spark, sf):
    m, n = inputs.turns(spark, sf).count(), inputs.n_zones(spark, sf)
    return A.batch_counts(inputs.od(spark, sf), inputs.assignment(spark, sf), m, n, noise="gaussian", family="md5")


@query("o1_noise_none", "SELECT sample_id, turn_id, greatest(x, 0) AS x_obs FROM counts", ["counts"], "x_obs")
def _(spark, sf):
    return observation_noise(inputs.counts(spark, sf), "none").select("sample_id", "turn_id", "x_obs")


@query(
    "o1_noise_gaussian",
    f"""SELECT sample_id, turn_id, greatest(x + 0.05 * {normal_sql(42, 'noise', 'sample_id', 'turn_id')} * greatest(x, 1), 0) AS x_obs
    FROM counts""",
    ["counts"],
    {"x_obs": 5},
)
def _(spark, sf):
    noisy = observation_noise(inputs.counts(spark, sf), "gaussian", 0.05, family="md5")
    return noisy.select("sample_id", "turn_id", "x_obs")


@query("o1_noise_poisson")
def _(spark, sf):
    return observation_noise(inputs.counts(spark, sf), "poisson", scale=0.8)
