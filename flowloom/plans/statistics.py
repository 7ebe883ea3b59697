"""Quality filters, table metrics and dataset statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import information as I
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import stats as ST
from ..operators.reshape import flatten, od_index, with_od_index
from ..session import materialise
from ..sources import fixtures as fx
from . import inputs
from .priors import PAIR_DRAW, dist
from .registry import query
from .sql_parts import uniform_sql


def od(spark, sf):
    return inputs.od(spark, sf)


def mean_base(spark, sf):
    """Base table for comparisons: flows of the average month."""
    n = n_samples(spark, sf)
    return inputs.base(spark, sf).withColumn("flow", F.col("flow") / F.lit(float(n)))


def n_samples(spark, sf):
    return inputs.n_samples(spark, sf)


MEAN_BASE = """mean_base AS (SELECT p.o, p.d, coalesce(b.flow, 0) / (SELECT count(*) FROM samples) AS flow
FROM pairs p LEFT JOIN base_od b ON b.o = p.o AND b.d = p.d)"""
FEATURES = """features AS (SELECT sample_id, sum(CASE WHEN f.o = f.d THEN f.flow ELSE 0 END) AS diagonal,
avg((f.flow <= 1e-12)::INT) AS sparsity,
CASE WHEN stddev_pop(f.flow) > 1e-12 AND stddev_pop(b.flow) > 1e-12 THEN corr(f.flow, b.flow) END AS correlation,
CASE WHEN sum(f.flow) > 0 THEN sum(f.flow * t.dist) / sum(f.flow) END AS trip_length
FROM dense f JOIN mean_base b ON b.o = f.o AND b.d = f.d JOIN dist t ON t.o = f.o AND t.d = f.d GROUP BY sample_id)"""
REASONS = """reasons AS (SELECT *, CASE WHEN diagonal > 1e-6 THEN 'diagonal'
WHEN sparsity IS NULL OR sparsity < 0 OR sparsity > 0.5 THEN 'sparsity'
WHEN correlation IS NULL OR correlation < 0.30 OR correlation > 0.80 THEN 'correlation'
WHEN trip_length IS NULL OR abs(trip_length - bl) / bl > 0.04 THEN 'trip_length' ELSE 'ok' END AS reason
FROM features, (SELECT sum(b.flow * t.dist) / sum(b.flow) AS bl FROM mean_base b JOIN dist t ON t.o = b.o AND t.d = b.d))"""
CONFIG = Q.QualityConfig(max_sparsity=0.5, max_correlation=0.80, max_trip_length_rel_error=0.04)


def features(spark, sf):
    return Q.filter_features(od(spark, sf), mean_base(spark, sf), dist(spark, sf), inputs.n_zones(spark, sf))


def reasons(spark, sf):
    length = Q.base_trip_length(mean_base(spark, sf), dist(spark, sf))
    return Q.filter_reasons(features(spark, sf), length, CONFIG)


_BASE = ["dense", "base_od", "dist"]


@query(
    "q1_filter_features",
    "SELECT sample_id, diagonal, sparsity, correlation, trip_length FROM features",
    _BASE,
    "diagonal sparsity correlation trip_length",
    [MEAN_BASE, FEATURES],
)
def _(spark, sf):
    return features(spark, sf)


@query("q2_filter_reasons", "SELECT sample_id, reason FROM reasons", _BASE, extra=[MEAN_BASE, FEATURES, REASONS])
def _(spark, sf):
    return reasons(spark, sf).select("sample_id", "reason")


@query("q2_reason_counts", "SELECT reason, count(*) AS n FROM reasons GROUP BY ALL", _BASE, extra=[MEAN_BASE, FEATURES, REASONS])
def _(spark, sf):
    return Q.reason_counts(reasons(spark, sf))


POSITIONS = "posn AS (SELECT sample_id, CAST(row_number() OVER (ORDER BY sample_id) - 1 AS INT) AS pos FROM samples)"


def pair_distance_sql(rows: str, size: str, draw: str = "drawn") -> str:
    """Distance of every drawn pair over a dense (sample_id, f, v) relation."""
    return f"""SELECT p.pair_id, {size} AS distance FROM {draw} p JOIN posn a ON a.pos = p.i JOIN posn b ON b.pos = p.j
    JOIN ({rows}) x ON x.sample_id = a.sample_id JOIN ({rows}) y ON y.sample_id = b.sample_id AND y.f = x.f GROUP BY p.pair_id"""


_OD_ROWS = "SELECT sample_id, od_index AS f, flow AS v FROM dense"
_X_ROWS = "SELECT sample_id, turn_id AS f, x AS v FROM dense_counts"
_MEAN, _SUM, _EUCLID = "avg(abs(x.v - y.v))", "sum(abs(x.v - y.v))", "sqrt(sum((x.v - y.v) * (x.v - y.v)))"


@query(
    "q3_auto_threshold",
    f"SELECT 0.35 * median(distance) AS threshold FROM ({pair_distance_sql(_OD_ROWS, _EUCLID)} HAVING p.pair_id < 2000)",
    ["dense"],
    "threshold",
    [PAIR_DRAW, POSITIONS],
)
def _(spark, sf):
    return Q.auto_threshold(od(spark, sf), inputs.n_zones(spark, sf))


#: realism filters first; what is ranked, thresholded and walked are the survivors
SURVIVORS = """surv AS (SELECT f.* FROM dense f JOIN reasons r USING (sample_id) WHERE r.reason = 'ok'),
ssamples AS (SELECT DISTINCT sample_id FROM surv),
sposn AS (SELECT sample_id, CAST(row_number() OVER (ORDER BY sample_id) - 1 AS INT) AS pos FROM ssamples)"""
SURVIVOR_SCORES = """sscores AS (SELECT sample_id, avg(abs(f.flow - m)) AS score FROM surv f
JOIN (SELECT od_index, avg(flow) AS m FROM surv GROUP BY ALL) g ON g.od_index = f.od_index GROUP BY ALL),
sranked AS (SELECT sample_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, sample_id) AS rank FROM sscores)"""
SCORES = """scores AS (SELECT sample_id, avg(abs(f.flow - m)) AS score FROM dense f
JOIN (SELECT od_index, avg(flow) AS m FROM dense GROUP BY ALL) g ON g.od_index = f.od_index GROUP BY ALL),
ranked AS (SELECT sample_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, sample_id) AS rank FROM scores)"""


def scores(spark, sf):
    return Q.diversity_scores(od(spark, sf), n_samples(spark, sf), inputs.n_zones(spark, sf))


@query("q4_diversity_rank", "SELECT sample_id, score, rank FROM ranked", ["dense"], "score", [SCORES])
def _(spark, sf):
    return scores(spark, sf)


TARGET = 30
#: share of the median distance below which two tables are too close; high enough to refuse most of them here
SHARE = 1.0
_SURV_ROWS = "SELECT sample_id, od_index AS f, flow AS v FROM surv"
SURV_DRAW = f"""sdrawn AS (SELECT pair_id, i, j0 + (j0 >= i)::INT AS j FROM (
SELECT pair_id, CAST(floor({uniform_sql(42, 'pairs.i', 'pair_id')} * n) AS INT) AS i, CAST(floor({uniform_sql(42, 'pairs.j', 'pair_id')} * (n - 1)) AS INT) AS j0
FROM range(2000) r(pair_id), (SELECT count(*) AS n FROM ssamples)))"""
#: walk down the ranking carrying the list of accepted ranks; the last 256 count
WALK = f"""tau AS (SELECT {SHARE} * median(distance) AS tau FROM ({pair_distance_sql(_SURV_ROWS, _EUCLID, 'sdrawn').replace('posn', 'sposn')})),
near AS (SELECT b.rank AS later, a.rank AS earlier FROM sranked a JOIN sranked b ON a.rank < b.rank
JOIN surv x ON x.sample_id = a.sample_id JOIN surv y ON y.sample_id = b.sample_id AND y.od_index = x.od_index
GROUP BY ALL HAVING sqrt(sum((x.flow - y.flow) * (x.flow - y.flow))) < (SELECT tau FROM tau)),
lists AS (SELECT r.rank, coalesce((SELECT list(earlier) FROM near WHERE later = r.rank), []) AS blockers FROM sranked r),
walk AS (SELECT CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS acc, CAST(NULL AS BOOLEAN) AS accepted, CAST(NULL AS BIGINT) AS blocked_by
UNION ALL SELECT l.rank, CASE WHEN len(list_intersect(l.blockers, w.acc[-256:])) = 0 THEN list_append(w.acc, l.rank) ELSE w.acc END,
len(list_intersect(l.blockers, w.acc[-256:])) = 0, list_min(list_intersect(l.blockers, w.acc[-256:]))
FROM walk w JOIN lists l ON l.rank = w.rank + 1 WHERE len(w.acc) < {TARGET})"""


def decisions(spark, sf, block=512):
    """Filter, threshold, rank and walk: the selection as a whole, over the survivors of the filters."""
    n = inputs.n_zones(spark, sf)
    cells = materialise(Q.survivors(od(spark, sf), reasons(spark, sf)), "survivors")
    tau = Q.auto_threshold(cells, n, SHARE).first()[0]
    rank = Q.diversity_scores(cells, cells.select("sample_id").distinct().count(), n).select("sample_id", "rank")
    return Q.select_diverse(flatten(cells, n).join(rank, "sample_id"), n, TARGET, tau, block)


_WALK = [MEAN_BASE, FEATURES, REASONS, SURVIVORS, SURVIVOR_SCORES, SURV_DRAW, WALK]


@query(
    "q5_diverse_subset",
    "SELECT r.sample_id, w.rank, w.accepted, w.blocked_by FROM walk w JOIN sranked r USING (rank)",
    _BASE,
    extra=_WALK,
)
def _(spark, sf):
    return decisions(spark, sf)


@query(
    "j7_first_conflict",
    "SELECT rank, blocked_by FROM walk WHERE NOT accepted",
    _BASE,
    extra=_WALK,
)
def _(spark, sf):
    """Which accepted table is too close to each refused one; blocks of 16 here,
    so that the check against the stored accepted tables is exercised."""
    return decisions(spark, sf, block=16).filter(~F.col("accepted")).select("rank", "blocked_by")


def entropy_sql(cells: str) -> str:
    return f"""SELECT o, d, -sum(p * ln(p)) AS entropy FROM (
    SELECT o, d, bin, count(*) / any_value(k) AS p FROM (
    SELECT o, d, k, CASE WHEN hi - lo < 1e-12 THEN 0 ELSE least(floor((flow - lo) / (hi - lo) * 20::DOUBLE), 19) END AS bin FROM (
    SELECT o, d, flow, min(flow) OVER w AS lo, max(flow) OVER w AS hi, count(*) OVER w AS k FROM {cells} WINDOW w AS (PARTITION BY o, d)))
    GROUP BY ALL) GROUP BY o, d"""


@query(
    "q6_cell_entropy",
    entropy_sql("dense"),
    ["dense"],
    "entropy",
)
def _(spark, sf):
    return Q.cell_entropy(od(spark, sf), n_samples(spark, sf), pairs=inputs.pairs(spark, sf).select("o", "d"))


STATS = f"""chosen AS (SELECT f.* FROM dense f JOIN sranked r USING (sample_id) JOIN walk w USING (rank) WHERE w.accepted),
csamples AS (SELECT DISTINCT sample_id FROM chosen),
cat AS (SELECT sample_id, CAST(row_number() OVER (ORDER BY sample_id) - 1 AS INT) AS pos FROM csamples),
cdrawn AS (SELECT pair_id, i, j0 + (j0 >= i)::INT AS j FROM (
SELECT pair_id, CAST(floor({uniform_sql(42, 'pairs.i', 'pair_id')} * n) AS INT) AS i, CAST(floor({uniform_sql(42, 'pairs.j', 'pair_id')} * (n - 1)) AS INT) AS j0
FROM range(5000) r(pair_id), (SELECT count(*) AS n FROM csamples))),
cpairs AS (SELECT p.pair_id, {_EUCLID} AS distance FROM cdrawn p JOIN cat a ON a.pos = p.i JOIN cat b ON b.pos = p.j
JOIN chosen x0 ON x0.sample_id = a.sample_id JOIN chosen y0 ON y0.sample_id = b.sample_id AND y0.od_index = x0.od_index,
LATERAL (SELECT x0.flow AS v) x, LATERAL (SELECT y0.flow AS v) y GROUP BY p.pair_id)"""


@query(
    "q7_filter_stats",
    f"""SELECT count(*) AS n_candidates, count(*) FILTER (reason = 'diagonal') AS n_rejected_diagonal,
    count(*) FILTER (reason = 'sparsity') AS n_rejected_sparsity, count(*) FILTER (reason = 'correlation') AS n_rejected_correlation,
    count(*) FILTER (reason = 'trip_length') AS n_rejected_trip_length,
    (SELECT count(*) FROM walk WHERE NOT accepted) AS n_rejected_pairwise,
    (SELECT CAST(count(*) AS INT) FROM csamples) AS n_accepted, CAST({TARGET} - (SELECT count(*) FROM csamples) AS INT) AS n_rejected_pool_exhausted,
    (SELECT avg(distance) FROM cpairs) AS mean_pairwise_frobenius, (SELECT min(distance) FROM cpairs) AS min_pairwise_frobenius,
    (SELECT avg(cv) FROM (SELECT stddev_pop(flow) / (avg(flow) + 1e-9) AS cv FROM chosen GROUP BY o, d)) AS mean_cell_cv,
    (SELECT avg(entropy) FROM ({entropy_sql('chosen')}) WHERE o <> d) AS mean_cell_entropy FROM reasons""",
    _BASE,
    "mean_pairwise_frobenius min_pairwise_frobenius mean_cell_cv mean_cell_entropy",
    [*_WALK, STATS],
)
def _(spark, sf):
    made = materialise(decisions(spark, sf), "decisions")
    selected = od(spark, sf).join(made.filter("accepted").select("sample_id"), "sample_id", "left_semi")
    return Q.filter_stats(reasons(spark, sf), made, selected, inputs.n_zones(spark, sf), TARGET)


# ---------------------------------------------------------------- per-table metrics


@query(
    "m1_base_analysis",
    """SELECT CAST(25 AS INT) AS num_zones, sum(flow) AS total_demand, count(*) FILTER (flow <> 0) AS num_nonzero,
    1 - count(*) FILTER (flow <> 0) / 625 AS sparsity_fraction FROM base_od""",
    ["base_od"],
    "sparsity_fraction",
)
def _(spark, sf):
    return M.analyse_base(fx.base_od(spark, sf), inputs.n_zones(spark, sf))


@query(
    "m1_base_marginals",
    """SELECT zone, sum(p) AS production, sum(a) AS attraction FROM (
    SELECT o AS zone, flow AS p, 0 AS a FROM base_od UNION ALL SELECT d, 0, flow FROM base_od) GROUP BY ALL""",
    ["base_od"],
)
def _(spark, sf):
    return M.base_marginals(fx.base_od(spark, sf))


@query("m2_top_pairs", "SELECT o, d, flow FROM base_od WHERE flow > 0 ORDER BY flow DESC, o, d LIMIT 20", ["base_od"])
def _(spark, sf):
    return M.top_pairs(fx.base_od(spark, sf), 20)


@query("m3_productions", "SELECT sample_id, o, sum(flow) AS production FROM od_batch GROUP BY ALL", ["od_batch"])
def _(spark, sf):
    return M.productions(od(spark, sf))


@query("m3_attractions", "SELECT sample_id, d, sum(flow) AS attraction FROM od_batch GROUP BY ALL", ["od_batch"])
def _(spark, sf):
    return M.attractions(od(spark, sf))


TABLE_METRICS = """table_metrics AS (
WITH cell AS (SELECT f.sample_id, avg(abs(f.flow - b.flow)) AS mae, sqrt(avg((f.flow - b.flow) * (f.flow - b.flow))) AS rmse,
  sum(abs(f.flow - b.flow)) / (sum(b.flow) + 1e-12) AS relative_error,
  CASE WHEN stddev_pop(f.flow) >= 1e-12 AND stddev_pop(b.flow) >= 1e-12 THEN corr(f.flow, b.flow) END AS correlation,
  count(*) FILTER (b.flow <= 0 AND f.flow > 1e-6) AS new_connections,
  sum(CASE WHEN f.o = f.d THEN f.flow ELSE 0 END) AS diagonal_violation, avg((f.flow = 0)::INT) AS sparsity, sum(f.flow) AS total_demand
  FROM dense f JOIN mean_base b ON b.o = f.o AND b.d = f.d GROUP BY f.sample_id),
p AS (SELECT sample_id, avg(abs((s - b) / (b + 1e-9))) AS production_error FROM (
  SELECT f.sample_id, f.o, sum(f.flow) AS s, sum(b.flow) AS b FROM dense f JOIN mean_base b ON b.o = f.o AND b.d = f.d GROUP BY ALL) GROUP BY ALL),
a AS (SELECT sample_id, avg(abs((s - b) / (b + 1e-9))) AS attraction_error FROM (
  SELECT f.sample_id, f.d, sum(f.flow) AS s, sum(b.flow) AS b FROM dense f JOIN mean_base b ON b.o = f.o AND b.d = f.d GROUP BY ALL) GROUP BY ALL)
SELECT * FROM cell JOIN p USING (sample_id) JOIN a USING (sample_id))"""
_M4 = "mae rmse relative_error correlation production_error attraction_error diagonal_violation sparsity"


@query(
    "m4_table_metrics",
    """SELECT *, CAST(sample_id % 9 AS INT) AS ipf_iterations, sample_id / 10000 AS ipf_final_error, sample_id < 10 AS ipf_converged
    FROM table_metrics""",
    ["dense", "base_od"],
    _M4 + " ipf_final_error",
    [MEAN_BASE, TABLE_METRICS],
)
def _(spark, sf):
    raking = od(spark, sf).select("sample_id").distinct().select(
        "sample_id", (F.col("sample_id") % 9).cast("int").alias("iterations"), (F.col("sample_id") / 10000.0).alias("final_error")
    )
    return M.table_metrics(od(spark, sf), mean_base(spark, sf), inputs.n_zones(spark, sf), raking)


@query(
    "m5_sampled_metrics",
    f"""SELECT avg(mae) AS mean_mae, avg(rmse) AS mean_rmse, avg(relative_error) AS mean_relative_error, avg(correlation) AS mean_correlation,
    stddev_pop(correlation) AS std_correlation, CAST(max(new_connections) AS DOUBLE) AS max_new_connections,
    avg(total_demand) AS mean_total_demand, stddev_pop(total_demand) AS std_total_demand, CAST(count(*) AS DOUBLE) AS eval_sample_size
    FROM (SELECT * FROM table_metrics ORDER BY {uniform_sql(42, 'metrics', 'sample_id')}, sample_id LIMIT 10000)""",
    ["dense", "base_od"],
    "mean_mae mean_rmse mean_relative_error mean_correlation std_correlation mean_total_demand std_total_demand",
    [MEAN_BASE, TABLE_METRICS],
)
def _(spark, sf):
    return M.sampled_metrics(od(spark, sf), mean_base(spark, sf), inputs.n_zones(spark, sf))


_FLOATS = "mae rmse relative_error correlation diagonal_violation sparsity total_demand production_error attraction_error".split()


@query(
    "m6_aggregate_metrics",
    "SELECT "
    + ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in _FLOATS)
    + ", avg(new_connections) AS mean_new_connections, CAST(max(new_connections) AS DOUBLE) AS max_new_connections FROM table_metrics",
    ["dense", "base_od"],
    {**{f"{k}_{c}": 5 for c in _FLOATS for k in ("mean", "std")}, "mean_new_connections": 6},
    [MEAN_BASE, TABLE_METRICS],
)
def _(spark, sf):
    return M.aggregate_metrics(M.table_metrics(od(spark, sf), mean_base(spark, sf), inputs.n_zones(spark, sf)))


# ---------------------------------------------------------------- dataset statistics


@query(
    "a1_turn_stats",
    """SELECT turn_id, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, stddev_pop(x) / (avg(x) + 1e-9) AS cv
    FROM dense_counts GROUP BY ALL""",
    ["dense_counts"],
    {c: 5 for c in ("mean", "std", "min", "max", "cv")},
)
def _(spark, sf):
    every = inputs.turns(spark, sf).select("turn_id")
    return ST.feature_stats(inputs.counts(spark, sf), "turn_id", "x", n_samples(spark, sf), every).drop("sparsity")


@query(
    "a2_od_stats",
    """SELECT od_index, avg(flow) AS mean, stddev_pop(flow) AS std, stddev_pop(flow) / (avg(flow) + 1e-9) AS cv, avg((flow = 0)::INT) AS sparsity
    FROM dense GROUP BY ALL""",
    ["dense"],
    "mean std cv sparsity",
)
def _(spark, sf):
    n = inputs.n_zones(spark, sf)
    every = inputs.pairs(spark, sf).select("od_index")
    return ST.feature_stats(with_od_index(od(spark, sf), n), "od_index", "flow", n_samples(spark, sf), every).drop("min", "max")


def _pair_summary(rows: str, size: str) -> str:
    return f"SELECT avg(distance) AS mean_distance, min(distance) AS min_distance, max(distance) AS max_distance FROM ({pair_distance_sql(rows, size)})"


@query("a3_pair_distance_mean", _pair_summary(_OD_ROWS, _MEAN), ["dense"], "mean_distance min_distance max_distance", [PAIR_DRAW, POSITIONS])
def _(spark, sf):
    n = inputs.n_zones(spark, sf)
    return ST.mean_pair_distance(od(spark, sf), od_index(n), n * n, "flow")


@query("a3_pair_distance_sum", _pair_summary(_X_ROWS, _SUM), ["dense_counts"], {c: 4 for c in ("mean_distance", "min_distance", "max_distance")}, [PAIR_DRAW, POSITIONS])
def _(spark, sf):
    x, m = materialise(inputs.counts(spark, sf), "counts"), inputs.turns(spark, sf).count()
    return ST.mean_pair_distance(x, F.col("turn_id"), m, "x", norm="sum")


@query(
    "a4_diversity_comparison",
    f"""SELECT (SELECT avg(distance) FROM ({pair_distance_sql(_OD_ROWS, _MEAN)})) AS mean_pairwise_od_distance,
    (SELECT avg(distance) FROM ({pair_distance_sql(_X_ROWS, _MEAN)})) AS mean_pairwise_turning_distance""",
    ["dense", "dense_counts"],
    "mean_pairwise_od_distance mean_pairwise_turning_distance",
    [PAIR_DRAW, POSITIONS],
)
def _(spark, sf):
    n = inputs.n_zones(spark, sf)
    x = materialise(inputs.counts(spark, sf), "counts")
    return ST.diversity_comparison(od(spark, sf), x, n, inputs.turns(spark, sf).count())


VARYING = f"""picked AS (SELECT turn_id FROM (SELECT turn_id FROM dense_counts GROUP BY ALL HAVING stddev_pop(x) > 1e-9)
ORDER BY {uniform_sql(42, 'features', 'turn_id')}, turn_id LIMIT 50),
corrs AS (SELECT a.turn_id AS f1, b.turn_id AS f2, corr(a.x, b.x) AS r FROM dense_counts a JOIN dense_counts b
ON a.sample_id = b.sample_id AND a.turn_id < b.turn_id WHERE a.turn_id IN (FROM picked) AND b.turn_id IN (FROM picked) GROUP BY ALL)"""


@query(
    "a5_correlation_summary",
    """SELECT avg(r) AS mean_correlation, min(r) AS min_correlation, max(r) AS max_correlation, max(abs(r)) AS max_abs_correlation,
    (SELECT CAST(count(*) AS INT) FROM picked) AS features_used FROM corrs""",
    ["dense_counts"],
    "mean_correlation min_correlation max_correlation max_abs_correlation",
    [VARYING],
)
def _(spark, sf):
    return ST.correlation_summary(materialise(inputs.counts(spark, sf), "counts"), "turn_id", "x", n_samples(spark, sf))


@query("a6_correlation_matrix", "SELECT f1, f2, r FROM corrs", ["dense_counts"], "r", [VARYING])
def _(spark, sf):
    x = materialise(inputs.counts(spark, sf), "counts")
    n = n_samples(spark, sf)
    chosen = ST.sample_features(ST.varying_features(x, "turn_id", "x", n), "turn_id", 50)
    return ST.correlation_matrix(x, "turn_id", "x", n, chosen)


@query("a7_pca_variance")
def _(spark, sf):
    return ST.explained_variance(flatten(od(spark, sf), inputs.n_zones(spark, sf)), "y", 20)


@query("a8_cluster_inertia")
def _(spark, sf):
    vectors = ST.evaluation_sample(flatten(od(spark, sf), inputs.n_zones(spark, sf)))
    return ST.cluster_inertia(materialise(vectors, "vectors"), "y")


@query(
    "a9_dataset_evaluation",
    f"""SELECT (SELECT CAST(count(*) AS INT) FROM samples) AS num_samples, mean_distance AS mean_pairwise_distance,
    min_distance AS min_pairwise_distance, max_distance AS max_pairwise_distance,
    (SELECT avg(cv) FROM cvs) AS mean_cell_cv, (SELECT max(cv) FROM cvs) AS max_cell_cv,
    (SELECT stddev_pop(t) / (avg(t) + 1e-12) FROM (SELECT sum(flow) AS t FROM od_batch GROUP BY sample_id)) AS demand_cv
    FROM ({_pair_summary(_OD_ROWS, _MEAN)})""",
    ["dense"],
    "mean_pairwise_distance min_pairwise_distance max_pairwise_distance mean_cell_cv max_cell_cv demand_cv",
    [PAIR_DRAW, POSITIONS, "cvs AS (SELECT stddev_pop(flow) / (avg(flow) + 1e-9) AS cv FROM dense GROUP BY od_index)"],
)
def _(spark, sf):
    return ST.evaluate_dataset(od(spark, sf), n_samples(spark, sf), inputs.n_zones(spark, sf))


@query(
    "a10_turning_stats",
    f"""SELECT (SELECT CAST(count(*) AS INT) FROM samples) AS num_samples, (SELECT count(*) FROM turns) AS num_turns,
    (SELECT avg(distance) FROM ({pair_distance_sql(_OD_ROWS, _MEAN)})) AS mean_pairwise_od_distance,
    (SELECT avg(r) FROM corrs) AS mean_turn_correlation, (SELECT max(abs(r)) FROM corrs) AS max_turn_correlation,
    (SELECT avg(m) FROM (SELECT avg(x) AS m FROM dense_counts GROUP BY turn_id)) AS mean_of_turn_means""",
    ["dense", "dense_counts"],
    "mean_pairwise_od_distance mean_turn_correlation max_turn_correlation mean_of_turn_means",
    [PAIR_DRAW, POSITIONS, VARYING],
)
def _(spark, sf):
    n, n_turns = n_samples(spark, sf), inputs.turns(spark, sf).count()
    x = materialise(inputs.counts(spark, sf), "counts")
    zones = inputs.n_zones(spark, sf)
    d = ST.mean_pair_distance(od(spark, sf), od_index(zones), zones * zones, "flow")
    r = ST.correlation_summary(x, "turn_id", "x", n)
    means = ST.feature_stats(x, "turn_id", "x", n).agg(F.sum("mean") / F.lit(float(n_turns)))
    return d.select(
        F.lit(n).alias("num_samples"), F.lit(n_turns).cast("long").alias("num_turns"), F.col("mean_distance").alias("mean_pairwise_od_distance"),
        r.select("mean_correlation").scalar().alias("mean_turn_correlation"),
        r.select("max_abs_correlation").scalar().alias("max_turn_correlation"), means.scalar().alias("mean_of_turn_means"),
    )


@query(
    "a11_demand_summary",
    """SELECT avg(t) AS demand_mean, stddev_pop(t) / (avg(t) + 1e-15) AS demand_cv, max(g) <= 1e-8 AS zero_diag FROM (
    SELECT sum(flow) AS t, max(CASE WHEN o = d THEN abs(flow) ELSE 0 END) AS g FROM raw_demand GROUP BY sample_id)""",
    ["raw_demand"],
    "demand_mean demand_cv",
)
def _(spark, sf):
    return ST.demand_summary(fx.raw_demand(spark, sf))


_BINNED = """SELECT *, CASE WHEN hi - lo < 1e-12 THEN 0 ELSE least(floor((v - lo) / (hi - lo) * 8::DOUBLE), 7) END AS bin FROM (
SELECT sample_id, {f} AS f, {v} AS v, min({v}) OVER (PARTITION BY {f}) AS lo, max({v}) OVER (PARTITION BY {f}) AS hi FROM {t} SEMI JOIN {s} ON {s}.{f} = {t}.{f})"""
MUTUAL = f"""mix AS (SELECT turn_id FROM (SELECT DISTINCT turn_id FROM counts) ORDER BY {uniform_sql(42, 'mi.x', 'turn_id')}, turn_id LIMIT 50),
miy AS (SELECT od_index FROM (SELECT DISTINCT CAST((o - 1) * 25 + d - 1 AS INT) AS od_index FROM od_batch) ORDER BY {uniform_sql(42, 'mi.y', 'od_index')}, od_index LIMIT 50),
bx AS (SELECT sample_id, f AS turn_id, bin FROM ({_BINNED.format(f='turn_id', v='x', t='dense_counts', s='mix')})),
bby AS (SELECT sample_id, f AS od_index, bin FROM ({_BINNED.format(f='od_index', v='flow', t='dense', s='miy')})),
jxy AS (SELECT turn_id, od_index, bx.bin AS b1, bby.bin AS b2, count(*) AS c FROM bx JOIN bby USING (sample_id) GROUP BY ALL),
mi AS (SELECT turn_id, od_index, sum(c / n * ln(c * n / (c1 * c2))) AS mutual_info FROM (
SELECT *, sum(c) OVER (PARTITION BY turn_id, od_index, b1) AS c1, sum(c) OVER (PARTITION BY turn_id, od_index, b2) AS c2,
sum(c) OVER (PARTITION BY turn_id, od_index) AS n FROM jxy) GROUP BY ALL)"""


def information(spark, sf):
    cells = materialise(with_od_index(od(spark, sf), inputs.n_zones(spark, sf)), "od")
    x = materialise(inputs.counts(spark, sf), "counts")
    return x, cells, I.sampled_information(x, cells, n_samples(spark, sf), bins=8)



@query("a12_mutual_information", "SELECT turn_id, od_index, mutual_info FROM mi", ["dense", "dense_counts"], "mutual_info", [MUTUAL])
def _(spark, sf):
    return information(spark, sf)[2]


RANKED_TURNS = """tl AS (SELECT sample_id, avg(flow) AS m FROM dense GROUP BY ALL),
tt AS (SELECT t.turn_id, coalesce((SELECT avg(mutual_info) FROM mi WHERE mi.turn_id = t.turn_id), 0) AS mi_mean,
var_pop(x) AS variance, CASE WHEN stddev_pop(x) > 1e-9 THEN abs(corr(x, m)) ELSE 0 END AS corr_proxy
FROM dense_counts t JOIN tl USING (sample_id) GROUP BY t.turn_id),
rt AS (SELECT *, (mi_mean / ((SELECT max(mi_mean) FROM tt) + 1e-9) + variance / ((SELECT max(variance) FROM tt) + 1e-9) + corr_proxy) / 3 AS importance_score FROM tt)"""
_A13 = {"mi_mean": 6, "variance": 1, "corr_proxy": 6, "importance_score": 6}


def ranked_turns(spark, sf):
    x, cells, mi = information(spark, sf)
    n = inputs.n_zones(spark, sf)
    return I.rank_turns(x, cells, mi, inputs.turns(spark, sf), n_samples(spark, sf), n * n)


@query("a13_rank_turns", "SELECT * FROM rt", ["dense", "dense_counts"], _A13, [MUTUAL, RANKED_TURNS])
def _(spark, sf):
    return ranked_turns(spark, sf)


@query(
    "a14_flow_histogram",
    """SELECT CAST(least(floor((flow - lo) / ((hi - lo) / 50::DOUBLE)), 49) AS INT) AS bin, lo + least(floor((flow - lo) / ((hi - lo) / 50::DOUBLE)), 49) * ((hi - lo) / 50) AS low,
    lo + (least(floor((flow - lo) / ((hi - lo) / 50::DOUBLE)), 49) + 1) * ((hi - lo) / 50) AS high, count(*) AS n
    FROM od_batch, (SELECT min(flow) AS lo, max(flow) AS hi FROM od_batch) GROUP BY ALL""",
    ["od_batch"],
    "low high",
)
def _(spark, sf):
    return ST.histogram(od(spark, sf), "flow", 50)


@query(
    "a16_analysis_bundle",
    """SELECT turn_id, importance_score, mean, std FROM rt JOIN (
    SELECT turn_id, avg(x) AS mean, stddev_pop(x) AS std FROM dense_counts GROUP BY ALL) USING (turn_id)
    ORDER BY round(importance_score, 6) DESC, turn_id LIMIT 20""",
    ["dense", "dense_counts"],
    {"importance_score": 6, "mean": 5, "std": 5},
    [MUTUAL, RANKED_TURNS],
)
def _(spark, sf):
    ranked = ranked_turns(spark, sf).withColumn("importance_score", F.round("importance_score", 6))
    top = I.top_turns(ranked, 20)
    stats = ST.feature_stats(inputs.counts(spark, sf), "turn_id", "x", n_samples(spark, sf))
    return top.join(stats, "turn_id").select("turn_id", "importance_score", "mean", "std")
