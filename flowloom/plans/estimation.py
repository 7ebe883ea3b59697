"""Operator facts, estimators, splits, scores, leaderboards, survey and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assignment as A
from ..operators import leaderboard as H
from ..operators import linear as L
from ..operators import regression as B
from ..operators import scoring as V
from ..operators import search as Q
from ..operators import splits as I
from ..operators import stats as ST
from ..operators import stored as K
from ..operators import survey as U
from ..operators.constraints import constrain
from ..operators.gram import cross_products
from ..operators.reshape import flatten, pack, transpose, unflatten, with_od_index
from ..session import materialise, scratch_path
from ..sources import fixtures as fx
from ..streaming import counts as X
from . import inputs
from .registry import query
from .sql_parts import SURVEY, uniform_sql
from .statistics import mean_base, n_samples, od


def _sizes(spark, sf):
    return inputs.n_zones(spark, sf), inputs.turns(spark, sf).count()


# ---------------------------------------------------------------- operator facts


@query("l1_rank")
def _(spark, sf):
    n, m = _sizes(spark, sf)
    return L.rank_report(spark, L.singular_values(inputs.assignment(spark, sf), m, n * n), m, n * n)


@query("l2_spectrum")
def _(spark, sf):
    n, m = _sizes(spark, sf)
    return L.spectrum(spark, L.singular_values(inputs.assignment(spark, sf), m, n * n))


@query("l3_compare_operators")
def _(spark, sf):
    n, m = _sizes(spark, sf)
    best = inputs.routes(spark, sf).filter("rank = 1")
    binary = materialise(A.binary_assignment(best, inputs.turns(spark, sf), n), "binary")
    reports = [L.rank_report(spark, L.singular_values(a, m, n * n), m, n * n) for a in (binary, inputs.assignment(spark, sf))]
    return L.compare_operators(*reports)


@query("l4_operator_summary")
def _(spark, sf):
    n, m = _sizes(spark, sf)
    return L.rank_report(spark, L.singular_values(inputs.assignment(spark, sf), m, n * n), m, n * n, rtol=1e-10)


@query("l4_pseudo_inverse")
def _(spark, sf):
    return L.pseudo_inverse(inputs.assignment(spark, sf), _sizes(spark, sf)[1])


def back_projection(spark, sf):
    """A given operator table: the transposed assignment, scaled."""
    return inputs.assignment(spark, sf).withColumn("weight", F.col("weight") * 0.01)


BACK = "back AS (SELECT turn_id, od_index, weight * 0.01::DOUBLE AS weight FROM assignment)"
BACK_Y = "back_y AS (SELECT sample_id, od_index, sum(x * weight) AS y FROM counts JOIN back USING (turn_id) GROUP BY ALL)"


@query("l5_apply_operator", "SELECT sample_id, od_index, y FROM back_y", ["counts"], {"y": 5}, [BACK, BACK_Y])
def _(spark, sf):
    return L.estimate(inputs.counts(spark, sf), back_projection(spark, sf))


@query("l6_tikhonov")
def _(spark, sf):
    m = _sizes(spark, sf)[1]
    x, a = materialise(inputs.counts(spark, sf), "counts"), inputs.assignment(spark, sf)
    y = materialise(L.tikhonov_estimate(x, a, m, 1.0), "tikhonov")
    return L.normal_equation_residual(y, x, a, 1.0)


@query("l6_tikhonov_estimate")
def _(spark, sf):
    return L.tikhonov_estimate(inputs.counts(spark, sf), inputs.assignment(spark, sf), _sizes(spark, sf)[1], 1.0)


@query("l7_physics_refine")
def _(spark, sf):
    n, m = _sizes(spark, sf)
    x = materialise(inputs.counts(spark, sf), "counts")
    start = with_od_index(od(spark, sf), n).select("sample_id", "od_index", (F.col("flow") * 0.9).alias("y"))
    return L.physics_refine(start, x, inputs.assignment(spark, sf), m, 0.1)


@query("l8_moore_penrose")
def _(spark, sf):
    return L.minimum_norm_estimate(inputs.counts(spark, sf), inputs.assignment(spark, sf), _sizes(spark, sf)[1])


@query(
    "l9_nullspace_diagnostics",
    """SELECT d.sample_id, l2_to_pinv, leak / greatest(xn, 1e-6) AS rel_leak, mean_abs_component FROM (
      SELECT sample_id, sqrt(sum(y * y)) AS l2_to_pinv, sum(abs(y)) / 625 AS mean_abs_component FROM diff GROUP BY ALL) d
    JOIN (SELECT sample_id, sqrt(sum(a * a)) AS leak FROM (
      SELECT sample_id, turn_id, sum(y * weight) AS a FROM diff JOIN assignment USING (od_index) GROUP BY ALL) GROUP BY ALL) k USING (sample_id)
    JOIN (SELECT sample_id, sqrt(sum(x * x)) AS xn FROM counts GROUP BY ALL) n USING (sample_id)""",
    ["counts"],
    {"l2_to_pinv": 5, "rel_leak": 6, "mean_abs_component": 6},
    [
        BACK,
        BACK_Y,
        """diff AS (SELECT sample_id, od_index, sum(y) AS y FROM (
        SELECT sample_id, CAST((o - 1) * 25 + d - 1 AS INT) AS od_index, 0.9 * flow AS y FROM od_batch
        UNION ALL SELECT sample_id, od_index, -y FROM back_y) GROUP BY ALL)""",
    ],
)
def _(spark, sf):
    n = inputs.n_zones(spark, sf)
    x, a = materialise(inputs.counts(spark, sf), "counts"), inputs.assignment(spark, sf)
    start = with_od_index(od(spark, sf), n).select("sample_id", "od_index", (F.col("flow") * 0.9).alias("y"))
    return L.nullspace_diagnostics(start, x, a, L.estimate(x, back_projection(spark, sf)), n * n)


@query("l9_null_component")
def _(spark, sf):
    y = with_od_index(od(spark, sf), inputs.n_zones(spark, sf)).select("sample_id", "od_index", F.col("flow").alias("y"))
    return L.null_component(y, inputs.assignment(spark, sf), _sizes(spark, sf)[1])


# ---------------------------------------------------------------- regressions


def design(spark, sf):
    """``sample_id, x, y``: dense counts and cells per sample."""
    n, m = _sizes(spark, sf)
    x = pack(inputs.counts(spark, sf), F.col("turn_id"), "x", m, "x")
    return materialise(x.join(flatten(od(spark, sf), n), "sample_id"), "design")


def folded(spark, sf, k=3):
    rows = design(spark, sf)
    at = ST.positions(rows)
    return materialise(rows.join(at.withColumn("fold", B.fold_of("pos", at.count(), k)), "sample_id"), "folded")


@query(
    "b1_cross_products",
    """SELECT CAST(a.k AS INT) AS i, CAST(b.k AS INT) AS j, sum(a.v * b.v) AS s FROM (
    SELECT sample_id, 0 AS k, 1::DOUBLE AS v FROM samples UNION ALL SELECT sample_id, turn_id + 1, x FROM dense_counts) a
    JOIN (SELECT sample_id, 0 AS k, 1::DOUBLE AS v FROM samples UNION ALL SELECT sample_id, turn_id + 1, x FROM dense_counts
    UNION ALL SELECT sample_id, od_index + 1 + (SELECT count(*) FROM turns), flow FROM dense) b USING (sample_id) GROUP BY ALL""",
    ["dense", "dense_counts"],
    {"s": 0},
)
def _(spark, sf):
    n, m = _sizes(spark, sf)
    return cross_products(design(spark, sf), m, n * n).drop("fold")


def _mean_error(rows, predicted):
    """Mean absolute error per sample of predicted vectors."""
    gap = F.aggregate(F.zip_with("t", "y", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, v: acc + v)
    return rows.select("sample_id", F.col("y").alias("t")).join(predicted, "sample_id").select(
        "sample_id", (gap / F.size("y")).alias("mae")
    )


@query("b1_least_squares")
def _(spark, sf):
    n, m = _sizes(spark, sf)
    rows = design(spark, sf)
    return _mean_error(rows, B.predict(rows, B.ridge(B.gather(rows, m, n * n)[0], 0.0)))


@query("b1_ridge")
def _(spark, sf):
    n, m = _sizes(spark, sf)
    rows = design(spark, sf)
    return _mean_error(rows, B.predict(rows, B.ridge(B.gather(rows, m, n * n)[0], 10.0)))


@query("b2_ridge_cv")
def _(spark, sf):
    n, m = _sizes(spark, sf)
    return B.ridge_cv(folded(spark, sf), m, n * n, [0.1, 1.0, 10.0, 100.0, 1000.0])


@query("b3_pls")
def _(spark, sf):
    n, m = _sizes(spark, sf)
    rows = design(spark, sf)
    return _mean_error(rows, B.predict(rows, B.pls(B.gather(rows, m, n * n)[0], 25)))


@query("b4_elastic_net")
def _(spark, sf):
    """Every cell is a target; the error of each sample's prediction."""
    n, m = _sizes(spark, sf)
    rows = design(spark, sf)
    fitted = B.sparse_fit(spark, B.gather(rows, m, n * n)[0], 0.01, 0.5)
    return _mean_error(rows, B.predict(rows, B.from_rows(materialise(fitted, "elastic"))))


@query("b4_lasso")
def _(spark, sf):
    """Weights of the lasso that are not zero, for every cell."""
    n, m = _sizes(spark, sf)
    fitted = B.sparse_fit(spark, B.gather(design(spark, sf), m, n * n)[0], 1.0, 1.0)
    each = fitted.select("od_index", F.posexplode("coef").alias("turn_id", "weight"))
    return each.filter(F.col("weight") != 0)


@query("b6_physics_ridge")
def _(spark, sf):
    n, m = _sizes(spark, sf)
    rows = design(spark, sf)
    y0 = B.predict(rows, B.ridge(B.gather(rows, m, n * n)[0], 10.0))
    long = y0.select("sample_id", F.posexplode("y").alias("od_index", "y"))
    return L.physics_refine(long, inputs.counts(spark, sf), inputs.assignment(spark, sf), m, 0.1)


@query("b7_penalty_search")
def _(spark, sf):
    """Ridge penalties scored on the validation split by the composite."""
    n, m = _sizes(spark, sf)
    split = materialise(I.split_ids(od(spark, sf).select("sample_id").distinct()), "splits")
    rows = materialise(design(spark, sf).join(split, "sample_id"), "design")
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    sums = B.gather(train, m, n * n)[0]
    made = None
    for alpha in B.log_grid(1e-1, 1e5, 4):
        y = unflatten(B.predict(val, B.ridge(sums, alpha)), n, value="y").withColumns(
            {"model": F.lit(f"{alpha:g}"), "split": F.lit("val")}
        )
        made = y if made is None else made.unionByName(y)
    made = materialise(made, "candidates")
    ids = split.filter("split = 'val'")
    truth = od(spark, sf).join(ids, "sample_id")
    x = inputs.counts(spark, sf).join(ids, "sample_id")
    scores = V.all_scores(made, truth, x, inputs.assignment(spark, sf), ids, n, m)
    ranked = scores.withColumn("score", V.composite())
    return ranked.agg(F.min_by("model", "score").alias("alpha"), F.min("score").alias("score"))


@query("b7_model_search")
def _(spark, sf):
    """Every candidate of Tikhonov, ridge, PLS and physics ridge, fitted on train and scored on the validation split."""
    n, m = _sizes(spark, sf)
    split = materialise(I.split_ids(od(spark, sf).select("sample_id").distinct()), "splits")
    rows = materialise(design(spark, sf).join(split, "sample_id"), "design")
    operator = inputs.assignment(spark, sf)
    matrix = A.operator_matrix(operator, "turn_id", "od_index", m, n * n)
    singles, physics = Q.default_families(B.gather(rows.filter("split = 'train'"), m, n * n)[0], operator, matrix)
    scores = Q.search_scores(rows.filter("split = 'val'"), singles, matrix, n, physics)
    best = Q.best_candidates(materialise(scores, "search")).select("model", F.col("score").alias("least"))
    return scores.join(F.broadcast(best), "model").withColumn("chosen", F.col("score") == F.col("least")).drop("least")


@query(
    "b8_predict_and_clip",
    "SELECT sample_id, o, d, CASE WHEN o <> d THEN greatest(y - 2, 0) ELSE 0 END AS y FROM back_y JOIN pairs USING (od_index)",
    ["counts", "pairs"],
    {"y": 5},
    [BACK, BACK_Y],
)
def _(spark, sf):
    y = U.estimate_cells(inputs.counts(spark, sf), back_projection(spark, sf), inputs.n_zones(spark, sf))
    return constrain(y.withColumn("y", F.col("y") - 2.0), value="y")


# ---------------------------------------------------------------- splits and scaling

SPLITS = f"""splits AS (SELECT sample_id, CASE WHEN r <= round(n * 0.70) THEN 'train' WHEN r <= round(n * 0.70) + round(n * 0.15) THEN 'val' ELSE 'test' END AS split
FROM (SELECT sample_id, row_number() OVER (ORDER BY {uniform_sql(42, 'split', 'sample_id')}, sample_id) AS r, count(*) OVER () AS n FROM samples))"""


def splits(spark, sf):
    return I.split_ids(od(spark, sf).select("sample_id").distinct())


@query("i1_split", "SELECT sample_id, split FROM splits", ["samples"], extra=[SPLITS])
def _(spark, sf):
    return splits(spark, sf)


@query("i2_disjoint", "SELECT sample_id, count(*) AS n FROM splits GROUP BY ALL HAVING count(*) > 1", ["samples"], extra=[SPLITS])
def _(spark, sf):
    return I.overlaps(splits(spark, sf))


def _digest_sql(columns: str, table: str) -> str:
    level = f"SELECT sha256(concat_ws('|', {columns})) AS h, 1 AS n FROM {table}"
    for digits in (6, 4, 2, 0):
        level = f"""SELECT concat(p, sha256(string_agg(h, '' ORDER BY h))) AS h, sum(n) AS n
        FROM (SELECT substr(h, 1, {digits}) AS p, h, n FROM ({level})) GROUP BY p"""
    return f"SELECT CAST(n AS BIGINT) AS rows, h AS sha256 FROM ({level})"


#: counts of a third of the turns shifted, so that the forward check has something to find
_CHECKED = "SELECT sample_id, x, x + 0.25 * (turn_id % 3) AS y FROM counts WHERE sample_id < 32"


@query(
    "i3_leakage_report",
    f"""SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test,
    count(*) = count(DISTINCT sample_id) AS splits_disjoint, CAST(100000 AS INT) AS survey_id,
    count(*) FILTER (sample_id = 100000) = 0 AS survey_excluded,
    (SELECT sha256 FROM ({_digest_sql("turn_id, od_index, CAST(round(weight * 1000000) AS BIGINT)", "assignment")})) AS operator_sha256,
    (SELECT count(DISTINCT sample_id) FROM ({_CHECKED})) AS forward_n_checked,
    (SELECT max(abs(x - y)) FROM ({_CHECKED})) AS forward_max_abs_err,
    (SELECT bool_and(abs(x - y) <= 1e-2 + 1e-3 * abs(x)) FROM ({_CHECKED})) AS forward_allclose FROM splits""",
    ["samples", "counts"],
    "forward_max_abs_err",
    [SPLITS],
)
def _(spark, sf):
    operator, n = inputs.assignment(spark, sf), inputs.n_zones(spark, sf)
    entries = I.table_fingerprint(operator, ["turn_id", "od_index", F.round(F.col("weight") * 1_000_000).cast("bigint")])
    shifted = inputs.counts(spark, sf).withColumn("x", F.col("x") + F.lit(0.25) * (F.col("turn_id") % 3))
    forward = A.forward_check(od(spark, sf), shifted, operator, n)
    return I.leakage_report(splits(spark, sf), 100_000, entries.first()["sha256"], forward)


@query("i5_table_fingerprint", _digest_sql("sample_id, o, d, CAST(flow AS BIGINT)", "od_batch"), ["od_batch"])
def _(spark, sf):
    return I.table_fingerprint(od(spark, sf), ["sample_id", "o", "d", F.col("flow").cast("bigint")])


SCALER = """scaler AS (SELECT turn_id, avg(x) AS mean, CASE WHEN stddev_pop(x) > 1e-6 THEN stddev_pop(x) ELSE 1 END AS scale
FROM dense_counts JOIN splits USING (sample_id) WHERE split = 'train' GROUP BY ALL)"""


def dense_counts(spark, sf):
    n, m = _sizes(spark, sf)
    packed = pack(inputs.counts(spark, sf), F.col("turn_id"), "x", m, "x")
    return packed.select("sample_id", F.posexplode("x").alias("turn_id", "x"))


def fitted(spark, sf, x):
    train = splits(spark, sf).filter("split = 'train'")
    return I.fit_scaler(x.join(train, "sample_id"), "turn_id", "x", train.count())


@query("i6_fit_scaler", "SELECT turn_id, mean, scale FROM scaler", ["dense_counts"], {"mean": 5, "scale": 5}, [SPLITS, SCALER])
def _(spark, sf):
    return fitted(spark, sf, dense_counts(spark, sf))


@query("i6_scale", "SELECT sample_id, turn_id, (x - mean) / scale AS x FROM dense_counts JOIN scaler USING (turn_id)", ["dense_counts"], {"x": 5}, [SPLITS, SCALER])
def _(spark, sf):
    x = materialise(dense_counts(spark, sf), "dense")
    return I.scale(x, fitted(spark, sf, x), "turn_id", "x").select("sample_id", "turn_id", "x")


@query("i6_unscale", "SELECT sample_id, turn_id, x FROM dense_counts", ["dense_counts"], {"x": 5})
def _(spark, sf):
    x = materialise(dense_counts(spark, sf), "dense")
    s = fitted(spark, sf, x)
    return I.unscale(I.scale(x, s, "turn_id", "x"), s, "turn_id", "x").select("sample_id", "turn_id", "x")


@query(
    "i7_capped_holdout",
    f"""SELECT sample_id, CASE WHEN r > least(n, 60) - 32 THEN 'hold' ELSE 'fit' END AS part FROM (
    SELECT sample_id, row_number() OVER (ORDER BY {uniform_sql(42, 'cap', 'sample_id')}, sample_id) AS r, count(*) OVER () AS n FROM samples) WHERE r <= 60""",
    ["samples"],
)
def _(spark, sf):
    return I.capped_holdout(od(spark, sf).select("sample_id").distinct(), 60)


# ---------------------------------------------------------------- scores

MEAN_MONTH = "mean_month AS (SELECT o, d, flow / (SELECT count(*) FROM samples) AS flow FROM base_od)"
PREDICTIONS = """preds AS (SELECT 'average' AS model, split, sample_id, o, d, flow AS y FROM splits CROSS JOIN mean_month
UNION ALL SELECT 'shrunk', split, sample_id, o, d, 0.75 * flow - 2 FROM od_batch JOIN splits USING (sample_id)
UNION ALL SELECT 'mirrored', split, sample_id, d, o, flow FROM od_batch JOIN splits USING (sample_id)),
cells AS (SELECT m.model, s.split, f.sample_id, f.o, f.d, f.od_index, f.flow AS t, coalesce(p.y, 0) AS p
FROM dense f JOIN splits s USING (sample_id) CROSS JOIN (SELECT DISTINCT model FROM preds) m
LEFT JOIN preds p ON p.model = m.model AND p.sample_id = f.sample_id AND p.o = f.o AND p.d = f.d)"""


def predictions(spark, sf, split):
    """Three stand-in models: the average month, a shrunken copy, the mirrored table."""
    n = inputs.n_zones(spark, sf)
    cells = od(spark, sf).join(split, "sample_id")
    listed = split.withColumn("o", F.explode(F.sequence(F.lit(1), F.lit(n))))
    average = listed.join(mean_base(spark, sf), "o").withColumnRenamed("flow", "y")
    shrunk = cells.withColumn("y", F.lit(0.75) * F.col("flow") - 2.0)
    mirrored = transpose(cells).withColumnRenamed("flow", "y")
    out = None
    for name, df in (("average", average), ("shrunk", shrunk), ("mirrored", mirrored)):
        part = df.select(F.lit(name).alias("model"), "split", "sample_id", "o", "d", "y")
        out = part if out is None else out.unionByName(part)
    return materialise(out, "predictions")


def scored(spark, sf):
    n, m = _sizes(spark, sf)
    split = materialise(splits(spark, sf), "splits")
    truth = od(spark, sf).join(split, "sample_id")
    x = inputs.counts(spark, sf).join(split, "sample_id")
    return V.all_scores(predictions(spark, sf, split), truth, x, inputs.assignment(spark, sf), split, n, m)


def _marginal_sql(key: str, name: str) -> str:
    return f"""{name} AS (SELECT model, split, avg(abs(t - p)) AS {name}_mae, sqrt(avg((t - p) * (t - p))) AS {name}_rmse,
    avg(abs(t - p) / greatest(abs(t), 1e-6)) AS {name}_rel_error FROM (
    SELECT model, split, sample_id, {key}, sum(t) AS t, sum(p) AS p FROM cells GROUP BY ALL) GROUP BY ALL)"""


def _r2_sql(cells: str) -> str:
    return f"""SELECT model, split, avg(CASE WHEN sst <= 1e-9 THEN (sse <= 1e-18)::INT ELSE 1 - sse / sst END) AS r2 FROM (
    SELECT model, split, od_index, sum((t - p) * (t - p)) AS sse, sum(t * t) - sum(t) * sum(t) / count(*) AS sst FROM {cells} GROUP BY ALL) GROUP BY ALL"""


SCORES = [
    """cellwise AS (SELECT model, split, avg(abs(t - p)) AS mae, sqrt(avg((t - p) * (t - p))) AS rmse, sqrt(avg((t - p) * (t - p))) AS frobenius,
    avg(abs(t - p) / greatest(abs(t), 1e-6)) AS relative_error, count(*) FILTER (p < -1e-8) / count(DISTINCT sample_id) AS negative_cells,
    avg(CASE WHEN o = d THEN abs(p) END) AS diagonal_violation, avg(CASE WHEN o = d THEN abs(p) END) AS mean_abs_diagonal,
    count(*) FILTER (t > 1e-6 AND p > 1e-6) / count(*) FILTER (t > 1e-6 OR p > 1e-6) AS support_jaccard,
    1 - avg((p > 1e-6)::INT) AS pred_sparsity, 1 - avg((t > 1e-6)::INT) AS true_sparsity,
    abs(avg((p > 1e-6)::INT) - avg((t > 1e-6)::INT)) AS sparsity_error FROM cells GROUP BY ALL)""",
    f"r2s AS ({_r2_sql('cells')})",
    """corrs AS (SELECT model, split, avg(r) AS correlation, avg(gap) AS total_demand_error FROM (
    SELECT model, split, sample_id, CASE WHEN stddev_pop(t) > 1e-12 AND stddev_pop(p) > 1e-12 THEN corr(t, p) END AS r, abs(sum(t) - sum(p)) AS gap
    FROM cells GROUP BY ALL) GROUP BY ALL)""",
    _marginal_sql("o", "production"),
    _marginal_sql("d", "attraction"),
    """rhos AS (SELECT model, split, avg(rho) AS spearman FROM (SELECT model, split, sample_id, corr(rt, rp) AS rho FROM (
    SELECT model, split, sample_id, rank() OVER (PARTITION BY model, sample_id ORDER BY t) + (count(*) OVER (PARTITION BY model, sample_id, t) - 1) / 2 AS rt,
    rank() OVER (PARTITION BY model, sample_id ORDER BY p) + (count(*) OVER (PARTITION BY model, sample_id, p) - 1) / 2 AS rp FROM cells) GROUP BY ALL) GROUP BY ALL)""",
    """xh AS (SELECT model, split, sample_id, turn_id, sum(p * weight) AS h FROM cells JOIN assignment USING (od_index) GROUP BY ALL),
    xx AS (SELECT m.model, s.split, c.sample_id, c.turn_id, c.x, coalesce(h.h, 0) AS h FROM dense_counts c JOIN splits s USING (sample_id)
    CROSS JOIN (SELECT DISTINCT model FROM preds) m LEFT JOIN xh h ON h.model = m.model AND h.sample_id = c.sample_id AND h.turn_id = c.turn_id),
    fwd AS (SELECT model, split, avg(abs(x - h)) AS forward_mae, sqrt(avg((x - h) * (x - h))) AS forward_rmse,
    1 - sum((x - h) * (x - h)) / (var_pop(x) * count(*)) AS forward_r2, corr(x, h) AS forward_correlation,
    sum(nrm) / count(DISTINCT sample_id) AS mean_residual_norm FROM (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY model, sample_id) = 1 THEN sqrt(sum((x - h) * (x - h)) OVER (PARTITION BY model, sample_id)) ELSE 0 END AS nrm FROM xx) GROUP BY ALL)""",
]
_DIGITS = {
    c: 5
    for c in (
        "mae rmse frobenius negative_cells diagonal_violation mean_abs_diagonal support_jaccard pred_sparsity true_sparsity sparsity_error r2 "
        "correlation total_demand_error production_mae production_rmse attraction_mae attraction_rmse spearman forward_mae forward_rmse "
        "forward_r2 forward_correlation mean_residual_norm pearson"
    ).split()
} | {"relative_error": 1, "production_rel_error": 1, "attraction_rel_error": 1}
_SCORE_PARTS = ["dense", "base_od", "dense_counts"]


@query(
    "v4_all_scores",
    """SELECT *, correlation AS pearson FROM cellwise JOIN r2s USING (model, split) JOIN corrs USING (model, split) JOIN production USING (model, split)
    JOIN attraction USING (model, split) JOIN rhos USING (model, split) JOIN fwd USING (model, split)""",
    _SCORE_PARTS,
    _DIGITS,
    [SPLITS, MEAN_MONTH, PREDICTIONS, *SCORES],
)
def _(spark, sf):
    return scored(spark, sf)


CLIPPED = "clipped AS (SELECT model, split, sample_id, o, d, od_index, greatest(t, 0) AS t, greatest(p, 0) AS p FROM cells)"


@query(
    "v1_clipped_scores",
    f"""SELECT * FROM (SELECT model, split, avg(abs(t - p)) AS mae, sqrt(avg((t - p) * (t - p))) AS rmse,
    100 * avg(CASE WHEN abs(t) > 1e-6 THEN abs((t - p) / t) END) AS mape, sqrt(avg((t - p) * (t - p))) AS frobenius FROM clipped GROUP BY ALL)
    JOIN ({_r2_sql('clipped')}) USING (model, split)
    JOIN (SELECT model, split, avg(abs(t - p)) AS production_mae FROM (SELECT model, split, sample_id, o, sum(t) AS t, sum(p) AS p FROM clipped GROUP BY ALL) GROUP BY ALL) USING (model, split)
    JOIN (SELECT model, split, avg(abs(t - p)) AS attraction_mae FROM (SELECT model, split, sample_id, d, sum(t) AS t, sum(p) AS p FROM clipped GROUP BY ALL) GROUP BY ALL) USING (model, split)
    JOIN (SELECT model, split, avg(r) AS correlation FROM (SELECT model, split, sample_id, corr(t, p) AS r FROM clipped GROUP BY ALL) GROUP BY ALL) USING (model, split)""",
    ["dense", "base_od"],
    "mae rmse mape frobenius r2 production_mae attraction_mae correlation",
    [SPLITS, MEAN_MONTH, PREDICTIONS, CLIPPED],
)
def _(spark, sf):
    split = materialise(splits(spark, sf), "splits")
    truth = od(spark, sf).join(split, "sample_id")
    return V.basic_scores(predictions(spark, sf, split), truth, split, inputs.n_zones(spark, sf))


@query(
    "v2_forward_scores",
    "SELECT * FROM fwd",
    _SCORE_PARTS,
    {c: 5 for c in ("forward_mae", "forward_rmse", "forward_r2", "forward_correlation", "mean_residual_norm")},
    [SPLITS, MEAN_MONTH, PREDICTIONS, SCORES[-1]],
)
def _(spark, sf):
    n, m = _sizes(spark, sf)
    split = materialise(splits(spark, sf), "splits")
    x = inputs.counts(spark, sf).join(split, "sample_id")
    return V.forward_scores(predictions(spark, sf, split), x, inputs.assignment(spark, sf), n, m, V.split_sizes(split))


@query(
    "v3_structural_scores",
    "SELECT model, split, support_jaccard, pred_sparsity, true_sparsity, mean_abs_diagonal FROM cellwise",
    ["dense", "base_od"],
    "support_jaccard pred_sparsity true_sparsity mean_abs_diagonal",
    [SPLITS, MEAN_MONTH, PREDICTIONS, SCORES[0]],
)
def _(spark, sf):
    split = materialise(splits(spark, sf), "splits")
    truth = od(spark, sf).join(split, "sample_id")
    return V.structural_scores(predictions(spark, sf, split), truth, split, inputs.n_zones(spark, sf))


#: model rows with four error measures taken straight from the line items
_NAMES = list(H.FAMILIES) + ["unlisted"]
_NAME_SQL = "[" + ", ".join(f"'{m}'" for m in _NAMES) + "]"
MODEL_ROWS = f"""model_rows AS (SELECT {_NAME_SQL}[l_suppkey % {len(_NAMES)} + 1] AS model, CASE WHEN l_linenumber % 2 = 0 THEN 'val' ELSE 'test' END AS split,
avg(l_quantity) AS mae, avg(l_extendedprice) / 1000 AS forward_mae, avg(l_discount) AS production_mae, avg(l_tax) AS attraction_mae FROM lineitem GROUP BY ALL),
refs AS (SELECT avg(mae) AS r1, avg(forward_mae) AS r2, avg(production_mae) AS r3, avg(attraction_mae) AS r4 FROM model_rows WHERE split = 'val'),
composed AS (SELECT m.*, mae / r1 + forward_mae / r2 + 0.5 * production_mae / r3 + 0.5 * attraction_mae / r4 AS composite_score FROM model_rows m, refs)"""


def model_rows(spark, sf):
    name = F.element_at(F.array(*(F.lit(m) for m in _NAMES)), (F.col("l_suppkey") % len(_NAMES) + 1).cast("int"))
    return fx.table(spark, sf, "lineitem").groupBy(
        name.alias("model"), F.when(F.col("l_linenumber") % 2 == 0, "val").otherwise("test").alias("split")
    ).agg(
        F.avg("l_quantity").alias("mae"), (F.avg("l_extendedprice") / 1000.0).alias("forward_mae"),
        F.avg("l_discount").alias("production_mae"), F.avg("l_tax").alias("attraction_mae"),
    )


def composed(spark, sf):
    rows = materialise(model_rows(spark, sf), "modelrows")
    return H.with_composite(rows, H.validation_references(rows))


_FAMILY_SQL = "CASE model " + " ".join(f"WHEN '{m}' THEN '{f}'" for m, f in H.FAMILIES.items()) + " ELSE 'other' END"


@query("v5_composite", "SELECT model, split, composite_score FROM composed", (), "composite_score", [MODEL_ROWS])
def _(spark, sf):
    return composed(spark, sf).select("model", "split", "composite_score")


@query(
    "v5_raw_composite",
    "SELECT model, split, mae + forward_mae + 0.5 * production_mae + 0.5 * attraction_mae AS composite_score FROM model_rows",
    (),
    "composite_score",
    [MODEL_ROWS],
)
def _(spark, sf):
    return model_rows(spark, sf).select("model", "split", V.composite().alias("composite_score"))


@query("v6_scores_per_split", "SELECT model, split, mae, rmse FROM cellwise", ["dense", "base_od"], "mae rmse", [SPLITS, MEAN_MONTH, PREDICTIONS, SCORES[0]])
def _(spark, sf):
    """Stored predictions of all models and splits scored in one pass."""
    return scored(spark, sf).select("model", "split", "mae", "rmse")


@query("v6_resumed_scores", "SELECT model, split, mae, rmse FROM cellwise", ["dense", "base_od"], "mae rmse", [SPLITS, MEAN_MONTH, PREDICTIONS, SCORES[0]])
def _(spark, sf):
    """One model is stored and scored, then the others come and a second run scores them alone."""
    n, m = _sizes(spark, sf)
    split = materialise(splits(spark, sf), "splits")
    truth, x = od(spark, sf).join(split, "sample_id"), inputs.counts(spark, sf).join(split, "sample_id")
    made = materialise(predictions(spark, sf, split), "predictions")
    first = F.col("model") == made.agg(F.min("model")).scalar()
    kept, scores = scratch_path(spark, "kept"), scratch_path(spark, "scores")
    for part in (made.filter(first), made.filter(~first)):
        K.put(part, kept)
        out = K.score_stored(kept, scores, truth, x, inputs.assignment(spark, sf), split, n, m)
    return out.select("model", "split", "mae", "rmse")


@query(
    "h1_validation_references",
    "SELECT r1 AS mae, r2 AS forward_mae, r3 AS production_mae, r4 AS attraction_mae FROM refs",
    (),
    "mae forward_mae production_mae attraction_mae",
    [MODEL_ROWS],
)
def _(spark, sf):
    return H.validation_references(model_rows(spark, sf))


@query("h2_families", f"SELECT model, split, {_FAMILY_SQL} AS family, composite_score FROM composed", (), "composite_score", [MODEL_ROWS])
def _(spark, sf):
    return composed(spark, sf).select("model", "split", "family", "composite_score")


@query(
    "h3_rankings",
    """SELECT model, CAST(row_number() OVER (ORDER BY mae, model) AS INT) AS od_rank, CAST(row_number() OVER (ORDER BY forward_mae, model) AS INT) AS forward_rank,
    CAST(row_number() OVER (ORDER BY production_mae + attraction_mae, model) AS INT) AS marginal_rank,
    CAST(row_number() OVER (ORDER BY composite_score, model) AS INT) AS overall_rank FROM composed WHERE split = 'test'""",
    extra=[MODEL_ROWS],
)
def _(spark, sf):
    return H.rankings(composed(spark, sf))


_HAVE = {"model", "family", "mae", "forward_mae", "production_mae", "attraction_mae", "composite_score"}
_BOARD = ", ".join(
    f"{_FAMILY_SQL} AS family" if c == "family" else c if c in _HAVE else f"CAST(NULL AS {'VARCHAR' if c in H.TEXT_COLUMNS else 'DOUBLE'}) AS {c}"
    for c in H.LEADERBOARD_COLUMNS
)


@query(
    "h4_leaderboard",
    f"SELECT {_BOARD} FROM composed WHERE split = 'test'",
    (),
    "mae forward_mae production_mae attraction_mae composite_score",
    [MODEL_ROWS],
)
def _(spark, sf):
    return H.leaderboard(composed(spark, sf))


@query("h5_best_model", "SELECT arg_min(model, mae) AS model, min(mae) AS mae FROM composed WHERE split = 'test' AND starts_with(model, 'ae_')", (), "mae", [MODEL_ROWS])
def _(spark, sf):
    return H.best_model(composed(spark, sf), prefix="ae_")


# ---------------------------------------------------------------- survey


@query("u1_estimate_cells", "SELECT sample_id, o, d, y FROM back_y JOIN pairs USING (od_index)", ["counts", "pairs"], {"y": 5}, [BACK, BACK_Y])
def _(spark, sf):
    return U.estimate_cells(inputs.counts(spark, sf), back_projection(spark, sf), inputs.n_zones(spark, sf))


@query(
    "u2_survey_scores",
    f"""SELECT avg(abs(f.flow - coalesce(y, 0))) AS mae, sqrt(avg((f.flow - coalesce(y, 0)) * (f.flow - coalesce(y, 0)))) AS rmse,
    CAST(NULL AS DOUBLE) AS r2, corr(f.flow, coalesce(y, 0)) AS correlation
    FROM dense f LEFT JOIN back_y b ON b.sample_id = f.sample_id AND b.od_index = f.od_index WHERE f.sample_id = {SURVEY}""",
    ["counts", "dense"],
    "mae rmse correlation",
    [BACK, BACK_Y],
)
def _(spark, sf):
    """The held-out survey is one sample, so only that one is scored."""
    n, m = _sizes(spark, sf)
    held = spark.createDataFrame([(SURVEY, "survey")], "sample_id int, split string")
    only = F.broadcast(held)
    x = inputs.counts(spark, sf).join(only, "sample_id")
    truth = od(spark, sf).join(only, "sample_id")
    y = U.estimate_cells(x, back_projection(spark, sf), n, ("sample_id", "split")).withColumn("model", F.lit("back"))
    return V.all_scores(y, truth, x, inputs.assignment(spark, sf), held, n, m).select("mae", "rmse", "r2", "correlation")


@query(
    "u3_scale_shift",
    f"""SELECT m1 AS mean, s1 AS std, m1 - m2 AS mean_shift_vs_train, s1 / greatest(s2, 1e-6) AS std_ratio_vs_train FROM
    (SELECT avg(flow) AS m1, stddev_pop(flow) AS s1 FROM dense WHERE sample_id = {SURVEY}),
    (SELECT avg(flow) AS m2, stddev_pop(flow) AS s2 FROM dense WHERE sample_id <> {SURVEY})""",
    ["dense"],
    "mean std mean_shift_vs_train std_ratio_vs_train",
)
def _(spark, sf):
    n = inputs.n_zones(spark, sf)
    is_survey = F.col("sample_id") == SURVEY
    return U.scale_shift(od(spark, sf).filter(is_survey), od(spark, sf).filter(~is_survey), "flow", n * n, (n_samples(spark, sf) - 1) * n * n)


@query(
    "u3_wasserstein",
    f"""SELECT avg(abs(a - b)) AS wasserstein1 FROM (
    SELECT row_number() OVER (ORDER BY flow) AS r, flow AS a FROM (SELECT flow FROM dense WHERE sample_id <> {SURVEY}
    ORDER BY {uniform_sql(0, 'w1.train', 'sample_id', 'o', 'd')}, sample_id, o, d LIMIT 5000)) JOIN (
    SELECT row_number() OVER (ORDER BY flow) AS r, flow AS b FROM (SELECT flow, i FROM (
    SELECT flow, row_number() OVER (ORDER BY sample_id, o, d) - 1 AS i FROM dense WHERE sample_id = {SURVEY}), range(8) t(k) WHERE k * 625 + i < 5000)) USING (r)""",
    ["dense"],
    "wasserstein1",
)
def _(spark, sf):
    cells = materialise(unflatten(flatten(od(spark, sf), inputs.n_zones(spark, sf)), inputs.n_zones(spark, sf)), "dense")
    is_survey = F.col("sample_id") == SURVEY
    return U.wasserstein(cells.filter(is_survey), cells.filter(~is_survey), ["sample_id", "o", "d"], "flow")


# ---------------------------------------------------------------- streams


@query(
    "x1_running_stats",
    """SELECT turn_id, count(*) AS count, avg(x) AS mean, stddev_pop(x) AS std, stddev_pop(x) / (avg(x) + 1e-9) AS cv FROM dense_counts GROUP BY ALL""",
    ["dense_counts"],
    {"mean": 5, "std": 4, "cv": 5},
)
def _(spark, sf):
    source = scratch_path(spark, "source")
    m = _sizes(spark, sf)[1]
    pack(inputs.counts(spark, sf), F.col("turn_id"), "x", m, "x").repartition(4).write.parquet(source)
    return X.run_running_stats(spark, source)


@query("x2_streamed_counts", "SELECT sample_id, turn_id, x FROM counts", ["counts"], "x")
def _(spark, sf):
    source = scratch_path(spark, "source")
    flatten(od(spark, sf), inputs.n_zones(spark, sf)).repartition(4).write.parquet(source)
    return X.run_counts(spark, source, inputs.assignment(spark, sf))
