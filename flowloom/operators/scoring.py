"""Scores of predicted demand tables, for all models and splits in one job.

``predictions(model, split, sample_id, o, d, y)`` and ``truth(split, sample_id,
o, d, flow)`` are sparse: an absent cell is zero. Both are stacked and summed
per cell, and every score is taken from sums plus the known cell counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import corr_from_sums
from ..session import join_small
from .assignment import apply_operator
from .reshape import destination_of, od_index, origin_of
from .sampling import sample_within

KEYS = ("model", "split")


def _per_model(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every truth row once per model: each model's split has to be compared with
    all of it. The model names are a short list."""
    names = predictions.select("model").distinct().agg(F.collect_set("model")).scalar()
    return truth.withColumn("model", F.explode(names))


def paired_cells(predictions: DataFrame, truth: DataFrame, clip: bool = False) -> DataFrame:
    """``model, split, sample_id, o, d, t, p`` for cells stored on either side."""
    lift = (lambda c: F.greatest(F.col(c), F.lit(0.0))) if clip else F.col
    zero = F.lit(0.0)
    both = (
        _per_model(truth, predictions)
        .select(*KEYS, "sample_id", "o", "d", lift("flow").alias("t"), zero.alias("p"))
        .unionByName(predictions.select(*KEYS, "sample_id", "o", "d", zero.alias("t"), lift("y").alias("p")))
    )
    return both.groupBy(*KEYS, "sample_id", "o", "d").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))


def _r2(pair: DataFrame, sizes: DataFrame, n_zones: int) -> DataFrame:
    """Mean over all cells of 1 - SSE/SST across samples.

    A cell with constant truth scores 1 when predicted exactly and 0 otherwise;
    cells never stored are such exact cells.
    """
    t, p, n = F.col("t"), F.col("p"), F.col("n_samples")
    per = pair.groupBy(*KEYS, "o", "d").agg(
        F.sum((t - p) * (t - p)).alias("sse"), F.sum(t).alias("st"), F.sum(t * t).alias("stt")
    ).join(F.broadcast(sizes), "split")
    sst = F.col("stt") - F.col("st") * F.col("st") / n
    flat = sst <= 1e-12 * F.col("stt")
    score = F.when(flat, F.when(F.col("sse") <= 1e-18, 1.0).otherwise(0.0)).otherwise(1.0 - F.col("sse") / sst)
    cells = F.lit(float(n_zones * n_zones))
    mean = (F.sum(score) + cells - F.count("*")) / cells
    return per.groupBy(*KEYS).agg(F.when(F.first("n_samples") >= 2, mean).alias("r2"))


def _cell_scores(pair: DataFrame, sizes: DataFrame, n_zones: int) -> DataFrame:
    t, p = F.col("t"), F.col("p")
    diff = t - p
    big = F.abs(t) > 1e-6
    tp, pp = t > 1e-6, p > 1e-6
    sums = pair.groupBy(*KEYS).agg(
        F.sum(F.abs(diff)).alias("sa"),
        F.sum(diff * diff).alias("ss"),
        F.sum(F.abs(diff) / F.greatest(F.abs(t), F.lit(1e-6))).alias("rel"),
        F.avg(F.when(big, F.abs(diff / F.when(big, t)))).alias("mape"),
        F.count_if(p < -1e-8).alias("neg"),
        F.sum(F.when(F.col("o") == F.col("d"), F.abs(p)).otherwise(0.0)).alias("diag"),
        F.count_if(tp).alias("nt"),
        F.count_if(pp).alias("np"),
        F.count_if(tp & pp).alias("both"),
        F.count_if(tp | pp).alias("either"),
    ).join(F.broadcast(sizes), "split")
    n = F.col("n_samples")
    cells = n * F.lit(float(n_zones * n_zones))
    return sums.select(
        *KEYS,
        (F.col("sa") / cells).alias("mae"),
        F.sqrt(F.col("ss") / cells).alias("rmse"),
        (F.col("mape") * 100.0).alias("mape"),
        F.sqrt(F.col("ss") / cells).alias("frobenius"),
        (F.col("rel") / cells).alias("relative_error"),
        (F.col("neg") / n).alias("negative_cells"),
        (F.col("diag") / (n * n_zones)).alias("diagonal_violation"),
        (F.col("diag") / (n * n_zones)).alias("mean_abs_diagonal"),
        F.try_divide(F.col("both"), F.col("either")).alias("support_jaccard"),
        (1.0 - F.col("np") / cells).alias("pred_sparsity"),
        (1.0 - F.col("nt") / cells).alias("true_sparsity"),
        F.abs(F.col("np") / cells - F.col("nt") / cells).alias("sparsity_error"),
    )


def _sample_scores(pair: DataFrame, n_zones: int, chosen: DataFrame | None) -> DataFrame:
    t, p = F.col("t"), F.col("p")
    n = F.lit(float(n_zones * n_zones))
    per = pair.groupBy(*KEYS, "sample_id").agg(
        corr_from_sums(n, F.sum(t), F.sum(p), F.sum(t * t), F.sum(p * p), F.sum(t * p), 1e-12 * n_zones).alias("r"),
        F.abs(F.sum(t) - F.sum(p)).alias("gap"),
    )
    if chosen is not None:
        marked = chosen.withColumn("_in", F.lit(True))
        per = join_small(per, marked, ["split", "sample_id"], "left").withColumn("r", F.when(F.col("_in"), F.col("r")))
    return per.groupBy(*KEYS).agg(F.avg("r").alias("correlation"), F.sum("gap").alias("gap"))


def _marginal_scores(pair: DataFrame, key: str, name: str, sizes: DataFrame, n_zones: int) -> DataFrame:
    gap = F.abs(F.col("t") - F.col("p"))
    per = pair.groupBy(*KEYS, "sample_id", key).agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    sums = per.groupBy(*KEYS).agg(
        F.sum(gap).alias("a"), F.sum(gap * gap).alias("s"), F.sum(gap / F.greatest(F.abs("t"), F.lit(1e-6))).alias("r")
    ).join(F.broadcast(sizes), "split")
    cells = F.col("n_samples") * F.lit(float(n_zones))
    return sums.select(
        *KEYS,
        (F.col("a") / cells).alias(f"{name}_mae"),
        F.sqrt(F.col("s") / cells).alias(f"{name}_rmse"),
        (F.col("r") / cells).alias(f"{name}_rel_error"),
    )


def split_sizes(samples: DataFrame) -> DataFrame:
    """``split, n_samples`` from ``samples(split, sample_id)``."""
    return samples.groupBy("split").agg(F.count_distinct("sample_id").cast("double").alias("n_samples"))


def spearman(pair: DataFrame, n_zones: int, samples: DataFrame) -> DataFrame:
    """Mean per-sample rank correlation over all cells of the listed samples (``split, sample_id``).

    Tied cells share their average rank. The listed samples (at most a few
    hundred) are densified, because zero cells tie too.
    """
    listed = join_small(pair, samples, ["split", "sample_id"], "left_semi")
    owners = listed.select(*KEYS, "sample_id").distinct()
    index = owners.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_zones * n_zones - 1))))
    zero = F.lit(0.0)
    blank = index.select(
        *KEYS, "sample_id", origin_of(F.col("i"), n_zones).alias("o"), destination_of(F.col("i"), n_zones).alias("d"), zero.alias("t"), zero.alias("p")
    )
    dense = blank.unionByName(listed).groupBy(*KEYS, "sample_id", "o", "d").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))

    def ranked(c: str) -> Column:
        order = W.partitionBy(*KEYS, "sample_id").orderBy(c)
        ties = W.partitionBy(*KEYS, "sample_id", c)
        return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0

    ranks = dense.select(*KEYS, "sample_id", "t", "p", ranked("t").alias("rt"), ranked("p").alias("rp"))
    varied = (F.stddev_pop("t") >= 1e-12) & (F.stddev_pop("p") >= 1e-12)
    per = ranks.groupBy(*KEYS, "sample_id").agg(F.when(varied, F.corr("rt", "rp")).alias("rho"))
    return per.groupBy(*KEYS).agg(F.avg("rho").alias("spearman"))


def forward_scores(
    predictions: DataFrame, counts: DataFrame, assignment: DataFrame, n_zones: int, n_turns: int, sizes: DataFrame, clip: bool = False
) -> DataFrame:
    """Agreement of the predicted tables' turning counts with the observed ones,
    pooled over samples and turns. ``counts(split, sample_id, turn_id, x)``."""
    y = F.greatest(F.col("y"), F.lit(0.0)) if clip else F.col("y")
    cells = predictions.select(*KEYS, "sample_id", od_index(n_zones).alias("od_index"), y.alias("y"))
    by = (*KEYS, "sample_id")
    made = apply_operator(cells, assignment, "od_index", "turn_id", "y", "h", by)
    zero = F.lit(0.0)
    both = (
        _per_model(counts, predictions)
        .select(*by, "turn_id", "x", zero.alias("h"))
        .unionByName(made.select(*by, "turn_id", zero.alias("x"), "h"))
        .groupBy(*by, "turn_id")
        .agg(F.sum("x").alias("x"), F.sum("h").alias("h"))
    )
    x, h = F.col("x"), F.col("h")
    per_sample = both.groupBy(*by).agg(
        F.sum(F.abs(x - h)).alias("sa"), F.sum((x - h) * (x - h)).alias("ss"), F.sqrt(F.sum((x - h) * (x - h))).alias("norm"),
        F.sum(x).alias("sx"), F.sum(h).alias("sh"), F.sum(x * x).alias("sxx"), F.sum(h * h).alias("shh"), F.sum(x * h).alias("sxh"),
    )
    pooled = per_sample.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("sa", "ss", "norm", "sx", "sh", "sxx", "shh", "sxh")))
    pooled = pooled.join(F.broadcast(sizes), "split")
    n = F.col("n_samples") * F.lit(float(n_turns))
    total = F.col("sxx") - F.col("sx") * F.col("sx") / n
    r = corr_from_sums(n, F.col("sx"), F.col("sh"), F.col("sxx"), F.col("shh"), F.col("sxh"), 1e-12)
    return pooled.select(
        *KEYS,
        (F.col("sa") / n).alias("forward_mae"),
        F.sqrt(F.col("ss") / n).alias("forward_rmse"),
        F.when(total > 1e-12, 1.0 - F.col("ss") / total).alias("forward_r2"),
        r.alias("forward_correlation"),
        (F.col("norm") / F.col("n_samples")).alias("mean_residual_norm"),
    )


def basic_scores(predictions: DataFrame, truth: DataFrame, samples: DataFrame, n_zones: int) -> DataFrame:
    """The short list, with both sides lifted to zero first."""
    sizes = split_sizes(samples)
    pair = paired_cells(predictions, truth, clip=True)
    return (
        _cell_scores(pair, sizes, n_zones).select(*KEYS, "mae", "rmse", "mape", "frobenius")
        .join(_r2(pair, sizes, n_zones), KEYS_LIST)
        .join(_marginal_scores(pair, "o", "production", sizes, n_zones).select(*KEYS, "production_mae"), KEYS_LIST)
        .join(_marginal_scores(pair, "d", "attraction", sizes, n_zones).select(*KEYS, "attraction_mae"), KEYS_LIST)
        .join(_sample_scores(pair, n_zones, None).select(*KEYS, "correlation"), KEYS_LIST)
    )


KEYS_LIST = list(KEYS)


def structural_scores(predictions: DataFrame, truth: DataFrame, samples: DataFrame, n_zones: int) -> DataFrame:
    cells = _cell_scores(paired_cells(predictions, truth), split_sizes(samples), n_zones)
    return cells.select(*KEYS, "support_jaccard", "pred_sparsity", "true_sparsity", "mean_abs_diagonal")


def all_scores(
    predictions: DataFrame,
    truth: DataFrame,
    counts: DataFrame,
    assignment: DataFrame,
    samples: DataFrame,
    n_zones: int,
    n_turns: int,
    rank_samples: int = 500,
    seed: int = 0,
) -> DataFrame:
    """The full suite, one row per model and split; nothing is clipped.

    Per-sample correlations use at most ``rank_samples`` samples of each split,
    chosen by hash.
    """
    sizes = split_sizes(samples)
    pair = paired_cells(predictions, truth)
    chosen = sample_within(samples.select("split", "sample_id").distinct(), rank_samples, "split", "sample_id", seed, "scores")
    per_sample = _sample_scores(pair, n_zones, chosen).join(F.broadcast(sizes), "split").select(
        *KEYS, "correlation", (F.col("gap") / F.col("n_samples")).alias("total_demand_error")
    )
    parts = [
        _r2(pair, sizes, n_zones),
        per_sample,
        _marginal_scores(pair, "o", "production", sizes, n_zones),
        _marginal_scores(pair, "d", "attraction", sizes, n_zones),
        spearman(pair, n_zones, chosen),
        forward_scores(predictions, counts, assignment, n_zones, n_turns, sizes),
    ]
    out = _cell_scores(pair, sizes, n_zones).drop("mape")
    for part in parts:
        out = out.join(part, KEYS_LIST)
    return out.withColumn("pearson", F.col("correlation"))


def normalised(value: Column, reference: Column) -> Column:
    """Value over its reference, NULL when the reference is near zero."""
    return F.when(F.abs(reference) >= 1e-12, F.try_divide(value, reference))


def composite(alpha: float = 1.0, beta: float = 0.5, gamma: float = 0.5, references: dict[str, Column] | None = None) -> Column:
    """Weighted sum of cell, forward and marginal errors, each over its reference."""
    terms = {"mae": 1.0, "forward_mae": alpha, "production_mae": beta, "attraction_mae": gamma}
    parts = [
        F.lit(float(w)) * (normalised(F.col(c), references[c]) if references else F.col(c)) for c, w in terms.items()
    ]
    return parts[0] + parts[1] + parts[2] + parts[3]
