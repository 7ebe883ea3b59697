"""Dataset-level statistics over features (turns or OD cells) and samples.

Tables are long: ``sample_id, <feature>, <value>`` with absent entries zero.
Means and deviations use sums over stored rows and the known sample count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import join_small, materialise
from .gram import gram_matrix
from .reshape import od_index, pack
from .sampling import row_numbers, sample_features, sample_pairs, sample_rows
from .vectors import to_lists, to_matrix


def _moments(value: str, n: Column) -> tuple[Column, Column]:
    mean = F.sum(value) / n
    var = F.sum(F.col(value) * F.col(value)) / n - mean * mean
    return mean, F.sqrt(F.greatest(var, F.lit(0.0)))


def feature_stats(rows: DataFrame, feature: str, value: str, n_samples: int, every: DataFrame | None = None) -> DataFrame:
    """``feature, mean, std, min, max, cv, sparsity`` per feature of ``every`` (by default: that occurs).

    ``sparsity`` is the share of exact zeros. A listed feature without rows is zero throughout.
    """
    n = F.lit(float(n_samples))
    mean, std = _moments(value, n)
    full = F.count("*") == n_samples
    found = rows.groupBy(feature).agg(
        mean.alias("mean"),
        std.alias("std"),
        F.when(full, F.min(value)).otherwise(F.least(F.min(value), F.lit(0.0))).alias("min"),
        F.when(full, F.max(value)).otherwise(F.greatest(F.max(value), F.lit(0.0))).alias("max"),
        (std / (mean + 1e-9)).alias("cv"),
        (1.0 - F.count_if(F.col(value) != 0) / n).alias("sparsity"),
    )
    if every is None:
        return found
    zero = {c: 0.0 for c in ("mean", "std", "min", "max", "cv")}
    return every.select(feature).join(found, feature, "left").fillna({**zero, "sparsity": 1.0})


def positions(rows: DataFrame) -> DataFrame:
    """``sample_id, pos``: contiguous positions from 0, for pair draws."""
    ranked = row_numbers(rows.select("sample_id").distinct(), ["sample_id"], "n")
    return ranked.select("sample_id", (F.col("n") - 1).cast("int").alias("pos"))


def pair_distances(
    rows: DataFrame, index: Column, width: int, value: str, n_pairs: int = 10_000, seed: int = 42, norm: str = "mean"
) -> DataFrame:
    """``pair_id, distance`` of randomly drawn sample pairs.

    ``index`` numbers the ``width`` features from 0. ``norm``: mean or sum of
    absolute differences, or Euclidean. Only the drawn samples are packed into
    vectors (at most two per pair), so the cost beyond one filtered scan is set
    by the number of pairs and not by the table.
    """
    if norm not in ("mean", "sum", "euclid"):
        raise ValueError(f"unknown norm: {norm}")
    at = positions(rows)
    n = at.count()
    drawn = materialise(sample_pairs(rows.sparkSession, n, n_pairs, seed), "pairs")
    ends = drawn.select(F.explode(F.array("i", "j")).alias("pos")).distinct()
    wanted = join_small(at, ends, "pos")
    packed = materialise(pack(join_small(rows, wanted.select("sample_id"), "sample_id"), index, value, width), "vectors")
    vectors = wanted.join(packed, "sample_id").select("pos", "y")
    a, b = vectors.select(F.col("pos").alias("i"), F.col("y").alias("a")), vectors.select(F.col("pos").alias("j"), F.col("y").alias("b"))
    gap = F.zip_with("a", "b", (lambda x, y: (x - y) * (x - y)) if norm == "euclid" else (lambda x, y: F.abs(x - y)))
    total = F.aggregate(gap, F.lit(0.0), lambda acc, v: acc + v)
    size = {"mean": total / F.lit(float(width)), "sum": total, "euclid": F.sqrt(total)}[norm]
    return drawn.join(a, "i").join(b, "j").select("pair_id", size.alias("distance"))


def mean_pair_distance(rows: DataFrame, index: Column, width: int, value: str, **args) -> DataFrame:
    """Mean, minimum and maximum over the drawn pairs; 0 when there is no pair."""
    zero = F.lit(0.0)
    return pair_distances(rows, index, width, value, **args).agg(
        F.coalesce(F.avg("distance"), zero).alias("mean_distance"),
        F.coalesce(F.min("distance"), zero).alias("min_distance"),
        F.coalesce(F.max("distance"), zero).alias("max_distance"),
    )


def diversity_comparison(od: DataFrame, counts: DataFrame, n_zones: int, n_turns: int, n_pairs: int = 10_000, seed: int = 42) -> DataFrame:
    a = mean_pair_distance(od, od_index(n_zones), n_zones * n_zones, "flow", n_pairs=n_pairs, seed=seed)
    b = mean_pair_distance(counts, F.col("turn_id"), n_turns, "x", n_pairs=n_pairs, seed=seed)
    return a.select(F.col("mean_distance").alias("mean_pairwise_od_distance"),
                    b.select("mean_distance").scalar().alias("mean_pairwise_turning_distance"))


def correlation_matrix(rows: DataFrame, feature: str, value: str, n_samples: int, features: DataFrame) -> DataFrame:
    """``f1, f2, r`` for f1 < f2 among the given (at most a few dozen) features.

    One pass: every sample becomes a short vector, partitions add up their cross
    products, and only those sums are shuffled. NULL where a feature is constant.
    """
    ids = [r[0] for r in features.orderBy(feature).collect()]
    chosen = join_small(rows.select("sample_id", feature, value), features, feature)
    mean = {r[0]: r[1] for r in chosen.groupBy(feature).agg(F.sum(value) / n_samples).collect()}
    place = F.element_at(F.create_map(*(F.lit(v) for i, f in enumerate(ids) for v in (f, i))), F.col(feature))
    packed = chosen.groupBy("sample_id").agg(F.collect_list(place).alias("at"), F.collect_list(value).alias("v"))
    sums, count = gram_matrix(packed, len(ids), np.array([mean.get(f, 0.0) for f in ids]))
    # samples without any stored entry are all-zero rows
    shift = np.array([mean.get(f, 0.0) for f in ids])
    sums = sums + (n_samples - count) * np.outer(shift, shift)
    std = np.sqrt(np.maximum(np.diag(sums), 0) / n_samples)
    out = []
    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            flat = std[i] <= 1e-12 or std[j] <= 1e-12
            out.append((ids[i], ids[j], None if flat else float(sums[i, j] / math.sqrt(sums[i, i] * sums[j, j]))))
    kind = dict(rows.dtypes)[feature]
    return rows.sparkSession.createDataFrame(out, f"f1 {kind}, f2 {kind}, r double")


def varying_features(rows: DataFrame, feature: str, value: str, n_samples: int) -> DataFrame:
    return feature_stats(rows, feature, value, n_samples).filter(F.col("std") > 1e-12).select(feature)


def correlation_summary(rows: DataFrame, feature: str, value: str, n_samples: int, max_features: int = 50, seed: int = 42) -> DataFrame:
    """Off-diagonal correlation of at most ``max_features`` varying features."""
    chosen = sample_features(varying_features(rows, feature, value, n_samples), feature, max_features, seed)
    used = chosen.count()
    r = correlation_matrix(rows, feature, value, n_samples, chosen)
    return r.agg(
        F.avg("r").alias("mean_correlation"),
        F.min("r").alias("min_correlation"),
        F.max("r").alias("max_correlation"),
        F.max(F.abs("r")).alias("max_abs_correlation"),
        F.lit(used).alias("features_used"),
    )


def explained_variance(vectors: DataFrame, column: str, components: int) -> DataFrame:
    """``component, ratio, cumulative`` by MLlib's PCA."""
    ready = vectors.select(array_to_vector(column).alias("features"))
    ratios = PCA(k=components, inputCol="features", outputCol="p").fit(ready).explainedVariance.toArray()
    total = np.cumsum(ratios)
    rows = [(i + 1, float(r), float(t)) for i, (r, t) in enumerate(zip(ratios, total))]
    return vectors.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")


def group_variance(vectors: DataFrame, group: str, column: str, components: int = 20, share: float = 0.90) -> DataFrame:
    """``group, pca_pc1_variance, pca_components_90pct`` of every group in one job.

    For groups of a bounded number of vectors, such as the samples of one
    configuration; a whole table goes to ``explained_variance``.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        x = np.array(rows.column(column).to_pylist())
        s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
        ratio = (s / max(s.sum(), 1e-300))[:components]
        return pa.table(
            {
                group: pa.array([key[0].as_py()], pa.int32()),
                "pca_pc1_variance": pa.array([float(ratio[0])]),
                "pca_components_90pct": pa.array([int((np.cumsum(ratio) < share).sum() + 1)], pa.int32()),
            }
        )

    return vectors.groupBy(group).applyInArrow(run, f"{group} int, pca_pc1_variance double, pca_components_90pct int")


def components_for(variance: DataFrame, share: float = 0.90) -> DataFrame:
    """Smallest number of components whose cumulative share reaches ``share``."""
    return variance.agg((F.count_if(F.col("cumulative") < share) + 1).cast("int").alias("n_components"))


def _cluster_starts(ready: DataFrame, width: int, most: int, starts: int, seed: int) -> np.ndarray:
    """First centres of every start, ``starts x most x width``: each next one is drawn with a chance that grows with
    the squared distance to the nearest centre so far. A smaller K takes the first ones of the same draw.

    A draw is the smallest of ``-log(u) / weight`` over all rows, with ``u`` hashed from the row's id, so each task
    offers one row for each start and the driver takes the best.
    """
    centres = np.zeros((starts, 0, width))
    for turn in range(most):
        label = f"{seed}|start|{turn}|"

        def offer(batches: Iterator[pa.RecordBatch], centres=centres, label=label) -> Iterator[pa.RecordBatch]:
            best: list = [None] * starts
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, ids = to_matrix(batch.column("v"), width), batch.column("id").to_pylist()
                for s in range(starts):
                    weight = _squared(x, centres[s]).min(axis=1) if centres.shape[1] else np.ones(len(x))
                    u = np.array([int(md5(f"{label}{s}|{i}".encode()).hexdigest()[:13], 16) + 0.5 for i in ids]) / 2.0**52
                    key = np.full(len(x), np.inf)
                    np.divide(-np.log(u), weight, out=key, where=weight > 0)
                    at = min(np.flatnonzero(key == key.min()), key=lambda r: ids[r])
                    mine = (float(key[at]), ids[at], x[at])
                    best[s] = min(best[s] or mine, mine, key=lambda t: t[:2])
            found = [(s, *b) for s, b in enumerate(best) if b]
            if found:
                columns = [list(c) for c in zip(*found)]
                columns[3] = [v.tolist() for v in columns[3]]
                yield pa.RecordBatch.from_pydict(dict(zip(("s", "key", "id", "v"), map(pa.array, columns))))

        offers = ready.mapInArrow(offer, "s bigint, key double, id string, v array<double>")
        won = offers.groupBy("s").agg(F.min_by("v", F.struct("key", "id")).alias("v")).orderBy("s").collect()
        centres = np.concatenate([centres, np.array([r["v"] for r in won])[:, None, :]], axis=1)
    return centres


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    far = (x * x).sum(axis=1)[:, None] - 2.0 * x @ centres.T + (centres * centres).sum(axis=1)
    return np.maximum(far, 0.0)


def _cluster_round(ready: DataFrame, width: int, runs: list[np.ndarray]) -> DataFrame:
    """``run, cluster, n, cost, total``: members, inertia and sum of every cluster of every run, by one scan.

    A task adds up all its rows before it sends one line for each cluster.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(c), dtype=np.int64) for c in runs]
        cost = [np.zeros(len(c)) for c in runs]
        total = [np.zeros_like(c) for c in runs]
        for batch in batches:
            x = to_matrix(batch.column("v"), width)
            for r, centres in enumerate(runs):
                far = _squared(x, centres)
                near = far.argmin(axis=1)
                member = near[None, :] == np.arange(len(centres))[:, None]
                n[r] += member.sum(axis=1)
                cost[r] += np.bincount(near, ((x - centres[near]) ** 2).sum(axis=1), len(centres))
                total[r] += member.astype(np.float64) @ x
        for r, centres in enumerate(runs):
            yield pa.RecordBatch.from_pydict(
                {
                    "run": pa.array(np.full(len(centres), r)),
                    "cluster": pa.array(np.arange(len(centres))),
                    "n": pa.array(n[r]),
                    "cost": pa.array(cost[r]),
                    "total": to_lists(total[r]),
                }
            )

    lines = ready.mapInArrow(local, "run bigint, cluster bigint, n bigint, cost double, total array<double>")
    each = lines.select("run", "cluster", "n", "cost", F.posexplode("total").alias("at", "part"))
    by_entry = each.groupBy("run", "cluster", "at").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("part").alias("part"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda t: t["part"])
    return by_entry.groupBy("run", "cluster").agg(F.max("n").alias("n"), F.max("cost").alias("cost"), listed.alias("total"))


def cluster_runs(
    vectors: DataFrame, column: str, ks: tuple = (2, 5, 10), starts: int = 10, seed: int = 42,
    key: str = "sample_id", max_iter: int = 100, tol: float = 1e-4,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``k, start, inertia, iterations`` of every run, and their centres.

    All runs advance together: a round is one scan for all of them, and the driver sees their centres alone, which the
    parameters bound. A run stops when its centres move by less than ``tol`` times the mean variance of the entries; an
    empty cluster keeps its centre. Vectors have one length; rows with a null vector are left out. With no rows there
    are no runs.
    """
    ready = vectors.filter(F.col(column).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(column).alias("v"))
    ready = materialise(ready, "vectors")
    spark, schema = vectors.sparkSession, "k int, start int, inertia double, iterations int"
    head = ready.head()
    if head is None:
        return spark.createDataFrame([], schema), []
    width = len(head["v"])
    first = _cluster_starts(ready, width, max(ks), starts, seed)
    names = [(k, s) for k in ks for s in range(starts)]
    runs = [first[s][:k].copy() for k, s in names]
    spread = ready.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.var_pop("x").alias("s"))
    bound = tol * (spread.agg(F.avg("s")).first()[0] or 0.0)
    iterations, live = [0] * len(runs), list(range(len(runs)))
    for _ in range(max_iter):
        moved = [np.zeros(1)] * len(runs)
        for line in _cluster_round(ready, width, [runs[r] for r in live]).collect():
            if line["n"]:
                r, c = live[line["run"]], line["cluster"]
                centre = np.array(line["total"]) / line["n"]
                moved[r] = moved[r] + ((centre - runs[r][c]) ** 2).sum()
                runs[r][c] = centre
        for r in live:
            iterations[r] += 1
        live = [r for r in live if moved[r][0] > bound]
        if not live:
            break
    cost = _cluster_round(ready, width, runs).groupBy("run").agg(F.sum("cost").alias("cost")).orderBy("run").collect()
    rows = [(k, s, float(line["cost"]), i) for (k, s), line, i in zip(names, cost, iterations)]
    return spark.createDataFrame(rows, schema), runs


def cluster_inertia(vectors: DataFrame, column: str, ks: tuple = (2, 5, 10), starts: int = 10, seed: int = 42) -> DataFrame:
    """``k, inertia``: the best of several seeded runs for each K."""
    return cluster_runs(vectors, column, ks, starts, seed)[0].groupBy("k").agg(F.min("inertia").alias("inertia"))


def cell_variation(cells: DataFrame, n_samples: int, n_cells: int) -> DataFrame:
    """Mean and maximum cell CV (absent cells have CV 0) and the CV of total demand."""
    per_cell = feature_stats(cells.withColumn("cell", F.struct("o", "d")), "cell", "flow", n_samples)
    totals = cells.groupBy("sample_id").agg(F.sum("flow").alias("t"))
    return per_cell.agg(
        (F.sum("cv") / F.lit(float(n_cells))).alias("mean_cell_cv"),
        F.max("cv").alias("max_cell_cv"),
        totals.agg(F.stddev_pop("t") / (F.avg("t") + 1e-12)).scalar().alias("demand_cv"),
    )


def evaluate_dataset(cells: DataFrame, n_samples: int, n_zones: int, n_pairs: int = 10_000, seed: int = 42) -> DataFrame:
    """Distance, variation and demand spread of a batch as one row."""
    n_cells = n_zones * n_zones
    d = mean_pair_distance(cells, od_index(n_zones), n_cells, "flow", n_pairs=n_pairs, seed=seed)
    v = cell_variation(cells, n_samples, n_cells)
    return v.select(
        F.lit(n_samples).alias("num_samples"),
        *(d.select(c).scalar().alias(a) for c, a in (
            ("mean_distance", "mean_pairwise_distance"), ("min_distance", "min_pairwise_distance"), ("max_distance", "max_pairwise_distance"))),
        "mean_cell_cv", "max_cell_cv", "demand_cv",
    )


def evaluation_sample(vectors: DataFrame, size: int = 50_000, seed: int = 42) -> DataFrame:
    """The subset PCA and K-means run on."""
    return sample_rows(vectors, size, "sample_id", seed, "evaluation")


def demand_summary(cells: DataFrame, tol: float = 1e-8) -> DataFrame:
    """Mean and CV of total demand, and whether every diagonal is zero."""
    per = cells.groupBy("sample_id").agg(
        F.sum("flow").alias("t"), F.max(F.when(F.col("o") == F.col("d"), F.abs("flow")).otherwise(0.0)).alias("diag")
    )
    return per.agg(
        F.avg("t").alias("demand_mean"),
        (F.stddev_pop("t") / (F.avg("t") + 1e-15)).alias("demand_cv"),
        (F.max("diag") <= tol).alias("zero_diag"),
    )


def histogram(values: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """``bin, low, high, n``: equal-width bins, the maximum in the last one."""
    edges = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = edges.select("lo").scalar(), edges.select("hi").scalar()
    width = (hi - lo) / F.lit(float(bins))
    at = F.when(hi > lo, F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = values.select(at.alias("bin"), lo.alias("lo"), width.alias("width")).groupBy("bin", "lo", "width").agg(F.count("*").alias("n"))
    return counted.select(
        "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"), "n"
    )
