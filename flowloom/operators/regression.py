"""Regression of OD cells on turning counts from distributed cross products.

One scan adds up ``[1, x]^T [1, x, y]`` per fold; ridge for any penalty, the
cross-validation grid and PLS are then small driver-side solves of turn count
size, and predictions are one batch product per sample row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .gram import cross_products
from .vectors import map_batches, to_lists, to_matrix


@dataclass(frozen=True)
class LinearModel:
    """y = x @ coef + intercept, in raw units."""

    coef: np.ndarray
    intercept: np.ndarray


@dataclass(frozen=True)
class Sums:
    """Cross products of one training set."""

    table: np.ndarray  # (1 + x, 1 + x + y)
    x_width: int

    @property
    def n(self) -> float:
        return self.table[0, 0]

    def centred(self, scale: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """X^T X and X^T Y about the means, the means, and the column scales."""
        p = 1 + self.x_width
        mx, my = self.table[0, 1:p] / self.n, self.table[0, p:] / self.n
        g = self.table[1:, 1:p] - self.n * np.outer(mx, mx)
        c = self.table[1:, p:] - self.n * np.outer(mx, my)
        std = np.sqrt(np.maximum(np.diag(g) / self.n, 0.0)) if scale else np.ones(self.x_width)
        std = np.where(std > 1e-12, std, 1.0)
        return g / np.outer(std, std), c / std[:, None], mx, my, std


def fold_of(position: str, n: int, k: int):
    """Contiguous folds; the first ``n mod k`` ones are one row longer."""
    small, longer = divmod(n, k)
    edge = longer * (small + 1)
    pos = F.col(position)
    return F.when(pos < edge, F.floor(pos / (small + 1))).otherwise(F.lit(longer) + F.floor((pos - edge) / max(small, 1))).cast("int")


def gather(rows: DataFrame, x_width: int, y_width: int, fold: str | None = None) -> dict[int, Sums]:
    """Cross products per fold (key 0 without folds)."""
    frame = cross_products(rows, x_width, y_width, fold).toPandas()
    out = {}
    for f, part in frame.groupby("fold"):
        table = np.zeros((1 + x_width, 1 + x_width + y_width))
        table[part["i"].to_numpy(), part["j"].to_numpy()] = part["s"].to_numpy()
        out[int(f)] = Sums(table, x_width)
    return out


def ridge(sums: Sums, alpha: float = 0.0, standardise: bool = True) -> LinearModel:
    """Multi-output ridge with an unpenalised intercept; alpha 0 is least squares
    (minimum norm when the counts are collinear)."""
    g, c, mx, my, std = sums.centred(standardise)
    if alpha > 0:
        w = np.linalg.solve(g + alpha * np.eye(len(g)), c)
    else:
        w = np.linalg.lstsq(g, c, rcond=1e-12)[0]
    coef = w / std[:, None]
    return LinearModel(coef, my - mx @ coef)


def pls_parts(sums: Sums, components: int, scale: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotations of raw counts, loadings of the targets, and both means: as many components as exist, up to ``components``.

    The weight vector of each component is the leading left singular vector of
    the deflated X^T Y; rotations act on the original columns, so X^T X is never
    deflated. The first k components are the model with k of them.
    """
    g, s, mx, my, std = sums.centred(scale)
    components = int(min(components, sums.n - 1, *s.shape))
    rotations, loadings, targets = [], [], []
    s0 = s.copy()
    for _ in range(components):
        left, values, _ = np.linalg.svd(s, full_matrices=False)
        w = left[:, 0]
        if values[0] <= 1e-12 * max(np.abs(s0).max(), 1e-300):
            break
        r = w.copy()
        for rot, load in zip(rotations, loadings):
            r -= (load @ w) * rot
        size = r @ g @ r
        if size <= 1e-14 * np.trace(g):
            break
        p, q = g @ r / size, s0.T @ r / size
        rotations.append(r), loadings.append(p), targets.append(q)
        s = s - size * np.outer(p, q)
    into = np.array(rotations).reshape(-1, len(g)).T / std[:, None]
    return into, np.array(targets).reshape(-1, s0.shape[1]), mx, my


def pls(sums: Sums, components: int, scale: bool = False) -> LinearModel:
    """Partial least squares from the cross products alone."""
    into, out, mx, my = pls_parts(sums, components, scale)
    coef = into @ out
    return LinearModel(coef, my - mx @ coef)


def predict(rows: DataFrame, model: LinearModel, clip: bool = False) -> DataFrame:
    """``sample_id, y``: the model applied to ``rows(sample_id, x ARRAY)``."""
    coef, intercept, width = model.coef, model.intercept, model.coef.shape[0]

    def run(batch):
        y = to_matrix(batch.column("x"), width) @ coef + intercept
        return {"sample_id": batch.column("sample_id"), "y": to_lists(np.maximum(y, 0.0) if clip else y)}

    id_type = dict(rows.dtypes)["sample_id"]
    return map_batches(rows.select("sample_id", "x"), run, f"sample_id {id_type}, y array<double>")


def model_table(spark: SparkSession, model: LinearModel) -> DataFrame:
    """``turn_id, od_index, weight``; the intercept has turn_id -1."""
    full = np.vstack([model.intercept, model.coef])
    i, j = np.divmod(np.arange(full.size), full.shape[1])
    return spark.createDataFrame(
        pd.DataFrame({"turn_id": (i - 1).astype(np.int32), "od_index": j.astype(np.int32), "weight": full.reshape(-1)})
    )


def _less(total: Sums, part: Sums) -> Sums:
    return Sums(total.table - part.table, total.x_width)


def _total(sums: dict[int, Sums]) -> Sums:
    parts = list(sums.values())
    return Sums(sum(p.table for p in parts), parts[0].x_width)


def ridge_cv(rows: DataFrame, x_width: int, y_width: int, alphas: list[float], standardise: bool = False) -> DataFrame:
    """``alpha, fold, mae``: held-out error of every penalty and fold.

    Two scans in all, whatever the grid: one for the per-fold sums (training
    sums are total minus fold), one in which each row is scored by the models of
    its own fold. ``rows(sample_id, x, y, fold)``.
    """
    sums = gather(rows, x_width, y_width, "fold")
    total = _total(sums)
    models = {f: [ridge(_less(total, s), a, standardise) for a in alphas] for f, s in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, folds = to_matrix(b.column("x"), x_width), to_matrix(b.column("y"), y_width), b.column("fold").to_numpy()
            out = {"alpha": [], "fold": [], "err": [], "n": []}
            for f in np.unique(folds):
                own = folds == f
                for a, m in zip(alphas, models[int(f)]):
                    e = np.abs(x[own] @ m.coef + m.intercept - y[own])
                    for key, v in zip(out, (float(a), int(f), float(e.sum()), int(e.size))):
                        out[key].append(v)
            yield pa.RecordBatch.from_pydict(
                {"alpha": out["alpha"], "fold": pa.array(out["fold"], pa.int32()), "err": out["err"], "n": out["n"]}
            )

    scored = rows.select("x", "y", "fold").mapInArrow(run, "alpha double, fold int, err double, n bigint")
    return scored.groupBy("alpha", "fold").agg((F.sum("err") / F.sum("n")).alias("mae"))


def best_alpha(scores: DataFrame) -> DataFrame:
    """One row: the penalty with the smallest mean held-out error."""
    return scores.groupBy("alpha").agg(F.avg("mae").alias("mae")).agg(F.min_by("alpha", "mae").alias("alpha"), F.min("mae").alias("mae"))


def _descend(g: np.ndarray, c: np.ndarray, penalty: float, l1_ratio: float, max_iter: int, tol: float) -> np.ndarray:
    """Coordinate descent for many targets at once: g is X^T X / n, c is X^T Y / n, a column per target."""
    w = np.zeros_like(c)
    shrink, scale = penalty * l1_ratio, np.diag(g) + penalty * (1.0 - l1_ratio)
    live = np.arange(c.shape[1])
    for _ in range(max_iter):
        v, r = w[:, live], c[:, live] - g @ w[:, live]
        moved = np.zeros(len(live))
        for j in np.flatnonzero(np.diag(g) > 0):
            old = v[j].copy()
            raw = r[j] + g[j, j] * old
            v[j] = np.sign(raw) * np.maximum(np.abs(raw) - shrink, 0.0) / scale[j]
            step = v[j] - old
            r -= np.outer(g[:, j], step)
            moved = np.maximum(moved, np.abs(step) * np.sqrt(g[j, j]))
        w[:, live] = v
        live = live[moved > tol * np.maximum(1e-12, np.sqrt(np.maximum((v * (g @ v)).sum(axis=0), 0.0)))]
        if not len(live):
            break
    return w


def sparse_fit(spark: SparkSession, sums: Sums, penalty: float = 0.01, l1_ratio: float = 0.5, max_iter: int = 2000, tol: float = 1e-4) -> DataFrame:
    """``od_index, coef ARRAY, intercept``: lasso (l1_ratio 1) or elastic net for every target in one job.

    The objective is (1 / 2n) |y - Xw|^2 + penalty * (l1_ratio |w|_1 + (1 - l1_ratio) / 2 |w|^2) on centred columns, so
    the cross products are all it needs: targets are rows, dealt over tasks, and each task descends on a batch of them.
    """
    g, c, mx, my, _ = sums.centred(False)
    g, n = g / sums.n, sums.n
    targets = spark.createDataFrame(
        pd.DataFrame({"od_index": np.arange(c.shape[1], dtype=np.int32), "c": [v.tolist() for v in (c / n).T], "my": my})
    ).repartition(spark.sparkContext.defaultParallelism)

    def run(batch):
        w = _descend(g, to_matrix(batch.column("c"), len(g)).T.copy(), penalty, l1_ratio, max_iter, tol)
        intercept = batch.column("my").to_numpy() - mx @ w
        return {"od_index": batch.column("od_index").cast(pa.int32()), "coef": to_lists(np.ascontiguousarray(w.T)), "intercept": intercept}

    return map_batches(targets, run, "od_index int, coef array<double>, intercept double")


def from_rows(fitted: DataFrame) -> LinearModel:
    """A model from rows ``od_index, coef, intercept``; as many rows as targets."""
    rows = fitted.orderBy("od_index").toPandas()
    return LinearModel(np.stack(rows["coef"].to_list()).T, rows["intercept"].to_numpy())


def log_grid(low: float, high: float, steps: int) -> list[float]:
    """Log-spaced candidate values, ends included."""
    return [float(v) for v in np.logspace(np.log10(low), np.log10(high), steps)]
