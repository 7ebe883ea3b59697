"""Facts about an assignment operator and linear estimators built from it.

The operator is a COO table (``turn_id, od_index, weight``). Only matrices of
turns by turns reach the driver, after a size check; everything with one row
per OD cell stays a table. Estimators are applied in factors: a turn-by-turn
kernel meets each sample's packed counts in one batch product, and one sparse
product with the transposed operator leads back to cells; for more turns than
the kernel may have, conjugate gradients need the operator's entries alone. The dense operator of
cells by turns is formed only where it is the result (``pseudo_inverse``,
``tikhonov_operator``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import is_small
from .assignment import apply_operator
from .reshape import pack
from .vectors import MAX_OPERATOR_CELLS, map_batches, to_lists, to_matrix

#: Entries of an operator that are shipped to every task for conjugate gradients (24 bytes each).
ENTRIES = 4_000_000


def _check_square(n: int) -> None:
    if n * n > MAX_OPERATOR_CELLS:
        raise ValueError(f"{n} x {n} matrix is too large for the driver")


def _triangle(assignment: DataFrame, n_turns: int) -> np.ndarray:
    """R of a tall-skinny QR of the cell-by-turn matrix.

    Keeps small singular values that a cross-product matrix would square away.
    """
    _check_square(n_turns)
    packed = pack(assignment.select(F.col("od_index").alias("sample_id"), "turn_id", "weight"), F.col("turn_id"), "weight", n_turns, "v")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """R of each task's rows, batch by batch; the R of the stacked ones is that of all rows."""
        r = np.zeros((0, n_turns))
        for b in batches:
            r = np.linalg.qr(np.vstack([r, to_matrix(b.column("v"), n_turns)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"v": to_lists(r)})

    # Two rounds, so that the driver stacks a few triangles and not one for each task.
    some = packed.select("v").mapInArrow(local, "v array<double>").repartition(4)
    parts = some.mapInArrow(local, "v array<double>").toPandas()["v"]
    stacked = np.vstack([np.zeros((1, n_turns)), *parts])
    return np.linalg.qr(stacked, mode="r")


def singular_values(assignment: DataFrame, n_turns: int, n_cells: int) -> np.ndarray:
    s = np.linalg.svd(_triangle(assignment, n_turns), compute_uv=False)
    out = np.zeros(min(n_turns, n_cells))
    out[: min(len(s), len(out))] = s[: len(out)]
    return out


def spectrum(spark: SparkSession, s: np.ndarray) -> DataFrame:
    """``i, s, energy``: singular values and their cumulative squared share."""
    share = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
    rows = [(i + 1, float(v), float(e)) for i, (v, e) in enumerate(zip(s, share))]
    return spark.createDataFrame(rows, "i int, s double, energy double")


def _rank_facts(s: np.ndarray, n_turns: int, n_cells: int, rtol: float | None = None) -> tuple:
    """Rank, nullity, condition number and 99% effective rank of singular values in falling order."""
    top = float(s[0]) if len(s) else 0.0
    cut = rtol * top if rtol is not None else top * max(n_turns, n_cells) * np.finfo(float).eps
    rank = int((s > cut).sum())
    kept = s[s > (cut if rtol is not None else 1e-12)]
    condition = float(kept[0] / kept[-1]) if len(kept) > 1 else (float("inf") if len(kept) else None)
    share = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
    effective = int((share < 0.99).sum() + 1) if len(s) else 0
    return rank, n_cells - rank, condition, effective


def rank_report(spark: SparkSession, s: np.ndarray, n_turns: int, n_cells: int, rtol: float | None = None) -> DataFrame:
    """Rank, nullity, condition number and 99% effective rank in one row.

    Without ``rtol`` the rank tolerance is the machine one and the condition
    number uses values above 1e-12; with it both use ``rtol`` times the largest.
    """
    return spark.createDataFrame(
        [(n_turns, n_cells, *_rank_facts(s, n_turns, n_cells, rtol))],
        "num_turning_movements int, num_od_pairs int, rank int, nullity int, condition_number double, effective_rank_99 int",
    )


def rank_reports(operators: DataFrame, keys: list[str], n_turns: int, n_cells: int, rtol: float | None = None) -> DataFrame:
    """``rank_report`` of every operator of a table ``keys..., turn_id, od_index, weight``, and ``max_entry, energy``.

    One job for all: a tree of QR triangles by operator. Tasks reduce their rows to one triangle for each operator they
    hold, a few tasks reduce those again, and one group by operator ends with its singular values. ``energy`` is the
    sum of their squares. An operator without entries has no row.
    """
    _check_square(n_turns)
    points = operators.select(*keys).distinct().orderBy(*keys).collect()
    types = dict(operators.dtypes)
    at = F.coalesce(*(F.when(F.struct(*keys) == F.struct(*(F.lit(p[k]).cast(types[k]) for k in keys)), i) for i, p in enumerate(points))) if points else F.lit(0)
    packed = pack(
        operators.select(F.struct(at.alias("point"), "od_index").alias("sample_id"), "turn_id", "weight"), F.col("turn_id"), "weight", n_turns, "v"
    )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r: dict = {}
        for b in batches:
            point, rows = b.column("point").to_numpy(), to_matrix(b.column("v"), n_turns)
            for p in np.unique(point):
                r[p] = np.linalg.qr(np.vstack([r.get(p, np.zeros((0, n_turns))), rows[point == p]]), mode="r")
        for p, v in r.items():
            yield pa.RecordBatch.from_pydict({"point": pa.array(np.full(len(v), p, dtype=np.int32)), "v": to_lists(v)})

    def facts(key: tuple, rows: pa.Table) -> pa.Table:
        stacked = to_matrix(rows.column("v").combine_chunks(), n_turns)
        found = np.linalg.svd(np.linalg.qr(np.vstack([np.zeros((1, n_turns)), stacked]), mode="r"), compute_uv=False)
        s = np.zeros(min(n_turns, n_cells))
        s[: min(len(s), len(found))] = found[: len(s)]
        rank, nullity, condition, effective = _rank_facts(s, n_turns, n_cells, rtol)
        return pa.table(
            {
                "point": pa.array([key[0].as_py()], pa.int32()),
                "rank": pa.array([rank], pa.int32()),
                "nullity": pa.array([nullity], pa.int32()),
                "condition_number": pa.array([condition], pa.float64()),
                "effective_rank_99": pa.array([effective], pa.int32()),
                "energy": pa.array([float((s**2).sum())]),
            }
        )

    lines = "point int, v array<double>"
    some = packed.select(F.col("sample_id.point").alias("point"), "v").mapInArrow(local, lines)
    few = some.repartition(4, "point", F.monotonically_increasing_id() % 4).mapInArrow(local, lines)
    ranks = few.groupBy("point").applyInArrow(
        facts, "point int, rank int, nullity int, condition_number double, effective_rank_99 int, energy double"
    )
    top = operators.groupBy(*keys).agg(F.max("weight").alias("max_entry")).withColumn("point", at)
    return top.join(ranks, "point").select(*keys, "rank", "nullity", "condition_number", "effective_rank_99", "max_entry", "energy")


def compare_operators(binary: DataFrame, fractional: DataFrame) -> DataFrame:
    """Rank gained and nullity lost by the fractional operator."""
    value = lambda df, c: df.select(c).scalar()
    return binary.select(
        F.col("rank").alias("binary_rank"),
        value(fractional, "rank").alias("fractional_rank"),
        (value(fractional, "rank") - F.col("rank")).alias("rank_improvement"),
        (F.col("nullity") - value(fractional, "nullity")).alias("nullity_reduction"),
    )


def _kernel(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """Turn-by-turn (or turn-by-component) matrix as ``turn_id, out, weight``."""
    i, j = np.divmod(np.arange(matrix.size), matrix.shape[1])
    frame = pd.DataFrame({"turn_id": i.astype(np.int32), "out": j.astype(np.int32), "weight": matrix.reshape(-1)})
    return spark.createDataFrame(frame)


def _times(assignment: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Cell-by-turn matrix times a driver-sized one: ``od_index, out, weight``."""
    rows = assignment.withColumnRenamed("weight", "a")
    kernel = _kernel(assignment.sparkSession, matrix)
    return apply_operator(rows, kernel, "turn_id", "out", "a", "w", by=("od_index",)).withColumnRenamed("w", "weight")


def pseudo_inverse(assignment: DataFrame, n_turns: int, rtol: float = 1e-10) -> DataFrame:
    """Moore-Penrose inverse as an operator table, by two sparse products:
    left singular vectors first, then their scaled combination."""
    _, s, vt = np.linalg.svd(_triangle(assignment, n_turns))
    keep = s > rtol * s[0]
    v = vt[: len(s)][keep].T
    left = _times(assignment, v / s[keep]).withColumnRenamed("out", "turn_id")
    return _times(left, (v / s[keep]).T).withColumnRenamed("out", "turn_id").select("turn_id", "od_index", "weight")


def turn_gram(assignment: DataFrame) -> DataFrame:
    """``t1, t2, g``: A A^T. Pairs arise only among turns that share a cell."""
    a = assignment.select("od_index", F.col("turn_id").alias("t1"), F.col("weight").alias("w1"))
    b = assignment.select("od_index", F.col("turn_id").alias("t2"), F.col("weight").alias("w2"))
    return a.join(b, "od_index").groupBy("t1", "t2").agg(F.sum(F.col("w1") * F.col("w2")).alias("g"))


def _tikhonov_kernel(assignment: DataFrame, n_turns: int, lam: float) -> np.ndarray:
    """(A A^T + lam I)^-1."""
    if lam <= 0:
        raise ValueError("lambda must be positive")
    _check_square(n_turns)
    g = turn_gram(assignment).toPandas()
    m = np.zeros((n_turns, n_turns))
    m[g["t1"].to_numpy(), g["t2"].to_numpy()] = g["g"].to_numpy()
    inverse = np.linalg.inv(m + lam * np.eye(n_turns))
    return (inverse + inverse.T) / 2


def tikhonov_operator(assignment: DataFrame, n_turns: int, lam: float) -> DataFrame:
    """Operator table of argmin |Ay - x|^2 + lam |y|^2.

    Uses A^T (A A^T + lam I)^-1, so only a turn-by-turn system is solved.
    """
    kernel = _tikhonov_kernel(assignment, n_turns, lam)
    return _times(assignment, kernel).withColumnRenamed("out", "turn_id").select("turn_id", "od_index", "weight")


def _back(counts: DataFrame, assignment: DataFrame, kernels: list[np.ndarray], n_turns: int, by: tuple) -> DataFrame:
    """``by..., od_index, y`` = A^T K_k ... K_1 x: batch products per sample, then one sparse product."""
    key = F.struct(*by).alias("sample_id")
    packed = pack(counts.select(key, "turn_id", "x"), F.col("turn_id"), "x", n_turns, "x")

    def run(batch):
        z = to_matrix(batch.column("x"), n_turns)
        for kernel in kernels:
            z = z @ kernel.T
        return {"sample_id": batch.column("sample_id"), "z": to_lists(z)}

    kind = packed.schema["sample_id"].dataType.simpleString()
    solved = map_batches(packed, run, f"sample_id {kind}, z array<double>")
    long = solved.select("sample_id.*", F.posexplode("z").alias("turn_id", "z")).filter(F.col("z") != 0)
    return apply_operator(long, assignment, "turn_id", "od_index", "z", "y", by)


class _Sparse:
    """A COO operator as two sorted lists of entries, for products with many vectors at once."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, weight: np.ndarray):
        self.rows, i = np.unique(rows, return_inverse=True)
        self.cols, j = np.unique(cols, return_inverse=True)
        self.by_row, self.by_col = (self._sorted(a, b, weight) for a, b in ((i, j), (j, i)))

    @staticmethod
    def _sorted(to: np.ndarray, of: np.ndarray, weight: np.ndarray) -> tuple:
        order = np.argsort(to, kind="stable")
        return np.searchsorted(to[order], np.arange(to.max() + 1)), of[order], weight[order]

    @staticmethod
    def _product(v: np.ndarray, parts: tuple) -> np.ndarray:
        starts, of, weight = parts
        return np.add.reduceat(v[:, of] * weight, starts, axis=1)

    def times(self, v: np.ndarray) -> np.ndarray:
        """Rows of vectors over ``cols`` to vectors over ``rows``."""
        return self._product(v, self.by_row)

    def back(self, v: np.ndarray) -> np.ndarray:
        return self._product(v, self.by_col)


def _solve(a: _Sparse, x: np.ndarray, lam: float, tol: float, rounds: int) -> np.ndarray:
    """(A A^T + lam I) z = x for each row of ``x`` by conjugate gradients, all rows in step."""
    z, r = np.zeros_like(x), x.copy()
    p, size = r.copy(), (r * r).sum(axis=1)
    goal = tol * tol * size
    for _ in range(rounds):
        if (size <= goal).all():
            return z
        q = a.times(a.back(p)) + lam * p
        curved = (p * q).sum(axis=1)
        step = np.divide(size, curved, out=np.zeros_like(size), where=curved > 0)[:, None]
        z += step * p
        r -= step * q
        now = (r * r).sum(axis=1)
        p = r + np.divide(now, size, out=np.zeros_like(size), where=size > 0)[:, None] * p
        size = now
    raise RuntimeError(f"conjugate gradients did not reach {tol} in {rounds} rounds")


def conjugate_estimate(
    counts: DataFrame, assignment: DataFrame, lam: float, by: tuple = ("sample_id",), tol: float = 1e-11, rounds: int = 20_000
) -> DataFrame:
    """``by..., od_index, y``: the Tikhonov solution of each sample by conjugate gradients, without any square matrix.

    A sample's counts come as one row and are solved in the task they are in, some at a time so that their products
    with the entries stay within ``MAX_OPERATOR_CELLS`` / 4. The operator is shipped entry by entry, at most ``ENTRIES``
    of them, whatever the number of turns or cells.
    """
    if lam <= 0:
        raise ValueError("lambda must be positive")
    if not is_small(assignment, ENTRIES):
        raise ValueError(f"operator of more than {ENTRIES} entries is too large to ship")
    entries = assignment.select("turn_id", "od_index", "weight").toPandas()
    a = _Sparse(entries["turn_id"].to_numpy(), entries["od_index"].to_numpy(), entries["weight"].to_numpy(np.float64)) if len(entries) else None
    at_once = max(1, MAX_OPERATOR_CELLS // 4 // max(1, len(entries)))
    listed = counts.groupBy(*by).agg(F.collect_list(F.struct("turn_id", "x")).alias("c"))
    listed = listed.select(F.struct(*by).alias("key"), F.col("c.turn_id").cast("array<long>").alias("turns"), F.col("c.x").cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows if a else 0, at_once):
                batch = whole.slice(i, at_once)
                row = np.repeat(np.arange(batch.num_rows), batch["turns"].value_lengths().to_numpy(zero_copy_only=False))
                turns, values = batch["turns"].flatten().to_numpy(), batch["x"].flatten().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(a.rows, turns), len(a.rows) - 1)
                known = a.rows[at] == turns  # a turn that the operator doesn't have changes no cell
                x = np.zeros((batch.num_rows, len(a.rows)))
                np.add.at(x, (row[known], at[known]), values[known])
                y = a.back(_solve(a, x, lam, tol, rounds))
                cells = pa.array(np.tile(a.cols.astype(np.int32), len(y)))
                ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * len(a.cols))
                lists = [pa.ListArray.from_arrays(ends, v) for v in (cells, pa.array(y.reshape(-1)))]
                yield pa.RecordBatch.from_arrays([batch["key"], *lists], ["key", "od_index", "y"])

    kind = listed.schema["key"].dataType.simpleString()
    solved = listed.mapInArrow(run, f"key {kind}, od_index array<int>, y array<double>")
    return solved.select("key.*", F.inline(F.arrays_zip("od_index", "y"))).filter("y != 0")


def tikhonov_estimate(counts: DataFrame, assignment: DataFrame, n_turns: int, lam: float, by: tuple = ("sample_id",)) -> DataFrame:
    """``by..., od_index, y``: the Tikhonov solution of each sample, without forming its operator.

    By a kernel of turns by turns while the driver can hold it, by conjugate gradients beyond.
    """
    if n_turns * n_turns > MAX_OPERATOR_CELLS:
        return conjugate_estimate(counts, assignment, lam, by)
    return _back(counts, assignment, [_tikhonov_kernel(assignment, n_turns, lam)], n_turns, by)


def minimum_norm_estimate(counts: DataFrame, assignment: DataFrame, n_turns: int, rtol: float = 1e-10, by: tuple = ("sample_id",)) -> DataFrame:
    """``by..., od_index, y`` = A+ x by singular vectors of the turns: first their coefficients, then back to turns."""
    _, s, vt = np.linalg.svd(_triangle(assignment, n_turns))
    keep = s > rtol * s[0]
    scaled = vt[: len(s)][keep] / s[keep, None]
    return _back(counts, assignment, [scaled, scaled.T], n_turns, by)


def estimate(counts: DataFrame, operator: DataFrame, by: tuple = ("sample_id",)) -> DataFrame:
    """``by..., od_index, y``: an estimator table applied to every sample."""
    return apply_operator(counts, operator, "turn_id", "od_index", "x", "y", by)


def residuals(estimates: DataFrame, counts: DataFrame, assignment: DataFrame, by: tuple = ("sample_id",)) -> DataFrame:
    """``by..., turn_id, x`` = observed counts minus the counts of the estimate."""
    fitted = apply_operator(estimates, assignment, "od_index", "turn_id", "y", "x", by)
    both = counts.select(*by, "turn_id", "x").unionByName(fitted.withColumn("x", -F.col("x")))
    return both.groupBy(*by, "turn_id").agg(F.sum("x").alias("x"))


def physics_refine(estimates: DataFrame, counts: DataFrame, assignment: DataFrame, n_turns: int, mu: float, by: tuple = ("sample_id",)) -> DataFrame:
    """Solve (I + mu A^T A) y = y0 + mu A^T x for every sample.

    The change y - y0 is the Tikhonov estimate, with weight 1/mu, of the part of
    the counts the estimate does not explain. Nothing changes when mu <= 0.
    """
    kept = estimates.select(*by, "od_index", "y")
    if mu <= 0:
        return kept
    change = tikhonov_estimate(residuals(kept, counts, assignment, by), assignment, n_turns, 1.0 / mu, by)
    return kept.unionByName(change.select(*by, "od_index", "y")).groupBy(*by, "od_index").agg(F.sum("y").alias("y"))


def null_component(estimates: DataFrame, assignment: DataFrame, n_turns: int, by: tuple = ("sample_id",)) -> DataFrame:
    """The part of each estimate the counts cannot see: y - A+ A y.

    Applied in factors; a cell-by-cell projector or null basis, which grows with
    the square of the cells, is never formed.
    """
    kept = estimates.select(*by, "od_index", "y")
    fitted = apply_operator(kept, assignment, "od_index", "turn_id", "y", "x", by)
    seen = minimum_norm_estimate(fitted, assignment, n_turns, by=by).withColumn("y", -F.col("y"))
    return kept.unionByName(seen.select(*by, "od_index", "y")).groupBy(*by, "od_index").agg(F.sum("y").alias("y"))


def nullspace_diagnostics(
    estimates: DataFrame, counts: DataFrame, assignment: DataFrame, inverse_estimate: DataFrame, n_cells: int, by: tuple = ("sample_id",)
) -> DataFrame:
    """Per sample: distance to the minimum-norm estimate, relative leak of that
    difference through the operator, and its mean absolute entry."""
    diff = (
        estimates.select(*by, "od_index", "y")
        .unionByName(inverse_estimate.select(*by, "od_index", (-F.col("y")).alias("y")))
        .groupBy(*by, "od_index")
        .agg(F.sum("y").alias("y"))
    )
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    size = diff.groupBy(*by).agg(
        norm("y").alias("l2_to_pinv"), (F.sum(F.abs("y")) / F.lit(float(n_cells))).alias("mean_abs_component")
    )
    leak = apply_operator(diff, assignment, "od_index", "turn_id", "y", "a", by).groupBy(*by).agg(norm("a").alias("leak"))
    scale = counts.groupBy(*by).agg(norm("x").alias("x_norm"))
    return size.join(leak, list(by), "left").join(scale, list(by), "left").select(
        *by,
        "l2_to_pinv",
        (F.coalesce("leak", F.lit(0.0)) / F.greatest(F.coalesce("x_norm", F.lit(0.0)), F.lit(1e-6))).alias("rel_leak"),
        "mean_abs_component",
    )


def normal_equation_residual(
    estimates: DataFrame, counts: DataFrame, assignment: DataFrame, lam: float, by: tuple = ("sample_id",)
) -> DataFrame:
    """Largest entry per sample of A^T (x - A y) - lam y, zero for the exact solution."""
    pushed = apply_operator(residuals(estimates, counts, assignment, by), assignment, "turn_id", "od_index", "x", "y", by)
    both = pushed.unionByName(estimates.select(*by, "od_index", (F.lit(-float(lam)) * F.col("y")).alias("y")))
    return both.groupBy(*by, "od_index").agg(F.sum("y").alias("r")).groupBy(*by).agg(F.max(F.abs("r")).alias("residual"))


