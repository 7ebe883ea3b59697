"""Search of parameters on a validation split: one scan scores every candidate of every model.

A prediction of these models is linear in the counts and goes through one decomposition per model: counts are taken to
components, each component is weighted by a factor that the parameter gives, and components lead to cells. Only the
factors differ between candidates, so a batch of samples is projected once and each candidate costs one product.
Tasks emit sums of absolute errors, a row for each candidate and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import turn_gram
from .regression import Sums, log_grid, pls_parts
from .scoring import composite
from .vectors import MAX_OPERATOR_CELLS, check_vector_size, to_matrix


@dataclass(frozen=True)
class Family:
    """Candidates of one model: y = ((x - centre) @ into * factors) @ out + offset, with factors by candidate."""

    model: str
    parameter: str
    values: list[float]
    into: np.ndarray  # (turns, components)
    out: np.ndarray  # (components, cells)
    factors: np.ndarray  # (candidates, components)
    centre: np.ndarray
    offset: np.ndarray


def _turn_spectrum(assignment: DataFrame, n_turns: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of A A^T, after a size check."""
    if n_turns * n_turns > MAX_OPERATOR_CELLS:
        raise ValueError(f"{n_turns} x {n_turns} matrix is too large for the driver")
    g = turn_gram(assignment).toPandas()
    m = np.zeros((n_turns, n_turns))
    m[g["t1"].to_numpy(), g["t2"].to_numpy()] = g["g"].to_numpy()
    values, vectors = np.linalg.eigh(m)
    return np.maximum(values, 0.0), vectors


def tikhonov_family(assignment: DataFrame, matrix: np.ndarray, lambdas: list[float]) -> Family:
    """argmin |Ay - x|^2 + lambda |y|^2: factors 1 / (s + lambda) of the eigenvalues s of A A^T."""
    return _operator_family(assignment, matrix, "tikhonov", "lambda", lambdas, lambda s, v: 1.0 / (s + v))


def refine_family(assignment: DataFrame, matrix: np.ndarray, mus: list[float]) -> Family:
    """The step from y0 to argmin |y - y0|^2 + mu |Ay - x|^2, applied to x - A y0: factors mu / (1 + mu s)."""
    return _operator_family(assignment, matrix, "refine", "mu", mus, lambda s, v: v / (1.0 + v * s))


def _operator_family(assignment: DataFrame, matrix: np.ndarray, model: str, parameter: str, values: list[float], factor) -> Family:
    if parameter == "lambda" and min(values) <= 0 or min(values) < 0:
        raise ValueError(f"{parameter} must be positive")
    s, u = _turn_spectrum(assignment, len(matrix))
    factors = np.stack([factor(s, v) for v in values])
    return Family(model, parameter, values, u, u.T @ matrix, factors, np.zeros(len(matrix)), np.zeros(matrix.shape[1]))


def ridge_family(sums: Sums, alphas: list[float], standardise: bool = True) -> Family:
    """Ridge with an unpenalised intercept: factors 1 / (e + alpha) of the eigenvalues e of the centred X^T X."""
    if min(alphas) <= 0:
        raise ValueError("alpha must be positive")
    g, c, mx, my, std = sums.centred(standardise)
    e, v = np.linalg.eigh(g)
    factors = np.stack([1.0 / (np.maximum(e, 0.0) + a) for a in alphas])
    return Family("ridge", "alpha", alphas, v / std[:, None], v.T @ c, factors, mx, my)


def pls_family(sums: Sums, components: list[int], scale: bool = True) -> Family:
    """Partial least squares: one fit with the most components, of which a candidate takes the first ones.

    Counts beyond what the training set supports give the largest model that exists.
    """
    into, out, mx, my = pls_parts(sums, max(components), scale)
    factors = np.stack([(np.arange(into.shape[1]) < k).astype(float) for k in components])
    return Family("pls", "n_components", [float(k) for k in components], into, out, factors, mx, my)


def default_families(sums: Sums, assignment: DataFrame, matrix: np.ndarray) -> tuple[list[Family], tuple[Family, Family]]:
    """Tikhonov, ridge and PLS over the usual ranges, and the two factors of physics ridge."""
    most = int(min(20, sums.n - 1, sums.x_width, matrix.shape[1]))
    singles = [
        tikhonov_family(assignment, matrix, log_grid(1e-6, 1e6, 25)),
        ridge_family(sums, log_grid(1e-4, 1e5, 19)),
        pls_family(sums, list(range(2, max(2, most) + 1))),
    ]
    return singles, (ridge_family(sums, log_grid(1e-4, 1e5, 10)), refine_family(assignment, matrix, log_grid(1e-6, 1e2, 9)))


_LINE = "model string, p1 string, v1 double, p2 string, v2 double, n bigint, cell double, fwd double, prod double, attr double"


def search_scores(
    rows: DataFrame,
    singles: list[Family],
    matrix: np.ndarray,
    n_zones: int,
    physics: tuple[Family, Family] | None = None,
    weights: tuple[float, float, float] = (1.0, 0.5, 0.5),
) -> DataFrame:
    """``model, parameter, value, parameter2, value2``, the four mean errors and ``score``, a row for each candidate.

    ``rows(x, y)`` are the dense counts and cells of the validation samples, ``matrix`` the operator of turns by cells.
    ``physics`` names a regression and a refinement; every pair of their candidates is scored as ``physics_ridge``.
    ``weights`` are those of the forward, production and attraction errors. No rows give no candidates.
    """
    n_turns, n_cells = matrix.shape
    check_vector_size(n_cells)
    forward = matrix.T

    def project(family: Family, x: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Value, cells and turning counts of each candidate."""
        parts = (x - family.centre) @ family.into
        seen, base = family.out @ forward, family.offset @ forward
        for value, factor in zip(family.values, family.factors, strict=True):
            z = parts * factor
            yield value, z @ family.out + family.offset, z @ seen + base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def add(key: tuple, x: np.ndarray, y: np.ndarray, p: np.ndarray, h: np.ndarray) -> None:
            gap = (p - y).reshape(len(y), n_zones, n_zones)
            line = [len(y), np.abs(gap).sum(), np.abs(x - h).sum(), np.abs(gap.sum(axis=2)).sum(), np.abs(gap.sum(axis=1)).sum()]
            sums[key] = sums.get(key, 0.0) + np.array(line)

        for b in batches:
            x, y = to_matrix(b.column("x"), n_turns), to_matrix(b.column("y"), n_cells)
            for family in singles:
                for value, p, h in project(family, x):
                    add((family.model, family.parameter, value, None, None), x, y, p, h)
            if physics:
                first, second = physics
                for value, p0, h0 in project(first, x):
                    for other, step, turned in project(second, x - h0):
                        add(("physics_ridge", first.parameter, value, second.parameter, other), x, y, p0 + step, h0 + turned)
        if sums:
            keys, lines = zip(*sums.items(), strict=True)
            types = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64())
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate(types)]
            columns += [pa.array(v, pa.int64() if i == 0 else pa.float64()) for i, v in enumerate(np.array(lines).T)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _LINE.split(", ")])

    n = F.sum("n")
    mean = rows.select("x", "y").mapInArrow(run, _LINE).groupBy("model", "p1", "v1", "p2", "v2").agg(
        (F.sum("cell") / (n * n_cells)).alias("mae"),
        (F.sum("fwd") / (n * n_turns)).alias("forward_mae"),
        (F.sum("prod") / (n * n_zones)).alias("production_mae"),
        (F.sum("attr") / (n * n_zones)).alias("attraction_mae"),
    )
    named = {"p1": "parameter", "v1": "value", "p2": "parameter2", "v2": "value2"}
    return mean.withColumnsRenamed(named).withColumn("score", composite(*weights))


def best_candidates(scores: DataFrame) -> DataFrame:
    """The candidate with the lowest score of each model; of equal ones that with the smaller values."""
    order = F.struct("score", "value", "value2")
    fields = ("parameter", "value", "parameter2", "value2", "score")
    best = scores.groupBy("model").agg(F.min_by(F.struct(*fields), order).alias("b"))
    return best.select("model", *[F.col(f"b.{c}").alias(c) for c in fields])
