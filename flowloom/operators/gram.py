"""Cross-product sums of vector rows.

Each Arrow batch is reduced to one matrix and each task emits its matrices as
rows; only those are shuffled. This is the map-side combine behind correlation,
ridge, PLS and the per-fold cross-validation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import MAX_OPERATOR_CELLS, to_matrix


def _check(entries: int) -> None:
    if entries > MAX_OPERATOR_CELLS:
        raise ValueError(f"cross-product matrix of {entries} entries is too large")


def gram_matrix(packed: DataFrame, width: int, shift: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum of outer products of (row - shift) and the row count.

    ``packed(at, v)`` lists the stored positions and values of each row.
    """
    _check(width * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((width, width)), 0
        for b in batches:
            at, v = b.column("at"), b.column("v")
            dense = np.zeros((b.num_rows, width))
            dense[np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = v.flatten().to_numpy()
            dense -= shift
            total += dense.T @ dense
            count += b.num_rows
        if count:
            i, j = np.divmod(np.arange(width * width), width)
            yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total.reshape(-1), "n": np.where(i + j == 0, count, 0)})

    sums = (
        packed.select("at", "v")
        .mapInArrow(run, "i int, j int, s double, n bigint")
        .groupBy("i", "j")
        .agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        .toPandas()
    )
    out = np.zeros((width, width))
    out[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["s"].to_numpy()
    return out, int(sums["n"].sum())


def cross_products(rows: DataFrame, x_width: int, y_width: int, fold: str | None = None) -> DataFrame:
    """``fold, i, j, s``: sums of products of the columns of ``[1, x, y]``.

    ``rows(x ARRAY, y ARRAY [, fold])``. Index 0 is the constant, then x, then y;
    the y-by-y block is left out. Row (0, 0) is the row count.
    """
    p, width = 1 + x_width, 1 + x_width + y_width
    _check(p * width)
    chosen = rows.select("x", "y", (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            fold_of = b.column("fold").to_numpy()
            full = np.hstack([np.ones((b.num_rows, 1)), to_matrix(b.column("x"), x_width), to_matrix(b.column("y"), y_width)])
            for f in np.unique(fold_of):
                part = full[fold_of == f]
                sums[int(f)] = sums.get(int(f), 0.0) + part[:, :p].T @ part
        i, j = np.divmod(np.arange(p * width), width)
        for f, s in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"fold": np.full(p * width, f, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "s": s.reshape(-1)}
            )

    partial = chosen.mapInArrow(run, "fold int, i int, j int, s double")
    return partial.groupBy("fold", "i", "j").agg(F.sum("s").alias("s"))
