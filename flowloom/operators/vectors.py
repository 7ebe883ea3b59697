"""Arrow helpers for vector tables: whole batches as NumPy matrices inside tasks.

A vector row is bounded by the zone count squared; ``check_vector_size`` refuses
zone systems for which a batch of rows would not fit in a task. Larger systems
use the long-form operators instead.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# The batch functions are small; sending them by value means executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

#: Entries per vector up to which batches of rows are handled in one task (128 zones).
MAX_VECTOR_CELLS = 16_384
#: Entries of an operator matrix that may be shipped to every task (128 MB of doubles).
MAX_OPERATOR_CELLS = 16_000_000


def check_vector_size(entries: int) -> None:
    if entries > MAX_VECTOR_CELLS:
        raise ValueError(f"{entries} entries per vector; beyond the vector form; use the form by cells")


def to_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), width)


def to_lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``fn`` (batch to named columns) to every Arrow batch; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch))

    return df.mapInArrow(run, schema)
