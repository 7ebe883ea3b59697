"""Assignment tables (turn by OD cell, COO form) and turning counts.

The step that grows with the data is ``turning_counts``; everything else has
the size of the network.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import is_small, join_small, scratch_path
from .network import k_shortest_paths, logit_shares, path_turns
from .reshape import od_index, pack
from .noise import observation_noise
from .vectors import MAX_OPERATOR_CELLS, check_vector_size, map_batches, to_lists, to_matrix

#: Entries of an operator up to which a task keeps it as a full matrix beside its compressed rows (16 MB).
MAX_DENSE = 2_000_000


def turn_uses(routes: DataFrame, turns: DataFrame, keys: list) -> DataFrame:
    """Turn id of every route step; steps that are no known turn drop out."""
    return path_turns(routes, keys).join(
        turns.select("turn_id", "incoming_edge", "outgoing_edge"), ["incoming_edge", "outgoing_edge"]
    )


def dropped_steps(routes: DataFrame, turns: DataFrame, keys: list) -> DataFrame:
    """Route steps that match no turn."""
    return path_turns(routes, keys).join(turns, ["incoming_edge", "outgoing_edge"], "left_anti")


def route_turns(routes: DataFrame, turns: DataFrame, keys: list) -> DataFrame:
    """Distinct turn ids per route, sorted, as an array."""
    return turn_uses(routes, turns, keys).groupBy(*keys).agg(F.array_sort(F.collect_set("turn_id")).alias("turn_ids"))


def binary_assignment(routes: DataFrame, turns: DataFrame, n_zones: int, weighted: bool = False) -> DataFrame:
    """``turn_id, od_index, weight``: 1 per used turn, or the number of uses."""
    uses = turn_uses(routes, turns, ["o", "d"]).groupBy("turn_id", od_index(n_zones).alias("od_index"))
    return uses.agg((F.count("*") if weighted else F.lit(1)).cast("double").alias("weight"))


def fractional_assignment(shares: DataFrame, turns: DataFrame, n_zones: int, extra: tuple = ()) -> DataFrame:
    """``turn_id, od_index, weight``: summed probability of the routes using the turn."""
    keys = [*extra, "o", "d", "rank", "probability"]
    once = turn_uses(shares, turns, keys).select(*keys, "turn_id").distinct()
    return once.groupBy(*extra, "turn_id", od_index(n_zones).alias("od_index")).agg(F.sum("probability").alias("weight"))


def assignment_checks(assignment: DataFrame, n_turns: int, n_zones: int) -> DataFrame:
    """Entry range and column sums; cells not stored are zero entries."""
    per_cell = assignment.groupBy("od_index").agg(
        F.sum("weight").alias("s"), F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.count("*").alias("n")
    )
    stored = F.coalesce(F.sum("n"), F.lit(0))
    low = F.when(stored < n_turns * n_zones * n_zones, F.least(F.min("lo"), F.lit(0.0))).otherwise(F.min("lo"))
    high = F.when(stored < n_turns * n_zones * n_zones, F.greatest(F.max("hi"), F.lit(0.0))).otherwise(F.max("hi"))
    return per_cell.agg(
        low.alias("min_entry"),
        high.alias("max_entry"),
        ((low >= -1e-12) & (high <= 1.0 + 1e-9)).alias("entries_in_01"),
        F.max("s").alias("max_column_sum"),
        F.coalesce(F.avg(F.when(F.col("s") > 0, F.col("s"))), F.lit(0.0)).alias("mean_column_sum"),
    )


def apply_operator(
    rows: DataFrame,
    operator: DataFrame,
    key: str,
    out: str,
    value: str = "flow",
    result: str = "x",
    by: tuple = ("sample_id",),
    small: bool | None = None,
) -> DataFrame:
    """Sparse product of every sample with a COO operator.

    ``rows(by..., key, value)`` and ``operator(key, out, weight)`` meet on
    ``key``; the operator is broadcast when its size is proven. Partial sums are
    taken before the shuffle, so it carries one row per sample and output, and
    a heavy sample or cell stays spread over the scanning tasks. ``small`` tells
    the outcome of an earlier size check, so that a stream doesn't repeat it.
    """
    left, right = rows.select(*by, key, value), operator.select(key, out, "weight")
    joined = join_small(left, right, key) if small is None else left.join(F.broadcast(right) if small else right, key)
    return joined.groupBy(*by, out).agg(F.sum(F.col(value) * F.col("weight")).alias(result))


def _block_product(operator: DataFrame, key: str, out: str):
    """Function for mapInArrow over ``sample_id, key, flow``: one row per sample of a batch with its outputs and sums.

    The operator comes as compressed rows: for each key the place of its first entry, then outputs and weights.
    """
    entries = operator.select(key, out, "weight").toPandas().sort_values([key, out])
    outs, first = np.unique(entries[out].to_numpy(), return_inverse=True)
    weight = entries["weight"].to_numpy(np.float64)
    keys = int(entries[key].max()) + 1 if len(entries) else 0
    ends = np.searchsorted(entries[key].to_numpy(), np.arange(keys + 1))
    whole = None  # the operator as a matrix, where sums of positive terms show which outputs were touched
    if keys * len(outs) <= MAX_DENSE and (weight > 0).all():
        whole = np.zeros((keys, len(outs)))
        whole[entries[key].to_numpy(), first] = weight

    def lists(samples: pa.Array, used: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        at = pa.array(np.searchsorted(used, np.arange(len(samples) + 1) * len(outs)).astype(np.int32))
        turns = pa.ListArray.from_arrays(at, pa.array(outs[used % max(1, len(outs))]))
        return pa.RecordBatch.from_arrays([samples, turns, pa.ListArray.from_arrays(at, pa.array(sums))], ["sample_id", "outs", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, flow = batch[key].to_numpy(), batch["flow"].to_numpy()
            known = (at >= 0) & (at < len(ends) - 1)
            if not known.all():  # keys without an entry
                batch, at, flow = batch.filter(pa.array(known)), at[known], flow[known]
            if not batch.num_rows:
                continue
            samples = batch["sample_id"].dictionary_encode()
            sample, n_samples = samples.indices.to_numpy().astype(np.int64), len(samples.dictionary)
            if whole is not None and n_samples * keys <= 8 * batch.num_rows + 100_000 and (flow > 0).all():
                filled = np.bincount(sample * keys + at, flow, n_samples * keys).reshape(n_samples, keys) @ whole
                used = np.flatnonzero(filled)
                yield lists(samples.dictionary, used, filled.reshape(-1)[used])
                continue
            n = ends[at + 1] - ends[at]
            total = n.cumsum()
            entry = np.arange(total[-1]) + np.repeat(ends[at] - total + n, n)
            cell = np.repeat(sample, n) * len(outs) + first[entry]
            value = np.repeat(flow, n) * weight[entry]
            if n_samples * len(outs) <= 4 * len(cell) + 100_000:
                used = np.flatnonzero(np.bincount(cell))
                sums = np.bincount(cell, value)[used]
            else:  # many samples with few cells each
                used, where = np.unique(cell, return_inverse=True)
                sums = np.bincount(where, value)
            yield lists(samples.dictionary, used, sums)

    return run


def block_product(rows: DataFrame, operator: DataFrame, key: str, out: str, result: str = "x") -> DataFrame:
    """``apply_operator`` by compressed rows of the operator, for ``rows(sample_id, key, flow)`` by sample.

    A batch of rows becomes one row of sums per sample in it, so no row per sample, key and output exists; those partial
    rows are shuffled by sample and added up. Rows with a null are left out. Only for operators whose size is proven small.
    """
    id_type, out_type = dict(rows.dtypes)["sample_id"], dict(operator.dtypes)[out]
    rows = rows.select("sample_id", F.col(key).cast("long").alias(key), F.col("flow").cast("double").alias("flow")).dropna()
    sums = rows.mapInArrow(
        _block_product(operator, key, out), f"sample_id {id_type}, outs array<{out_type}>, sums array<double>"
    )
    lines = sums.repartition("sample_id").select("sample_id", F.inline(F.arrays_zip(F.col("outs").alias(out), F.col("sums").alias(result))))
    return lines.groupBy("sample_id", out).agg(F.sum(result).alias(result))


def turning_counts(cells: DataFrame, assignment: DataFrame, n_zones: int) -> DataFrame:
    """``sample_id, turn_id, x``; a turn without traffic has no row.

    By compressed blocks while the assignment table is provably small, else by a join.
    """
    rows = cells.withColumn("od_index", od_index(n_zones))
    if not is_small(assignment):
        return apply_operator(rows, assignment, "od_index", "turn_id")
    return block_product(rows, assignment, "od_index", "turn_id")


def operator_matrix(operator: DataFrame, row: str, col: str, n_rows: int, n_cols: int) -> np.ndarray:
    """A network-sized operator as a matrix for shipping to tasks; size checked first."""
    if n_rows * n_cols > MAX_OPERATOR_CELLS:
        raise ValueError(f"operator of {n_rows} x {n_cols} is too large to ship")
    entries = operator.select(row, col, "weight").toPandas()
    out = np.zeros((n_rows, n_cols))
    out[entries[row].to_numpy(), entries[col].to_numpy()] = entries["weight"].to_numpy()
    return out


def vector_counts(vectors: DataFrame, assignment: DataFrame, n_turns: int, n_zones: int) -> DataFrame:
    """``sample_id, x ARRAY<DOUBLE>`` from vector rows: one matrix product per
    Arrow batch, no shuffle. For bounded zone systems."""
    check_vector_size(n_zones * n_zones)
    matrix = operator_matrix(assignment, "turn_id", "od_index", n_turns, n_zones * n_zones).T.copy()
    width = n_zones * n_zones

    def run(batch):
        y = to_matrix(batch.column("y"), width)
        return {"sample_id": batch.column("sample_id"), "x": to_lists(y @ matrix)}

    id_type = dict(vectors.dtypes)["sample_id"]
    return map_batches(vectors.select("sample_id", "y"), run, f"sample_id {id_type}, x array<double>")


def reconstruction_error(cells: DataFrame, counts: DataFrame, assignment: DataFrame, n_zones: int) -> DataFrame:
    """``sample_id, turn_id, x, x_hat`` with absent sides as zero: both tables
    are stacked and summed, which replaces a full outer join."""
    again = turning_counts(cells, assignment, n_zones)
    zero = F.lit(0.0)
    both = counts.select("sample_id", "turn_id", "x", zero.alias("x_hat")).unionByName(
        again.select("sample_id", "turn_id", zero.alias("x"), F.col("x").alias("x_hat"))
    )
    return both.groupBy("sample_id", "turn_id").agg(F.sum("x").alias("x"), F.sum("x_hat").alias("x_hat"))


def validate_counts(cells: DataFrame, counts: DataFrame, assignment: DataFrame, n_zones: int, atol: float = 1e-6) -> DataFrame:
    """Largest reconstruction error and whether it stays within ``atol``."""
    err = F.max(F.abs(F.col("x") - F.col("x_hat")))
    return reconstruction_error(cells, counts, assignment, n_zones).agg(
        err.alias("max_reconstruction_error"), (err <= atol).alias("matrix_mult_consistent")
    )


def forward_check(
    cells: DataFrame, counts: DataFrame, assignment: DataFrame, n_zones: int,
    atol: float = 1e-2, rtol: float = 1e-3, n_check: int = 32,
) -> DataFrame:
    """Compare counts with the forward map on the first ``n_check`` sample ids.

    The bound is the operator's own spot check; ``validate_counts`` covers all rows.
    """
    first = F.col("sample_id") < n_check
    pairs = reconstruction_error(cells.filter(first), counts.filter(first), assignment, n_zones)
    err = F.abs(F.col("x") - F.col("x_hat"))
    return pairs.agg(
        F.count_distinct("sample_id").alias("n_checked"),
        F.max(err).alias("max_abs_err"),
        F.avg(err).alias("mean_abs_err"),
        F.max(err / F.greatest(F.abs("x"), F.lit(1e-6))).alias("max_rel_err"),
        F.bool_and(err <= atol + rtol * F.abs("x_hat")).alias("allclose"),
    )


def sensitivity_assignments(
    edges: DataFrame, turns: DataFrame, pairs: DataFrame, n_zones: int,
    k_values: list[int], theta_values: list[float], metric: str = "length",
) -> DataFrame:
    """``k_paths, theta, turn_id, od_index, weight`` for the whole grid.

    Paths are searched once at the largest K; each route then lists the grid
    points it takes part in.
    """
    routes = k_shortest_paths(edges, pairs, max(k_values), metric)
    grid = F.array(
        *(F.struct(F.lit(k).alias("k_paths"), F.lit(float(t)).alias("theta")) for k in k_values for t in theta_values)
    )
    listed = (
        routes.withColumn("g", F.explode(grid))
        .select("g.k_paths", "g.theta", "o", "d", "rank", "edges", "cost")
        .filter(F.col("rank") <= F.col("k_paths"))
        # theta scales the cost, so one softmax pass serves every grid point
        .withColumn("cost", F.col("cost") * F.col("theta"))
    )
    shares = logit_shares(listed, 1.0, ("k_paths", "theta", "o", "d"))
    return fractional_assignment(shares, turns, n_zones, ("k_paths", "theta"))


def batch_counts(
    cells: DataFrame, assignment: DataFrame, n_turns: int, n_zones: int, target: str | None = None,
    noise: str = "none", sigma: float = 0.05, scale: float = 1.0, seed: int = 42, family: str = "xx", atol: float = 1e-3,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the counts of a batch with their noisy twins; statistics and a check come from what was written.

    Returns ``sample_id, turn_id, x, x_obs`` (one row for each sample and turn, read back from ``target``), per turn
    ``turn_id, n, mean, std, cv, mean_obs``, and one row ``num_samples, num_turns, first_sample,
    max_reconstruction_error, matrix_mult_consistent, total``. ``num_samples``, ``first_sample`` and ``total`` are
    observed by the write itself, so no pass counts the samples. The check takes the smallest sample and forms its
    counts again by a join, not by the blocks the written ones came from. Turn ids run from 0; samples whose cells use
    no route have no row. Without samples the check's error is null and it does not hold.
    """
    spark = cells.sparkSession
    target = target or scratch_path(spark, "batchcounts")
    vectors = pack(turning_counts(cells, assignment, n_zones), F.col("turn_id"), "x", n_turns, "x")
    rows = vectors.select("sample_id", F.posexplode("x").alias("turn_id", "x"))
    noisy = observation_noise(rows, noise, sigma, scale, seed, family).select("sample_id", "turn_id", "x", "x_obs")
    seen = Observation()
    # turn 0 stands for its sample
    noisy.observe(
        seen, F.count_if(F.col("turn_id") == 0).alias("n"), F.min("sample_id").alias("first"), F.sum("x").alias("total")
    ).write.parquet(target)
    done = spark.read.schema(noisy.schema).parquet(target)
    n, first, total = (seen.get[k] for k in ("n", "first", "total"))
    mean = F.sum("x") / F.count("*")
    std = F.sqrt(F.greatest(F.sum(F.col("x") * F.col("x")) / F.count("*") - mean * mean, F.lit(0.0)))
    stats = done.groupBy("turn_id").agg(
        F.count("*").alias("n"), mean.alias("mean"), std.alias("std"), (std / (mean + 1e-9)).alias("cv"), F.avg("x_obs").alias("mean_obs")
    )
    mine = F.col("sample_id") == F.lit(first)
    again = apply_operator(cells.filter(mine).withColumn("od_index", od_index(n_zones)), assignment, "od_index", "turn_id", result="again")
    both = done.filter(mine).join(again.select("turn_id", "again"), "turn_id", "left")
    error = F.max(F.abs(F.col("x") - F.coalesce("again", F.lit(0.0))))
    check = both.agg(
        F.lit(n).cast("long").alias("num_samples"),
        F.lit(n_turns).alias("num_turns"),
        F.lit(first).alias("first_sample"),
        error.alias("max_reconstruction_error"),
        F.coalesce(error <= atol, F.lit(False)).alias("matrix_mult_consistent"),
        F.lit(total).cast("double").alias("total"),
    )
    return done, stats, check
