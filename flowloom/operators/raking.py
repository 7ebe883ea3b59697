"""Iterative proportional fitting of many demand tables at once.

``rake`` works on cell tables with windows: both scalings, the row totals after
them and the per-sample error are window sums, and the totals after one
iteration are the row sums of the next. Iterations are chained in one plan and
written out every ``chunk`` of them; samples that converged leave the loop.

``rake_factors`` keeps the cells fixed and iterates row factors in a table of
their own, so that no task ever needs a whole sample.

``rake_vectors`` does the same for vector rows inside Arrow batches without any
shuffle; it iterates only the row and column factors, never the cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .vectors import check_vector_size, map_batches, to_lists, to_matrix

#: Iterations chained in one plan at most; deeper plans overflow the optimiser's stack.
MAX_CHAIN = 12


def _row() -> WindowSpec:
    return W.partitionBy("sample_id", "o")


def _col() -> WindowSpec:
    return W.partitionBy("sample_id", "d")


def _sample() -> WindowSpec:
    return W.partitionBy("sample_id")


def _with_targets(cells: DataFrame, row_target: DataFrame, col_target: DataFrame) -> DataFrame:
    """Attach both targets and the error of zones that have a target but no cell."""
    rows = row_target.select("sample_id", "o", F.col("target").alias("tr"))
    cols = col_target.select("sample_id", "d", F.col("target").alias("tc"))
    unmet = (
        rows.join(cells.select("sample_id", "o"), ["sample_id", "o"], "left_anti")
        .select("sample_id", F.abs("tr").alias("t"))
        .unionByName(
            cols.join(cells.select("sample_id", "d"), ["sample_id", "d"], "left_anti").select(
                "sample_id", F.abs("tc").alias("t")
            )
        )
        .groupBy("sample_id")
        .agg(F.max("t").alias("unmet"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return (
        cells.select("sample_id", "o", "d", "flow")
        .join(rows, ["sample_id", "o"], "left")
        .join(cols, ["sample_id", "d"], "left")
        .join(unmet, "sample_id", "left")
        .select("sample_id", "o", "d", "flow", zero("tr"), zero("tc"), zero("unmet"))
    )


def _iterate(state: DataFrame, tol: float, keep_history: bool) -> DataFrame:
    active = F.col("final_error") >= tol
    scaled_rows = state.withColumn(
        "flow", F.when(active & (F.col("rs") > 0), F.col("flow") * F.col("tr") / F.col("rs")).otherwise(F.col("flow"))
    )
    scaled = scaled_rows.withColumn("cs", F.sum("flow").over(_col())).withColumn(
        "flow", F.when(active & (F.col("cs") > 0), F.col("flow") * F.col("tc") / F.col("cs")).otherwise(F.col("flow"))
    )
    summed = scaled.withColumn("rs", F.sum("flow").over(_row()))
    col_error = F.when(F.col("cs") > 0, 0.0).otherwise(F.abs("tc"))
    error = F.max(F.greatest(F.abs(F.col("rs") - F.col("tr")), col_error, F.col("unmet"))).over(_sample())
    state = summed.withColumn("e", error).withColumn("iterations", F.col("iterations") + active.cast("int"))
    if keep_history:
        state = state.withColumn("history", F.when(active, F.concat("history", F.array("e"))).otherwise(F.col("history")))
    return state.withColumn("final_error", F.when(active, F.col("e")).otherwise(F.col("final_error"))).drop("cs", "e")


def rake(
    cells: DataFrame,
    row_target: DataFrame,
    col_target: DataFrame,
    tol: float = 1e-3,
    max_iter: int = 1000,
    chunk: int = 10,
    colocate: bool = True,
    keep_history: bool = False,
) -> DataFrame:
    """``sample_id, o, d, flow, iterations, final_error, converged [, history]``.

    A row or column without mass keeps factor 1. Never fails to return: samples
    that do not reach ``tol`` come back with ``converged = false``.

    ``colocate`` hashes each sample to one task so that no iteration shuffles;
    turn it off for zone systems whose single table outgrows a task, which are
    raked in factors. ``chunk`` iterations are chained in one plan,
    ``MAX_CHAIN`` at most; the results don't depend on it.
    """
    if not colocate:
        flows, errors = rake_factors(cells, row_target, col_target, tol, max_iter)
        return flows.join(_history(errors), "sample_id", "left") if keep_history else flows
    state = (
        _with_targets(cells, row_target, col_target)
        .withColumn("iterations", F.lit(0))
        .withColumn("final_error", F.lit(float("inf")))
    )
    if keep_history:
        state = state.withColumn("history", F.array().cast("array<double>"))
    finished, done = [], 0
    while done < max_iter:
        steps = min(chunk, MAX_CHAIN, max_iter - done)
        state = state.repartition("sample_id").withColumn("rs", F.sum("flow").over(_row()))
        for _ in range(steps):
            state = _iterate(state, tol, keep_history)
        done += steps
        if done >= max_iter:
            break
        state = materialise(state, "rake")
        finished.append(state.filter(F.col("final_error") < tol))
        state = state.filter(F.col("final_error") >= tol)
        if state.isEmpty():
            break
    for part in finished:
        state = state.unionByName(part)
    out = ["sample_id", "o", "d", "flow", "iterations", "final_error", (F.col("final_error") < tol).alias("converged")]
    return state.select(*out, *(["history"] if keep_history else []))


def _history(errors: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("iteration", "error")))
    return errors.groupBy("sample_id").agg(F.transform(listed, lambda s: s["error"]).alias("history"))


def rake_factors(
    cells: DataFrame, row_target: DataFrame, col_target: DataFrame, tol: float = 1e-3, max_iter: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """The result of ``rake``, and ``sample_id, iteration, error`` of every iteration.

    A raked cell is its seed times a factor of its row and one of its column.
    The seed is written once, with its targets; an iteration is two joins with
    factors, each followed by a sum that starts map-side, and writes one row
    per sample and zone. Errors go to a table of their own, samples within
    ``tol`` leave the loop. Column factors are never stored: they follow from
    the row factors. Seeds and targets are not negative.
    """
    spark = cells.sparkSession
    seed = materialise(_with_targets(cells, row_target, col_target), "seed")
    factor = lambda target, mass: F.when(F.col(mass) > 0, F.col(target) / F.col(mass)).otherwise(0.0)

    def column_factors(a: DataFrame) -> DataFrame:
        mass = seed.join(a, ["sample_id", "o"]).groupBy("sample_id", "d").agg(
            F.sum(F.col("flow") * F.col("a")).alias("mass"), F.first("tc").alias("tc")
        )
        return mass.select("sample_id", "d", "mass", "tc", factor("tc", "mass").alias("b"))

    rows = materialise(
        seed.groupBy("sample_id", "o").agg(F.sum("flow").alias("mass"), F.first("tr").alias("tr"))
        .select("sample_id", "o", "tr", factor("tr", "mass").alias("a")),
        "rows",
    )
    # columns that no row with traffic reaches stay out of reach
    lost = F.max(F.when(F.col("mass") > 0, 0.0).otherwise(F.abs("tc"))).alias("lost")
    unreached = column_factors(rows.select("sample_id", "o", "a")).groupBy("sample_id").agg(lost)
    floor = materialise(
        seed.groupBy("sample_id").agg(F.max("unmet").alias("unmet")).join(unreached, "sample_id", "left")
        .select("sample_id", F.greatest("unmet", "lost").alias("least")),
        "floor",
    )
    factors, errors = scratch_path(spark, "factors"), scratch_path(spark, "errors")
    for iteration in range(1, max_iter + 1):
        b = column_factors(rows.select("sample_id", "o", "a")).select("sample_id", "d", "b")
        mass = seed.join(b, ["sample_id", "d"]).groupBy("sample_id", "o").agg(F.sum(F.col("flow") * F.col("b")).alias("mass"))
        rows = materialise(rows.join(mass, ["sample_id", "o"]), "rows")
        error = rows.groupBy("sample_id").agg(F.max(F.abs(F.col("a") * F.col("mass") - F.col("tr"))).alias("e"))
        error.join(floor, "sample_id").select(
            "sample_id", F.lit(iteration).alias("iteration"), F.greatest("e", "least").alias("error")
        ).write.parquet(f"{errors}/it={iteration}")
        now = spark.read.parquet(f"{errors}/it={iteration}")
        stop = F.lit(iteration == max_iter) | (F.col("error") < tol)
        ended, going = now.agg(F.count_if(stop), F.count_if(~stop)).first()
        if ended or not going:
            left = rows.join(now.filter(stop), "sample_id")
            left.select("sample_id", "o", "a", F.col("iteration").alias("iterations"), F.col("error").alias("final_error")).write.parquet(
                f"{factors}/it={iteration}"
            )
        if not going:
            break
        if ended:
            rows = rows.join(now.filter(~stop).select("sample_id"), "sample_id", "left_semi")
        rows = rows.select("sample_id", "o", "tr", factor("tr", "mass").alias("a"))
    a = spark.read.parquet(factors).drop("it")
    b = column_factors(a.select("sample_id", "o", "a")).select("sample_id", "d", "b")
    flows = seed.join(a, ["sample_id", "o"]).join(b, ["sample_id", "d"]).select(
        "sample_id", "o", "d", (F.col("flow") * F.col("a") * F.col("b")).alias("flow"),
        "iterations", "final_error", (F.col("final_error") < tol).alias("converged"),
    )
    return flows, spark.read.parquet(errors).drop("it")


def raking_summary(raked: DataFrame) -> DataFrame:
    """One row per sample: iterations, final error, convergence."""
    return raked.groupBy("sample_id").agg(
        F.max("iterations").alias("iterations"),
        F.max("final_error").alias("final_error"),
        F.bool_and("converged").alias("converged"),
    )


def raking_history(raked: DataFrame) -> DataFrame:
    """``sample_id, iteration, error`` from a result kept with its history."""
    one = raked.groupBy("sample_id").agg(F.first("history").alias("h"))
    return one.select("sample_id", F.posexplode("h").alias("p", "error")).select(
        "sample_id", (F.col("p") + 1).alias("iteration"), "error"
    )


def _balance(seed: np.ndarray, row_t: np.ndarray, col_t: np.ndarray, tol: float, max_iter: int):
    """Factors of a stack of tables; a table stops changing once it is within ``tol``."""
    count, n, _ = seed.shape
    a, b = np.ones((count, n)), np.ones((count, n))
    iterations, error = np.full(count, max_iter), np.full(count, np.inf)
    live = np.arange(count)
    k, tr, tc, al, bl = seed, row_t, col_t, a.copy(), b.copy()
    kb = np.matmul(k, bl[:, :, None])[:, :, 0]
    for it in range(1, max_iter + 1):
        np.divide(tr, kb, out=al, where=al * kb > 0)
        ka = np.matmul(al[:, None, :], k)[:, 0, :]
        positive = ka * bl > 0
        np.divide(tc, ka, out=bl, where=positive)
        kb = np.matmul(k, bl[:, :, None])[:, :, 0]
        err = np.maximum(np.abs(al * kb - tr).max(axis=1), np.where(positive, 0.0, np.abs(tc)).max(axis=1))
        stop = err < tol
        if it == max_iter:
            stop = np.ones_like(stop)
        if stop.any():
            who = live[stop]
            a[who], b[who], error[who], iterations[who] = al[stop], bl[stop], err[stop], it
            keep = ~stop
            if not keep.any():
                break
            live, k, tr, tc = live[keep], k[keep], tr[keep], tc[keep]
            al, bl, kb = al[keep], bl[keep], kb[keep]
    return a[:, :, None] * seed * b[:, None, :], iterations, error


def rake_vectors(vectors: DataFrame, n_zones: int, tol: float = 1e-3, max_iter: int = 1000) -> DataFrame:
    """Rake ``sample_id, y, row_target, col_target`` (arrays) row by row.

    Returns ``sample_id, y, iterations, final_error, converged``.
    """
    check_vector_size(n_zones * n_zones)

    def run(batch):
        seed = to_matrix(batch.column("y"), n_zones * n_zones).reshape(-1, n_zones, n_zones)
        row_t, col_t = to_matrix(batch.column("row_target"), n_zones), to_matrix(batch.column("col_target"), n_zones)
        flow, iterations, error = _balance(seed, row_t, col_t, tol, max_iter)
        return {
            "sample_id": batch.column("sample_id"),
            "y": to_lists(flow.reshape(len(flow), -1)),
            "iterations": iterations.astype(np.int32),
            "final_error": error,
            "converged": error < tol,
        }

    id_type = dict(vectors.dtypes)["sample_id"]
    schema = f"sample_id {id_type}, y array<double>, iterations int, final_error double, converged boolean"
    return map_batches(vectors.select("sample_id", "y", "row_target", "col_target"), run, schema)
