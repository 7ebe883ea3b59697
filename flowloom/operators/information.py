"""Binned mutual information and the ranking of turns by information."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import join_small, materialise
from .sampling import sample_features


def _codes(rows: DataFrame, feature: str, value: str, n_samples: int, bins: int, offset: int) -> tuple[DataFrame, list, list]:
    """Number the listed features and bin their stored values.

    Returns ``sample_id, code`` with code = offset + place * bins + bin over
    equal-width bins of each feature's own range, the feature ids in place order
    and the bin an absent (zero) entry falls in.
    """
    missing = F.count("*") < n_samples
    span = rows.groupBy(feature).agg(
        F.when(missing, F.least(F.min(value), F.lit(0.0))).otherwise(F.min(value)).alias("lo"),
        F.when(missing, F.greatest(F.max(value), F.lit(0.0))).otherwise(F.max(value)).alias("hi"),
    )
    spread = F.col("hi") - F.col("lo")

    def bin_of(v):
        at = F.least(F.floor((v - F.col("lo")) / spread * F.lit(float(bins))), F.lit(bins - 1))
        return F.when(spread < 1e-12, 0).otherwise(at).cast("int")

    # one row per sampled feature
    known = span.withColumn("zero", bin_of(F.lit(0.0))).orderBy(feature).collect()
    places = [(r[feature], i, r["lo"], r["hi"]) for i, r in enumerate(known)]
    kind = dict(rows.dtypes)[feature]
    table = rows.sparkSession.createDataFrame(places, f"{feature} {kind}, place int, lo double, hi double")
    coded = rows.join(F.broadcast(table), feature).select(
        "sample_id", (F.lit(offset) + F.col("place") * bins + bin_of(F.col(value))).alias("code")
    )
    return coded, [r[feature] for r in known], [r["zero"] for r in known]


def mutual_information(
    x: DataFrame, y: DataFrame, n_samples: int, x_features: DataFrame, y_features: DataFrame, bins: int = 10
) -> DataFrame:
    """``turn_id, od_index, mutual_info`` (nats) for every listed turn and cell.

    Plug-in estimate over equal-width bins. The feature lists are short (the
    operator samples at most 50 of each). Every sample packs its bin codes into
    one row, batches turn them into indicator matrices whose product is the
    joint count table, and only those counts are shuffled.
    """
    xr = join_small(x.select("sample_id", "turn_id", "x"), x_features, "turn_id")
    yr = join_small(y.select("sample_id", "od_index", "flow"), y_features, "od_index")
    xc, x_ids, x_zero = _codes(xr, "turn_id", "x", n_samples, bins, 0)
    nx = len(x_ids)
    yc, y_ids, y_zero = _codes(yr, "od_index", "flow", n_samples, bins, nx * bins)
    ny = len(y_ids)
    packed = xc.unionByName(yc).groupBy("sample_id").agg(F.collect_list("code").alias("codes"))
    default = np.arange(nx + ny) * bins + np.array(x_zero + y_zero)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint, rows = np.zeros((nx * bins, ny * bins)), 0
        for b in batches:
            codes = b.column("codes")
            row = np.repeat(np.arange(b.num_rows), np.diff(codes.offsets.to_numpy()))
            code = codes.flatten().to_numpy()
            held = np.tile(default, (b.num_rows, 1))
            held[row, code // bins] = code
            mark = np.zeros((b.num_rows, (nx + ny) * bins), dtype=np.float32)
            np.put_along_axis(mark, held, 1.0, axis=1)
            joint += mark[:, : nx * bins].T @ mark[:, nx * bins :]
            rows += b.num_rows
        if rows:
            i, j = np.nonzero(joint)
            yield pa.RecordBatch.from_pydict(
                {"i": np.append(i, -1).astype(np.int32), "j": np.append(j, -1).astype(np.int32), "c": np.append(joint[i, j], rows)}
            )

    counted = packed.mapInArrow(run, "i int, j int, c double").groupBy("i", "j").agg(F.sum("c").alias("c"))
    counted = materialise(counted, "joint")
    # samples without any listed entry fall into the zero bins of every pair
    unseen = F.lit(float(n_samples)) - F.coalesce(counted.filter("i < 0").select("c").scalar(), F.lit(0.0))
    zeros = rows_of(x.sparkSession, default[:nx], "i").withColumn(
        "j", F.explode(F.array(*(F.lit(int(c) - nx * bins) for c in default[nx:])))
    ).withColumn("c", unseen)
    joint = counted.filter("i >= 0").unionByName(zeros).groupBy("i", "j").agg(F.sum("c").alias("c")).filter("c > 0")
    place = lambda ids, code: F.element_at(F.array(*(F.lit(v) for v in ids)), (F.floor(code / bins) + 1).cast("int"))
    named = joint.select(
        place(x_ids, F.col("i")).alias("turn_id"), place(y_ids, F.col("j")).alias("od_index"), "i", "j", "c"
    )
    n = F.lit(float(n_samples))
    cx = F.sum("c").over(W.partitionBy("turn_id", "od_index", "i"))
    cy = F.sum("c").over(W.partitionBy("turn_id", "od_index", "j"))
    term = named.withColumn("t", F.col("c") / n * F.log(F.col("c") * n / (cx * cy)))
    return term.groupBy("turn_id", "od_index").agg(F.sum("t").alias("mutual_info"))


def rows_of(spark: SparkSession, values: np.ndarray, name: str) -> DataFrame:
    return spark.createDataFrame([(int(v),) for v in values], f"{name} int")


def sampled_information(x: DataFrame, y: DataFrame, n_samples: int, n_turns: int = 50, n_cells: int = 50, bins: int = 10, seed: int = 42) -> DataFrame:
    xf = sample_features(x, "turn_id", n_turns, seed, "mi.x")
    yf = sample_features(y, "od_index", n_cells, seed, "mi.y")
    return mutual_information(x, y, n_samples, xf, yf, bins)


def rank_turns(x: DataFrame, y: DataFrame, information: DataFrame, turns: DataFrame, n_samples: int, n_cells: int) -> DataFrame:
    """``turn_id, mi_mean, variance, corr_proxy, importance_score`` for all turns.

    The proxy is the absolute correlation of a turn with the mean flow per cell.
    """
    n = F.lit(float(n_samples))
    load = y.groupBy("sample_id").agg((F.sum("flow") / F.lit(float(n_cells))).alias("m"))
    loads = load.agg(F.sum("m").alias("sm"), F.sum(F.col("m") * F.col("m")).alias("smm"))
    per_turn = x.join(load, "sample_id").groupBy("turn_id").agg(
        F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("m")).alias("sxm")
    )
    sm, smm = loads.select("sm").scalar(), loads.select("smm").scalar()
    vx = F.greatest(F.col("sxx") / n - F.pow(F.col("sx") / n, 2), F.lit(0.0))
    vm = F.greatest(smm / n - F.pow(sm / n, 2), F.lit(0.0))
    cov = F.col("sxm") / n - F.col("sx") / n * (sm / n)
    mi = information.groupBy("turn_id").agg(F.avg("mutual_info").alias("mi_mean"))
    zero = F.lit(0.0)
    table = turns.select("turn_id").join(per_turn, "turn_id", "left").join(mi, "turn_id", "left").select(
        "turn_id",
        F.coalesce("mi_mean", zero).alias("mi_mean"),
        F.coalesce(vx, zero).alias("variance"),
        F.coalesce(F.when(F.sqrt(vx) > 1e-9, F.abs(F.try_divide(cov, F.sqrt(vx * vm)))), zero).alias("corr_proxy"),
    )
    top = table.agg(F.max("mi_mean").alias("a"), F.max("variance").alias("b"))
    score = (
        F.col("mi_mean") / (top.select("a").scalar() + 1e-9)
        + F.col("variance") / (top.select("b").scalar() + 1e-9)
        + F.col("corr_proxy")
    ) / 3.0
    return table.withColumn("importance_score", score)


def top_turns(ranked: DataFrame, k: int = 20) -> DataFrame:
    return ranked.orderBy(F.desc("importance_score"), "turn_id").limit(k)
