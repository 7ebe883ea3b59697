"""Realism filters and diversity selection of candidate tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import corr_from_sums
from ..session import join_small, materialise, scratch_path
from .metrics import base_sums, beside_base
from .reshape import od_index
from .sampling import row_numbers
from .stats import pair_distances
from .vectors import to_matrix

#: Entries of the vectors that a tile of tables holds (8 bytes each).
TILE = 1 << 18


@dataclass(frozen=True)
class QualityConfig:
    """Thresholds of the filters; the defaults are fixed values."""

    oversample_factor: float = 10.0
    min_sparsity: float = 0.0
    max_sparsity: float = 0.95
    min_correlation: float = 0.30
    max_correlation: float = 0.95
    max_trip_length_rel_error: float = 0.35
    min_distance: float = 0.0  # 0: derived from the median pair distance
    auto_fraction: float = 0.35
    entropy_bins: int = 20
    require_zero_diagonal: bool = True
    max_diagonal_mass: float = 1e-6


def filter_features(cells: DataFrame, base: DataFrame, dist: DataFrame, n_zones: int) -> DataFrame:
    """``sample_id, diagonal, sparsity, correlation, trip_length`` in one group-by.

    Sparsity and correlation run over all cells, the diagonal included.
    """
    n = F.lit(float(n_zones * n_zones))
    b1, b2 = base_sums(base)
    pair = join_small(beside_base(cells, base), dist, ["o", "d"])
    s, b = F.col("s"), F.col("b")
    mass = F.sum("s")
    return pair.groupBy("sample_id").agg(
        F.sum(F.when(F.col("o") == F.col("d"), s).otherwise(0.0)).alias("diagonal"),
        (1.0 - F.count_if(s > 1e-12) / n).alias("sparsity"),
        corr_from_sums(n, mass, b1, F.sum(s * s), b2, F.sum(s * b), 1e-12).alias("correlation"),
        F.when(mass > 0, F.try_divide(F.sum(s * F.col("dist")), mass)).alias("trip_length"),
    )


def base_trip_length(base: DataFrame, dist: DataFrame) -> DataFrame:
    joined = join_small(base, dist, ["o", "d"])
    return joined.agg(F.try_divide(F.sum(F.col("flow") * F.col("dist")), F.sum("flow")).alias("trip_length"))


def filter_reasons(features: DataFrame, base_length: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Add ``reason``: the first failed filter, or ``ok``. Undefined values fail."""
    length = base_length.scalar()
    off = F.abs(F.col("trip_length") - length) / length
    fine = lambda cond: F.coalesce(cond, F.lit(False))
    diagonal_ok = fine(F.col("diagonal") <= config.max_diagonal_mass) if config.require_zero_diagonal else F.lit(True)
    reason = (
        F.when(~diagonal_ok, "diagonal")
        .when(~fine(F.col("sparsity").between(config.min_sparsity, config.max_sparsity)), "sparsity")
        .when(~fine(F.col("correlation").between(config.min_correlation, config.max_correlation)), "correlation")
        .when(~fine((length > 0) & (off <= config.max_trip_length_rel_error)), "trip_length")
        .otherwise("ok")
    )
    return features.withColumn("reason", reason)


def reason_counts(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


def auto_threshold(cells: DataFrame, n_zones: int, fraction: float = 0.35, n_pairs: int = 2_000, seed: int = 42) -> DataFrame:
    """One row: a fraction of the median distance of drawn pairs, 0 without pairs."""
    d = pair_distances(cells, od_index(n_zones), n_zones * n_zones, "flow", n_pairs, seed, "euclid")
    return d.agg(F.coalesce(F.lit(float(fraction)) * F.median("distance"), F.lit(0.0)).alias("threshold"))


def diversity_scores(cells: DataFrame, n_samples: int, n_zones: int) -> DataFrame:
    """``sample_id, score, rank``: mean absolute deviation from the cell means.

    A sample starts from the sum of all means (what its absent cells deviate by)
    and every stored cell corrects that sum, so nothing is densified.
    """
    mean = cells.groupBy("o", "d").agg((F.sum("flow") / F.lit(float(n_samples))).alias("m"))
    everything = mean.agg(F.sum("m")).scalar()
    joined = join_small(cells, mean, ["o", "d"])
    change = F.sum(F.abs(F.col("flow") - F.col("m")) - F.col("m"))
    scores = joined.groupBy("sample_id").agg(change.alias("change")).select(
        "sample_id", ((everything + F.col("change")) / F.lit(float(n_zones * n_zones))).alias("score")
    )
    return row_numbers(scores, [F.round("score", 9).desc(), F.col("sample_id")], "rank")


def _near(left: DataFrame, n_left: int, right: DataFrame, n_right: int, tau: float, width: int) -> DataFrame:
    """``later, earlier``: ranks of all pairs of a ``left`` table and an earlier ``right`` one closer than ``tau``.

    Both sides ``(rank, y)`` are dealt into tiles of a bounded number of entries, and each pair of tiles is one group,
    so the vectors go from task to task and only ranks come out. Distances are by exact differences.
    """

    def tiles(n: int) -> int:
        return max(1, -(-n * width // TILE))

    here = left.select("rank", "y", F.pmod("rank", F.lit(tiles(n_left))).cast("int").alias("lt"))
    here = here.withColumn("rt", F.explode(F.sequence(F.lit(0), F.lit(tiles(n_right) - 1))))
    there = right.select("rank", "y", F.pmod("rank", F.lit(tiles(n_right))).cast("int").alias("rt"))
    there = there.withColumn("lt", F.explode(F.sequence(F.lit(0), F.lit(tiles(n_left) - 1))))

    def compare(mine: pa.Table, others: pa.Table) -> pa.Table:
        later, earlier = [], []
        if mine.num_rows and others.num_rows:
            ranks = others["rank"].to_numpy()
            table = to_matrix(others["y"].combine_chunks(), width)
            for rank, v in zip(mine["rank"].to_numpy(), to_matrix(mine["y"].combine_chunks(), width), strict=True):
                before = ranks < rank
                hit = ranks[before][np.sqrt(((table[before] - v) ** 2).sum(axis=1)) < tau]
                later.append(np.full(len(hit), rank)), earlier.append(hit)
        none = np.zeros(0, np.int64)
        return pa.table({"later": np.concatenate([none, *later]), "earlier": np.concatenate([none, *earlier])})

    return here.groupBy("lt", "rt").cogroup(there.groupBy("lt", "rt")).applyInArrow(compare, "later bigint, earlier bigint")


def survivors(cells: DataFrame, reasons: DataFrame) -> DataFrame:
    """Cells of the tables that pass all filters."""
    return cells.join(reasons.filter("reason = 'ok'").select("sample_id"), "sample_id", "left_semi")


def select_diverse(
    ranked: DataFrame, n_zones: int, target: int, tau: float, block: int = 512, window: int | None = 256
) -> DataFrame:
    """Walk the ranking and accept a table when it is at least ``tau`` away from
    the last ``window`` tables accepted before (None: from all of them); stop at
    ``target``.

    ``ranked(sample_id, rank, y)`` with ranks from 1. Returns ``sample_id, rank,
    accepted, blocked_by`` (best accepted rank in conflict) for all tables looked
    at. Blocks of ``block`` ranks are taken in turn: the block's tables are
    compared with the accepted ones and among themselves in tiles, and the walk
    through the block sees pairs of ranks, at most ``block`` times ``block`` and
    ``window`` of them (without a window, one per refused table and those within
    the block). Ranks after the target is reached are never compared.
    """
    spark, width = ranked.sparkSession, n_zones * n_zones
    stored = materialise(ranked.select("sample_id", F.col("rank").cast("bigint"), "y"), "ranked")
    if tau <= 1e-6:
        nothing = F.lit(None).cast("bigint").alias("blocked_by")
        return stored.filter(F.col("rank") <= target).select("sample_id", "rank", F.lit(True).alias("accepted"), nothing)
    accepted_at, decided_at = scratch_path(spark, "accepted"), scratch_path(spark, "decided")
    last = stored.agg(F.max("rank")).first()[0] or 0
    start = 1
    taken: list[int] = []  # accepted ranks; with a window only its last ones are looked at
    while start <= last and len(taken) < target:
        stop_at = min(start + block - 1, last)
        here = stored.filter(F.col("rank").between(start, stop_at))
        size = stop_at - start + 1
        near: dict[int, list[int]] = {}
        blocked_by: dict[int, int] = {}
        compared, n_compared = here, size
        if taken:
            accepted = spark.read.schema(stored.schema).parquet(accepted_at)
            if window is None:
                hits = _near(here, size, accepted, len(taken), tau, width).groupBy("later").agg(F.min("earlier").alias("earlier"))
                blocked_by = {h["later"]: h["earlier"] for h in hits.collect()}
                open_ = [r for r in range(start, stop_at + 1) if r not in blocked_by]
                compared, n_compared = here.filter(F.col("rank").isin(open_)), len(open_)
            else:
                recent = taken[-window:]
                compared = accepted.filter(F.col("rank").isin(recent)).unionByName(here)
                n_compared += len(recent)
        if n_compared:
            for h in _near(here, size, compared, n_compared, tau, width).collect():
                near.setdefault(h["later"], []).append(h["earlier"])
        chosen: list[int] = []
        for rank in range(start, stop_at + 1):
            if rank in blocked_by:
                continue
            counts = set(chosen if window is None else taken[-window:])
            in_way = [e for e in near.get(rank, []) if e in counts]
            if in_way:
                blocked_by[rank] = min(in_way)
                continue
            chosen.append(rank)
            taken.append(rank)
            if len(taken) == target:
                stop_at = rank
                break
        if chosen:
            here.filter(F.col("rank").isin(chosen)).write.mode("append").parquet(accepted_at)
        verdict = [(r, r not in blocked_by, blocked_by.get(r)) for r in range(start, stop_at + 1)]
        table = spark.createDataFrame(verdict, "rank bigint, accepted boolean, blocked_by bigint")
        here.select("sample_id", "rank").join(F.broadcast(table), "rank").select(
            "sample_id", "rank", "accepted", "blocked_by"
        ).write.mode("append").parquet(decided_at)
        start += block
    schema = f"sample_id {dict(stored.dtypes)['sample_id']}, rank bigint, accepted boolean, blocked_by bigint"
    return spark.read.schema(schema).parquet(decided_at) if last else spark.createDataFrame([], schema)


def cell_entropy(cells: DataFrame, n_samples: int, bins: int = 20, pairs: DataFrame | None = None) -> DataFrame:
    """``o, d, entropy`` in nats over equal-width bins of each cell's own range, for the cells of ``pairs`` (by default:
    those that occur; one without flow has entropy 0).

    Absent entries are zeros: they widen the range and fill the bin of zero, as
    one weighted row per cell.
    """
    missing = F.lit(n_samples) - F.count("*")
    zero_in = missing > 0
    span = cells.groupBy("o", "d").agg(
        F.when(zero_in, F.least(F.min("flow"), F.lit(0.0))).otherwise(F.min("flow")).alias("lo"),
        F.when(zero_in, F.greatest(F.max("flow"), F.lit(0.0))).otherwise(F.max("flow")).alias("hi"),
        missing.alias("missing"),
    )
    weighted = cells.select("o", "d", "flow", F.lit(1).cast("long").alias("w")).unionByName(
        span.filter("missing > 0").select("o", "d", F.lit(0.0).alias("flow"), F.col("missing").cast("long").alias("w"))
    )
    joined = join_small(weighted, span.select("o", "d", "lo", "hi"), ["o", "d"])
    spread = F.col("hi") - F.col("lo")
    position = F.floor((F.col("flow") - F.col("lo")) / spread * F.lit(float(bins)))
    at = F.when(spread < 1e-12, F.lit(0)).otherwise(F.least(position, F.lit(bins - 1)))
    counted = joined.groupBy("o", "d", F.when(spread < 1e-12, 0).otherwise(at).alias("bin")).agg(F.sum("w").alias("c"))
    p = F.col("c") / F.lit(float(n_samples))
    found = counted.groupBy("o", "d").agg((-F.sum(p * F.log(p))).alias("entropy"))
    return found if pairs is None else pairs.select("o", "d").join(found, ["o", "d"], "left").fillna({"entropy": 0.0})


def filter_stats(reasons: DataFrame, decisions: DataFrame, selected: DataFrame, n_zones: int, target: int, bins: int = 20, n_pairs: int = 5_000, seed: int = 42) -> DataFrame:
    """One row: how many candidates each filter turned away, and how diverse the
    accepted set is.

    ``decisions`` comes from ``select_diverse``; ``selected`` holds the accepted cells.
    """
    n = decisions.filter("accepted").count()
    d = pair_distances(selected, od_index(n_zones), n_zones * n_zones, "flow", n_pairs, seed, "euclid").agg(
        F.avg("distance").alias("mean_d"), F.min("distance").alias("min_d")
    )
    size = F.lit(float(n))
    mean = F.sum("flow") / size
    std = F.sqrt(F.greatest(F.sum(F.col("flow") * F.col("flow")) / size - mean * mean, F.lit(0.0)))
    cv = selected.groupBy("o", "d").agg((std / (mean + 1e-9)).alias("cv")).agg(F.sum("cv") / F.lit(float(n_zones * n_zones)))
    entropy = cell_entropy(selected.filter(F.col("o") != F.col("d")), n, bins).agg(
        F.sum("entropy") / F.lit(float(n_zones * (n_zones - 1)))
    )
    rejected = lambda r: F.count_if(F.col("reason") == r).alias(f"n_rejected_{r}")
    return reasons.agg(
        F.count("*").alias("n_candidates"),
        *(rejected(r) for r in ("diagonal", "sparsity", "correlation", "trip_length")),
    ).select(
        "*",
        decisions.agg(F.count_if(~F.col("accepted"))).scalar().alias("n_rejected_pairwise"),
        F.lit(n).alias("n_accepted"),
        F.lit(max(target - n, 0)).alias("n_rejected_pool_exhausted"),
        d.select("mean_d").scalar().alias("mean_pairwise_frobenius"),
        d.select("min_d").scalar().alias("min_pairwise_frobenius"),
        cv.scalar().alias("mean_cell_cv"),
        entropy.scalar().alias("mean_cell_entropy"),
    )
