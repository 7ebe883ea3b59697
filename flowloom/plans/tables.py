"""Scans, sinks, index arithmetic, masks and scalar formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import reshape as R
from ..session import scratch_path
from ..sources import demand, network_xml
from ..sources import fixtures as fx
from . import inputs
from .registry import query


@query("s1_scan_base_od", "SELECT sample_id, o, d, greatest(flow, 0) AS flow FROM raw_demand WHERE o <> d", ["raw_demand"])
def _(spark, sf):
    return demand.clean_demand(fx.raw_demand(spark, sf))


@query("s1_scan_without_clip", "SELECT sample_id, o, d, flow FROM raw_demand WHERE o <> d", ["raw_demand"])
def _(spark, sf):
    path = scratch_path(spark, "raw")
    fx.raw_demand(spark, sf).write.parquet(path)
    return demand.read_base_od(spark, path, clip=False)


@query("s2_scan_od_batch", "SELECT sample_id, o, d, flow FROM od_batch", ["od_batch"])
def _(spark, sf):
    path = scratch_path(spark, "od")
    demand.write_od_batch(fx.od_batch(spark, sf), path)
    return demand.read_od_batch(spark, path)


@query(
    "s2_paired_scan",
    """SELECT c.sample_id, CAST(count(*) AS BIGINT) AS cells FROM od_batch c
    WHERE c.sample_id <= least((SELECT max(sample_id) FROM od_batch), (SELECT max(sample_id) FROM counts)) GROUP BY ALL""",
    ["counts"],
)
def _(spark, sf):
    od, _x = demand.paired(fx.od_batch(spark, sf), inputs.counts(spark, sf))
    return od.groupBy("sample_id").agg(F.count("*").alias("cells"))


def _xml(spark, sf):
    path = scratch_path(spark, "net")
    e = fx.edges(spark, sf)
    network_xml.write_network_xml(fx.junctions(spark, sf), e, fx.connections(e), path)
    return path


@query("s3_network_edges", "SELECT edge_id, from_j, to_j, length, speed, time FROM edges", ["edges"], "time")
def _(spark, sf):
    return network_xml.read_edges(spark, _xml(spark, sf) + "/edge")


@query("s3_network_junctions", "SELECT concat('J', zone) AS id, x, y FROM zones", ["zones"])
def _(spark, sf):
    return network_xml.read_junctions(spark, _xml(spark, sf) + "/junction")


@query("s3_network_connections", "SELECT from_edge, to_edge FROM connections", ["connections"])
def _(spark, sf):
    return network_xml.read_connections(spark, _xml(spark, sf) + "/connection")


@query(
    "s4_edge_weight",
    """SELECT edge_id, 'length' AS metric, length AS weight FROM edges
    UNION ALL SELECT edge_id, 'time', time FROM edges""",
    ["edges"],
    "weight",
)
def _(spark, sf):
    e = fx.edges(spark, sf)
    parts = [e.select("edge_id", F.lit(m).alias("metric"), S.edge_weight(m).alias("weight")) for m in ("length", "time")]
    return parts[0].unionByName(parts[1])


@query("s5_sink_counts", "SELECT sample_id, turn_id, x FROM counts", ["counts"], "x")
def _(spark, sf):
    path = scratch_path(spark, "counts")
    demand.write_od_batch(inputs.counts(spark, sf), path)
    return spark.read.parquet(path)


@query("s6_sink_turn_catalog", "SELECT turn_id, incoming_edge, outgoing_edge, junction FROM turns", ["turns"])
def _(spark, sf):
    path = scratch_path(spark, "turns")
    demand.write_catalog_csv(inputs.turns(spark, sf), path)
    return spark.read.option("header", True).schema(inputs.turns(spark, sf).schema).csv(path)


@query("s7_sink_summary", "SELECT count(*) AS cells, sum(flow) AS total FROM od_batch", ["od_batch"])
def _(spark, sf):
    path = scratch_path(spark, "summary")
    summary = fx.od_batch(spark, sf).agg(F.count("*").alias("cells"), F.sum("flow").alias("total"))
    demand.write_summary_json(summary, path)
    return spark.read.schema(summary.schema).json(path)


@query(
    "r1_od_pair_index",
    "SELECT p.od_index, p.o, p.d, coalesce(b.flow, 0) AS base_flow FROM pairs p LEFT JOIN base_od b USING (o, d)",
    ["pairs", "base_od"],
)
def _(spark, sf):
    base = fx.base_od(spark, sf).withColumnRenamed("flow", "base_flow")
    return inputs.pairs(spark, sf).join(base, ["o", "d"], "left").fillna(0.0, ["base_flow"])


@query(
    "r2_flatten",
    """SELECT sample_id, CAST(625 AS INT) AS entries, sum(flow) AS total, sum(flow * (od_index + 1)) AS weighted
    FROM dense GROUP BY ALL""",
    ["dense"],
)
def _(spark, sf):
    y = R.flatten(fx.od_batch(spark, sf), inputs.n_zones(spark, sf))
    total = F.aggregate("y", F.lit(0.0), lambda a, v: a + v)
    weighted = F.aggregate(F.transform("y", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return y.select("sample_id", F.size("y").alias("entries"), total.alias("total"), weighted.alias("weighted"))


@query("r3_unflatten", "SELECT sample_id, o, d, flow FROM dense", ["dense"])
def _(spark, sf):
    n = inputs.n_zones(spark, sf)
    return R.unflatten(R.flatten(fx.od_batch(spark, sf), n), n)


@query("r4_densify", "SELECT sample_id, o, d, flow FROM dense", ["dense"])
def _(spark, sf):
    return R.densify(fx.od_batch(spark, sf), inputs.n_zones(spark, sf))


@query("r4_sparsify", "SELECT sample_id, o, d, flow FROM dense WHERE flow <> 0", ["dense"])
def _(spark, sf):
    return R.sparsify(R.densify(fx.od_batch(spark, sf), inputs.n_zones(spark, sf)))


@query("r5_transpose", "SELECT sample_id, d AS o, o AS d, flow FROM od_batch", ["od_batch"])
def _(spark, sf):
    return R.transpose(fx.od_batch(spark, sf))


@query("e1_off_diagonal_support", "SELECT sample_id, o, d, flow FROM raw_demand WHERE o <> d", ["raw_demand"])
def _(spark, sf):
    return R.off_diagonal(fx.raw_demand(spark, sf))


@query(
    "e2_sparsity_mask",
    """SELECT r.sample_id, r.o, r.d, r.flow FROM raw_demand r
    WHERE EXISTS (SELECT 1 FROM od_batch s WHERE s.o = r.d AND s.d = r.o)""",
    ["raw_demand", "od_batch"],
)
def _(spark, sf):
    support = R.transpose(fx.base_od(spark, sf))
    return R.mask_to_support(fx.raw_demand(spark, sf), support)


@query(
    "e3_zero_diagonal",
    "SELECT sample_id, o, d, CASE WHEN o <> d THEN flow ELSE 0 END AS flow FROM raw_demand",
    ["raw_demand"],
)
def _(spark, sf):
    return R.zero_diagonal(fx.raw_demand(spark, sf))


@query(
    "e4_distance_decay",
    """SELECT b.o, b.d, b.flow * exp(-dist / 500) AS exponential, b.flow * pow(dist + 1, -1.5) AS power
    FROM base_od b JOIN dist USING (o, d)""",
    ["base_od", "dist"],
    "exponential power",
)
def _(spark, sf):
    from ..operators.spatial import distances

    dist = distances(fx.zones(spark, sf), inputs.n_zones(spark, sf))
    return fx.base_od(spark, sf).join(dist, ["o", "d"]).select(
        "o",
        "d",
        (F.col("flow") * S.off_diagonal(S.distance_impedance(F.col("dist")))).alias("exponential"),
        (F.col("flow") * S.off_diagonal(S.distance_impedance(F.col("dist"), "power"))).alias("power"),
    )


@query(
    "e5_noise_scale",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity - 10 <= 0 THEN 1 ELSE greatest(0.5::DOUBLE, 1 - (l_quantity - 10) / 100) END AS scale
    FROM lineitem""",
    (),
    "scale",
)
def _(spark, sf):
    pct = F.col("l_quantity") - 10.0
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.noise_scale(pct).alias("scale"))


@query(
    "e6_softplus",
    """SELECT sample_id, o, d, CASE WHEN flow / 10 > 20 THEN flow / 10 ELSE ln(1 + exp(greatest(flow / 10, -20))) END AS y
    FROM raw_demand""",
    ["raw_demand"],
    "y",
)
def _(spark, sf):
    return fx.raw_demand(spark, sf).select("sample_id", "o", "d", S.softplus(F.col("flow") / 10.0).alias("y"))


@query(
    "e7_guarded_correlation",
    """SELECT sample_id, CASE WHEN stddev_pop(flow) >= 1e-12 AND stddev_pop(back) >= 1e-12 THEN corr(flow, back) END AS r
    FROM (SELECT a.sample_id, a.flow, b.flow AS back FROM dense a JOIN dense b
    ON a.sample_id = b.sample_id AND a.o = b.d AND a.d = b.o) GROUP BY ALL""",
    ["dense"],
    "r",
)
def _(spark, sf):
    cells = R.densify(fx.od_batch(spark, sf), inputs.n_zones(spark, sf))
    back = R.transpose(cells).withColumnRenamed("flow", "back")
    return cells.join(back, ["sample_id", "o", "d"]).groupBy("sample_id").agg(
        S.guarded_corr(F.col("flow"), F.col("back")).alias("r")
    )
