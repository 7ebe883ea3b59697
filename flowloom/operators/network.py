"""Turning movements, shortest paths, k shortest simple paths, logit shares.

Path searches are frontier loops: each round extends the open partial paths by
one edge-table join and writes the result, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import edge_weight
from ..session import materialise
from ..sources.network_xml import routable_edges
from .sampling import row_numbers


def allowed_turns(edges: DataFrame, connections: DataFrame) -> DataFrame:
    """``incoming_edge, outgoing_edge, junction``: edges that meet at a junction
    and are listed as a connection. Starts from the connection list, so the full
    incoming-by-outgoing product of a busy junction is never built."""
    inc = edges.select(F.col("edge_id").alias("from_edge"), F.col("to_j").alias("junction"))
    out = edges.select(F.col("edge_id").alias("to_edge"), F.col("from_j").alias("junction"))
    return (
        connections.filter(F.col("from_edge") != F.col("to_edge"))
        .distinct()
        .join(inc, "from_edge")
        .join(out, ["to_edge", "junction"])
        .select(F.col("from_edge").alias("incoming_edge"), F.col("to_edge").alias("outgoing_edge"), "junction")
    )


def turning_movements(edges: DataFrame, connections: DataFrame) -> DataFrame:
    """``turn_id`` from 0 in string order of junction, incoming, outgoing edge."""
    order = ["junction", "incoming_edge", "outgoing_edge"]
    ranked = row_numbers(allowed_turns(edges, connections), order, "n")
    return ranked.select((F.col("n") - 1).cast("int").alias("turn_id"), "incoming_edge", "outgoing_edge", "junction")


def _links(edges: DataFrame, metric: str) -> DataFrame:
    return routable_edges(edges).select(
        F.col("from_j").alias("node"), F.col("to_j").alias("next"), "edge_id", edge_weight(metric).alias("w")
    )


#: Hops of a search that one job takes before it writes.
HOPS = 4


def cheapest_costs(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, node, cost``: cost of the cheapest way from each node to each root, for nodes that reach it.

    ``roots(root, node)``. A hop extends the labels that improved in the hop before; a label is one number, and labels
    are written every ``HOPS`` hops. A label and its extensions come from one row, so a hop reads the labels once and the
    plan of ``HOPS`` hops is a chain.
    """
    back = links.groupBy(F.col("next").alias("node")).agg(F.collect_list(F.struct(F.col("node").alias("from"), "w")).alias("ways"))
    none = F.array().cast("array<struct<from:string,w:double>>")
    labels = roots.select("root", "node", F.lit(0.0).alias("cost"), F.lit(True).alias("fresh"))
    while True:
        for _ in range(HOPS):
            own = F.array(F.struct("node", "cost", F.lit(False).alias("fresh")))
            onward = F.when(F.col("fresh"), F.coalesce("ways", none)).otherwise(none)
            grown = F.transform(onward, lambda e: F.struct(e["from"].alias("node"), (e["w"] + F.col("cost")).alias("cost"), F.lit(True).alias("fresh")))
            spread = labels.join(back, "node", "left").select("root", F.explode(F.concat(own, grown)).alias("e")).select("root", "e.*")
            best = spread.groupBy("root", "node").agg(F.min(F.struct("cost", "fresh")).alias("b"))
            labels = best.select("root", "node", "b.*")
        labels = materialise(labels, "costs")
        if labels.filter("fresh").isEmpty():
            return labels.drop("fresh")


def cheapest_paths(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, node, cost, nodes, edges``: the cheapest way from each node to each root, arrays from the node on.

    Of equally cheap ways the one with the smaller node list. Each node first gets its next node, which is the smallest
    on a cheapest way; then paths grow by the path of their last node, so their length doubles with each join. Weights
    must be positive.
    """
    if not links.filter("w <= 0 OR w IS NULL").isEmpty():
        raise ValueError("edge weights must be positive")
    costs = cheapest_costs(links, roots)
    onward = costs.select("root", F.col("node").alias("next"), F.col("cost").alias("rest"))
    steps = costs.join(links, "node").join(onward, ["root", "next"]).filter(F.col("cost") == F.col("w") + F.col("rest"))
    steps = steps.groupBy("root", "node").agg(F.min(F.struct("next", "edge_id")).alias("s"))
    at_root = roots.select("root", "node", F.array("node").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.lit(True).alias("done"))
    first = steps.join(roots, ["root", "node"], "left_anti").select(
        "root", "node", F.array("node", "s.next").alias("nodes"), F.array("s.edge_id").alias("edges"), F.lit(False).alias("done")
    )
    paths = materialise(at_root.unionByName(first), "steps")
    while not paths.filter("NOT done").isEmpty():
        # One doubling a job: paths meet themselves, so the plan of n doublings would have 2 ** n scans.
        tail = paths.select("root", F.col("node").alias("end"), F.col("nodes").alias("more"), F.col("edges").alias("more_edges"), F.col("done").alias("there"))
        longer = paths.withColumn("end", F.element_at("nodes", -1)).join(tail, ["root", "end"]).select(
            "root",
            "node",
            F.concat("nodes", F.slice("more", F.lit(2), F.size("more"))).alias("nodes"),
            F.concat("edges", "more_edges").alias("edges"),
            (F.col("done") | F.col("there")).alias("done"),
        )
        paths = materialise(longer, "paths")
    return costs.join(paths.drop("done"), ["root", "node"])


def _zone_nodes(pairs: DataFrame, column: str) -> DataFrame:
    return pairs.select(F.col(column).alias("root")).distinct().withColumn("node", F.concat(F.lit("J"), "root"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, metric: str = "length") -> DataFrame:
    """``o, d, nodes, edges, cost`` for ``pairs(o, d)``.

    A diagonal pair gets empty arrays and cost 0; an unreachable one NULL cost
    and empty arrays.
    """
    labels = cheapest_paths(materialise(_links(edges, metric), "links"), _zone_nodes(pairs, "d"))
    found = labels.select(F.col("root").alias("d"), F.col("node").alias("start"), "cost", "nodes", "edges")
    same = F.col("o") == F.col("d")
    empty = F.array().cast("array<string>")
    return (
        pairs.select("o", "d", F.concat(F.lit("J"), "o").alias("start"))
        .join(found, ["d", "start"], "left")
        .select(
            "o",
            "d",
            F.when(same | F.col("nodes").isNull(), empty).otherwise(F.col("nodes")).alias("nodes"),
            F.when(same | F.col("edges").isNull(), empty).otherwise(F.col("edges")).alias("edges"),
            F.when(same, 0.0).otherwise(F.col("cost")).alias("cost"),
        )
    )


def path_turns(routes: DataFrame, keys: list) -> DataFrame:
    """Consecutive edge pairs of each route: keys, ``step, incoming_edge, outgoing_edge``."""
    steps = F.zip_with(
        F.slice("edges", F.lit(1), F.greatest(F.size("edges") - 1, F.lit(0))),
        F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("incoming_edge"), b.alias("outgoing_edge")),
    )
    return routes.select(*keys, F.posexplode(steps).alias("step", "turn")).select(
        *keys, "step", "turn.incoming_edge", "turn.outgoing_edge"
    )


def _paths_within(links: DataFrame, to_go: DataFrame, budgets: DataFrame) -> DataFrame:
    """All simple paths of each pair that cost no more than its budget.

    ``to_go(d, node, rest)`` is the cheapest completion, so a partial path is
    dropped exactly when no completion can stay within the budget. A step turns
    each open path into its extensions and lets complete ones through; every
    ``HOPS`` steps the paths are written, and only the last writing is read again.
    """
    ways = links.groupBy("node").agg(F.collect_list(F.struct("next", "edge_id", "w")).alias("ways"))
    state = budgets.select(
        "o",
        "d",
        "budget",
        F.concat(F.lit("J"), "o").alias("node"),
        F.lit(0.0).alias("cost"),
        F.array(F.concat(F.lit("J"), "o")).alias("nodes"),
        F.array().cast("array<string>").alias("edges"),
    )
    done = F.col("node") == F.concat(F.lit("J"), "d")
    while True:
        for _ in range(HOPS):
            onward = F.filter(F.coalesce("ways", F.array().cast("array<struct<next:string,edge_id:string,w:double>>")), lambda e: ~F.array_contains("nodes", e["next"]))
            stay = F.array(F.struct(F.col("node").alias("next"), F.lit(None).cast("string").alias("edge_id"), F.lit(0.0).alias("w")))
            state = (
                state.join(ways, "node", "left")
                .withColumn("e", F.explode(F.when(done, stay).otherwise(onward)))
                .select(
                    "o",
                    "d",
                    "budget",
                    F.col("e.next").alias("node"),
                    (F.col("cost") + F.col("e.w")).alias("cost"),
                    F.when(F.col("e.edge_id").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array("e.next"))).alias("nodes"),
                    F.when(F.col("e.edge_id").isNull(), F.col("edges")).otherwise(F.concat("edges", F.array("e.edge_id"))).alias("edges"),
                )
                .join(to_go, ["d", "node"])
                .filter(F.col("cost") + F.col("rest") <= F.col("budget") * (1 + 1e-12) + 1e-9)
                .drop("rest")
            )
        state = materialise(state, "paths")
        if state.filter(~done).isEmpty():
            return state.select("o", "d", "nodes", "edges", "cost")


def _kth_bounds(links: DataFrame, labels: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``o, d, bound``: an upper bound on the k-th cheapest simple path, NULL where one deviation gives fewer paths.

    ``labels(d, node, rest, path)`` holds the cheapest way from each node to d. A path that leaves the cheapest one at
    some node and goes on by the cheapest way is simple if the two parts share no node, and two such paths differ, so
    the k-th cheapest of them bounds the k-th cheapest of all.
    """
    own = labels.select("d", F.col("node").alias("start"), "rest", "path")
    best = wanted.withColumn("start", F.concat(F.lit("J"), "o")).join(own, ["d", "start"])
    spur = best.select("o", "d", "rest", "path", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("i", "spur"))
    before = F.slice("path", F.lit(1), F.col("i") + 1)
    at_spur = labels.select("d", F.col("node").alias("spur"), F.col("rest").alias("rest_spur"))
    after = labels.select("d", F.col("node").alias("next"), F.col("rest").alias("rest_next"), F.col("path").alias("path_next"))
    deviations = (
        spur.join(links.withColumnRenamed("node", "spur"), "spur")
        .filter((F.col("next") != F.element_at("path", F.col("i") + 2)) & ~F.array_contains(before, F.col("next")))
        .join(at_spur, ["d", "spur"])
        .join(after, ["d", "next"])
        .filter(~F.arrays_overlap(before, "path_next"))
        .select("o", "d", (F.col("rest") - F.col("rest_spur") + F.col("w") + F.col("rest_next")).alias("cost"))
    )
    costs = deviations.unionByName(best.select("o", "d", F.col("rest").alias("cost")))
    return costs.groupBy("o", "d").agg(F.try_element_at(F.array_sort(F.collect_list("cost")), F.lit(k)).alias("bound"))


def k_shortest_paths(
    edges: DataFrame, pairs: DataFrame, k: int = 5, metric: str = "length", path_limit: int | None = None
) -> DataFrame:
    """``o, d, rank, nodes, edges, cost``: up to k (and at most ``path_limit``) loop-free
    paths per off-diagonal pair in cost order, ties by node list.

    Enumerates every simple path under a per-pair budget. The budget is a bound
    on the k-th cost from paths with one deviation; pairs with too few of those
    get an allowance, doubled until they have k paths or it exceeds the whole
    network, so the result is exact.
    """
    k = k if path_limit is None else min(k, path_limit)
    links = materialise(_links(edges, metric), "links")
    limits = links.agg(F.avg("w").alias("mean"), F.sum("w").alias("all")).first()
    wanted = pairs.select("o", "d").filter(F.col("o") != F.col("d")).distinct()
    labels = cheapest_paths(links, _zone_nodes(wanted, "d"))
    labels = materialise(labels.select(F.col("root").alias("d"), "node", F.col("cost").alias("rest"), F.col("nodes").alias("path")), "togo")
    to_go = labels.drop("path")
    start = to_go.withColumn("o", F.expr("try_cast(substring(node, 2) AS int)")).select("o", "d", "rest")
    bounds = _kth_bounds(links, labels, wanted, k)
    todo = materialise(wanted.join(start, ["o", "d"]).join(bounds, ["o", "d"], "left"), "budgets")
    slack, kept = 3.5 * limits["mean"], []
    order = W.partitionBy("o", "d").orderBy("cost", "nodes")
    while True:
        budget = F.coalesce("bound", F.col("rest") + F.lit(slack))
        found = _paths_within(links, to_go, todo.withColumn("budget", budget))
        ranked = materialise(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "routes")
        if slack > limits["all"]:
            kept.append(ranked)
            break
        full = ranked.filter(F.col("rank") == k).select("o", "d")
        kept.append(ranked.join(full, ["o", "d"], "left_semi"))
        left = todo.join(full, ["o", "d"], "left_anti").withColumn("bound", F.lit(None).cast("double"))
        todo = materialise(left, "budgets")
        if todo.isEmpty():
            break
        slack *= 2.0
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out.select("o", "d", "rank", "nodes", "edges", "cost")


def catalog_stats(routes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Total routes, off-diagonal pairs without a route, mean routes per pair
    (diagonal pairs count in the mean)."""
    per_pair = routes.groupBy("o", "d").agg(F.count("*").alias("n"))
    joined = pairs.select("o", "d").join(per_pair, ["o", "d"], "left")
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_routes"),
        F.count_if(F.col("n").isNull() & (F.col("o") != F.col("d"))).alias("unreachable_pairs"),
        (F.coalesce(F.sum("n"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("mean_routes_per_od"),
    )


def logit_shares(routes: DataFrame, theta: float = 0.1, keys: tuple = ("o", "d")) -> DataFrame:
    """Add ``utility`` (shifted by the pair's maximum) and ``probability``."""
    if theta <= 0:
        raise ValueError("theta must be positive")
    w = W.partitionBy(*keys)
    utility = F.lit(-float(theta)) * F.col("cost")
    shifted = routes.withColumn("u0", utility).withColumn("utility", F.col("u0") - F.max("u0").over(w)).drop("u0")
    weight = F.exp("utility")
    return shifted.withColumn("probability", weight / F.sum(weight).over(w))


def route_probabilities(shares: DataFrame) -> DataFrame:
    return shares.select("probability")
