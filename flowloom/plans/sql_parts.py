"""SQL building blocks shared by the query twins (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Iterable

SURVEY = 24
THETA = 0.01
K_PATHS = 5

#: name -> (names it builds on, CTE text)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "zones": (
        (),
        """zones AS (SELECT n_nationkey + 1 AS zone, CAST(250 * (n_nationkey % 5) AS DOUBLE) AS x,
        CAST(250 * floor(n_nationkey / 5) AS DOUBLE) AS y FROM nation)""",
    ),
    "pairs": (
        ("zones",),
        """pairs AS (SELECT a.zone AS o, b.zone AS d, CAST((a.zone - 1) * 25 + b.zone - 1 AS INT) AS od_index
        FROM zones a CROSS JOIN zones b)""",
    ),
    "dist": (
        ("zones",),
        """dist AS (SELECT a.zone AS o, b.zone AS d,
        sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM zones a CROSS JOIN zones b)""",
    ),
    "shipments": (
        (),
        """shipments AS (SELECT CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INT) AS sample_id,
        s_nationkey + 1 AS o, c_nationkey + 1 AS d, l_quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey)""",
    ),
    "raw_demand": (
        ("shipments",),
        """raw_demand AS (SELECT sample_id, o, d, sum(l_quantity - 25) AS flow FROM shipments GROUP BY ALL)""",
    ),
    "od_batch": (
        ("shipments",),
        """od_batch AS (SELECT sample_id, o, d, sum(l_quantity) AS flow FROM shipments WHERE o <> d GROUP BY ALL)""",
    ),
    "base_od": (("od_batch",), "base_od AS (SELECT o, d, sum(flow) AS flow FROM od_batch GROUP BY ALL)"),
    "samples": (("od_batch",), "samples AS (SELECT DISTINCT sample_id FROM od_batch)"),
    "dense": (
        ("samples", "pairs"),
        """dense AS (SELECT s.sample_id, p.o, p.d, p.od_index, coalesce(f.flow, 0) AS flow
        FROM samples s CROSS JOIN pairs p LEFT JOIN od_batch f
        ON f.sample_id = s.sample_id AND f.o = p.o AND f.d = p.d)""",
    ),
    "dense_base": (
        ("base_od", "pairs"),
        """dense_base AS (SELECT p.o, p.d, p.od_index, coalesce(b.flow, 0) AS flow
        FROM pairs p LEFT JOIN base_od b ON b.o = p.o AND b.d = p.d)""",
    ),
    "edges": (
        ("zones",),
        """edges AS (SELECT concat('E', za, '_', zb) AS edge_id, concat('J', za) AS from_j, concat('J', zb) AS to_j,
        length, speed, length / speed AS time FROM (
        SELECT a.zone AS za, b.zone AS zb, CAST(250 + ((a.zone * 7 + b.zone * 13) % 41) AS DOUBLE) AS length,
        CAST(10 + 5 * ((a.zone + b.zone) % 3) AS DOUBLE) AS speed
        FROM zones a JOIN zones b ON abs(a.x - b.x) + abs(a.y - b.y) = 250))""",
    ),
    "connections": (
        ("edges",),
        """connections AS (SELECT e.edge_id AS from_edge, f.edge_id AS to_edge
        FROM edges e JOIN edges f ON e.to_j = f.from_j WHERE e.from_j <> f.to_j)""",
    ),
    "turns": (
        ("connections",),
        """turns AS (SELECT CAST(row_number() OVER (ORDER BY junction, incoming_edge, outgoing_edge) - 1 AS INT) AS turn_id, *
        FROM (SELECT DISTINCT a.edge_id AS incoming_edge, b.edge_id AS outgoing_edge, a.to_j AS junction
        FROM edges a JOIN edges b ON a.to_j = b.from_j
        JOIN connections c ON c.from_edge = a.edge_id AND c.to_edge = b.edge_id WHERE a.edge_id <> b.edge_id))""",
    ),
    # cheapest cost by number of hops, then over all hop counts
    "hops": (
        ("edges",),
        """hops AS (SELECT id AS root, id AS node, CAST(0 AS DOUBLE) AS cost, 0 AS h
        FROM (SELECT DISTINCT from_j AS id FROM edges)
        UNION ALL SELECT root, to_j, min(cost + length), h + 1 FROM hops JOIN edges ON node = from_j
        WHERE h < 12 GROUP BY root, to_j, h)""",
    ),
    "togo": (("hops",), "togo AS (SELECT root, node, min(cost) AS rest FROM hops GROUP BY ALL)"),
    "demand_pairs": (("base_od",), "demand_pairs AS (SELECT o, d FROM base_od)"),
    # every simple path within 1700 m of the shortest; every pair has five by then
    "paths": (
        ("togo", "demand_pairs"),
        """paths AS (SELECT o, d, concat('J', o) AS node, concat('J', d) AS target, CAST(0 AS DOUBLE) AS cost,
        t.rest + 1700 AS budget, [concat('J', o)] AS nodes, CAST([] AS VARCHAR[]) AS edge_ids
        FROM demand_pairs JOIN togo t ON t.root = concat('J', o) AND t.node = concat('J', d)
        UNION ALL SELECT p.o, p.d, e.to_j, p.target, p.cost + e.length, p.budget,
        list_append(p.nodes, e.to_j), list_append(p.edge_ids, e.edge_id)
        FROM paths p JOIN edges e ON e.from_j = p.node JOIN togo t ON t.root = e.to_j AND t.node = p.target
        WHERE p.node <> p.target AND NOT list_contains(p.nodes, e.to_j) AND p.cost + e.length + t.rest <= p.budget)""",
    ),
    "routes": (
        ("paths",),
        f"""routes AS (SELECT * FROM (SELECT o, d, CAST(row_number() OVER (PARTITION BY o, d ORDER BY cost, nodes) AS INT) AS rank,
        nodes, edge_ids, cost FROM paths WHERE node = target) WHERE rank <= {K_PATHS})""",
    ),
    "shares": (
        ("routes",),
        f"""shares AS (SELECT *, exp(utility) / sum(exp(utility)) OVER (PARTITION BY o, d) AS probability FROM (
        SELECT *, -{THETA} * cost - max(-{THETA} * cost) OVER (PARTITION BY o, d) AS utility FROM routes))""",
    ),
    "route_steps": (
        ("shares",),
        """route_steps AS (SELECT o, d, rank, probability, i - 1 AS step,
        edge_ids[i] AS incoming_edge, edge_ids[i + 1] AS outgoing_edge
        FROM shares, unnest(range(1, len(edge_ids))) t(i))""",
    ),
    "assignment": (
        ("route_steps", "turns"),
        """assignment AS (SELECT turn_id, CAST((o - 1) * 25 + d - 1 AS INT) AS od_index, sum(probability) AS weight
        FROM (SELECT DISTINCT o, d, rank, probability, turn_id FROM route_steps JOIN turns USING (incoming_edge, outgoing_edge))
        GROUP BY ALL)""",
    ),
    "counts": (
        ("assignment", "od_batch"),
        """counts AS (SELECT sample_id, turn_id, sum(flow * weight) AS x
        FROM od_batch JOIN assignment ON od_index = (o - 1) * 25 + d - 1 GROUP BY ALL)""",
    ),
    "dense_counts": (
        ("counts", "samples"),
        """dense_counts AS (SELECT s.sample_id, t.turn_id, coalesce(c.x, 0) AS x FROM samples s CROSS JOIN turns t
        LEFT JOIN counts c ON c.sample_id = s.sample_id AND c.turn_id = t.turn_id)""",
    ),
}


def with_parts(names: Iterable[str], extra: Iterable[str] = ()) -> str:
    """WITH clause holding the named parts, all they build on, and further CTE texts."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in PARTS[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    texts = [PARTS[n][1] for n in order] + list(extra)
    return "WITH RECURSIVE " + ",\n".join(texts) + "\n" if texts else ""


def uniform_sql(seed: int, stream: str, *keys: str) -> str:
    """The md5 uniform of the draws module, in SQL."""
    joined = ", ".join([f"'{seed}'", f"'{stream}'", *keys])
    return f"((('0x' || substr(md5(concat_ws('|', {joined})), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def normal_sql(seed: int, stream: str, *keys: str) -> str:
    u1, u2 = uniform_sql(seed, stream + ".r", *keys), uniform_sql(seed, stream + ".a", *keys)
    return f"(sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2}))"


def log_gamma_sql(source: str, shape: str, seed: int, stream: str, *keys: str, tries: int = 16) -> str:
    """``keys, lg``: log of a Gamma(shape, 1) draw for each row of ``source``; all tries written out, first hit taken."""
    k = ", ".join(keys)
    return f"""(SELECT {k}, ln(gd) + min_by(lv, i) + CASE WHEN any_value(gs) < 1 THEN ln({uniform_sql(seed, stream + '.b', *keys)}) / any_value(gs) ELSE 0 END AS lg
    FROM (SELECT *, CASE WHEN 1 + gc * gx > 0 THEN 3 * ln(1 + gc * gx) END AS lv FROM (
      SELECT *, {normal_sql(seed, stream + '.n', *keys, 'i')} AS gx, ln({uniform_sql(seed, stream + '.u', *keys, 'i')}) AS gu, 1 / sqrt(9 * gd) AS gc FROM (
        SELECT {k}, i, {shape} AS gs, CASE WHEN {shape} < 1 THEN {shape} + 1 ELSE {shape} END - 1 / 3::DOUBLE AS gd FROM {source}, range({tries}) r(i))))
    WHERE gu < 0.5 * gx * gx + gd * (1 - exp(lv) + lv) GROUP BY {k}, gd)"""


def poisson_sql(source: str, rate: str, seed: int, stream: str, *keys: str, below: int = 25, tries: int = 24) -> str:
    """``keys, k``: Poisson draws of each row of ``source``: inverse CDF for small rates, transformed rejection beyond."""
    k = ", ".join(keys)
    top = int(below + 12 * below**0.5 + 20)
    rows = f"(SELECT {k}, {rate}::DOUBLE AS r FROM {source})"
    fact = """((t + 1 - 0.5) * ln(t + 1) - (t + 1) + 0.5 * ln(2 * pi()) + 1 / (12.0::DOUBLE * (t + 1)) - 1 / (360.0::DOUBLE * pow(t + 1, 3))
    + 1 / (1260.0::DOUBLE * pow(t + 1, 5)))"""
    return f"""(SELECT {k}, count(*) FILTER (cdf < w) AS k FROM (
      SELECT {k}, w, sum(exp(-r + j * ln(r) - lgamma(j + 1))) OVER (PARTITION BY {k} ORDER BY j) AS cdf FROM (
        SELECT *, {uniform_sql(seed, stream + '.w', *keys)} AS w FROM {rows}, range({top}) s(j) WHERE r < {below})) GROUP BY {k}
    UNION ALL SELECT {k}, CAST(min_by(t, i) AS BIGINT) FROM (
      SELECT *, floor((2 * a / (0.5 - abs(u)) + b) * u + r + 0.43) AS t FROM (
        SELECT *, -0.059 + 0.02483 * b AS a, {uniform_sql(seed, stream + '.u', *keys, 'i')} - 0.5 AS u, {uniform_sql(seed, stream + '.v', *keys, 'i')} AS v FROM (
          SELECT *, 0.931 + 2.53 * sqrt(r) AS b FROM {rows}, range({tries}) s(i) WHERE r >= {below})))
    WHERE (0.5 - abs(u) >= 0.07 AND v <= 0.9277 - 3.6224 / (b - 2)) OR (t >= 0 AND NOT (0.5 - abs(u) < 0.013 AND v > 0.5 - abs(u))
      AND ln(v * (1.1239 + 1.1328 / (b - 3.4)) / (a / pow(0.5 - abs(u), 2) + b)) <= t * ln(r) - r - {fact}) GROUP BY {k})"""


def ipf_sql(start: str, iterations: int) -> list[str]:
    """CTEs ``ipf1 .. ipfN`` scaling ``start(sample_id, o, d, flow, tr, tc)``."""
    out, before = [], start
    for t in range(1, iterations + 1):
        out.append(
            f"""ipf{t}r AS (SELECT sample_id, o, d, tr, tc, CASE WHEN rs > 0 THEN flow * tr / rs ELSE flow END AS flow
            FROM (SELECT *, sum(flow) OVER (PARTITION BY sample_id, o) AS rs FROM {before}))"""
        )
        out.append(
            f"""ipf{t} AS (SELECT sample_id, o, d, tr, tc, CASE WHEN cs > 0 THEN flow * tc / cs ELSE flow END AS flow
            FROM (SELECT *, sum(flow) OVER (PARTITION BY sample_id, d) AS cs FROM ipf{t}r))"""
        )
        before = f"ipf{t}"
    return out
