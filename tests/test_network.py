from __future__ import annotations

from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import assignment as A
from flowloom.operators import linear as L
from flowloom.operators import network as N
from flowloom.operators.reshape import flatten
from flowloom.plans import inputs
from flowloom.sources import network_xml

LINKS = [
    ("a", "J1", "J2", 4.0), ("b", "J2", "J3", 3.0), ("c", "J1", "J3", 9.0), ("d", "J3", "J4", 2.0), ("e", "J2", "J4", 8.0),
    ("f", "J4", "J1", 1.0), ("g", "J3", "J2", 3.0), ("h", "J4", "J3", 2.0), ("i", "J2", "J1", 4.0), ("p", "J1", "J2", 4.5),
]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(e, f, t, w, 10.0, w / 10.0) for e, f, t, w in LINKS]
    return spark.createDataFrame(rows, "edge_id string, from_j string, to_j string, length double, speed double, time double")


def brute_force():
    """All simple paths, every node order tried; the last parallel link wins."""
    w = {}
    for e, f, t, c in LINKS:
        w[(f, t)] = (c, e)
    nodes = ["J1", "J2", "J3", "J4"]
    out = {}
    for size in (2, 3, 4):
        for p in permutations(nodes, size):
            if all(s in w for s in zip(p, p[1:])):
                out.setdefault((p[0], p[-1]), []).append((sum(w[s][0] for s in zip(p, p[1:])), list(p), [w[s][1] for s in zip(p, p[1:])]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("k", [1, 3, 50])
def test_k_shortest_equals_brute_force(spark, small, k):
    pairs = spark.createDataFrame([(i, j) for i in range(1, 5) for j in range(1, 5)], "o int, d int")
    got = {}
    for r in N.k_shortest_paths(small, pairs, k).collect():
        got.setdefault((f"J{r['o']}", f"J{r['d']}"), []).append((r["cost"], r["nodes"], r["edges"]))
    want = {key: v[:k] for key, v in brute_force().items()}
    assert {key: sorted(v) for key, v in got.items()} == want


def test_shortest_path_and_unreachable_pair(spark, small):
    pairs = spark.createDataFrame([(1, 4), (2, 2), (1, 5)], "o int, d int")
    got = {(r["o"], r["d"]): r for r in N.shortest_paths(small, pairs).collect()}
    assert got[(1, 4)]["cost"] == brute_force()[("J1", "J4")][0][0]
    assert got[(2, 2)]["edges"] == [] and got[(2, 2)]["cost"] == 0.0
    assert got[(1, 5)]["edges"] == [] and got[(1, 5)]["cost"] is None


XML = """<net>
<junction id=":J1_0" x="9" y="9"/><junction id="J1" x="0" y="0"/><junction id="J2" x="100" y="0"/>
<edge id=":in" function="internal"><lane length="1" speed="1"/></edge>
<edge id="one" from="J1" to="J2"><lane length="100" speed="10"/><lane length="999" speed="1"/></edge>
<edge id="two" from="J1" to="J2"><lane length="120" speed="12"/></edge>
<connection from="one" to="two"/><connection from="" to="two"/>
</net>"""


def test_xml_rules(spark, tmp_path: Path):
    path = tmp_path / "net.xml"
    path.write_text(XML)
    assert [r["id"] for r in network_xml.read_junctions(spark, str(path)).orderBy("id").collect()] == ["J1", "J2"]
    edges = network_xml.read_edges(spark, str(path))
    assert {(r["edge_id"], r["length"], r["time"]) for r in edges.collect()} == {("one", 100.0, 10.0), ("two", 120.0, 10.0)}
    assert [r["edge_id"] for r in network_xml.routable_edges(edges).collect()] == ["two"]
    assert network_xml.read_connections(spark, str(path)).count() == 1


@pytest.mark.parametrize("lane", ["", '<lane length="5" speed="0"/>'])
def test_xml_refuses_broken_edges(spark, tmp_path: Path, lane):
    path = tmp_path / "net.xml"
    path.write_text(f'<net><edge id="x" from="J1" to="J2">{lane}</edge></net>')
    with pytest.raises(Exception, match="edge with"):
        network_xml.read_edges(spark, str(path)).collect()


def test_grid_network(spark, sf):
    assert inputs.turns(spark, sf).count() == 188
    shares = inputs.shares(spark, sf).groupBy("o", "d").agg(F.sum("probability").alias("p"))
    assert shares.filter(F.abs(F.col("p") - 1) > 1e-9).count() == 0
    a = inputs.assignment(spark, sf)
    assert a.filter("weight < 0 or weight > 1 + 1e-9").count() == 0


def test_counts_vector_form_equals_long_form(spark, sf, od):
    a = inputs.assignment(spark, sf)
    long = {(r["sample_id"], r["turn_id"]): r["x"] for r in A.turning_counts(od, a, 25).collect()}
    for r in A.vector_counts(flatten(od, 25), a, 188, 25).collect():
        for t, x in enumerate(r["x"]):
            assert np.isclose(x, long.get((r["sample_id"], t), 0.0), atol=1e-6)


def matrix(a, m=188, n=625):
    out = np.zeros((m, n))
    for r in a.collect():
        out[r["turn_id"], r["od_index"]] = r["weight"]
    return out


def test_linear_algebra(spark, sf, od):
    a = inputs.assignment(spark, sf)
    m = matrix(a)
    s = L.singular_values(a, 188, 625)
    assert np.allclose(s, np.linalg.svd(m, compute_uv=False), atol=1e-9)
    report = L.rank_report(spark, s, 188, 625).first()
    assert report["rank"] == np.linalg.matrix_rank(m) and report["nullity"] == 625 - report["rank"]
    inv = matrix(L.pseudo_inverse(a, 188)).T
    assert np.allclose(m @ inv @ m, m, atol=1e-6)
    assert np.allclose(inv, np.linalg.pinv(m, rcond=1e-10), atol=1e-5)
    tik = matrix(L.tikhonov_operator(a, 188, 0.5)).T
    assert np.allclose(tik, np.linalg.solve(m.T @ m + 0.5 * np.eye(625), m.T), atol=1e-8)


def test_physics_refine_solves_its_system(spark, sf, od):
    a = inputs.assignment(spark, sf)
    m, mu = matrix(a), 0.3
    x = A.turning_counts(od, a, 25)
    start = od.select("sample_id", ((F.col("o") - 1) * 25 + F.col("d") - 1).alias("od_index"), (F.col("flow") * 0.8).alias("y"))
    out = np.zeros(625)
    for r in L.physics_refine(start, x, a, 188, mu).filter("sample_id = 3").collect():
        out[r["od_index"]] = r["y"]
    y0, xs = np.zeros(625), np.zeros(188)
    for r in start.filter("sample_id = 3").collect():
        y0[r["od_index"]] = r["y"]
    for r in x.filter("sample_id = 3").collect():
        xs[r["turn_id"]] = r["x"]
    want = np.linalg.solve(np.eye(625) + mu * m.T @ m, y0 + mu * m.T @ xs)
    assert np.allclose(out, want, atol=1e-6)


def test_path_search_jobs_read_their_tables_once(spark, monkeypatch):
    """A job of the search reads its labels and paths once or twice, not 2 ** HOPS times."""
    leaves, write = {}, N.materialise

    def counted(df, label):
        n = df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
        leaves[label] = max(n, leaves.get(label, 0))
        return write(df, label)

    monkeypatch.setattr(N, "materialise", counted)
    links = spark.createDataFrame([(f"J{i}", f"J{i + 1}", f"e{i}", 1.0) for i in range(1, 12)], "node string, next string, edge_id string, w double")
    got = N.cheapest_paths(write(links, "links"), spark.createDataFrame([(12, "J12")], "root int, node string"))
    assert got.filter("node = 'J1'").first()["edges"] == [f"e{i}" for i in range(1, 12)]
    assert leaves["costs"] <= N.HOPS + 1 and leaves["paths"] <= 2
