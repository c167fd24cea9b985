"""Queries that do the whole job, against brute force on the small tables or on fixtures of a few rows."""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_module
from pkgloom.session import Scratch


def run(spark, folder, name):
    return entry_module.queries()[name](spark, str(folder))


# ---- spectral measures


@pytest.fixture(scope="module")
def matrix(data):
    """(nodes, adjacency) of the part graph."""
    lines = defaultdict(set)
    for r in pq.read_table(f"{data}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey"]).to_pylist():
        lines[r["l_orderkey"], r["l_linenumber"]].add(r["l_partkey"])
    arcs = {(p, q) for (o, n), parts in lines.items() for p in parts for q in lines.get((o, n + 1), ()) if p != q}
    nodes = sorted({x for a in arcs for x in a})
    at = {n: k for k, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in arcs:
        m[at[a], at[b]] = 1
    return np.array(nodes), m


def stochastic(m):
    out = m.sum(axis=1, keepdims=True)
    return np.divide(m, out, out=np.zeros_like(m), where=out > 0)


def ranks(m, p):
    flow = stochastic(m) + np.outer(m.sum(axis=1) == 0, p)
    return np.linalg.solve(np.eye(len(p)) - 0.85 * flow.T, 0.15 * p)


def dominant(m):
    values, vectors = np.linalg.eig(m.T)
    x = np.abs(np.real(vectors[:, np.argmax(np.abs(values))]))
    return x / np.linalg.norm(x)


def one_in_ten(nodes):
    return (nodes % 10 == 0).astype(float)


SPECTRAL = {
    "C8_pagerank_converged": lambda nodes, m: ranks(m, np.full(len(nodes), 1 / len(nodes))),
    "C18_preferential_pagerank_converged": lambda nodes, m: ranks(m, one_in_ten(nodes) / one_in_ten(nodes).sum()),
    "C19_single_source_pagerank_converged": lambda nodes, m: ranks(m, (nodes == 1).astype(float)),
    "C7_katz_converged": lambda nodes, m: np.linalg.solve(np.eye(len(nodes)) - 0.01 * m.T, np.ones(len(nodes))),
    "C17_query_katz_converged": lambda nodes, m: np.linalg.solve(np.eye(len(nodes)) - 0.01 * m.T, one_in_ten(nodes)),
    "C5_eigenvector_converged": lambda nodes, m: dominant(m),
    "C6_seeley_converged": lambda nodes, m: (x := dominant(stochastic(m))) / x.sum(),
    "C9_hits_converged": lambda nodes, m: dominant(m.T @ m),
}


@pytest.mark.parametrize("name", SPECTRAL)
def test_spectral_fixpoints(spark, data, matrix, name):
    nodes, m = matrix
    got = {r["node"]: r["x"] for r in run(spark, data, name).collect()}
    assert sorted(got) == nodes.tolist()
    assert np.allclose([got[n] for n in nodes], SPECTRAL[name](nodes, m), rtol=0, atol=3e-7)


# ---- source text

PLAIN = "A note on  the list (short) and its class loader.\n"
SOURCE = """/* class Old { int  gone(int a) {} } */
class Store<T> extends Base {
    // int  hidden() {}
    public String name() { return "x"; }
    private static List<String> all(int a, int b) { return null; }
    boolean is(int a) { return a > 0; }
}
"""
TESTS = """import org.mockito.Mockito;
public class StoreTest {
    @Test(timeout = 5)
    public void one() { if (a) { b.when(c); } }
    /* @Test public void gone() {} */
    @Test public void two() { d(); }
    void helper() { e.mock(f); }
}
"""


def test_source_statistics(spark, tmp_path):
    rows = [("plain", PLAIN, "a"), ("source", SOURCE, "a"), ("tests", TESTS, "a"), ("none", None, "b")]
    spark.createDataFrame(rows, "doc_id string, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[2:] for r in run(spark, tmp_path, "F21_source_statistics").collect()}
    assert got == {"plain": (False, 0, 0, False, 0), "source": (True, 3, 0, False, 0), "tests": (True, 3, 2, True, 1), "none": (False, 0, 0, False, 0)}
    per = {r["source"]: tuple(r)[1:] for r in run(spark, tmp_path, "N12_module_statistics").collect()}
    assert per == {"a": (3, 1, 1, 3, 2, 1, 1, 1.0, 0.667, 0.5), "b": (1, 0, 0, 0, 0, 0, 0, None, None, None)}


# ---- dependents


@pytest.fixture
def chain(spark, tmp_path):
    """Version 1 is needed by 2, 2 by 3; 4 allows 1 but resolves to 5, the higher version of the same package."""
    v = [(1, 10, "1.0"), (2, 20, "1.0"), (3, 30, "1.0"), (4, 40, "1.0"), (5, 10, "2.0")]
    d = [(2, 10, ["1.0"]), (3, 20, ["[1.0,)"]), (4, 10, ["[1.0,)"])]
    lines = [(1, 1, 100), (1, 2, 101), (2, 1, 200), (2, 2, 100), (3, 1, 300), (3, 2, 200), (4, 1, 400), (4, 2, 100), (5, 1, 500)]
    spark.createDataFrame(v, "id long, package_id long, version string").write.parquet(str(tmp_path / "package_versions.parquet"))
    spark.createDataFrame(d, "package_version_id long, dependency_id long, version_range array<string>").write.parquet(str(tmp_path / "dependencies.parquet"))
    spark.createDataFrame([(i, f"g{i}:a") for i in (10, 20, 30, 40)], "id long, package_name string").write.parquet(str(tmp_path / "packages.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    return tmp_path


def test_search_of_all_dependents(spark, chain):
    got = {r["node"]: (r["dist"], r["indegree"], r["outdegree"]) for r in run(spark, chain, "G3_search_of_dependents").collect()}
    # 300 is two hops above the root; 400 is of a version that resolves to another one; 200 has no caller in the graph of 2
    assert got == {200: (1, 0, 1), 300: (2, 0, 1)}


def test_all_invalidated_files(spark, chain):
    got = {r["path"] for r in run(spark, chain, "D12_all_invalidated_files").collect()}
    assert got == {"g/g10/a/1.0.json", "g/g20/a/1.0.json", "g/g30/a/1.0.json", "g/g40/a/1.0.json"}


# ---- reach


def steps(pairs, start):
    """{node: steps from start}, start left out."""
    dist, todo = {start: 0}, [start]
    for a in todo:
        for p, q in pairs:
            if p == a and q not in dist:
                dist[q] = dist[a] + 1
                todo.append(q)
    return {n: d for n, d in dist.items() if d}


@pytest.fixture
def lines(spark, tmp_path):
    """Calls 1 > 2 > 3 > 4 > 5 > 1, each in an order of its own, and 6 > 1; the suppliers likewise."""
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 1), (6, 1)]
    rows = [(o, n + 1, x, x, "N") for o, pair in enumerate(pairs, 1) for n, x in enumerate(pair)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    return tmp_path, pairs


def test_reach_has_no_bound(spark, lines):
    folder, pairs = lines
    got = {r["node"]: r["reached"] for r in run(spark, folder, "G11_reach_counts").collect()}
    assert got == {n: len({n, *steps(pairs, n)}) for n in range(1, 7)}
    assert tuple(run(spark, folder, "A11_reach_summary").first()) == (5, 6, round(31 / 6, 6))


def test_reach_shuffles_lines_and_arcs_once(spark, tmp_path, monkeypatch):
    """One order, also with lines that repeat, that stand alone and that lack a value."""
    rows = [(1, 1, 1), (1, 2, 2), (1, 2, 3), (1, 2, 3), (1, 3, 1), (1, 3, 3), (1, 5, 9), (2, 1, 3), (2, 2, 4), (3, 1, 4), (3, 2, 4), (4, 1, None), (4, 2, 5), (None, 1, 5), (None, 2, 6), (5, None, 7), (5, None, 8), (6, 2**31 - 1, 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    shuffles, real = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: (shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange ")), real(self, df))[1])
    got = {r["node"]: r["reached"] for r in run(spark, tmp_path, "G11_reach_counts").collect()}
    pairs = {(s, t) for o, n, s in rows for q, m, t in rows if None not in (o, n, s, q, m, t) and (q, m) == (o, n + 1) and s != t}
    assert got == {n: len({n, *steps(pairs, n)}) for n in {x for p in pairs for x in p}} and len(got) == 4
    assert sum(shuffles) == 3  # of the lines, of the arcs, and of the nodes


def test_reach_across_revisions_has_no_bound(spark, data):
    from pkgloom.plans.pipelines import _gid_edges
    from pkgloom.sources.catalog import Catalog

    edges, appears = _gid_edges(Catalog(spark, data))
    inside = {(r["gid"], r["rev"]) for r in appears.collect()}
    pairs = {(r["src"], r["dst"]) for r in edges.collect() if (r["src"], r["rev"]) in inside}
    for name, arcs in (("G7_cross_revision_reach_all", pairs), ("G8_cross_revision_coreach_all", {(b, a) for a, b in pairs})):
        expected = steps(arcs, 1)
        assert max(expected.values()) > 2
        assert {r["gid"]: r["dist"] for r in run(spark, data, name).collect()} == expected


# ---- labels


def test_layered_order_keeps_clusters_together(spark, monkeypatch):
    """Three blocks of nodes whose ids are interleaved."""
    from pkgloom.operators import graph as g

    asked, costs = [], []
    real, real_cost = g.label_propagation, g.log_gap_cost
    monkeypatch.setattr(g, "label_propagation", lambda e, gamma, **o: (asked.append(gamma), real(e, gamma, **o))[1])
    monkeypatch.setattr(g, "log_gap_cost", lambda e, o: (costs.append(1), real_cost(e, o))[1])
    pairs = [p for b in range(3) for p in itertools.permutations(range(b, 18, 3), 2)] + [(0, 1), (1, 2)]
    order = {r["node"]: r["number"] for r in g.layered_order(spark.createDataFrame(pairs, "src long, dst long"), (0.5, 0.25, 0.0)).collect()}
    assert asked == [0.5, 0.25, 0.0] and len(costs) == 3
    assert sorted(order.values()) == list(range(18))
    for b in range(3):
        at = [order[n] for n in range(b, 18, 3)]
        assert max(at) - min(at) == 5
    assert g.GAMMAS == tuple(1 / 2**k for k in range(11)) + (0.0,)


def test_layered_order_in_tasks_is_that_of_tables(spark, monkeypatch):
    """Numbers and texts, with loops, repeats and arcs one way only; a round of a propagation is no job."""
    from pkgloom.operators import all_pairs
    from pkgloom.operators import graph as g
    from pkgloom.operators import labels as by_tasks

    rng = np.random.default_rng(3)
    pairs = [(int(b * 20 + x), int(b * 20 + y)) for b in range(3) for x, y in rng.integers(0, 20, (60, 2))] + [(0, 25), (30, 50), (70, 70), (5, 5)]
    arcs, gammas = spark.createDataFrame(pairs + pairs[:9], "src long, dst long"), (1.0, 0.25, 0.0)
    written, real = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: (written.append(1), real(self, df))[1])
    monkeypatch.setattr(by_tasks, "KEPT_LINKS", 0)
    monkeypatch.setattr(all_pairs, "FILE_ARCS", 40)  # sources whose arcs are in two files
    got = g.layered_order(arcs, gammas, rounds=4)
    assert len(written) == 8 and got.columns == ["node", "number"]
    cost = g.log_gap_cost(arcs.distinct(), got).first()[0]
    assert g.layered_gap_cost(arcs, gammas, rounds=4).first()[0] == cost
    monkeypatch.setattr(by_tasks, "NODES", 0)
    tables = g.layered_order(arcs, gammas, rounds=4)
    assert len(written) > 40 and sorted(got.collect()) == sorted(tables.collect())
    monkeypatch.setattr(by_tasks, "NODES", 10**6)
    text = g.layered_order(arcs.selectExpr("concat('n', src) AS src", "concat('n', dst) AS dst"), gammas, rounds=4)
    assert {r["node"] for r in text.collect()} == {f"n{r['node']}" for r in got.collect()} and sorted(r["number"] for r in text.collect()) == list(range(got.count()))


def test_labels_run_to_the_default_end(spark, data, monkeypatch):
    from pkgloom.operators import graph as g

    asked = []
    real = g.label_propagation
    monkeypatch.setattr(g, "label_propagation", lambda e, *a, **o: (asked.append((a, o)), real(e, *a, **o))[1])
    assert run(spark, data, "L1_label_propagation").count() > 0
    assert asked == [((), {})]


def test_descendants_of_all(spark, data):
    below = run(spark, data, "p6_found").selectExpr("sum(n_below)").first()[0]
    got = run(spark, data, "p6_descendants")
    assert got.count() == below > 0 and got.distinct().count() == below


def test_matched_edges_are_written_after_the_last_shuffle(spark, data):
    plan = run(spark, data, "D5_matched_edges")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_invalidation_stream_prepares_once(spark, data, monkeypatch):
    """Four batches write no table of versions or uses of their own."""
    written, real = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: (written.append(1), real(self, df))[1])
    run(spark, data, "T17_invalidation_stream")
    assert len(written) == 3
