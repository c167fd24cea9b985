"""The reference-side operators on small fixtures, brute force and hostile rows."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from pkgloom.functions import json_ops, uri
from pkgloom.functions.versions import constraint, dotted_range, split_constraints, version_key
from pkgloom.operators import graph as g
from pkgloom.operators import stitching as m
from pkgloom.operators.dependencies import constraint_sets, dependents, match_counts, matches, resolve, source_counts
from pkgloom.operators.predicates import FilterStack, full_match, metadata_contains, pointer_matches
from pkgloom.operators.upsert import append_new, get_or_create, last_of_each, upsert
from pkgloom.plans.reads import in_intervals
from pkgloom.session import Scratch
from pkgloom.sources.graph_store import GraphStore, graph_json, random_graphs, read_coordinates, read_graph_json
from pkgloom.streaming.lanes import offload, retried


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


# ---- graphs


def test_search_of_five_nodes(spark):
    e = edges_of(spark, [(0, 1), (1, 2), (1, 3), (2, 4), (3, 4), (4, 1)])
    seed = spark.createDataFrame([(1,), (99,)], "node long")
    rows = {r["node"]: (r["dist"], r["indegree"], r["outdegree"], r["score"]) for r in g.search(e, seed).collect()}
    assert rows.keys() == {2, 3, 4}
    assert rows[2][:3] == rows[3][:3] == (1, 1, 1) and rows[4][:3] == (2, 2, 1)
    assert rows[2][3] == pytest.approx(2 / math.log2(3)) and rows[4][3] == pytest.approx(1.5)
    hidden = g.search(e, seed, keep=F.col("node") != 2).collect()
    assert {r["node"] for r in hidden} == {3, 4}  # hidden nodes are still walked through
    assert {r["node"] for r in g.search(e, seed, forward=False).collect()} == {0, 2, 3, 4}
    assert g.search(e.limit(0), seed).count() == 0


@pytest.fixture(scope="module")
def arcs():
    rng = random.Random(0)
    return sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(120)} - {(i, i) for i in range(30)})


def brute_distances(arcs):
    out = defaultdict(dict)
    nxt = defaultdict(list)
    for a, b in arcs:
        nxt[a].append(b)
    for s in {x for e in arcs for x in e}:
        todo, seen = deque([s]), {s: 0}
        while todo:
            x = todo.popleft()
            for y in nxt[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        out[s] = seen
    return out


def test_distance_measures(spark, arcs):
    d = brute_distances(arcs)
    got = {r["node"]: r for r in g.distance_measures(edges_of(spark, arcs + arcs[:5])).collect()}
    for n in d:
        inward = [d[s][n] for s in d if n in d[s] and s != n]
        assert got[n]["closeness"] == pytest.approx(1 / sum(inward) if inward else 0)
        assert got[n]["harmonic"] == pytest.approx(sum(1 / x for x in inward))
        assert got[n]["lin"] == pytest.approx((len(inward) + 1) ** 2 / sum(inward) if inward else 1)


def test_betweenness(spark, arcs):
    nodes = sorted({x for e in arcs for x in e})
    d = brute_distances(arcs)
    nxt = defaultdict(list)
    for a, b in arcs:
        nxt[a].append(b)

    def count(s, t):
        if s == t:
            return 1
        return sum(count(y, t) for y in nxt[s] if t in d[y] and d[y][t] == d[s][t] - 1)

    got = {r["node"]: r["betweenness"] for r in g.betweenness(edges_of(spark, arcs)).collect()}
    for v in nodes:
        total = sum(count(s, v) * count(v, t) / count(s, t) for s in nodes for t in nodes if s != v != t and s != t and t in d[s] and v in d[s] and t in d[v] and d[s][v] + d[v][t] == d[s][t])
        assert got[v] == pytest.approx(total)


@pytest.mark.parametrize(
    "way",
    [
        {},
        {"PAIR_NS": 1e6, "CELL_NS": 0, "TILE": 7, "ROWS": 5},  # rows of all sources at once
        {"ROW_NS": 1e9, "SPREAD": 11},  # arcs for one source, forward
        {"ROW_NS": 1e9, "CELL_NS": 0},  # and back from what is not reached
        {"PART": 1, "STATE": 900},  # a component at a time, few sources at once
        {"HELD_ARCS": 3},  # from files
    ],
)
def test_betweenness_goes_any_way(tmp_path, monkeypatch, way):
    """Two graphs side by side, arcs in files; what a block reaches is read once for the blocks that follow."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from pkgloom.operators import all_pairs

    for name, value in way.items():
        monkeypatch.setattr(all_pairs, name, value)
    reads, real = [], all_pairs._read
    monkeypatch.setattr(all_pairs, "_read", lambda path, columns: (reads.append(path), real(path, columns))[1])
    rng = random.Random(7)
    arcs = sorted({(3 * a + k, 3 * b + k) for k, n, m in ((0, 40, 160), (1, 25, 40)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})
    ids = sorted({x for e in arcs for x in e})
    files = []
    for k in range(0, len(arcs), 50):
        src, dst = zip(*arcs[k : k + 50], strict=True)
        pq.write_table(pa.table({"src": src, "dst": dst}), str(tmp_path / f"{k}.parquet"))
        files.append(((tmp_path / f"{k}.parquet").as_uri(), src[0], src[-1]))
    pq.write_table(pa.table({"node": ids}), str(tmp_path / "nodes.parquet"))
    stored = all_pairs._Arcs([(tmp_path / "nodes.parquet").as_uri()], files)
    total, reached = np.zeros(len(ids)), all_pairs._Reached(stored)
    for low in range(0, len(ids), 64):
        high = min(len(ids), low + 64)
        parts = reached.parts_of(low, high)
        assert (parts is None) == ("HELD_ARCS" in way)
        if parts is None:
            all_pairs._shares_from_files(stored, low, high, total)
        else:
            for part, sources in parts:
                total[part.nodes] += part.shares(sources)
    assert len(reads) <= 1 + len(files) * -(-len(ids) // 64)

    d, nxt, want = brute_distances(arcs), defaultdict(list), dict.fromkeys(ids, 0.0)
    for a, b in arcs:
        nxt[a].append(b)
    for s in d:  # backwards over the arcs of shortest paths
        order = sorted(d[s], key=d[s].get)
        paths, behind = defaultdict(float, {s: 1.0}), defaultdict(float)
        for x in order:
            for y in nxt[x]:
                if d[s][y] == d[s][x] + 1:
                    paths[y] += paths[x]
        for x in reversed(order):
            behind[x] = sum(paths[x] / paths[y] * (1 + behind[y]) for y in nxt[x] if d[s][y] == d[s][x] + 1)
            want[x] += behind[x] if x != s else 0.0
    assert total.tolist() == pytest.approx([want[x] for x in ids])


def _dense(arcs):
    nodes = sorted({x for e in arcs for x in e})
    return nodes, {n: [b for a, b in arcs if a == n] for n in nodes}


def test_pagerank_converges(spark, arcs):
    nodes, out = _dense(arcs)
    x = {n: 1 / len(nodes) for n in nodes}
    for _ in range(200):
        lost = sum(x[n] for n in nodes if not out[n])
        y = {n: 0.15 / len(nodes) + 0.85 * lost / len(nodes) for n in nodes}
        for n in nodes:
            for b in out[n]:
                y[b] += 0.85 * x[n] / len(out[n])
        x = y
    got = {r["node"]: r["x"] for r in g.pagerank(edges_of(spark, arcs), rounds=60, tolerance=1e-6).collect()}
    assert sum(got.values()) == pytest.approx(1)
    assert all(got[n] == pytest.approx(x[n], abs=1e-5) for n in nodes)


def test_components_and_salsa(spark):
    e = edges_of(spark, [(1, 2), (2, 3), (10, 11), (12, 11), (5, 5)])
    comp = {r["node"]: r["component"] for r in g.components(e).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 5: 5}
    x = {r["node"]: r["x"] for r in g.salsa(e).collect()}
    assert x[11] == pytest.approx(0.25) and x[1] == 0 and sum(x.values()) == pytest.approx(1)


def test_label_propagation(spark):
    blocks = [range(0, 6), range(10, 16)]
    arcs = [(a, b) for block in blocks for a, b in itertools.permutations(block, 2)] + [(0, 10)]
    labels = {r["node"]: r["label"] for r in g.label_propagation(edges_of(spark, arcs)).collect()}
    assert len({labels[n] for n in blocks[0]}) == 1 and len({labels[n] for n in blocks[1]}) == 1
    assert labels[1] != labels[11]


def test_integrity(spark):
    nodes = spark.createDataFrame([(1,), (1,), (2,)], "node long")
    e = edges_of(spark, [(1, 2), (1, 2), (2, 9)])
    assert {(r["error"], r["a"]) for r in g.integrity_errors(nodes, e).collect()} == {("duplicate node", 1), ("duplicate arc", 1), ("unknown node", 9)}


def test_prefix_sums(spark):
    rows = [(i, (i * 7) % 5) for i in range(200)]
    got = {r["k"]: r["upto"] for r in g.prefix_sums(spark.createDataFrame(rows, "k long, v long"), "k", "v").collect()}
    assert got == {k: sum(v for q, v in rows if q <= k) for k, _ in rows}


def test_clustering(spark, arcs):
    und = {tuple(sorted(e)) for e in arcs}
    near = defaultdict(set)
    for a, b in und:
        near[a].add(b)
        near[b].add(a)
    got = {r["node"]: r["clustering"] for r in g.clustering(edges_of(spark, arcs)).collect()}
    for n, k in near.items():
        linked = sum(1 for a, b in itertools.combinations(sorted(k), 2) if (a, b) in und)
        assert got[n] == pytest.approx(2 * linked / (len(k) * (len(k) - 1)) if len(k) > 1 else 0)


# ---- versions


ORDERED = ["1-alpha", "1-alpha2", "1-beta", "1-milestone1", "1-rc1", "1-rc2", "1-snapshot", "1", "1-sp", "1-abc", "1-1", "1.0.1", "1.1-rc1", "1.1", "1.2", "1.10", "2", "10.0"]
EQUAL = [("1", "1.0"), ("1", "1.0.0"), ("1", "1-ga"), ("1", "1.0.Final"), ("1-rc", "1-cr"), ("1.0-RC1", "1-rc1"), ("1a1", "1-alpha-1"), ("1.01", "1.1")]


def test_version_order(spark):
    df = spark.createDataFrame([(v,) for v in ORDERED + [x for p in EQUAL for x in p]], "v string").select("v", version_key("v").alias("k")).distinct()
    k = {r["v"]: r["k"] for r in df.collect()}
    assert sorted(ORDERED, key=k.__getitem__) == ORDERED and len({k[v] for v in ORDERED}) == len(ORDERED)
    assert all(k[a] == k[b] for a, b in EQUAL)
    assert spark.createDataFrame([(None,)], "v string").select(version_key("v")).first()[0] is None


@pytest.mark.parametrize(
    "specs, expected",
    [
        (["(1.0,3.0]"], "2.0 3.0"), (["[2.0,3.0]"], "2.0 3.0"), (["[1.0,2.0)", "(2.0,3.0]"], "1.0 3.0"), (["1.0"], "1.0"), (["[1.0]"], "1.0"), (["(,2.0]"], "1.0 2.0"), (["[2.0,]"], "2.0 3.0"),
        (["(,1.0]", "[3.0,)"], "1.0 3.0"), (["(,2.0)", "(2.0,)"], "1.0 3.0"), (["*"], ""), (["[ 2.0 , 2.5 ]"], "2.0"), ([], ""), (["9"], ""),
    ],
)
def test_matching_revisions(spark, specs, expected):
    d = spark.createDataFrame([(50, 7, specs), (51, 7, None)], "package_version_id long, dependency_id long, version_range array<string>")
    v = spark.createDataFrame([(1, 7, "1.0"), (2, 7, "2.0"), (3, 7, "3.0"), (4, 8, "2.0")], "id long, package_id long, version string")
    _, sets = constraint_sets(d)
    assert sorted(r["target"] for r in matches(sets, v).collect()) == [int(float(x)) for x in expected.split()]
    assert sum(r["n"] for r in match_counts(sets, v).collect()) == len(expected.split())


def test_counts_are_those_of_the_edges(spark):
    rng = random.Random(8)
    names = ["1.0", "1", "1.0.0", "1.5-rc1", "1.5", "2.0", "2.1-beta", "3", "3.0.1", "10.0"]
    v = [(i, i % 3, rng.choice(names)) for i in range(60)]
    specs = ["[1,2)", "(1,3]", "(,2.0]", "[1.5,)", "(,)", "1.0", "[1.0]", "3", "[9,1]", "(2.0,2.0]"]
    d = [(100 + i, rng.randrange(3), rng.sample(specs, rng.randint(1, 3))) for i in range(40)]
    versions = spark.createDataFrame(v, "id long, package_id long, version string")
    uses, sets = constraint_sets(spark.createDataFrame(d, "package_version_id long, dependency_id long, version_range array<string>"))
    edges = matches(sets, versions)
    assert {tuple(r) for r in match_counts(sets, versions).collect()} == {tuple(r) for r in edges.groupBy("set_id").count().collect()}
    into = uses.join(edges, "set_id").groupBy("target").count()
    assert {tuple(r) for r in source_counts(uses, sets, versions).collect()} == {tuple(r) for r in into.collect()}


def test_dependents(spark):
    d = spark.createDataFrame([(2, 10, ["1.0"]), (3, 20, ["[1.0,)"]), (4, 30, ["1.0"]), (1, 40, ["1.0"])], "package_version_id long, dependency_id long, version_range array<string>")
    v = spark.createDataFrame([(i, 10 * i, "1.0", f"2020-01-0{i} 00:00:00") for i in range(1, 5)], "id long, package_id long, version string, t string").withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    uses, sets = constraint_sets(d)
    roots = spark.createDataFrame([(1,)], "node long")
    full = {r["node"]: r["dist"] for r in dependents(uses, sets, v, roots).collect()}
    assert full == {2: 1, 3: 2, 4: 3, 1: 4}  # a cycle leads back to the root
    assert {r["node"] for r in dependents(uses, sets, v, roots, transitive=False).collect()} == {2}
    assert dependents(uses, sets, v, roots, since="2020-01-03 00:00:00").count() == 0


def test_resolve_and_search_within(spark):
    d = spark.createDataFrame([(1, 20, ["[1.0,2.0)"]), (2, 30, ["9"]), (3, 30, ["[1.0,]"])], "package_version_id long, dependency_id long, version_range array<string>")
    v = spark.createDataFrame([(1, 10, "1"), (2, 20, "1.0"), (3, 20, "1.9"), (4, 20, "2.0"), (5, 30, "3"), (6, 30, "10")], "id long, package_id long, version string")
    uses, sets = constraint_sets(d)
    got = {r["node"]: r["dist"] for r in resolve(uses, sets, v, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: 0, 3: 1, 6: 2}
    homes = spark.createDataFrame([(100, 1), (101, 1), (102, 3), (103, 6), (104, 5)], "node long, revision long")
    revisions = spark.createDataFrame([(k, x == 0) for k, x in got.items()], "revision long, root boolean")
    e = edges_of(spark, [(100, 102), (102, 103), (102, 104), (104, 103), (101, 100)])
    assert {r["node"]: r["dist"] for r in g.search_within(e, homes, revisions).collect()} == {102: 1, 103: 2}


def test_dotted_ranges(spark):
    df = spark.createDataFrame([("[1.2..1.5]",), ("[2.3..]",), ("[ 2.0.1 ]",), ("[..4]",), ("[1..2..3]",), (None,)], "s string")
    got = {r["s"]: (r["lower"], r["upper"]) for r in df.select("s", *[c.alias(k) for k, c in dotted_range(F.col("s")).items()]).collect()}
    assert got == {"[1.2..1.5]": ("1.2", "1.5"), "[2.3..]": ("2.3", None), "[ 2.0.1 ]": ("2.0.1", "2.0.1"), "[..4]": (None, "4"), "[1..2..3]": (None, None), None: (None, None)}


def test_constraint_texts(spark):
    specs = ["[1.0],[2,3]", "1.0", "$x,y", None, "(,1],(2,)"]
    df = spark.createDataFrame([(s,) for s in specs], "s string").select("s", split_constraints(F.col("s")).alias("c"))
    assert {r["s"]: r["c"] for r in df.collect()} == {"[1.0],[2,3]": ["[1.0]", "[2,3]"], "1.0": ["1.0"], "$x,y": ["$x,y"], None: ["*"], "(,1],(2,)": ["(,1]", "(2,)"]}
    row = spark.createDataFrame([("[1.0,2.0)",)], "s string").select(*[c.alias(k) for k, c in constraint(F.col("s")).items()]).first()
    assert row.asDict() == {"bracketed": True, "lower": "1.0", "upper": "2.0", "lower_in": True, "upper_in": False}


# ---- stitching


def test_dispatch(spark):
    types = spark.createDataFrame([("Baz", "Bar", 0), ("Bar", m.LAST, 0), ("Foo", m.LAST, 0), ("X", "Y", 0), ("Y", "X", 0), ("Multi", "Foo", 0), ("Multi", "Bar", 1)], "type string, parent string, idx int")
    methods = spark.createDataFrame([("Bar", "super()", 1), ("Baz", "<init>()", 2), ("Bar", "<init>()", 3), ("Foo", "static()", 4), ("Foo", "<init>()", 5), ("Baz", "own()", 6), (m.LAST, "hash()", 7), ("Foo", "both()", 8), ("Bar", "both()", 9)], "type string, signature string, gid long")
    asked = [("VIRTUAL", "Baz", "super()"), ("SPECIAL", "Baz", "<init>()"), ("SPECIAL", "Bar", "<init>()"), ("STATIC", "Foo", "static()"), ("VIRTUAL", "Bar", "own()"), ("VIRTUAL", "Baz", "hash()"), ("STATIC", "Baz", "super()"), ("DYNAMIC", "Foo", "static()"), ("INTERFACE", "Multi", "both()"), ("VIRTUAL", "X", "none()"), ("VIRTUAL", None, "x()")]
    calls = spark.createDataFrame([(100, False, *a) for a in asked] + [(101, True, "STATIC", "Foo", "static()")], "source long, external boolean, call_type string, receiver string, signature string")
    above = m.ancestors(types)
    order = [r["ancestor"] for r in above.where("type = 'Multi'").orderBy("place").collect()]
    assert order == ["Foo", "Bar", m.LAST]
    done = m.dispatch(calls, methods, above)
    got = {(r["source"], r["receiver"], r["signature"]): (r["target"], r["stage"]) for r in done.collect()}
    assert got == {
        (100, "Baz", "super()"): (1, 2), (100, "Baz", "<init>()"): (2, 1), (100, "Bar", "<init>()"): (3, 1), (100, "Foo", "static()"): (4, 1), (100, "Bar", "own()"): (6, 3),
        (100, "Baz", "hash()"): (7, 2), (100, "Multi", "both()"): (8, 2), (101, "Foo", "static()"): (4, 1),
    }
    assert {(4, 101), (100, 4)} <= {tuple(r) for r in m.merged_edges(done).collect()}
    assert sorted(r["gid"] for r in m.unresolved(calls, done).collect()) == [-2, -1]


def test_origins(spark):
    s, d = edges_of(spark, [(1, 2), (2, 3)]), edges_of(spark, [(1, 2), (1, 3), (3, 9)])
    assert {tuple(r) for r in m.combine_origins(s, d).collect()} == {(1, 2, "staticAndDynamic"), (2, 3, "static"), (1, 3, "dynamic")}


# ---- writes


def test_upsert(spark):
    old = spark.createDataFrame([(1, None, '{"a":1,"b":{"c":[1]}}', 5, "x"), (2, "k", None, 1, "y")], "id long, k string, md string, n long, extra string")
    new = spark.createDataFrame([(1, None, '{"b":2}', 7), (3, "z", '{"q":null}', 1), (2, "k", '{"a":1}', 2)], "id long, k string, md string, n long")
    got = {r["id"]: r for r in upsert(old, new, ["id", "k"], {"md": "concat", "n": "add"}).collect()}
    assert got[1]["md"] == '{"a":1,"b":2}' and got[1]["n"] == 12 and got[1]["extra"] == "x"
    assert got[2]["md"] is None and got[3]["extra"] is None and len(got) == 3
    got = {r["id"]: r["md"] for r in upsert(old, new, ["id", "k"], {"md": "concat_null"}).collect()}
    assert got[2] == '{"a":1}'
    assert upsert(old.limit(0), new, ["id"]).count() == 3 and upsert(old, new.limit(0), ["id"]).count() == 2


def test_dictionary(spark):
    d = spark.createDataFrame([("a", 4)], "name string, id long")
    names = spark.createDataFrame([("b",), ("a",), ("c",), ("b",), (None,)], "name string")
    assert {tuple(r) for r in get_or_create(d, names).collect()} == {("a", 4), ("b", 5), ("c", 6)}
    assert {tuple(r) for r in get_or_create(d.limit(0), names).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert append_new(d, spark.createDataFrame([("a", 9), ("z", 1), ("z", 2)], "name string, id long"), ["name"]).count() == 2
    rows = spark.createDataFrame([(1, 5, "old"), (1, 6, "new"), (2, 1, None)], "k long, t long, v string")
    assert {r["k"]: r["v"] for r in last_of_each(rows, ["k"], ["t"]).collect()} == {1: "new", 2: None}


def test_json(spark):
    row = spark.createDataFrame([('{"a":1,"n":null,"o":{"p/q":[10,{"z":"w"}]}}',)], "j string").select(
        json_ops.has_key("j", "n").alias("has"), json_ops.has_key("j", "zz").alias("hasnt"), json_ops.without_key("j", "a").alias("cut"), json_ops.only_keys("j", ["a"]).alias("only"),
        json_ops.pointer("j", "/o/p~1q/1/z").alias("deep"), json_ops.pointer("j", "/o/none").alias("none"), json_ops.put_nested("j", "v", F.lit("id1"), F.lit('{"s":1}')).alias("put"),
    ).first()
    assert row["has"] and not row["hasnt"] and row["only"] == '{"a":1}' and row["deep"] == "w" and row["none"] is None
    assert "id1" in row["put"] and '"a":1' in row["put"] and '"a"' not in row["cut"]
    bad = spark.createDataFrame([("{",), (None,), ("[1]",)], "j string")
    assert [r[0] for r in bad.select(json_ops.has_key("j", "a")).collect()] == [False] * 3


def test_intervals(spark):
    rng = random.Random(4)
    iv = [(i, rng.choice([1, 2, None]), *sorted((rng.randrange(100), rng.randrange(100)))) for i in range(80)]
    pts = sorted({(rng.choice([1, 2]), rng.randrange(100)) for _ in range(60)})
    got = {(r["id"], r["_at"]) for r in in_intervals(spark.createDataFrame(pts, "k long, at int"), spark.createDataFrame(iv, "id int, k long, lo int, hi int"), "k", "at", "lo", "hi").collect()}
    assert got == {(i, x) for i, k, lo, hi in iv for q, x in pts if k == q and lo <= x <= hi}


# ---- filters, identifiers


def test_filter_stack(spark):
    df = spark.createDataFrame([(1, '{"a":"x1"}'), (2, '{"a":null}'), (3, None), (4, "{")], "id int, md string")
    md = F.col("md")
    s = FilterStack().push(metadata_contains(md, "a")).push(pointer_matches(md, "/a", "x.")).and_()
    assert [r["id"] for r in df.where(s.column()).collect()] == [1]
    assert [r["id"] for r in df.where(s.not_().column()).collect()] == [2, 3, 4]
    assert df.where(s.clear().column()).count() == 4
    with pytest.raises(ValueError):
        FilterStack().not_()
    with pytest.raises(ValueError):
        FilterStack().push(F.lit(True)).and_()
    assert df.where(full_match(F.col("md"), "x")).count() == 0


def test_identifiers(spark):
    row = spark.createDataFrame([("cg://mvn!g:a$1.0/ns/C.m(%2Fint)%2Fvoid", "pkg:maven/g.x/a@1%2B2?type=jar#s")], "u string, p string").select(
        *[c.alias(k) for k, c in uri.split_full_uri("u").items()], *[c.alias("p_" + k) for k, c in uri.purl_parts("p").items()], uri.purl_package("p").alias("pkg"),
        uri.percent_decode(F.lit("a%2Bb+c")).alias("dec"), uri.percent_decode_fully(F.lit("%25252F")).alias("full"), uri.percent_decode(F.lit("%zz")).alias("bad"), uri.callable_name(F.lit("A::B::B")).alias("ctor"), uri.callable_name(F.lit("m")).alias("one"), uri.file_name(F.lit("a:b/c$1")).alias("file"),
    ).first()
    assert (row["forge"], row["product"], row["version"], row["partial"]) == ("mvn", "g:a", "1.0", "/ns/C.m(%2Fint)%2Fvoid")
    assert (row["p_type"], row["p_namespace"], row["p_name"], row["p_version"], row["p_ecosystem"], row["pkg"]) == ("maven", "g.x", "a", "1+2", "mvn", "g.x:a")
    assert (row["dec"], row["full"], row["bad"], row["ctor"], row["one"], row["file"]) == ("a+b+c", "/", None, "A$B.<init>(", "m(", "a-b-c-1")


# ---- storage, streaming


def test_graph_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    assert store.load(1) is None
    nodes = spark.createDataFrame([(1, 1, False), (1, 2, True), (257, 5, False)], "graph_id long, node long, external boolean")
    edges = spark.createDataFrame([(1, 1, 2), (1, 1, 2)], "graph_id long, src long, dst long")
    store.save(nodes, edges)
    n, e = store.load(1)
    assert n.count() == 2 and [tuple(r) for r in e.collect()] == [(1, 1, 2)]
    store.delete(1)
    assert store.load(1) is None and store.load(257)[0].count() == 1  # another graph of the same bucket stays
    with pytest.raises(ValueError, match="unknown node"):
        store.save(nodes, spark.createDataFrame([(1, 1, 77)], "graph_id long, src long, dst long"))
    with pytest.raises(ValueError, match="duplicate node"):
        store.save(nodes.union(nodes), edges)
    back_nodes, back_edges = read_graph_json(graph_json(nodes, edges.distinct()))
    assert {tuple(r) for r in back_nodes.collect()} == {tuple(r) for r in nodes.collect()} and back_edges.count() == 1


def test_other_sources(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("h\ng:a:1\n bad \ng:b:2\n")
    assert {tuple(r) for r in read_coordinates(spark, str(p), header=True).collect()} == {("g", "a", "1"), ("g", "b", "2")}
    a, b = (random_graphs(spark, 3, 20, 40, seed=s).collect() for s in (1, 1))
    assert sorted(a) == sorted(b) and all(r["dst"] < r["src"] < 20 for r in a)
    rows = spark.createDataFrame([(1, "x" * 50), (2, "y")], "key long, payload string")
    folder = Scratch(spark).root.toString() + "/p"
    out = {r["key"]: r["payload"] for r in offload(rows, folder, 10).collect()}
    assert out[2] == "y" and re.match(r'\{"dir":', out[1]) and spark.read.parquet(folder).count() == 1
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError

    retried(flaky, wait_s=0)
    assert len(tries) == 3
    with pytest.raises(ZeroDivisionError):
        retried(lambda: 1 / 0, retries=2, wait_s=0)


def test_lists_and_strict_appends(spark):
    from pkgloom.operators.upsert import append_strict, from_lists, ids_in_order

    lists = spark.createDataFrame([(1, ["a", "b"], [1, None]), (2, [], []), (3, None, None)], "k int, n array<string>, v array<int>")
    assert sorted(tuple(r) for r in from_lists(lists, ["n", "v"], ["k"]).collect()) == [(1, "a", 1), (1, "b", None)]
    with pytest.raises(Exception, match="different length"):
        from_lists(spark.createDataFrame([(1, ["a"], [1, 2])], "k int, n array<string>, v array<int>"), ["n", "v"]).collect()
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(tuple(r) for r in append_strict(stored, spark.createDataFrame([("c", 3)], "k string, v int"), ["k"]).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    for bad in ([("a", 3)], [("d", 1), ("d", 1)]):
        with pytest.raises(Exception, match="stored already"):
            append_strict(stored, spark.createDataFrame(bad, "k string, v int"), ["k"]).collect()
    names = spark.createDataFrame([("x", 7)], "name string, id long")
    got = ids_in_order(names, spark.createDataFrame([(0, "y"), (1, "x"), (2, "y"), (3, None)], "place int, name string"), "place")
    assert sorted(tuple(r) for r in got.collect()) == [(0, "y", 8), (1, "x", 7), (2, "y", 8)]


def test_graphs_replaced_and_dumped(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    nodes = spark.createDataFrame([(1, 1, False), (1, 2, True), (257, 5, False)], "graph_id long, node long, external boolean")
    edges = spark.createDataFrame([(1, 1, 2)], "graph_id long, src long, dst long")
    sites = spark.createDataFrame([(1, 1, 2, 7, "VIRTUAL", ["/b"]), (1, 1, 2, 3, "STATIC", [])], "graph_id long, src long, dst long, line int, call_type string, receivers array<string>")
    for _ in range(2):
        store.save(nodes, edges, sites)
    assert store.table("nodes").count() == 3 and store.table("edges").count() == 1
    assert [(r["line"], r["receivers"]) for r in store.sites(1).collect()] == [(3, []), (7, ["/b"])] and store.sites(257).count() == 0
    store.dump(1, str(tmp_path / "dump"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "dump")).collect()]
    assert lines[0] == "1 -> 2" and lines[1].startswith("1: [") and len(lines) == 2
    store.save(nodes.where("graph_id = 1").limit(1), edges.limit(0))
    assert store.load(1)[0].count() == 1 and store.load(257)[0].count() == 1 and store.sites(1).count() == 0
    store.delete(99)
    assert store.load(99) is None


def test_readers(spark, tmp_path, monkeypatch):
    from pkgloom.sources.graph_store import malformed_coordinates
    from pkgloom.sources.readers import ChainRepository, by_forge, indexed, jdbc_options, json_files, json_lines

    monkeypatch.setenv("PGPASSWORD", "x")
    options = jdbc_options("jdbc:postgresql://h/d", "packages", user="u", split="id", low=1, high=9, parts=3)
    assert options["fetchsize"] == "10000" and options["password"] == "x" and options["partitionColumn"] == "id" and options["numPartitions"] == "3"
    a, b = (spark.createDataFrame([(i,)], "id long") for i in (1, 2))
    assert by_forge({"mvn": a, "debian": b}).where("forge = 'debian'").collect() == [(2, "debian")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "one.json").write_text('{"a":\n1}')
    (tmp_path / "j" / "two.json").write_text("{")
    (tmp_path / "j" / "three.json").write_text("")
    assert {(r["file"], r["broken"]) for r in json_files(spark, str(tmp_path / "j")).collect()} >= {("one.json", False), ("two.json", True)}
    (tmp_path / "l.txt").write_text('{"a":1}\n\n  \n{\n{"a":2}\n')
    assert sorted((r["json"], r["broken"]) for r in json_lines(spark, str(tmp_path / "l.txt")).collect()) == [("{", True), ('{"a":1}', False), ('{"a":2}', False)]
    assert indexed(spark, lambda r: r, files=str(tmp_path / "l.txt")).count() == 2
    repo = ChainRepository(spark, str(tmp_path / "chains"))
    assert repo.load().count() == 0
    repo.store(spark.createDataFrame([("g:a", "1/2", "[1]"), ("g:b", "1", "[2]"), (None, "1", "[3]")], "package string, version string, json string"))
    repo.store(spark.createDataFrame([("g:a", "1/2", "[9]")], "package string, version string, json string"))
    assert [tuple(r) for r in repo.load("g:a", "1/2").collect()] == [("g:a", "1/2", "g-a-1-2.json", "[9]")] and repo.load().count() == 3
    (tmp_path / "c.txt").write_text("g:a:1\nbroken\n\nx:y\n")
    assert sorted(r[0] for r in malformed_coordinates(spark, str(tmp_path / "c.txt")).collect()) == ["broken", "x:y"]


def test_all_pairs_write_no_pair(spark, monkeypatch):
    """A ring of 200 nodes has 40,000 pairs; what is written grows with nodes and arcs, and nodes may be texts."""
    written, real = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: (out := real(self, df), written.append(out[0].count()))[0])
    n = 200
    edges = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "src long, dst long")
    assert {r["reached"] for r in g.reach_counts(edges).collect()} == {n}
    assert {round(r["closeness"] * n * (n - 1) / 2, 9) for r in g.distance_measures(edges).collect()} == {1.0}
    assert {r["betweenness"] for r in g.betweenness(edges).collect()} == {(n - 1) * (n - 2) / 2}
    assert sum(written) < n * n
    texts = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert {r["node"]: r["reached"] for r in g.reach_counts(texts).collect()} == {"a": 3, "b": 2, "c": 1}
    assert g.betweenness(edges.limit(0)).count() == 0


def test_matches_over_many_lists(spark):
    """Sets that span several lists of versions, and overlap in themselves, name each version once."""
    versions = spark.createDataFrame([(i, 1, f"{i // 2}") for i in range(20)], "id long, package_id long, version string")
    _, sets = constraint_sets(spark.createDataFrame([(100, 1, ["[1,6)", "(4,8]", "9"])], "package_version_id long, dependency_id long, version_range array<string>"))
    assert sorted(r["target"] for r in matches(sets, versions, width=3).collect()) == [*range(2, 20)]
