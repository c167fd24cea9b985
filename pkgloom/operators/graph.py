"""Graphs as edge tables (src, dst): access, traversal, search scores, centralities, clustering.

Loops keep only their frontier or their score table, written to the shared checkpoint folder each few rounds, and stop
when the frontier is empty, the change falls below a tolerance, or the given number of rounds is done.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgloom.operators import labels as by_tasks
from pkgloom.operators.all_pairs import INTEGERS, Stored, distance_sums, path_shares, stored
from pkgloom.session import Scratch, cut

ROUNDS = 1000
TOLERANCE = 1e-7


# ---- access and construction


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrize(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(transpose(edges)).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, indegree, outdegree): one pass, each edge counted at both ends before the shuffle."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("node").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))


def integrity_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(error, a, b) for duplicate nodes, duplicate arcs and arcs whose ends are no nodes."""
    null = F.lit(None).cast("long")
    dup_node = nodes.groupBy("node").count().where("count > 1").select(F.lit("duplicate node").alias("error"), F.col("node").alias("a"), null.alias("b"))
    dup_arc = edges.groupBy("src", "dst").count().where("count > 1").select(F.lit("duplicate arc").alias("error"), F.col("src").alias("a"), F.col("dst").alias("b"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    unknown = ends.join(nodes, "node", "left_anti").select(F.lit("unknown node").alias("error"), F.col("node").alias("a"), null.alias("b"))
    return dup_node.unionByName(dup_arc).unionByName(unknown)


def prefix_sums(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with upto: the sum of ``value`` over all rows up to this one in the order of ``key`` (unique).

    Rows are range-partitioned by the key and summed within the partitions; only the partitions' totals, one row
    each, meet in one task.
    """
    parts = cut(rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("_part").agg(F.sum(value).alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0))).select("_part", "_before")
    local = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("_in", F.sum(value).over(local)).join(F.broadcast(before), "_part").withColumn("upto", F.col("_before") + F.col("_in")).drop("_part", "_before", "_in")


def renumber(nodes: DataFrame) -> DataFrame:
    """(node, number): dense numbers from 0 in node order."""
    rows = prefix_sums(nodes.select("node").distinct().withColumn("one", F.lit(1).cast("long")), "node", "one")
    return rows.select("node", (F.col("upto") - 1).alias("number"))


# ---- traversal


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node, dist): shortest distances from the seeds (keys, node), dist 0 for the seeds in the graph.

    With keys, one search per key value runs in the same rounds. Seeds outside the graph are ignored. Each round
    expands the last frontier only and drops what was reached before, so a cycle ends.
    """
    scratch = Scratch(edges.sparkSession)
    edges, _ = scratch.write(edges.select("src", "dst").distinct())
    on = [*keys, "node"]
    start = seeds.select(*on).distinct().join(nodes_of(edges), "node", "left_semi").select(*on)
    frontier, _ = scratch.write(start.withColumn("dist", F.lit(0)))
    levels, depth, n = [frontier], 0, nodes_of(edges).count() if keys else 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        if keys:  # a search that has reached every node is over
            whole = reduce(DataFrame.unionByName, levels).groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= n)
            frontier = frontier.join(whole.select(*keys), list(keys), "left_anti")
        step = frontier.join(edges, F.col("node") == F.col("src")).select(*keys, F.col("dst").alias("node")).distinct()
        reached = reduce(DataFrame.unionByName, levels).select(*on)
        frontier, _ = scratch.write(step.join(reached, on, "left_anti").withColumn("dist", F.lit(depth)))
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels)


class Reach(NamedTuple):
    """A reachability question: what ``node`` reaches, or what reaches it, within ``max_depth`` steps."""

    edges: DataFrame
    node: int
    forward: bool = True
    max_depth: int | None = None

    def run(self) -> DataFrame:
        """(node, dist)"""
        seed = self.edges.sparkSession.createDataFrame([(self.node,)], "node long")
        return bfs(self.edges if self.forward else transpose(self.edges), seed, self.max_depth)


def trivial_score(indegree: str = "indegree", outdegree: str = "outdegree", dist: str = "dist") -> Column:
    return (F.col(indegree) + F.col(outdegree)) / F.log2(F.col(dist) + F.lit(2.0))


def search(edges: DataFrame, seeds: DataFrame, forward: bool = True, max_depth: int | None = None, keep: Column | None = None, score: Callable[[], Column] = trivial_score, top: int | None = None) -> DataFrame:
    """(node, dist, indegree, outdegree, score) of the nodes reached, best first.

    The filter ``keep`` decides what is shown, not what is walked through; seeds are walked from, never shown.
    """
    found = bfs(edges if forward else transpose(edges), seeds, max_depth).where("dist > 0")
    rows = found.join(degrees(edges.select("src", "dst").distinct()), "node").withColumn("score", score())
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.select("node", "dist", "indegree", "outdegree", "score").orderBy(F.desc("score"), "node")
    return rows if top is None else rows.limit(top)


def search_within(edges: DataFrame, homes: DataFrame, revisions: DataFrame, seeds: DataFrame | None = None, forward: bool = True, **options) -> DataFrame:
    """``search`` in the graph of some revisions only: the arcs whose ends both live there.

    homes: (node, revision), a node living in any number of revisions. revisions: (revision), the first ones being
    those searched from where no seeds are given: then every node of theirs is a seed (column ``root`` true).
    """
    inside = homes.join(revisions.select("revision"), "revision", "left_semi").select("node").distinct()
    kept = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    if seeds is None:
        seeds = homes.join(revisions.where("root").select("revision"), "revision", "left_semi").select("node").distinct()
    return search(cut(kept), seeds, forward, **options)


def search_dependents(edges: DataFrame, homes: DataFrame, resolved: DataFrame, root: DataFrame, **options) -> DataFrame:
    """``search`` backward from the nodes of the root revision in the graph of each of its dependents.

    homes: (node, revision). resolved: (dependent, revision), each dependent's own revision and all that it resolves to,
    for the root too. root: (revision), one row. A dependent that doesn't resolve to the root is left out. A node found
    in several graphs is shown as in that of the smallest dependent.
    """
    scratch = Scratch(edges.sparkSession)
    true = resolved.join(F.broadcast(root.select("revision")), "revision", "left_semi").select("dependent").distinct()
    inside, _ = scratch.write(resolved.join(true, "dependent", "left_semi").join(homes, "revision").select("dependent", "node").distinct())
    kept = edges.join(inside.withColumnRenamed("node", "src"), "src").join(inside.withColumnRenamed("node", "dst"), ["dependent", "dst"], "left_semi")
    at = lambda end: F.struct("dependent", F.col(end).alias("node")).alias(end)
    kept, _ = scratch.write(kept.select(at("src"), at("dst")))
    own = homes.join(F.broadcast(root.select("revision")), "revision", "left_semi").select("node").distinct()
    seeds = inside.join(own, "node", "left_semi").select(F.struct("dependent", "node").alias("node"))
    found = search(kept, seeds, False, **options)
    row = F.struct("dist", "indegree", "outdegree", "score")
    first = found.groupBy("node.node").agg(F.min_by(row, "node.dependent").alias("r"))
    return first.select("node", "r.*").orderBy(F.desc("score"), "node")


def reach_counts(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, reached): how many nodes each node reaches, itself included."""
    edges, name = _numbered(edges)
    return name(distance_sums(stored(transpose(edges)), max_depth).select("node", F.col("n").alias("reached")))


def _numbered(edges: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Arcs between integers, and how to name the nodes of a result again."""
    if {t for k, t in edges.dtypes if k in ("src", "dst")} <= INTEGERS:
        return edges, lambda rows: rows
    number = cut(renumber(nodes_of(edges)))
    a, b = number.select(F.col("node").alias("src"), F.col("number").alias("s")), number.select(F.col("node").alias("dst"), F.col("number").alias("t"))
    arcs = edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))
    return arcs, lambda rows: rows.withColumnRenamed("node", "number").join(number, "number").select("node", *[c for c in rows.columns if c != "node"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each weakly connected component, by pointer jumping over neighbour minima."""
    scratch = Scratch(edges.sparkSession)
    links, _ = scratch.write(symmetrize(edges))
    labels, at = scratch.write(nodes_of(links).withColumn("component", F.col("node")))
    while True:
        near = links.join(labels, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after, at_after = scratch.write(lower.join(jump, "component").select("node", "was", F.col("up").alias("component")))
        moved = after.where("was <> component").isEmpty()
        scratch.drop(at)
        labels, at = after.select("node", "component"), at_after
        if moved:
            return labels


# ---- measures on distances


def distances(edges: DataFrame) -> DataFrame:
    """(source, node, dist) for all pairs with a path, without the pairs of a node with itself."""
    starts = nodes_of(edges).select(F.col("node").alias("source"), "node")
    return bfs(edges, starts, None, ("source",)).where("dist > 0")


def distance_measures(edges: DataFrame) -> DataFrame:
    """(node, closeness, lin, harmonic) over incoming paths; a node that nothing reaches has 0, 1 and 0."""
    edges, name = _numbered(edges)
    arcs = stored(edges)
    rows = arcs.nodes.join(distance_sums(arcs), "node", "left")
    reach = F.col("n")
    return name(rows.select(
        "node", F.when(F.col("s") > 0, 1.0 / F.col("s")).otherwise(0.0).alias("closeness"), F.when(F.col("s") > 0, reach * reach / F.col("s")).otherwise(1.0).alias("lin"), F.coalesce("h", F.lit(0.0)).alias("harmonic")
    ))


def query_measures(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(node, closeness, harmonic) over paths from weighted query nodes (node, weight).

    closeness 1 / sum(dist / weight) where that sum is positive; harmonic sum(weight / dist) without the query node itself.
    """
    q = queries.select(F.col("node").alias("source"), "node", "weight")
    found = bfs(edges, q.select("source", "node"), None, ("source",)).join(q.select("source", "weight"), "source")
    per = found.groupBy("node").agg(F.sum(F.col("dist") / F.col("weight")).alias("s"), F.sum(F.when(F.col("dist") > 0, F.col("weight") / F.col("dist")).otherwise(0.0)).alias("harmonic"))
    return per.where("s > 0").select("node", (1.0 / F.col("s")).alias("closeness"), "harmonic")


def betweenness(edges: DataFrame) -> DataFrame:
    """(node, betweenness) by counting shortest paths forward from every source and accumulating backwards."""
    edges, name = _numbered(edges)
    return name(path_shares(stored(edges)))


def clustering(edges: DataFrame) -> DataFrame:
    """(node, clustering) on the symmetrized graph: linked pairs of neighbours over pairs of neighbours.

    Triangles are counted once each, on edges directed from the lower to the higher degree, which bounds the pairs
    formed at a node of high degree.
    """
    und = cut(symmetrize(edges).where("src <> dst"))
    deg = und.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    a, b = deg.select(F.col("src").alias("s"), F.col("k").alias("ks")), deg.select(F.col("src").alias("t"), F.col("k").alias("kt"))
    up = cut(und.join(a, F.col("src") == F.col("s")).join(b, F.col("dst") == F.col("t")).where("ks < kt OR (ks = kt AND src < dst)").select("src", "dst"))
    wedges = up.select(F.col("src").alias("x"), F.col("dst").alias("y")).join(up.select(F.col("src").alias("x2"), F.col("dst").alias("z")), (F.col("x") == F.col("x2"))).where("y <> z")
    triangles = wedges.join(up, (F.col("y") == F.col("src")) & (F.col("z") == F.col("dst")))
    per = triangles.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    rows = deg.withColumnRenamed("src", "node").join(per, "node", "left")
    return rows.select("node", F.when(F.col("k") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"))


# ---- spectral measures


def _iterate(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, tolerance: float) -> DataFrame:
    """Repeats ``step`` on (node, x) until the sum of changes is below the tolerance (0: never) or the rounds are done."""
    scratch = Scratch(start.sparkSession)
    x, at = scratch.write(start)
    for _ in range(rounds):
        after, at_after = scratch.write(step(x))
        if tolerance:
            moved = after.join(x.withColumnRenamed("x", "was"), "node").agg(F.sum(F.abs(F.col("x") - F.col("was")))).first()[0] or 0.0
            if moved <= tolerance:
                return after
        scratch.drop(at)
        x, at = after, at_after
    return x


def _pull(x: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, pulled): the sum of x over the arcs that end in a node."""
    return x.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.sum("x").alias("pulled")).withColumnRenamed("to", "node")


def _prepared(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    edges = cut(edges.select("src", "dst").distinct())
    return edges, cut(nodes_of(edges))


def pagerank(edges: DataFrame, alpha: float = 0.85, preference: DataFrame | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, x). Rank of dangling nodes goes to the preference (node, weight), uniform if none is given."""
    edges, nodes = _prepared(edges)
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    weighted = cut(edges.join(out, "src"))
    if preference is None:
        p = nodes.withColumn("p", F.lit(1.0 / max(n, 1)))
    else:
        total = preference.agg(F.sum("weight")).first()[0]
        p = nodes.join(preference.select("node", (F.col("weight") / total).alias("p")), "node", "left").fillna(0.0, ["p"])
    p = cut(p)

    def step(x: DataFrame) -> DataFrame:
        flow = x.join(weighted, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("x") / F.col("k")).alias("f"))
        lost = x.join(out, F.col("node") == F.col("src"), "left_anti").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("lost"))
        rows = p.join(flow, F.col("node") == F.col("to"), "left").join(F.broadcast(lost))
        return rows.select("node", (F.lit(1 - alpha) * F.col("p") + alpha * (F.coalesce("f", F.lit(0.0)) + F.col("lost") * F.col("p"))).alias("x"))

    return _iterate(p.select("node", F.col("p").alias("x")), step, rounds, tolerance)


def katz(edges: DataFrame, alpha: float, preference: DataFrame | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, x) with x = alpha * (sum of x over incoming arcs) + preference, 1 everywhere if none is given."""
    edges, nodes = _prepared(edges)
    v = nodes.withColumn("p", F.lit(1.0)) if preference is None else nodes.join(preference.select("node", F.col("weight").cast("double").alias("p")), "node", "left").fillna(0.0, ["p"])
    v = cut(v)
    return _iterate(v.select("node", F.col("p").alias("x")), lambda x: v.join(_pull(x, edges), "node", "left").select("node", (F.col("p") + alpha * F.coalesce("pulled", F.lit(0.0))).alias("x")), rounds, tolerance)


def _normalised(rows: DataFrame, norm: Column) -> DataFrame:
    total = rows.agg(norm.alias("norm"))
    return rows.join(F.broadcast(total)).select("node", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(F.col("x")).alias("x"))


def _l1() -> Column:
    return F.sum(F.abs("x"))


def _l2() -> Column:
    return F.sqrt(F.sum(F.col("x") * F.col("x")))


def eigenvector(edges: DataFrame, markovian: bool = False, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, x): dominant left eigenvector by the power method; markovian: of the row-normalised matrix (Seeley)."""
    edges, nodes = _prepared(edges)
    weighted = edges
    if markovian:
        weighted = cut(edges.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("k")), "src"))

    def step(x: DataFrame) -> DataFrame:
        share = F.col("x") / F.col("k") if markovian else F.col("x")
        pulled = x.join(weighted, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.sum(share).alias("f"))
        return _normalised(nodes.join(pulled, F.col("node") == F.col("to"), "left").select("node", F.coalesce("f", F.lit(0.0)).alias("x")), _l1() if markovian else _l2())

    n = nodes.count()
    return _iterate(nodes.withColumn("x", F.lit(1.0 / max(n, 1))), step, rounds, tolerance)


def hits(edges: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, x): authority scores, L2-normalised; hubs are the authorities of the transpose."""
    edges, nodes = _prepared(edges)
    back = transpose(edges)

    def step(x: DataFrame) -> DataFrame:
        hub = _pull(x, back).withColumnRenamed("pulled", "x")
        return _normalised(nodes.join(_pull(hub, edges), "node", "left").select("node", F.coalesce("pulled", F.lit(0.0)).alias("x")), _l2())

    return _iterate(nodes.withColumn("x", F.lit(1.0)), step, rounds, tolerance)


def salsa(edges: DataFrame) -> DataFrame:
    """(node, x): in closed form, the share of a node's arcs in its component of the co-citation graph, times the component's share of the nodes that are pointed to."""
    edges, nodes = _prepared(edges)
    two_sided = edges.select((F.col("src") * 2 + 1).alias("src"), (F.col("dst") * 2).alias("dst"))
    comp = components(two_sided).where("node % 2 = 0").select((F.col("node") / 2).cast("long").alias("node"), "component")
    indegree = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    rows = comp.join(indegree, "node")
    per = rows.groupBy("component").agg(F.sum("k").alias("arcs"), F.count(F.lit(1)).alias("size"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    scored = rows.join(per, "component").join(F.broadcast(total)).select("node", (F.col("size") / F.col("total") * F.col("k") / F.col("arcs")).alias("x"))
    return nodes.join(scored, "node", "left").select("node", F.coalesce("x", F.lit(0.0)).alias("x"))


# ---- clustering and ordering


def label_propagation(edges: DataFrame | Stored, gamma: float = 0.0, rounds: int = 100, gain: float = 0.001, seed: int = 1) -> DataFrame:
    """(node, label): each round a node takes the neighbour label that maximises freq - gamma * (volume + 1 - freq).

    Ties go by a hash of label, node and seed. To keep two nodes from swapping labels for ever, only the half of the
    nodes chosen by the round's hash may move. Ends when less than ``gain`` of the nodes moved in two rounds.
    Stored arcs, which have both directions and no loops, are gone through in one task, when the table is read.
    """
    if isinstance(edges, Stored):
        return by_tasks.propagated(edges, gamma, rounds, gain, seed)
    scratch = Scratch(edges.sparkSession)
    links, _ = scratch.write(symmetrize(edges).where("src <> dst"))
    labels, at = scratch.write(nodes_of(links).withColumn("label", F.col("node")))
    n = labels.count()
    quiet = 0
    for r in range(rounds):
        volume = labels.groupBy("label").agg(F.count(F.lit(1)).alias("vol"))
        freq = links.join(labels, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to"), "label").agg(F.count(F.lit(1)).alias("f"))
        scored = freq.join(volume, "label").withColumn("v", F.col("f") - gamma * (F.col("vol") + 1 - F.col("f")))
        best = scored.groupBy("to").agg(F.max(F.struct("v", F.xxhash64("label", "to", F.lit(seed)).alias("h"), "label")).alias("b")).select(F.col("to").alias("node"), F.col("b.label").alias("new"))
        may = F.pmod(F.xxhash64("node", F.lit(seed + r)), F.lit(2)) == 0
        after, at_after = scratch.write(labels.join(best, "node", "left").select("node", F.col("label").alias("was"), F.when(may & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("label")).alias("label")))
        moved = after.where("was <> label").count()
        scratch.drop(at)
        labels, at = after.select("node", "label"), at_after
        quiet = quiet + 1 if moved <= gain * n else 0
        if quiet == 2:
            break
    return labels


def log_gap_cost(edges: DataFrame | Stored, order: DataFrame | list[str]) -> DataFrame:
    """(cost): sum of ceil(log2 |gap|) between successive neighbours under an ordering (node, number), for stored arcs in files."""
    if isinstance(edges, Stored):
        return by_tasks.gap_costs(edges, order)
    a, b = order.select(F.col("node").alias("src"), F.col("number").alias("s")), order.select(F.col("node").alias("dst"), F.col("number").alias("t"))
    w = Window.partitionBy("s").orderBy("t")
    gaps = edges.join(a, "src").join(b, "dst").select("s", "t").withColumn("gap", F.abs(F.col("t") - F.coalesce(F.lag("t").over(w), F.col("s"))))
    return gaps.agg(F.coalesce(F.sum(F.ceil(F.log2(F.greatest(F.col("gap"), F.lit(1))))), F.lit(0)).cast("long").alias("cost"))


GAMMAS = (*(2.0**-k for k in range(11)), 0.0)


def _combined(labels: DataFrame, major: DataFrame) -> DataFrame:
    """(node, label): the nodes that share both labels, numbered in the order of the label of the major label's node, then the major label, then the label."""
    both = labels.join(major.select("node", F.col("label").alias("major")), "node").join(labels.select(F.col("node").alias("major"), F.col("label").alias("first")), "major")
    key = F.struct("first", "major", "label").alias("node")
    numbers = renumber(both.select(key)).select(F.col("node").alias("k"), "number")
    return both.select("node", key.alias("k")).join(numbers, "k").select("node", F.col("number").alias("label"))


def _ordered_by_tasks(arcs: Stored, gammas: tuple[float, ...], **options) -> DataFrame | None:
    """(node, number): ``layered_order`` of a graph that fits in a task, else None; all propagations in one job, all gap costs in another."""
    if not 0 < arcs.n <= by_tasks.NODES:
        return None
    spark = arcs.scratch.spark
    table = spark.read.parquet(*[path for path, *_ in arcs.arc_files])
    if 2 * table.count() > by_tasks.LINKS:
        return None
    links = stored(table.unionByName(transpose(table)).where("src <> dst"))
    if not links.n:
        return None
    numbered = lambda tables: reduce(DataFrame.unionByName, [t.withColumn("k", F.lit(k)) for k, t in enumerate(tables)])
    found, _ = links.scratch.write(numbered(label_propagation(links, gamma, **options) for gamma in gammas))
    files = {r["k"]: r["p"] for r in found.groupBy("k").agg(F.collect_set("_metadata.file_path").alias("p")).collect()}
    if len({p for of in files.values() for p in of}) < sum(map(len, files.values())):
        raise RuntimeError("labels of several gammas are in one file")
    costs = numbered(log_gap_cost(arcs, files[k]) for k in range(len(gammas))).collect()
    return links.scratch.write(by_tasks.combined(links, [files[k] for _, k in sorted((-r["cost"], r["k"]) for r in costs)]))[0]


def layered_gap_cost(edges: DataFrame, gammas: tuple[float, ...] = GAMMAS, **options) -> DataFrame:
    """(cost): gap cost of the layered order; edges may repeat."""
    arcs = stored(_numbered(edges)[0])
    order = _ordered_by_tasks(arcs, gammas, **options)
    if order is not None:
        return log_gap_cost(arcs, order.inputFiles())
    edges, _ = Scratch(edges.sparkSession).write(edges.select("src", "dst").distinct())
    return log_gap_cost(edges, layered_order(edges, gammas, **options))


def layered_order(edges: DataFrame, gammas: tuple[float, ...] = GAMMAS, **options) -> DataFrame:
    """(node, number): label propagation at each gamma, combined in the order of their gap costs, the least last and again after each."""
    arcs, name = _numbered(edges)
    order = _ordered_by_tasks(stored(arcs), gammas, **options)
    if order is not None:
        kind = dict(edges.dtypes)["src"]
        return name(order.withColumnRenamed("number", "place")).select(F.col("node").cast(kind).alias("node"), F.col("place").alias("number"))
    scratch = Scratch(edges.sparkSession)
    edges, _ = scratch.write(edges.select("src", "dst").distinct())
    order = lambda labels: renumber(labels.select(F.struct("label", "node").alias("node"))).select("node.node", "number")
    layers = []
    for k, gamma in enumerate(gammas):
        labels, _ = scratch.write(label_propagation(edges, gamma, **options))
        layers.append((-log_gap_cost(edges, order(labels)).first()[0], k, labels))
    layers = [x[2] for x in sorted(layers, key=lambda x: x[:2])]
    best = layers[-1]
    labels, at = best, None
    for layer in layers:
        for major in (layer, best):
            after, at_after = scratch.write(_combined(labels, major))
            if at:
                scratch.drop(at)
            labels, at = after, at_after
    return order(labels)
