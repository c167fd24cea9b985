"""Parent-child links to full hierarchies: root, depth, path and descendants of every node, cycles named.

1. Leaves are peeled to expose the cycles, 2^k layers at a time: what is left of a table of single parents after
   2^k peelings is the image of the 2^k-fold parent pointer, which doubles each round.
2. The forest (cycles cut out) becomes Euler tours, one arc down and one arc up per node, linked by first child,
   next sibling and parent; siblings are linked in salted buckets, so a parent of a third of all nodes is no task.
3. Parallel list ranking (pointer doubling over the arcs that are not ranked yet) gives entry and exit places.
4. The intervals are cut into chunks of fixed length; a node goes to its own chunk and to those its interval spans,
   so each chunk starts with its open ancestors and yields depth, root and path in one pass over sorted rows.
5. The descendants of chosen nodes are the nodes that enter within their intervals, joined chunk by chunk.

Every step is a join or an aggregation on node ids; the driver sees row counts only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgloom.operators.drift import Aliases, field_aliases, profile_fields
from pkgloom.operators.jsonio import parse_object
from pkgloom.session import Scratch

CHUNK = 8192
BUCKETS = 64
SEPARATOR = " > "
HIERARCHY_SCHEMA = "coordinate string, root_coordinate string, depth int, full_path string, n_below int"
_PURL = re.compile(r"pkg:\w+/(?:(.*)/)?([^/@]+)@([^?#]+)")


def parse_coordinate(text) -> str | None:
    """group:artifact:version of a written coordinate; blanks, a packaging part and a purl's dress do not count."""
    if not isinstance(text, str):
        return None
    text = "".join(text.split())
    m = _PURL.match(text)
    if m:
        parts = [unquote(x or "").replace("/", ".") for x in m.groups()]
    else:
        parts = text.split("@")[0].split(":")
        if not 3 <= len(parts) <= 5:
            return None
        parts = [parts[0], parts[1], parts[-1]]
    return ":".join(parts) if all(parts) else None


def coordinate_names(messages: DataFrame) -> Aliases:
    """The keys under which messages bear their coordinate and its parent."""
    wanted = ["payload", "payload.groupId", "payload.artifactId", "payload.version", "payload.parentCoordinate"]
    return field_aliases(profile_fields(messages, within={"", "payload."}), wanted)


def coordinate_links(messages: DataFrame, names: Aliases | None = None) -> DataFrame:
    """(node, parent) of every message; renamed keys are followed (names: found in the messages themselves by default).

    Messages that are no JSON object, or lack a part of their own coordinate, name nothing.
    """
    names = names or coordinate_names(messages)

    def get(obj: dict, of: dict[str, list[str]], field: str):
        return next((obj[k] for k in of[field] if k in obj), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[str, str | None], None] = {}
            for text, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m, of = parse_object(text), names.of(part)
                p = m and get(m, of, "payload")
                if not isinstance(p, dict):
                    continue
                own = [get(p, of, f"payload.{k}") for k in ("groupId", "artifactId", "version")]
                own = ":".join("".join(x.split()) for x in own) if all(isinstance(x, str) and x.strip() for x in own) else None
                parent = parse_coordinate(get(p, of, "payload.parentCoordinate"))
                if own:
                    out[own, parent] = None
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in out], pa.string()) for i in (0, 1)], names=["node", "parent"])

    return messages.select(F.col("message").cast("string"), F.col("topic_partition").cast("int")).mapInArrow(run, "node string, parent string")


class Placed(NamedTuple):
    """nodes: id, pid, name; forest: id, name, root, hung, enter, leave; cycle: id, pid of the nodes on cycles, or None."""

    nodes: DataFrame
    forest: DataFrame
    cycle: DataFrame | None
    scratch: Scratch


def place(links: DataFrame, buckets: int = BUCKETS) -> Placed:
    """Steps 1 to 3 for ``links`` (node, parent: strings)."""
    spark = links.sparkSession
    scratch = Scratch(spark)
    both = F.array(F.struct("node", "parent"), F.struct(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
    pairs = links.where("node IS NOT NULL").select(F.inline(both)).where("node IS NOT NULL")  # a union would read the links twice
    named, _ = scratch.write(pairs.groupBy("node").agg(F.min("parent").alias("parent")))
    for seed in range(8):  # 62 bits of hash as node id, checked to be unique
        key = lambda c, s=seed: F.shiftrightunsigned(F.xxhash64(F.lit(s), F.col(c)), 2)
        nodes, at = scratch.write(named.select(key("node").alias("id"), F.when(F.col("parent").isNotNull(), key("parent")).alias("pid"), F.col("node").alias("name")))
        if nodes.groupBy("id").count().where("count > 1").isEmpty():
            break
        scratch.drop(at)
    tree, cycle = _cut_cycles(nodes, scratch)
    ranked = _euler_ranks(tree, scratch, buckets)
    forest, _ = scratch.write(nodes.drop("pid").join(ranked, "id"))
    return Placed(nodes, forest, cycle, scratch)


def hierarchies(links: DataFrame, chunk: int = CHUNK, buckets: int = BUCKETS) -> DataFrame:
    """HIERARCHY_SCHEMA for every node of ``links`` (node, parent: strings).

    Of several parents the smallest counts, and ``further_parents`` names the others; null nodes are left out; repeated
    rows change nothing. A node on or below a cycle has depth -1 and empty root and path; n_below of a node on a cycle
    counts all others of the cycle and whatever hangs on it.
    """
    p = place(links, buckets)
    out = _paths(p.forest, chunk)
    return out if p.cycle is None else out.unionByName(_on_cycles(p))


def further_parents(links: DataFrame) -> DataFrame:
    """(node, kept, further): the parents that a node names beside the one that counts, each once."""
    named = links.where("node IS NOT NULL AND parent IS NOT NULL")
    kept = named.groupBy("node").agg(F.min("parent").alias("kept"), F.max("parent").alias("last")).where("kept < last").select("node", "kept")
    return named.join(kept, "node").where("parent <> kept").select("node", "kept", F.col("parent").alias("further")).distinct()


def descendants(placed: Placed, chosen: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, descendant) for every node of ``chosen`` (node: string), each pair once.

    A descendant enters the tour within its ancestor's interval. Both are joined by tree and chunk of the tour, so no
    task holds more of a tree than a chunk. On a cycle the others of the cycle and whatever hangs on it are descendants.
    """
    div = lambda c: F.call_function("div", F.col(c), F.lit(chunk))
    wanted = chosen.select("node").where("node IS NOT NULL").distinct()
    f = placed.forest
    above = f.join(wanted, f["name"] == F.col("node"), "left_semi").where("enter - leave > 1")
    above = above.select("root", F.col("name").alias("node"), F.col("enter").alias("e"), F.col("leave").alias("l"), F.explode(F.sequence(div("leave"), div("enter"))).alias("c"))
    below = f.select("root", F.col("name").alias("descendant"), "enter", "leave", div("enter").alias("c"))
    out = above.join(below, ["root", "c"]).where("enter < e AND leave > l").select("node", "descendant")
    if placed.cycle is None:
        return out
    ring = _rings(placed).join(placed.nodes.select("id", "name"), "id").select("id", "low", "name")
    on = ring.join(wanted, F.col("name") == F.col("node"), "left_semi").select("low", F.col("name").alias("node"))
    trees = f.where("hung IS NOT NULL AND leave = 0").select("root", F.col("hung").alias("id")).join(ring.select("id", "low"), "id").select("root", "low")
    hanging = f.join(trees, "root").select("low", F.col("name").alias("descendant"))
    around = ring.select("low", F.col("name").alias("descendant")).unionByName(hanging)
    return out.unionByName(on.join(around, "low").where("node <> descendant").select("node", "descendant"))


def _cut_cycles(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(id, tp, hung of the forest nodes; id, pid of those on cycles, or None).

    tp: the parent within the forest, null at its roots; hung: the parent on a cycle that a root hangs on.
    """
    links = nodes.select("id", "pid")
    # up: the ancestor 2^k steps above; null once the root has been passed, with which the node is known to be acyclic
    active, at, left = scratch.counted(links.where("pid IS NOT NULL").select("id", F.col("pid").alias("up")))
    while left:
        step = active.alias("a").join(active.alias("b"), F.col("a.up") == F.col("b.id")).select("a.id", F.col("b.up").alias("up"))
        after, at_after, remain = scratch.counted(step)  # inner join: a node whose pointer leaves the active ones ends at a root
        scratch.drop(at)
        active, at = after, at_after
        if remain == left:
            break
        left = remain
    if not left:
        return links.select("id", F.col("pid").alias("tp"), F.lit(None).cast("long").alias("hung")), None
    images = active.select("up").distinct().count()
    while True:  # the image of the pointer shrinks until only cycles are left
        step = active.alias("a").join(active.alias("b"), F.col("a.up") == F.col("b.id")).select("a.id", F.col("b.up").alias("up"))
        active, _ = scratch.write(step)
        now = active.select("up").distinct().count()
        if now == images:
            break
        images = now
    on, _ = scratch.write(active.select(F.col("up").alias("id")).distinct())
    cycle, _ = scratch.write(links.join(on, "id", "left_semi"))
    apart = links.join(on, "id", "left_anti").join(on.select(F.col("id").alias("cid")), F.col("pid") == F.col("cid"), "left")
    tree, _ = scratch.write(apart.select("id", F.when(F.col("cid").isNull(), F.col("pid")).alias("tp"), F.col("cid").alias("hung")))
    return tree, cycle


def _euler_ranks(tree: DataFrame, scratch: Scratch, buckets: int) -> DataFrame:
    """(id, root, hung, enter, leave): arcs left in the tour of the root's tree from the node's way down and up.

    enter counts from the end, so an ancestor has the larger enter and the smaller leave.
    """
    kids = tree.where("tp IS NOT NULL").select("id", "tp", F.pmod(F.hash("id"), F.lit(buckets)).alias("b"))
    w = Window.partitionBy("tp", "b").orderBy("id")
    linked, at_linked = scratch.write(kids.withColumns({"nxt": F.lead("id").over(w), "head": F.row_number().over(w) == 1}))
    v = Window.partitionBy("tp").orderBy("b")  # at most ``buckets`` rows a parent
    heads = linked.where("head").select("tp", "b", F.col("id").alias("first")).withColumns({"next_head": F.lead("first").over(v), "eldest": F.row_number().over(v) == 1})
    heads, at_heads = scratch.write(heads)
    tails = linked.where("nxt IS NULL").join(heads.select("tp", "b", "next_head"), ["tp", "b"]).select("id", "tp", F.col("next_head").alias("sib"))
    siblings = linked.where("nxt IS NOT NULL").select("id", "tp", F.col("nxt").alias("sib")).unionByName(tails)
    eldest = heads.where("eldest").select(F.col("tp").alias("id"), F.col("first").alias("child"))
    down = tree.select("id").join(eldest, "id", "left").select(F.shiftleft("id", 1).alias("arc"), F.coalesce(F.shiftleft("child", 1), F.shiftleft("id", 1).bitwiseOR(F.lit(1))).alias("nxt"))
    up = siblings.select(F.shiftleft("id", 1).bitwiseOR(F.lit(1)).alias("arc"), F.coalesce(F.shiftleft("sib", 1), F.shiftleft("tp", 1).bitwiseOR(F.lit(1))).alias("nxt"))
    ends = tree.where("tp IS NULL").select(F.shiftleft("id", 1).bitwiseOR(F.lit(1)).alias("arc"), F.col("id").alias("root"), F.lit(0).cast("long").alias("dist"))
    active, at, left = scratch.counted(down.unionByName(up).withColumn("dist", F.lit(1).cast("long")))
    known, at_known = scratch.write(ends)  # ranked arcs of the tours that are not wholly ranked
    finished, reach = [known], 1
    while left:
        ahead = active.select(F.col("arc").alias("to"), F.col("nxt").alias("further"), F.col("dist").alias("more"), F.lit(None).cast("long").alias("root"))
        ended = known.select(F.col("arc").alias("to"), F.lit(None).cast("long").alias("further"), F.col("dist").alias("more"), "root")
        step = active.join(ahead.unionByName(ended), F.col("nxt") == F.col("to")).select("arc", F.col("further").alias("nxt"), (F.col("dist") + F.col("more")).alias("dist"), "root")
        both, at_both, left = scratch.counted(step, "root IS NULL")
        fresh = both.where("root IS NOT NULL").select("arc", "root", "dist")
        finished.append(fresh)
        reach *= 2  # now every arc less than ``reach`` from its end is ranked, and the others point ``reach`` ahead
        still = both.where("root IS NULL").select("arc", "nxt", "dist")
        if left:
            unfinished = fresh.where(F.col("dist") == reach - 1).select("root")
            known, at_next = scratch.write(known.unionByName(fresh).join(unfinished, "root", "left_semi").select("arc", "root", "dist"))
            if reach > 2:
                scratch.drop(at_known)
            at_known = at_next
        if reach == 2:
            scratch.drop(at)
        active = still
    scratch.drop(at_linked)
    scratch.drop(at_heads)
    arcs = finished[0]
    for x in finished[1:]:
        arcs = arcs.unionByName(x)
    odd = F.col("arc").bitwiseAND(F.lit(1)) == 1
    ranks = arcs.groupBy(F.shiftright("arc", 1).alias("id")).agg(F.max("root").alias("root"), F.max(F.when(~odd, F.col("dist"))).alias("enter"), F.max(F.when(odd, F.col("dist"))).alias("leave"))
    return ranks.join(tree.select("id", "hung"), "id")


def _paths(placed: DataFrame, chunk: int) -> DataFrame:
    """Rows of HIERARCHY_SCHEMA for the forest, from names and intervals."""
    spans = placed.withColumn("c", F.explode(F.sequence(F.call_function("div", F.col("leave"), F.lit(chunk)), F.call_function("div", F.col("enter"), F.lit(chunk)))))
    rows = spans.select("root", "c", F.col("enter"), "leave", "name", F.col("hung").isNotNull().alias("hung"), (F.col("c") == F.call_function("div", F.col("enter"), F.lit(chunk))).alias("own"))
    rows = rows.repartition("root", "c").sortWithinPartitions("root", "c", F.desc("enter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []  # stack: (leave, name, path)
        lost = False
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            weight = 0
            for root, c, enter, leave, name, hung, own in zip(*(x.to_pylist() for x in batch.columns)):
                if at != (root, c):
                    at, stack, lost = (root, c), [], hung
                while stack and stack[-1][0] > enter:
                    stack.pop()
                path = f"{stack[-1][1]}{SEPARATOR}{name}" if stack else name
                if own:
                    below = (enter - leave - 1) // 2
                    row = (name, "", -1, "", below) if lost else (name, stack[0][2] if stack else name, len(stack), path, below)
                    for x, y in zip(cols, row):
                        x.append(y)
                    weight += len(path)
                stack.append((leave, path, name))
                if weight > 16_000_000:
                    yield _batch(cols)
                    cols, weight = [[] for _ in range(5)], 0
            yield _batch(cols)

    return rows.mapInArrow(run, HIERARCHY_SCHEMA)


def _batch(cols: list[list]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["coordinate", "root_coordinate", "depth", "full_path", "n_below"])


def _rings(placed: Placed) -> DataFrame:
    """(id, low) of the nodes on cycles: a cycle is known by its smallest id, found by doubling over the cycle."""
    low = placed.cycle.select("id", F.col("pid").alias("up"), F.least("id", "pid").alias("low"))
    low, _ = placed.scratch.write(low)
    while True:
        step = low.alias("a").join(low.alias("b"), F.col("a.up") == F.col("b.id")).select("a.id", F.col("b.up").alias("up"), F.least("a.low", "b.low").alias("low"), (F.col("a.low") > F.col("b.low")).alias("moved"))
        after, _, moved = placed.scratch.counted(step, "moved")
        low = after.select("id", "up", "low")
        if not moved:
            return low.select("id", "low")


def _on_cycles(placed: Placed) -> DataFrame:
    """Rows of HIERARCHY_SCHEMA for the nodes on cycles."""
    low = _rings(placed)
    hanging = placed.forest.where("hung IS NOT NULL AND leave = 0").groupBy(F.col("hung").alias("id")).agg(F.sum((F.col("enter") - F.col("leave") + 1) / 2).cast("long").alias("n"))
    sizes = low.join(hanging, "id", "left").groupBy("low").agg((F.count(F.lit(1)) + F.coalesce(F.sum("n"), F.lit(0))).alias("size"))
    rows = low.join(sizes, "low").join(placed.nodes.select("id", "name"), "id")
    return rows.select(F.col("name").alias("coordinate"), F.lit("").alias("root_coordinate"), F.lit(-1).cast("int").alias("depth"), F.lit("").alias("full_path"), (F.col("size") - 1).cast("int").alias("n_below"))
