"""Composite pipelines (N1-N15) and what is left of the graph operators (G7, G8, G17, C2, L2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgloom.functions import uri
from pkgloom.operators import graph as g
from pkgloom.operators import ingest
from pkgloom.operators.nested import first_payload_with, flatten
from pkgloom.operators.upsert import get_or_create
from pkgloom.plans.graphs import WHOLE, bfs_sql
from pkgloom.plans.reads import affected_versions, in_intervals
from pkgloom.plans.registry import Registry
from pkgloom.plans.scalars import source_counts_of
from pkgloom.session import Scratch, cut

pipelines = Registry()


@pipelines(
    "N1_ingested_graph",
    """WITH ns AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT regexp_extract(uri, '^/([^/]+)/', 1) AS name FROM callables)),
    cg AS (SELECT id, row_number() OVER (ORDER BY id) AS gid FROM callables)
    SELECT a.gid AS src, b.gid AS dst, n.id AS namespace FROM call_sites s JOIN cg a ON a.id = s.source_id JOIN cg b ON b.id = s.target_id JOIN callables cl ON cl.id = s.source_id JOIN ns n ON n.name = regexp_extract(cl.uri, '^/([^/]+)/', 1)""",
)
def ingested_graph(c):
    """Namespaces into a dictionary, callables to dense global ids, call sites to edges between them."""
    parts = uri.split_partial_uri("uri")
    cl = c.callables.select("id", parts["namespace"].alias("name"))
    stored = cl.select("name", F.lit(0).cast("long").alias("id")).limit(0)
    names = get_or_create(stored, cl.select("name")).withColumnRenamed("id", "namespace")
    gids = g.renumber(cl.select(F.col("id").alias("node"))).select(F.col("node").alias("id"), (F.col("number") + 1).alias("gid"))
    src = cl.join(names, "name").join(gids, "id").select(F.col("id").alias("source_id"), F.col("gid").alias("src"), "namespace")
    dst = gids.select(F.col("id").alias("target_id"), F.col("gid").alias("dst"))
    return c.call_sites.select("source_id", "target_id").join(src, "source_id").join(dst, "target_id").select("src", "dst", "namespace")


@pipelines("N5_graph_index", "SELECT m.package_version_id AS graph, count(DISTINCT x.node) AS n_nodes, count(DISTINCT (s.source_id, s.target_id)) AS n_edges FROM call_sites s JOIN callables cl ON cl.id = s.source_id JOIN modules m ON m.id = cl.module_id, LATERAL (SELECT unnest([s.source_id, s.target_id]) AS node) x GROUP BY 1")
def graph_index(c):
    """Nodes and edges of each stored graph."""
    cl = c.callables.select(F.col("id").alias("source_id"), "module_id").join(c.modules.select(F.col("id").alias("module_id"), F.col("package_version_id").alias("graph")), "module_id")
    e = c.call_sites.join(cl, "source_id").select("graph", "source_id", "target_id")
    nodes = e.select("graph", F.explode(F.array("source_id", "target_id")).alias("node")).distinct().groupBy("graph").agg(F.count(F.lit(1)).alias("n_nodes"))
    edges = e.distinct().groupBy("graph").agg(F.count(F.lit(1)).alias("n_edges"))
    return nodes.join(edges, "graph")


@pipelines(
    "N6_vulnerability_propagation",
    """WITH aff AS (SELECT DISTINCT x.vulnerability_id, pv.id AS version_id FROM packages p JOIN pv ON pv.package_id = p.id JOIN vpurls x ON x.package_name = p.package_name AND x.package_version = pv.version AND x.forge = p.forge),
    li AS (SELECT DISTINCT id AS vulnerability_id, try_cast(json_extract_string(l, '$') AS INT) AS line FROM (SELECT id, unnest(CASE WHEN json_type(p, '$.new_changed_line_numbers') = 'ARRAY' THEN json_extract(p, '$.new_changed_line_numbers[*]') WHEN json_type(p, '$.new_changed_line_numbers') = 'NULL' THEN [] ELSE [json_extract(p, '$.new_changed_line_numbers')] END) AS l
      FROM (SELECT id, unnest(CASE WHEN json_type(st, '$.patches') = 'ARRAY' THEN json_extract(st, '$.patches[*]') ELSE [json_extract(st, '$.patches')] END) AS p FROM (SELECT id, CASE WHEN json_type(statement) = 'ARRAY' THEN json_extract(statement, '$[0]') ELSE statement::JSON END AS st FROM vulnerabilities)) WHERE json_exists(p, '$.new_changed_line_numbers')) WHERE json_type(l) <> 'NULL')
    SELECT DISTINCT aff.vulnerability_id, cl.id AS callable_id FROM aff JOIN li ON li.vulnerability_id = aff.vulnerability_id JOIN modules m ON m.package_version_id = aff.version_id JOIN callables cl ON cl.module_id = m.id AND li.line BETWEEN cl.line_start AND cl.line_end""",
)
def vulnerability_propagation(c):
    """Changed lines of the patches, on the callables of all affected versions: lines and callables of a version meet in bins."""
    lines = flatten(c.vulnerabilities, "id", "statement", {"patches.new_changed_line_numbers"}).where("plain IS NOT NULL")
    lines = lines.select(F.col("record_key").alias("vulnerability_id"), F.col("plain").try_cast("int").alias("line")).distinct()
    points = cut(affected_versions(c).join(lines, "vulnerability_id").select("vulnerability_id", "version_id", "line"))
    m = c.modules.select(F.col("id").alias("module_id"), F.col("package_version_id").alias("version_id"))
    spans = c.callables.select("id", "module_id", "line_start", "line_end").join(m, "module_id").select("id", "version_id", "line_start", "line_end")
    hit = in_intervals(points.select("version_id", "line").distinct(), spans, "version_id", "line", "line_start", "line_end").select("id", "version_id", F.col("_at").alias("line"))
    return hit.join(points, ["version_id", "line"]).select("vulnerability_id", F.col("id").alias("callable_id")).distinct()


@pipelines("N12_repository_statistics", "SELECT source, count(*) AS n_files, CAST(sum(len(regexp_extract_all(text, 'int [a-z]\\w*\\('))) AS BIGINT) AS n_methods FROM documents WHERE text LIKE '%public final class%' GROUP BY source")
def repository_statistics(c):
    """Files and int methods of public final classes, as its SQL; N12_module_statistics has all."""
    d = c.documents.where(F.col("text").contains("public final class"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.regexp_count("text", F.lit(r"int [a-z]\w*\("))).alias("n_methods"))


@pipelines("N12_module_statistics")
def module_statistics(c):
    """Counts and ratios of each source over all of its documents.

    Documents have no layout of folders: a Java text with unit tests is a test file, any other a source file, whose
    functions are counted. A ratio of nothing is null.
    """
    d = source_counts_of(c.documents).withColumn("source_file", F.col("is_code") & (F.col("n_tests") == 0))
    per = d.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if("source_file").alias("n_files"), F.count_if(F.col("n_tests") > 0).alias("n_test_files"), F.sum(F.when(F.col("source_file"), F.col("n_functions")).otherwise(0)).alias("n_functions"),
        F.sum("n_tests").alias("n_tests"), F.count_if("mock_import").alias("n_mock_files"), F.sum("n_tests_with_mock").alias("n_tests_with_mock"),
    )
    ratio = lambda a, b: F.round(F.try_divide(a, b), 3)
    return per.withColumns({"tests_to_files": ratio("n_test_files", "n_files"), "tests_to_functions": ratio("n_tests", "n_functions"), "mocking": ratio("n_tests_with_mock", "n_tests")})


@pipelines("N15_echo", "SELECT id, package_name FROM packages")
def echo(c):
    return c.packages.select("id", "package_name")


def _gid_edges(c) -> tuple[DataFrame, DataFrame]:
    """(edges by URI within a revision: rev, src, dst; appears: gid, rev), URIs being ids across revisions."""
    u = c.callables.select("id", F.regexp_extract("uri", r"\.m(\d+)\(", 1).cast("long").alias("gid"), "is_internal_call", "module_id")
    rev = c.modules.select(F.col("id").alias("module_id"), F.col("package_version_id").alias("rev"))
    u = u.join(rev, "module_id")
    e = c.call_sites.join(u.select(F.col("id").alias("source_id"), F.col("gid").alias("src"), "rev"), "source_id").join(u.select(F.col("id").alias("target_id"), F.col("gid").alias("dst")), "target_id")
    return e.select("rev", "src", "dst").distinct(), u.where("is_internal_call").select("gid", "rev").distinct()


@pipelines("G17_inverted_indexes", "SELECT l_partkey AS gid, count(DISTINCT l_orderkey) FILTER (WHERE internal) AS appears_in, count(DISTINCT l_orderkey) FILTER (WHERE NOT internal) AS called_by FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_returnflag) <> 'R' AS internal FROM lineitem GROUP BY ALL) GROUP BY l_partkey")
def inverted_indexes(c):
    """In how many revisions each global id is defined, and in how many it is called from outside."""
    gid = F.regexp_extract("uri", r"\.m(\d+)\(", 1).cast("long")
    u = c.callables.join(c.modules.select(F.col("id").alias("module_id"), "package_version_id"), "module_id")
    return u.groupBy(gid.alias("gid")).agg(F.count_distinct(F.when(F.col("is_internal_call"), F.col("package_version_id"))).alias("appears_in"), F.count_distinct(F.when(~F.col("is_internal_call"), F.col("package_version_id"))).alias("called_by"))


_CROSS = """le AS (SELECT l_orderkey AS rev, l_linenumber AS ln, l_partkey AS gid, min(l_returnflag) <> 'R' AS internal FROM lineitem GROUP BY ALL),
ge AS (SELECT DISTINCT a.rev, a.gid AS src, b.gid AS dst FROM le a JOIN le b ON b.rev = a.rev AND b.ln = a.ln + 1), ap AS (SELECT DISTINCT gid, rev FROM le WHERE internal)"""


@pipelines("G7_cross_revision_reach", f"WITH {_CROSS}, s1 AS (SELECT DISTINCT ge.dst AS gid FROM ap JOIN ge ON ge.rev = ap.rev AND ge.src = ap.gid WHERE ap.gid = 1), s2 AS (SELECT DISTINCT ge.dst AS gid FROM s1 JOIN ap ON ap.gid = s1.gid JOIN ge ON ge.rev = ap.rev AND ge.src = ap.gid) SELECT gid, 1 AS dist FROM s1 WHERE gid <> 1 UNION ALL SELECT gid, 2 FROM s2 WHERE gid <> 1 AND gid NOT IN (SELECT gid FROM s1)")
def cross_revision_reach(c):
    """The first two steps, as its SQL; G7_cross_revision_reach_all has all."""
    return _reach_across(c, max_depth=2)


_ACROSS = f"{_CROSS}, ac AS MATERIALIZED (SELECT DISTINCT ge.src, ge.dst FROM ap JOIN ge ON ge.rev = ap.rev AND ge.src = ap.gid)"


@pipelines("G7_cross_revision_reach_all", f"WITH {_ACROSS}, {bfs_sql('ac', 'SELECT CAST(1 AS BIGINT) AS node', WHOLE)} SELECT node AS gid, d AS dist FROM dist WHERE d > 0")
def cross_revision_reach_all(c):
    return _reach_across(c)


def _reach_across(c, forward: bool = True, max_depth: int | None = None) -> DataFrame:
    """(gid, dist) from id 1: at each step a call goes on in every revision that defines what it calls."""
    edges, appears = _gid_edges(c)
    across = appears.join(edges.withColumnRenamed("src", "gid"), ["gid", "rev"]).select(F.col("gid").alias("src"), "dst").distinct()
    seed = c.spark.createDataFrame([(1,)], "node long")
    return g.bfs(across if forward else g.transpose(across), seed, max_depth).where("dist > 0").select(F.col("node").alias("gid"), "dist")


@pipelines("G8_cross_revision_coreach", f"WITH {_CROSS}, t AS (SELECT DISTINCT ge.src, ge.dst FROM ap JOIN ge ON ge.rev = ap.rev AND ge.src = ap.gid) SELECT DISTINCT src AS gid, 1 AS dist FROM t WHERE dst = 1 AND src <> 1")
def cross_revision_coreach(c):
    """The direct callers, as its SQL; G8_cross_revision_coreach_all has all."""
    return _reach_across(c, False, 1)


@pipelines("G8_cross_revision_coreach_all", f"WITH {_ACROSS}, {bfs_sql('ac', 'SELECT CAST(1 AS BIGINT) AS node', WHOLE, False)} SELECT node AS gid, d AS dist FROM dist WHERE d > 0")
def cross_revision_coreach_all(c):
    return _reach_across(c, False)


def ball_sketches(edges: DataFrame, rounds: int, log2m: int = 12) -> DataFrame:
    """(node, round, estimate): sizes of the balls of growing radius around each node, one mergeable sketch per node."""
    scratch = Scratch(edges.sparkSession)
    links, _ = scratch.write(edges.select("src", "dst").distinct())
    now, _ = scratch.write(g.nodes_of(links).groupBy("node").agg(F.hll_sketch_agg("node", F.lit(log2m)).alias("s")))
    out = []
    for r in range(1, rounds + 1):
        pulled = links.join(now, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "s")
        now, _ = scratch.write(now.unionByName(pulled).groupBy("node").agg(F.hll_union_agg("s").alias("s")))
        out.append(now.select("node", F.lit(r).alias("round"), F.hll_sketch_estimate("s").alias("estimate")))
    return reduce(DataFrame.unionByName, out)


@pipelines("C2_approximate_balls", "SELECT 1 AS round, true AS close UNION ALL SELECT 2, true")
def approximate_balls(c):
    """Whether the mean ball size from sketches is within five per cent of the exact one."""
    approx = ball_sketches(c.part_edges, 2).groupBy("round").agg(F.avg("estimate").alias("a"))
    starts = g.nodes_of(c.part_edges).select(F.col("node").alias("source"), "node")
    exact = g.bfs(c.part_edges, starts, 2, ("source",)).groupBy("dist").agg(F.count(F.lit(1)).alias("n"))
    total = g.nodes_of(c.part_edges).agg(F.count(F.lit(1)).alias("nodes"))
    upto = exact.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("round"), "dist", "n").where("dist <= round").groupBy("round").agg(F.sum("n").alias("n"))
    j = approx.join(upto, "round").join(F.broadcast(total))
    return j.select("round", (F.abs(F.col("a") - F.col("n") / F.col("nodes")) <= 0.05 * F.col("n") / F.col("nodes")).alias("close"))


@pipelines("C2_sketched_balls", "SELECT node, count(*) AS ball FROM (SELECT src AS node, src AS x FROM part_edges UNION SELECT dst, dst FROM part_edges UNION SELECT src, dst FROM part_edges) GROUP BY node")
def sketched_balls(c):
    """Sizes of the balls of radius 1 by sketch; a sketch counts sets this small without error."""
    return ball_sketches(c.part_edges, 1).select("node", F.round("estimate").cast("long").alias("ball"))


@pipelines("L2_layered_labels")
def layered_labels(c):
    """Gap cost of the order from label propagation at all twelve resolutions, combined by their own gap costs."""
    return g.layered_gap_cost(c.supplier_calls)


_CHAIN = """WITH RECURSIVE ok AS (SELECT record_id, message::JSON AS m FROM callable_messages WHERE json_valid(message) AND message IS NOT NULL AND trim(message) <> ''),
chain(record_id, depth, m) AS (SELECT record_id, 0, m FROM ok WHERE json_type(m) = 'OBJECT'
 UNION ALL SELECT record_id, depth + 1, CASE WHEN json_type(m, '$.input') = 'OBJECT' THEN json_extract(m, '$.input') ELSE json_extract_string(m, '$.input')::JSON END FROM chain
 WHERE json_type(m, '$.input') = 'OBJECT' OR CASE WHEN json_type(m, '$.input') = 'VARCHAR' AND json_valid(json_extract_string(m, '$.input')) THEN json_type(json_extract_string(m, '$.input')::JSON) = 'OBJECT' ELSE false END)"""


@pipelines("F17_payload_with_forge", f"{_CHAIN} SELECT c.record_id, f.artifact FROM callable_messages c LEFT JOIN (SELECT record_id, arg_min(coalesce(json_extract_string(m, '$.payload.artifactId'), ''), depth) AS artifact FROM chain WHERE json_type(m, '$.payload.forge') <> 'NULL' GROUP BY record_id) f ON f.record_id = c.record_id")
def payload_with_forge(c):
    """The artifact in the outermost payload that names a forge, however deep it lies; '' where that payload names none."""
    found = first_payload_with(c.callable_messages, "record_id", "message", "forge")
    artifact = F.when(F.col("payload").isNotNull(), F.coalesce(F.try_variant_get(F.try_parse_json("payload"), "$.artifactId", "string"), F.lit("")))
    return found.select(F.col("key").alias("record_id"), artifact.alias("artifact"))


@pipelines("O6_few_chains", "SELECT package_version_id, source_id FROM (SELECT m.package_version_id, s.source_id, row_number() OVER (PARTITION BY m.package_version_id ORDER BY s.source_id, s.target_id) AS rn FROM call_sites s JOIN callables cl ON cl.id = s.source_id JOIN modules m ON m.id = cl.module_id) WHERE rn <= 5")
def few_chains(c):
    """The first five calls of each version."""
    cl = c.callables.select(F.col("id").alias("source_id"), "module_id").join(c.modules.select(F.col("id").alias("module_id"), "package_version_id"), "module_id")
    w = Window.partitionBy("package_version_id").orderBy("source_id", "target_id")
    return c.call_sites.join(cl, "source_id").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("package_version_id", "source_id")


@pipelines("A11_reach_summary", "WITH sg AS (SELECT * FROM supplier_edges), r1 AS (SELECT src AS s, src AS t FROM sg UNION SELECT dst, dst FROM sg UNION SELECT src, dst FROM sg), r2 AS (SELECT s, t FROM r1 UNION SELECT r1.s, sg.dst FROM r1 JOIN sg ON sg.src = r1.t) SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT s, count(*) AS n FROM r2 GROUP BY s)")
def reach_summary(c):
    return g.reach_counts(c.supplier_edges).agg(F.min("reached").alias("least"), F.max("reached").alias("most"), F.round(F.avg("reached"), 6).alias("mean"))


@pipelines("G0i_search_order", f"WITH {bfs_sql('part_edges', 'SELECT CAST(1 AS BIGINT) AS node', WHOLE)} SELECT node, row_number() OVER (ORDER BY d, node) - 1 AS number FROM dist")
def search_order(c):
    """Nodes renumbered in the order of a search, distance first, then node."""
    seed = c.spark.createDataFrame([(1,)], "node long")
    found = g.bfs(c.part_edges, seed).select(F.struct("dist", "node").alias("node"))
    return g.renumber(found).select("node.node", "number")


def _java_records(c) -> DataFrame:
    """(graph, json): the call graph of each order in the form of Java records; an order has a few lines."""
    line = c.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.max("l_returnflag").alias("flag"))
    kind = F.concat(F.lit("/t/T"), F.col("part").cast("string"))
    method = F.create_map(F.col("l_linenumber").cast("string"), F.struct(F.concat(kind, F.lit(".m()V")).alias("uri"), F.struct(F.col("l_linenumber").alias("first"), (F.col("l_linenumber") + 5).cast("string").alias("last"), (F.col("flag") == "R").alias("defined")).alias("metadata")))
    types = line.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(kind, F.lit("-"), F.col("l_linenumber").cast("string")), F.struct(F.lit("public").alias("access"), F.array(F.lit("/t/Base")).alias("superClasses"), method.alias("methods"))))).alias("t"))
    a, b = line.select("l_orderkey", "l_linenumber", "flag"), line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("part").alias("to"))
    site = lambda pc, of, types_of: F.struct(F.lit(pc), F.struct(F.col("l_linenumber").alias("line"), F.lit(of).alias("type"), types_of.alias("receiver")))
    to = F.concat(F.lit("[/t/T"), F.col("to").cast("string"), F.lit(",/t/Base]"))
    pcs = F.map_from_entries(F.array(site("1", "invokevirtual", to), site("9", "invokestatic", F.lit("[/t/Other]"))))
    calls = a.join(b, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey").agg(F.collect_list(F.array(F.col("l_linenumber").cast("string"), (F.col("l_linenumber") + 1).cast("string"), F.to_json(pcs))).alias("s"))
    record = F.struct(F.lit("mvn").alias("forge"), F.struct(F.col("t").alias("internalTypes")).alias("cha"), F.coalesce("s", F.array().cast("array<array<string>>")).alias("call-sites"))
    return types.join(calls, "l_orderkey", "left").select(F.col("l_orderkey").alias("graph"), F.to_json(record).alias("json"))


_LINES = "ln AS (SELECT l_orderkey AS graph, l_linenumber AS no, min(l_partkey) AS part, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL)"


@pipelines("N2_java_callables", f"WITH {_LINES} SELECT graph, '/t/T' || part || '-' || no AS module, CAST(no AS BIGINT) AS local_id, '/t/T' || part || '.m()V' AS uri, CAST(no AS INT) AS line_start, CAST(no + 5 AS INT) AS line_end, flag = 'R' AS defined FROM ln")
def java_callables(c):
    """Records of Java call graphs taken apart: types, methods, peeled metadata."""
    return ingest.java_callables(_java_records(c)).select("graph", "module", "local_id", "uri", "line_start", "line_end", "defined")


@pipelines("N2_java_edges", f"WITH {_LINES} SELECT a.graph, CAST(a.no AS BIGINT) AS source, CAST(b.no AS BIGINT) AS target, 2 AS n_sites, 'STATIC:/t/Other;VIRTUAL:/t/T' || b.part || ',/t/Base' AS sites FROM ln a JOIN ln b ON b.graph = a.graph AND b.no = a.no + 1")
def java_edges(c):
    """One row per pair of callables, with the receivers of all its program counters (A6, M12)."""
    e = ingest.java_edges(_java_records(c))
    text = F.transform("receivers", lambda r: F.concat(r.call_type, F.lit(":"), F.array_join(r.types, ",")))
    return e.select("graph", "source", "target", F.size("receivers").alias("n_sites"), F.array_join(F.sort_array(text), ";").alias("sites"))


def _plain_records(c, form: str) -> DataFrame:
    """(graph, json) of each order in the form of C or Python records."""
    line = c.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.max("l_returnflag").alias("flag"))
    no = F.col("l_linenumber").cast("string")
    name = F.concat(F.lit("p"), F.col("part").cast("string"))
    meta = F.struct(no.alias("first"), (F.col("l_linenumber") + 5).cast("string").alias("last"))
    if form == "c":
        each = F.struct(no, F.struct(F.concat(F.lit("/bin;C/"), name, F.lit("()")).alias("uri"), F.array(F.concat(name, F.lit(".c"))).alias("files"), meta.alias("metadata")))
    else:
        each = F.struct(no, F.struct(F.concat(F.lit("/m/"), name, F.lit("()")).alias("namespace"), meta.alias("metadata")))
    pair = F.when(F.col("l_linenumber") > 1, F.array((F.col("l_linenumber") - 1).cast("string"), no))
    per = line.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(each)).alias("m"), F.collect_list(pair).alias("calls"))
    graph = F.struct(F.col("calls").alias("internalCalls"))
    if form == "c":
        record = F.struct(F.struct(F.struct(F.create_map(F.lit("bin"), F.struct(F.col("m").alias("methods"))).alias("binaries")).alias("internal")).alias("functions"), graph.alias("graph"))
    else:
        record = F.struct(F.create_map(F.lit("internal"), F.create_map(F.lit("/m/"), F.struct(F.lit("m.py").alias("sourceFile"), F.col("m").alias("namespaces")))).alias("modules"), graph.alias("graph"))
    return per.select(F.col("l_orderkey").alias("graph"), F.to_json(record).alias("json"))


_PLAIN = f"WITH {_LINES} SELECT graph, {{module}} AS module, CAST(no AS BIGINT) AS local_id, {{uri}} AS uri, CAST(no AS INT) AS line_start, CAST(no + 5 AS INT) AS line_end FROM ln"


@pipelines("N3_c_callables", _PLAIN.format(module="'p' || part || '.c_module'", uri="'/bin;C/p' || part || '()'"))
def c_callables(c):
    return ingest.c_callables(_plain_records(c, "c")).select("graph", "module", "local_id", "uri", "line_start", "line_end")


@pipelines("N4_python_callables", _PLAIN.format(module="'/m/'", uri="'/m/p' || part || '()'"))
def python_callables(c):
    return ingest.python_callables(_plain_records(c, "python")).select("graph", "module", "local_id", "uri", "line_start", "line_end")


@pipelines("N4_python_edges", f"WITH {_LINES} SELECT graph, CAST(no - 1 AS BIGINT) AS source, CAST(no AS BIGINT) AS target FROM ln WHERE no > 1")
def python_edges(c):
    return ingest.plain_edges(_plain_records(c, "python"), ingest.PYTHON).select("graph", "source", "target")


@pipelines("G13_versions_of_uris", "SELECT cl.uri, count(DISTINCT m.package_version_id) AS n_versions, min(m.package_version_id) AS first_version FROM callables cl JOIN modules m ON m.id = cl.module_id GROUP BY cl.uri")
def versions_of_uris(c):
    """The revisions in which each URI occurs, whatever its version."""
    m = c.modules.select(F.col("id").alias("module_id"), "package_version_id")
    return c.callables.select("uri", "module_id").join(m, "module_id").groupBy("uri").agg(F.count_distinct("package_version_id").alias("n_versions"), F.min("package_version_id").alias("first_version"))


@pipelines("G14_reach_objects", "WITH RECURSIVE f(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.dst FROM f JOIN part_edges e ON e.src = f.node), b(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.src FROM b JOIN part_edges e ON e.dst = b.node) SELECT 'reach' AS kind, node FROM f WHERE node <> 1 UNION ALL SELECT 'coreach', node FROM b WHERE node <> 1")
def reach_objects(c):
    """Both kinds of reachability as objects that are put together first and run later."""
    kinds = {"reach": g.Reach(c.part_edges, 1), "coreach": g.Reach(c.part_edges, 1, forward=False)}
    return reduce(DataFrame.unionByName, [r.run().where("dist > 0").select(F.lit(k).alias("kind"), "node") for k, r in kinds.items()])


@pipelines("G0h_arcs_with_data", "WITH d AS (SELECT src AS node, count(*) AS k FROM part_edges GROUP BY src) SELECT e.src, e.dst, coalesce(a.k, 0) AS src_degree, coalesce(b.k, 0) AS dst_degree FROM part_edges e LEFT JOIN d a ON a.node = e.src LEFT JOIN d b ON b.node = e.dst")
def arcs_with_data(c):
    """Arcs with the data of both ends as columns."""
    d = c.part_edges.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    j = c.part_edges.join(d.withColumnRenamed("k", "src_degree"), "src", "left").join(d.select(F.col("src").alias("dst"), F.col("k").alias("dst_degree")), "dst", "left")
    return j.select("src", "dst", F.coalesce("src_degree", F.lit(0)).alias("src_degree"), F.coalesce("dst_degree", F.lit(0)).alias("dst_degree"))


@pipelines("O8_sorted_edges", "SELECT src, dst, row_number() OVER (ORDER BY src::VARCHAR, dst::VARCHAR) - 1 AS place FROM part_edges")
def sorted_edges(c):
    """The place of every edge in the order of its ends as texts."""
    text = lambda x: F.col(x).cast("string").alias(x)
    n = g.renumber(c.part_edges.select(F.struct(text("src"), text("dst")).alias("node")))
    return n.select(F.col("node.src").cast("long").alias("src"), F.col("node.dst").cast("long").alias("dst"), F.col("number").alias("place"))


@pipelines("G_components_of_nations", "SELECT c_nationkey AS component, count(*) + 1 AS n FROM customer GROUP BY c_nationkey")
def components_of_nations(c):
    """Components of the graph that ties customers to their nations: one for each nation that has any."""
    e = c.customer.select((F.col("c_custkey") + 1000).alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    return g.components(e).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@pipelines("C10_salsa_by_component", "WITH e AS (SELECT DISTINCT l_suppkey AS src, 1000000 + l_suppkey % 40 * 100 + l_partkey % 3 + l_suppkey // 40 % 20 AS dst FROM lineitem), k AS (SELECT dst AS node, dst // 100 AS comp, count(*) AS k FROM e GROUP BY dst), t AS (SELECT comp, sum(k) AS arcs, count(*) AS nodes FROM k GROUP BY comp) SELECT k.node, round(k / arcs * nodes / (SELECT count(*) FROM k)::DOUBLE, 9) AS x FROM k JOIN t ON t.comp = k.comp")
def salsa_by_component(c):
    """SALSA on a graph of many components of co-citation, where a node's share depends on the size of its own."""
    s = F.col("l_suppkey")
    e = c.lineitem.select(s.alias("src"), (1_000_000 + s % 40 * 100 + F.col("l_partkey") % 3 + F.floor(s / 40) % 20).alias("dst")).distinct()
    return g.salsa(e).where("node >= 1000000").select("node", F.round("x", 9).alias("x"))


QUERIES, SQL = pipelines.queries, pipelines.sql
