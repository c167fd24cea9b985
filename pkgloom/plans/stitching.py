"""Stitching queries (M1-M15) on a hierarchy of types derived from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgloom.functions.uri import percent_decode_fully
from pkgloom.operators import graph as g
from pkgloom.operators import stitching as m
from pkgloom.plans.registry import Registry

stitching = Registry()

_BASE = """
ty AS (SELECT DISTINCT 'P' || (p_partkey % 40) AS type, 'B' || (p_partkey % 40 % 8) AS p1, 'I' || (p_partkey % 40 % 5) AS p2 FROM part),
tb AS (SELECT DISTINCT 'B' || (p_partkey % 8) AS type, 'C' || (p_partkey % 8 % 3) AS p1 FROM part),
anc AS (SELECT type, p1 AS ancestor, 1 AS r FROM ty UNION SELECT type, p2, 2 FROM ty UNION SELECT ty.type, tb.p1, 3 FROM ty JOIN tb ON tb.type = ty.p1 UNION SELECT type, p1, 1 FROM tb),
dict AS (SELECT CASE p_size % 4 WHEN 0 THEN 'P' || (p_partkey % 40) WHEN 1 THEN 'B' || (p_partkey % 8) WHEN 2 THEN 'I' || (p_partkey % 5) ELSE 'C' || (p_partkey % 3) END AS type, 'm' || ((p_partkey % 8 + p_size % 3) % 13) AS signature, min(p_partkey) AS gid FROM part GROUP BY 1, 2),
calls AS (SELECT DISTINCT l_partkey AS source, l_linenumber = 7 AS external, CASE l_returnflag WHEN 'R' THEN 'STATIC' WHEN 'A' THEN 'VIRTUAL' ELSE 'INTERFACE' END AS call_type,
  CASE l_suppkey % 4 WHEN 0 THEN 'B' || (l_suppkey % 8) WHEN 1 THEN 'C' || (l_suppkey % 3) ELSE 'P' || (l_suppkey % 40) END AS receiver, 'm' || ((l_linenumber + l_suppkey) % 13) AS signature FROM lineitem),
r1 AS (SELECT c.*, d.gid AS target, 1 AS stage FROM calls c JOIN dict d ON d.type = c.receiver AND d.signature = c.signature),
o1 AS (SELECT * FROM calls c WHERE call_type <> 'STATIC' AND NOT EXISTS (SELECT 1 FROM dict d WHERE d.type = c.receiver AND d.signature = c.signature)),
r2 AS (SELECT o1.*, arg_min(d.gid, a.r) AS target, 2 AS stage FROM o1 JOIN anc a ON a.type = o1.receiver JOIN dict d ON d.type = a.ancestor AND d.signature = o1.signature GROUP BY ALL),
o2 AS (SELECT * FROM o1 WHERE NOT EXISTS (SELECT 1 FROM r2 WHERE r2.receiver = o1.receiver AND r2.signature = o1.signature)),
r3 AS (SELECT DISTINCT o2.*, d.gid AS target, 3 AS stage FROM o2 JOIN anc a ON a.ancestor = o2.receiver JOIN dict d ON d.type = a.type AND d.signature = o2.signature),
resolved AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)"""


def _types(c):
    k = F.col("p_partkey")
    name = lambda x, n: F.concat(F.lit(x), n.cast("string"))
    leaf = c.part.select(name("P", k % 40).alias("type"), F.posexplode(F.array(name("B", k % 40 % 8), name("I", k % 40 % 5))).alias("idx", "parent"))
    base = c.part.select(name("B", k % 8).alias("type"), F.lit(0).alias("idx"), name("C", k % 8 % 3).alias("parent"))
    return leaf.unionByName(base).distinct()


def _dictionary(c):
    k, s = F.col("p_partkey"), F.col("p_size") % 4
    name = lambda x, n: F.concat(F.lit(x), n.cast("string"))
    t = F.when(s == 0, name("P", k % 40)).when(s == 1, name("B", k % 8)).when(s == 2, name("I", k % 5)).otherwise(name("C", k % 3))
    return c.part.groupBy(t.alias("type"), name("m", (k % 8 + F.col("p_size") % 3) % 13).alias("signature")).agg(F.min("p_partkey").alias("gid"))


def _calls(c):
    s = F.col("l_suppkey")
    name = lambda x, n: F.concat(F.lit(x), n.cast("string"))
    kind = F.when(F.col("l_returnflag") == "R", "STATIC").when(F.col("l_returnflag") == "A", "VIRTUAL").otherwise("INTERFACE")
    receiver = F.when(s % 4 == 0, name("B", s % 8)).when(s % 4 == 1, name("C", s % 3)).otherwise(name("P", s % 40))
    return c.lineitem.select(F.col("l_partkey").alias("source"), (F.col("l_linenumber") == 7).alias("external"), kind.alias("call_type"), receiver.alias("receiver"), name("m", (F.col("l_linenumber") + s) % 13).alias("signature")).distinct()


def _resolved(c):
    return m.dispatch(_calls(c), _dictionary(c), m.ancestors(_types(c)))


@stitching("M2_class_hierarchy", f"WITH {_BASE} SELECT type, ancestor, row_number() OVER (PARTITION BY type ORDER BY r, ancestor) AS place FROM anc")
def class_hierarchy(c):
    """Ancestors in the order in which a call looks for its target."""
    w = Window.partitionBy("type").orderBy("place")
    return m.ancestors(_types(c)).select("type", "ancestor", F.row_number().over(w).alias("place"))


@stitching("M3_type_dictionary", f"WITH {_BASE} SELECT type, count(*) AS n_signatures, min(gid) AS first_gid FROM dict GROUP BY type")
def type_dictionary(c):
    return _dictionary(c).groupBy("type").agg(F.count(F.lit(1)).alias("n_signatures"), F.min("gid").alias("first_gid"))


@stitching("M4_dispatch", f"WITH {_BASE} SELECT source, external, receiver, signature, target, stage FROM (SELECT DISTINCT source, external, call_type, receiver, signature, target, stage FROM resolved)")
def dispatched(c):
    return _resolved(c)


@stitching("M1_merged_graph", f"WITH {_BASE} SELECT DISTINCT CASE WHEN external THEN target ELSE source END AS src, CASE WHEN external THEN source ELSE target END AS dst FROM resolved")
def merged_graph(c):
    return m.merged_edges(_resolved(c))


@stitching("M6_external_nodes", f"WITH {_BASE} SELECT receiver, signature, -row_number() OVER (ORDER BY receiver, signature) AS gid FROM (SELECT DISTINCT receiver, signature FROM calls EXCEPT SELECT receiver, signature FROM resolved)")
def external_nodes(c):
    return m.unresolved(_calls(c), _resolved(c))


@stitching("M10_merge_all", f"WITH {_BASE} SELECT src % 10 AS bucket, count(*) AS n FROM (SELECT DISTINCT CASE WHEN external THEN target ELSE source END AS src, CASE WHEN external THEN source ELSE target END AS dst FROM resolved UNION SELECT src, dst FROM part_edges) GROUP BY 1")
def merge_all(c):
    """The stitched graph and the graph within packages as one."""
    both = m.merged_edges(_resolved(c)).union(c.part_edges).distinct()
    return both.groupBy((F.col("src") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@stitching("M11_local_numbers", "SELECT uri AS node, row_number() OVER (ORDER BY uri) - 1 AS number FROM (SELECT DISTINCT uri FROM callables)")
def local_numbers(c):
    return g.renumber(c.callables.select(F.col("uri").alias("node")))


@stitching("M13_rendered_pairs", "SELECT DISTINCT regexp_extract(a.uri, '^/[^/]+/([^(]+)', 1) || ' -> ' || regexp_extract(b.uri, '^/[^/]+/([^(]+)', 1) AS pair FROM call_sites s JOIN callables a ON a.id = s.source_id JOIN callables b ON b.id = s.target_id")
def rendered_pairs(c):
    short = F.regexp_extract("uri", r"^/[^/]+/([^(]+)", 1)
    u = c.callables.select("id", short.alias("name"))
    j = c.call_sites.join(u.select(F.col("id").alias("source_id"), F.col("name").alias("a")), "source_id").join(u.select(F.col("id").alias("target_id"), F.col("name").alias("b")), "target_id")
    return j.select(F.concat_ws(" -> ", "a", "b").alias("pair")).distinct()


_ORIGINS = """st AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_linestatus = 'F' AND a.l_partkey <> b.l_partkey),
dy AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_returnflag = 'R' AND a.l_partkey <> b.l_partkey),
kn AS (SELECT src AS n FROM st UNION SELECT dst FROM st),
both_ AS (SELECT coalesce(st.src, d.src) AS src, coalesce(st.dst, d.dst) AS dst, CASE WHEN st.src IS NOT NULL AND d.src IS NOT NULL THEN 'staticAndDynamic' WHEN st.src IS NOT NULL THEN 'static' ELSE 'dynamic' END AS origin
 FROM st FULL JOIN (SELECT * FROM dy WHERE src IN (SELECT n FROM kn) AND dst IN (SELECT n FROM kn)) d ON d.src = st.src AND d.dst = st.dst)"""


def _origins(c):
    a = c.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), "l_linestatus", "l_returnflag")
    b = c.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    e = a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst")
    return m.combine_origins(e.where("l_linestatus = 'F'").select("src", "dst"), e.where("l_returnflag = 'R'").select("src", "dst"))


@stitching("M14_static_and_dynamic", f"WITH {_ORIGINS} SELECT src, dst, origin FROM both_")
def static_and_dynamic(c):
    return _origins(c)


@stitching("M15_origin_breakdown", f"WITH {_ORIGINS} SELECT origin, count(*) AS n FROM both_ GROUP BY origin")
def origin_breakdown(c):
    return _origins(c).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@stitching("M8_receiver_types", "SELECT p_partkey, CAST(len(string_split(p_name || ' ' || p_type, ' ')) AS INT) AS n, string_split(p_name || ' ' || p_type, ' ')[-1] AS last FROM part")
def receiver_lists(c):
    """As many receivers as a part's name and type have words."""
    t = m.receiver_types(F.concat(F.lit("["), F.replace(F.concat_ws(" ", "p_name", "p_type"), F.lit(" "), F.lit(", ")), F.lit("]")))
    return c.part.select("p_partkey", F.size(t).alias("n"), F.element_at(t, -1).alias("last"))


@stitching("M7_decoded_signatures", "SELECT DISTINCT uri AS signature, replace(replace(uri, '%25', '%'), '%2F', '/') AS decoded FROM callables UNION SELECT DISTINCT 'm' || regexp_extract(uri, '\\.m(.*)$', 1), 'm' || regexp_extract(uri, '\\.m(.*)$', 1) FROM callables")
def decoded_signatures(c):
    """A signature that begins with a slash is decoded until nothing is left to decode; any other stays."""
    u = c.callables.select("uri").distinct()
    s = u.select(F.col("uri").alias("signature")).union(u.select(F.concat(F.lit("m"), F.regexp_extract("uri", r"\.m(.*)$", 1)))).distinct()
    return s.select("signature", F.when(F.startswith("signature", F.lit("/")), percent_decode_fully("signature")).otherwise(F.col("signature")).alias("decoded"))


QUERIES, SQL = stitching.queries, stitching.sql
