"""Graph queries (G0-G17, C1-C20, L1-L6) on the call graphs derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgloom.operators import graph as g
from pkgloom.plans.registry import Registry

graphs = Registry()
SEED_NODE = 1
# SQL unrolls this many rounds, which is past the fixed point to the digits compared; the queries stop at the tolerance
FIXED, TIGHT = 40, 1e-12
WHOLE = 9  # levels in SQL; the graph has fewer, the queries search to the end
_PE = "pe AS MATERIALIZED (SELECT * FROM part_edges)"
_DEG = "SELECT node, CAST(sum(i) AS BIGINT) AS indegree, CAST(sum(o) AS BIGINT) AS outdegree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM {e} UNION ALL SELECT dst, 0, 1 FROM {e}) GROUP BY node"
_NODES = "SELECT src AS node FROM {e} UNION SELECT dst FROM {e}"


def bfs_sql(e: str, seed: str, depth: int, forward: bool = True) -> str:
    """CTEs d0..dn and dist(node, d): shortest distances up to ``depth``."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    parts = [f"d0 AS (SELECT node, 0 AS d FROM ({seed}))"]
    for k in range(1, depth + 1):
        parts.append(f"d{k} AS (SELECT node, min(d) AS d FROM (SELECT node, d FROM d{k - 1} UNION ALL SELECT e.{b}, {k} FROM d{k - 1} JOIN {e} e ON e.{a} = node WHERE d = {k - 1}) GROUP BY node)")
    return ", ".join(parts) + f", dist AS (SELECT node, d FROM d{depth})"


def _seed(c) -> DataFrame:
    return c.spark.createDataFrame([(SEED_NODE,)], "node long")


@graphs("G0_nodes", "SELECT count(*) AS n_nodes, (SELECT count(*) FROM part_edges) AS n_arcs FROM (" + _NODES.format(e="part_edges") + ")")
def node_counts(c):
    e = c.part_edges
    return g.nodes_of(e).agg(F.count(F.lit(1)).alias("n_nodes")).join(e.agg(F.count(F.lit(1)).alias("n_arcs")))


@graphs("G0b_successors", "SELECT src AS node, string_agg(dst, ',' ORDER BY dst) AS successors FROM part_edges GROUP BY src")
def successors(c):
    return c.part_edges.groupBy(F.col("src").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), ",").alias("successors"))


@graphs("G0c_edges_of", "SELECT node, count(*) AS n_edges FROM (SELECT src AS node, src, dst FROM part_edges UNION SELECT dst, src, dst FROM part_edges) GROUP BY node")
def edges_of(c):
    both = c.part_edges.select(F.explode(F.array("src", "dst")).alias("node"), "src", "dst").distinct()
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("n_edges"))


@graphs("G0d_transpose", "SELECT dst AS src, src AS dst FROM part_edges")
def transposed(c):
    return g.transpose(c.part_edges)


@graphs("G0e_symmetrized", "SELECT src, dst FROM part_edges UNION SELECT dst, src FROM part_edges")
def symmetrized(c):
    return g.symmetrize(c.part_edges)


@graphs("G0f_integrity", "SELECT 'unknown node' AS error, node AS a, CAST(NULL AS BIGINT) AS b FROM (SELECT target_id AS node FROM call_sites UNION SELECT source_id FROM call_sites) WHERE node NOT IN (SELECT id FROM callables WHERE is_internal_call)")
def integrity(c):
    """Arcs of the call graph whose ends are no internal callables."""
    nodes = c.callables.where("is_internal_call").select(F.col("id").alias("node"))
    edges = c.call_sites.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return g.integrity_errors(nodes, edges)


@graphs("G0g_renumbered", "SELECT node, row_number() OVER (ORDER BY node) - 1 AS number FROM (" + _NODES.format(e="part_edges") + ")")
def renumbered(c):
    return g.renumber(g.nodes_of(c.part_edges))


@graphs("A7_degrees", _DEG.format(e="part_edges"))
def degree_table(c):
    return g.degrees(c.part_edges)


@graphs(
    "G1_forward_search",
    f"WITH {bfs_sql('part_edges', f'SELECT CAST({SEED_NODE} AS BIGINT) AS node', WHOLE)}, deg AS ({_DEG.format(e='part_edges')}) SELECT dist.node, d AS dist, indegree, outdegree, round((indegree + outdegree) / log2(d + 2.0), 6) AS score FROM dist JOIN deg ON deg.node = dist.node WHERE d > 0",
)
def forward_search(c):
    return g.search(c.part_edges, _seed(c)).withColumn("score", F.round("score", 6))


@graphs(
    "G3_backward_search",
    f"WITH {bfs_sql('part_edges', f'SELECT CAST({SEED_NODE} AS BIGINT) AS node', WHOLE, False)}, deg AS ({_DEG.format(e='part_edges')}) SELECT dist.node, d AS dist, indegree, outdegree, round((indegree + outdegree) / log2(d + 2.0), 6) AS score FROM dist JOIN deg ON deg.node = dist.node WHERE d > 0 AND outdegree >= 10",
)
def backward_search(c):
    """The filter hides nodes of few callees but does not stop the walk at them."""
    return g.search(c.part_edges, _seed(c), forward=False, keep=F.col("outdegree") >= 10).withColumn("score", F.round("score", 6))


@graphs("G5_top10", f"WITH {bfs_sql('part_edges', f'SELECT CAST({SEED_NODE} AS BIGINT) AS node', WHOLE)}, deg AS ({_DEG.format(e='part_edges')}) SELECT dist.node, round((indegree + outdegree) / log2(d + 2.0), 6) AS score FROM dist JOIN deg ON deg.node = dist.node WHERE d > 0 ORDER BY (indegree + outdegree) / log2(d + 2.0) DESC, dist.node LIMIT 10")
def top10(c):
    return g.search(c.part_edges, _seed(c), top=10).select("node", F.round("score", 6).alias("score"))


@graphs("G9_packed_ids", "SELECT src, dst, (src << 40) | dst AS packed, ((src << 40) | dst) >> 40 AS unpacked FROM part_edges")
def packed(c):
    """Two ids in one number: 24 bits of graph and 40 bits of node."""
    p = F.shiftleft("src", 40).bitwiseOR(F.col("dst"))
    return c.part_edges.select("src", "dst", p.alias("packed"), F.shiftrightunsigned(p, 40).alias("unpacked"))


@graphs("G11_reach_counts", f"WITH sg AS (SELECT * FROM supplier_edges), r1 AS (SELECT src AS s, src AS t FROM sg UNION SELECT dst, dst FROM sg UNION SELECT src, dst FROM sg), r2 AS (SELECT s, t FROM r1 UNION SELECT r1.s, sg.dst FROM r1 JOIN sg ON sg.src = r1.t) SELECT s AS node, count(*) AS reached FROM r2 GROUP BY s")
def reach(c):
    return g.reach_counts(c.supplier_calls)


@graphs("G12_neighbourhood", f"WITH {bfs_sql('part_edges', f'SELECT CAST({SEED_NODE} AS BIGINT) AS node', 2)} SELECT d AS dist, count(*) AS n FROM dist GROUP BY d")
def neighbourhood(c):
    return g.bfs(c.part_edges, _seed(c), 2).groupBy("dist").agg(F.count(F.lit(1)).alias("n"))


@graphs(
    "G10_capped_revisions",
    f"WITH {bfs_sql('part_edges', f'SELECT CAST({SEED_NODE} AS BIGINT) AS node', WHOLE)} SELECT node, d AS dist FROM (SELECT node, d, row_number() OVER (PARTITION BY node % 25 ORDER BY d, node) AS rn FROM dist) WHERE rn <= 3",
)
def capped(c):
    """At most three nodes of each product, in the order of discovery (distance, then node)."""
    w = Window.partitionBy(F.col("node") % 25).orderBy("dist", "node")
    return g.bfs(c.part_edges, _seed(c)).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("node", "dist")


@graphs("G15_vulnerable_chains", "SELECT cl.id FROM call_sites s JOIN callables cl ON cl.id = s.source_id JOIN callables t ON t.id = s.target_id WHERE t.uri LIKE '/ns3/%' OR cl.uri LIKE '/ns3/%' GROUP BY cl.id")
def chains(c):
    u = c.callables.select("id", "uri")
    s = c.call_sites.join(u.withColumnRenamed("id", "source_id"), "source_id").withColumnRenamed("uri", "su").join(u.select(F.col("id").alias("target_id"), F.col("uri").alias("tu")), "target_id")
    return s.where(F.exists(F.array("su", "tu"), lambda x: x.startswith("/ns3/"))).select(F.col("source_id").alias("id")).distinct()


@graphs("G16_graph_json", """SELECT m.package_version_id AS graph, '{"edges":' || count(*) || ',"sources":' || count(DISTINCT source_id) || '}' AS json FROM call_sites s JOIN callables cl ON cl.id = s.source_id JOIN modules m ON m.id = cl.module_id GROUP BY 1""")
def graph_json(c):
    cl = c.callables.select(F.col("id").alias("source_id"), "module_id").join(c.modules.select(F.col("id").alias("module_id"), F.col("package_version_id").alias("graph")), "module_id")
    per = c.call_sites.join(cl, "source_id").groupBy("graph").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("source_id").alias("sources"))
    return per.select("graph", F.to_json(F.struct("edges", "sources")).alias("json"))


_DIST2 = """sg AS (SELECT * FROM supplier_edges), sn AS (SELECT src AS node FROM sg UNION SELECT dst FROM sg),
a1 AS (SELECT src AS s, dst AS t, 1 AS d FROM sg),
a2 AS (SELECT s, t, min(d) AS d FROM (SELECT s, t, d FROM a1 UNION ALL SELECT a1.s, sg.dst, 2 FROM a1 JOIN sg ON sg.src = a1.t WHERE a1.s <> sg.dst) GROUP BY s, t),
a3 AS (SELECT s, t, min(d) AS d FROM (SELECT s, t, d FROM a2 UNION ALL SELECT a2.s, sg.dst, 3 FROM a2 JOIN sg ON sg.src = a2.t WHERE a2.d = 2 AND a2.s <> sg.dst) GROUP BY s, t),
ad AS (SELECT s, t, min(d) AS d FROM (SELECT s, t, d FROM a3 UNION ALL SELECT a3.s, sg.dst, 4 FROM a3 JOIN sg ON sg.src = a3.t WHERE a3.d = 3 AND a3.s <> sg.dst) GROUP BY s, t)"""


@graphs(
    "C1_closeness",
    f"WITH {_DIST2} SELECT node, round(CASE WHEN sum(d) > 0 THEN 1.0 / sum(d) ELSE 0 END, 9) AS closeness, round(CASE WHEN sum(d) > 0 THEN (count(d) + 1.0) * (count(d) + 1.0) / sum(d) ELSE 1 END, 6) AS lin, round(coalesce(sum(1.0 / d), 0), 6) AS harmonic FROM sn LEFT JOIN ad ON t = node GROUP BY node",
)
def closeness(c):
    """C1, C3 and C4 from one search of all pairs."""
    m = g.distance_measures(c.supplier_edges)
    return m.select("node", F.round("closeness", 9).alias("closeness"), F.round("lin", 6).alias("lin"), F.round("harmonic", 6).alias("harmonic"))


_QUERY = "(SELECT node, 1.0 + node % 3 AS weight FROM sn WHERE node % 7 = 0)"


@graphs(
    "C13_query_closeness",
    f"WITH {_DIST2} SELECT t AS node, round(1.0 / sum(d / weight), 9) AS closeness, round(sum(weight / d), 6) AS harmonic FROM {_QUERY} q JOIN ad ON ad.s = q.node GROUP BY t",
)
def query_closeness(c):
    q = g.nodes_of(c.supplier_edges).where("node % 7 = 0").select("node", (1.0 + F.col("node") % 3).alias("weight"))
    m = g.query_measures(c.supplier_edges, q)
    return m.select("node", F.round("closeness", 9).alias("closeness"), F.round("harmonic", 6).alias("harmonic"))


@graphs("C15_plain_query_closeness", f"WITH {_DIST2} SELECT t AS node, round(1.0 / sum(d), 9) AS closeness, round(sum(1.0 / d), 6) AS harmonic FROM (SELECT node FROM sn WHERE node % 7 = 0) q JOIN ad ON ad.s = q.node GROUP BY t")
def plain_query_closeness(c):
    """C13 and C14 with weights of 1."""
    m = g.query_measures(c.supplier_edges, g.nodes_of(c.supplier_edges).where("node % 7 = 0").withColumn("weight", F.lit(1.0)))
    return m.select("node", F.round("closeness", 9).alias("closeness"), F.round("harmonic", 6).alias("harmonic"))


def _rank_sql(e: str, rounds: int, alpha: float, pref: str) -> str:
    parts = [f"nd AS ({_NODES.format(e=e)})", f"pf AS ({pref})", f"od AS (SELECT src, count(*) AS k FROM {e} GROUP BY src)", "x0 AS (SELECT node, p AS x FROM pf)"]
    for r in range(1, rounds + 1):
        parts.append(
            f"x{r} AS MATERIALIZED (SELECT pf.node, (1 - {alpha}) * p + {alpha} * (coalesce(f, 0) + p * coalesce((SELECT sum(x) FROM x{r - 1} WHERE node NOT IN (SELECT src FROM od)), 0)) AS x FROM pf LEFT JOIN (SELECT e.dst, sum(x / k) AS f FROM x{r - 1} JOIN {e} e ON e.src = x{r - 1}.node JOIN od ON od.src = e.src GROUP BY e.dst) q ON q.dst = pf.node)"
        )
    return ", ".join(parts)


@graphs("C8_pagerank_converged", f"WITH {_PE}, {_rank_sql('pe', FIXED, 0.85, 'SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS p FROM nd')} SELECT node, round(x, 9) AS x FROM x{FIXED}")
def pagerank_converged(c):
    return g.pagerank(c.part_edges, tolerance=TIGHT).select("node", F.round("x", 9).alias("x"))


_PREF = "SELECT nd.node, CASE WHEN node % 10 = 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM nd WHERE node % 10 = 0) ELSE 0 END AS p FROM nd"


@graphs("C18_preferential_pagerank_converged", f"WITH {_PE}, {_rank_sql('pe', FIXED, 0.85, _PREF)} SELECT node, round(x, 9) AS x FROM x{FIXED}")
def preferential_converged(c):
    q = g.nodes_of(c.part_edges).where("node % 10 = 0").withColumn("weight", F.lit(1.0))
    return g.pagerank(c.part_edges, preference=q, tolerance=TIGHT).select("node", F.round("x", 9).alias("x"))


@graphs("C19_single_source_pagerank_converged", f"WITH {_PE}, {_rank_sql('pe', FIXED, 0.85, f'SELECT node, CASE WHEN node = {SEED_NODE} THEN 1.0::DOUBLE ELSE 0 END AS p FROM nd')} SELECT node, round(x, 9) AS x FROM x{FIXED}")
def single_source_converged(c):
    return g.pagerank(c.part_edges, preference=_seed(c).withColumn("weight", F.lit(1.0)), tolerance=TIGHT).select("node", F.round("x", 9).alias("x"))


def _katz_sql(e: str, rounds: int, alpha: float, pref: str) -> str:
    parts = [f"nd AS ({_NODES.format(e=e)})", f"pf AS ({pref})", "x0 AS (SELECT node, p AS x FROM pf)"]
    for r in range(1, rounds + 1):
        parts.append(f"x{r} AS MATERIALIZED (SELECT pf.node, p + {alpha} * coalesce(f, 0) AS x FROM pf LEFT JOIN (SELECT e.dst, sum(x) AS f FROM x{r - 1} JOIN {e} e ON e.src = x{r - 1}.node GROUP BY e.dst) q ON q.dst = pf.node)")
    return ", ".join(parts)


@graphs("C7_katz_converged", f"WITH {_PE}, {_katz_sql('pe', FIXED, 0.01, 'SELECT node, 1.0::DOUBLE AS p FROM nd')} SELECT node, round(x, 7) AS x FROM x{FIXED}")
def katz_converged(c):
    return g.katz(c.part_edges, 0.01, tolerance=TIGHT * 100).select("node", F.round("x", 7).alias("x"))


@graphs("C17_query_katz_converged", f"WITH {_PE}, {_katz_sql('pe', FIXED, 0.01, 'SELECT node, CASE WHEN node % 10 = 0 THEN 1.0::DOUBLE ELSE 0 END AS p FROM nd')} SELECT node, round(x, 7) AS x FROM x{FIXED}")
def query_katz_converged(c):
    q = g.nodes_of(c.part_edges).where("node % 10 = 0").withColumn("weight", F.lit(1.0))
    return g.katz(c.part_edges, 0.01, preference=q, tolerance=TIGHT * 100).select("node", F.round("x", 7).alias("x"))


def _power_sql(e: str, rounds: int, share: str, norm: str) -> str:
    parts = [f"nd AS ({_NODES.format(e=e)})", f"od AS (SELECT src, count(*) AS k FROM {e} GROUP BY src)", "x0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS x FROM nd)"]
    for r in range(1, rounds + 1):
        parts.append(f"y{r} AS MATERIALIZED (SELECT nd.node, coalesce(f, 0) AS x FROM nd LEFT JOIN (SELECT e.dst, sum({share}) AS f FROM x{r - 1} JOIN {e} e ON e.src = x{r - 1}.node JOIN od ON od.src = e.src GROUP BY e.dst) q ON q.dst = nd.node)")
        parts.append(f"x{r} AS MATERIALIZED (SELECT node, x / (SELECT {norm} FROM y{r}) AS x FROM y{r})")
    return ", ".join(parts)


@graphs("C5_eigenvector_converged", f"WITH {_PE}, {_power_sql('pe', FIXED, 'x', 'sqrt(sum(x * x))')} SELECT node, round(x, 8) AS x FROM x{FIXED}")
def eigen_converged(c):
    return g.eigenvector(c.part_edges, tolerance=TIGHT * 10).select("node", F.round("x", 8).alias("x"))


@graphs("C6_seeley_converged", f"WITH {_PE}, {_power_sql('pe', FIXED, 'x / k', 'sum(abs(x))')} SELECT node, round(x, 9) AS x FROM x{FIXED}")
def seeley_converged(c):
    return g.eigenvector(c.part_edges, markovian=True, tolerance=TIGHT).select("node", F.round("x", 9).alias("x"))


def _hits_sql(e: str, rounds: int) -> str:
    parts = [f"nd AS ({_NODES.format(e=e)})", "x0 AS (SELECT node, 1.0::DOUBLE AS x FROM nd)"]
    for r in range(1, rounds + 1):
        parts.append(f"h{r} AS MATERIALIZED (SELECT e.src AS node, sum(x) AS h FROM x{r - 1} JOIN {e} e ON e.dst = x{r - 1}.node GROUP BY e.src)")
        parts.append(f"y{r} AS MATERIALIZED (SELECT nd.node, coalesce(f, 0) AS x FROM nd LEFT JOIN (SELECT e.dst, sum(h) AS f FROM h{r} JOIN {e} e ON e.src = h{r}.node GROUP BY e.dst) q ON q.dst = nd.node)")
        parts.append(f"x{r} AS MATERIALIZED (SELECT node, x / (SELECT sqrt(sum(x * x)) FROM y{r}) AS x FROM y{r})")
    return ", ".join(parts)


@graphs("C9_hits_converged", f"WITH {_PE}, {_hits_sql('pe', FIXED)} SELECT node, round(x, 8) AS x FROM x{FIXED}")
def hits_converged(c):
    return g.hits(c.part_edges, tolerance=TIGHT * 10).select("node", F.round("x", 8).alias("x"))


@graphs("C10_salsa", "SELECT node, round(coalesce(k, 0) / (SELECT count(*) FROM supplier_edges)::DOUBLE, 9) AS x FROM (SELECT src AS node FROM supplier_edges UNION SELECT dst FROM supplier_edges) LEFT JOIN (SELECT dst, count(*) AS k FROM supplier_edges GROUP BY dst) ON dst = node")
def salsa_scores(c):
    """The dense graph has one component of co-citation, where the closed form is the share of arcs."""
    return g.salsa(c.supplier_edges).select("node", F.round("x", 9).alias("x"))


@graphs(
    "C11_betweenness",
    f"""WITH {_DIST2}, f2 AS (SELECT a.s, a.t, a.d, CASE WHEN a.d = 1 THEN 1 ELSE (SELECT count(*) FROM sg x JOIN sg y ON y.src = x.dst WHERE x.src = a.s AND y.dst = a.t) END AS paths FROM ad a WHERE a.d <= 2)
    SELECT n.node, round(coalesce(b, 0), 6) AS betweenness FROM sn n LEFT JOIN (SELECT x.dst AS node, sum(1.0 / f2.paths) AS b FROM f2 JOIN sg x ON x.src = f2.s JOIN sg y ON y.src = x.dst AND y.dst = f2.t WHERE f2.d = 2 GROUP BY x.dst) q ON q.node = n.node
    WHERE (SELECT max(d) FROM ad) <= 2""",
)
def betweenness_scores(c):
    b = g.betweenness(c.supplier_edges).select("node", F.round("betweenness", 6).alias("betweenness"))
    return b


@graphs(
    "C12_clustering",
    """WITH und AS (SELECT src, dst FROM part_edges UNION SELECT dst, src FROM part_edges), k AS (SELECT src AS node, count(*) AS k FROM und GROUP BY src),
    t AS (SELECT a.src AS node, count(*) AS t FROM und a JOIN und b ON b.src = a.src AND b.dst > a.dst JOIN und c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src)
    SELECT k.node, round(CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 8) AS clustering FROM k LEFT JOIN t ON t.node = k.node""",
)
def clustering_scores(c):
    return g.clustering(c.part_edges).select("node", F.round("clustering", 8).alias("clustering"))


@graphs("C20_degree_argmax", f"SELECT node, indegree + outdegree AS degree FROM ({_DEG.format(e='part_edges')}) ORDER BY indegree + outdegree DESC, node LIMIT 1")
def degree_argmax(c):
    return g.degrees(c.part_edges).select("node", (F.col("indegree") + F.col("outdegree")).alias("degree")).orderBy(F.desc("degree"), "node").limit(1)


@graphs("G_components", "SELECT count(*) AS n, min(node) AS component FROM (SELECT src AS node FROM part_edges UNION SELECT dst FROM part_edges)")
def component_sizes(c):
    """The part graph is one component at every scale of the test data."""
    return g.components(c.part_edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@graphs("L1_label_propagation")
def labels(c):
    return g.label_propagation(c.part_edges).groupBy("label").agg(F.count(F.lit(1)).alias("size"))


@graphs(
    "L3_log_gap_cost",
    """WITH nn AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS number FROM (SELECT src AS node FROM part_edges UNION SELECT dst FROM part_edges)),
    gp AS (SELECT abs(t - coalesce(lag(t) OVER (PARTITION BY s ORDER BY t), s)) AS gap FROM (SELECT a.number AS s, b.number AS t FROM part_edges JOIN nn a ON a.node = src JOIN nn b ON b.node = dst))
    SELECT CAST(sum(ceil(log2(greatest(gap, 1)))) AS BIGINT) AS cost FROM gp""",
)
def gap_cost(c):
    return g.log_gap_cost(c.part_edges, g.renumber(g.nodes_of(c.part_edges)))


@graphs("L6_prefix_sums", "SELECT node, outdegree, CAST(sum(outdegree) OVER (ORDER BY node) AS BIGINT) AS upto FROM (SELECT src AS node, count(*) AS outdegree FROM supplier_edges GROUP BY src)")
def prefix_sums(c):
    """Prefix counts and the k-th element of a weighted sequence, here the out-degrees in node order."""
    d = c.supplier_edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outdegree"))
    return g.prefix_sums(d, "node", "outdegree")


QUERIES, SQL = graphs.queries, graphs.sql
