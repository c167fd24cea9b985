"""Storage queries (S5-S29): graphs written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pkgloom.plans.registry import Registry
from pkgloom.session import Scratch
from pkgloom.sources.graph_store import GraphStore, cached, graph_json, read_coordinates, read_graph_json, write_csv, write_edge_list
from pkgloom.sources.readers import ChainRepository, by_forge, indexed, json_files, json_lines

storage = Registry()


def _graphs(c):
    """The calls between parts, one graph per brand of the caller."""
    brand = c.part.select(F.col("p_partkey").alias("src"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("graph_id"))
    edges = c.part_edges.join(brand, "src").select("graph_id", "src", "dst")
    nodes = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("external", F.col("node") % 3 == 0)
    return nodes, edges


_GRAPHS = "ge AS (SELECT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS graph_id, src, dst FROM part_edges JOIN part ON p_partkey = src)"


@storage("S5_saved_graphs", f"WITH {_GRAPHS} SELECT graph_id, count(*) AS n_edges FROM ge GROUP BY graph_id")
def saved_graphs(c):
    store = GraphStore(c.spark, Scratch(c.spark).root.toString() + "/graphs")
    store.save(*_graphs(c))
    store.save(*_graphs(c))  # once more replaces them
    return store.table("edges").groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))


@storage("S9_deleted_graph", f"WITH {_GRAPHS} SELECT graph_id, count(*) AS n_edges FROM ge WHERE graph_id <> (SELECT min(graph_id) FROM ge) GROUP BY graph_id")
def deleted_graph(c):
    store = GraphStore(c.spark, Scratch(c.spark).root.toString() + "/graphs")
    nodes, edges = _graphs(c)
    store.save(nodes, edges)
    store.delete(nodes.agg(F.min("graph_id")).first()[0])
    return store.table("edges").groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))


@storage("S18_cached_table", "SELECT src, dst FROM part_edges")
def cached_table(c):
    path = Scratch(c.spark).root.toString() + "/edges"
    cached(c.spark, path, lambda: c.part_edges)
    return cached(c.spark, path, lambda: c.part_edges.limit(0))


@storage("S20_edge_list", "SELECT DISTINCT '/p' || src || '->' || '/p' || dst AS value FROM part_edges")
def edge_list(c):
    path = Scratch(c.spark).root.toString() + "/list"
    names = c.part.select(F.col("p_partkey").alias("node"), F.concat(F.lit("/p"), F.col("p_partkey").cast("string")).alias("uri"))
    write_edge_list(c.part_edges, names, path)
    return c.spark.read.text(path)


@storage("S21_csv", "SELECT p_partkey::VARCHAR AS k, p_name || ', \"' || p_brand || '\"' AS v FROM part")
def csv(c):
    path = Scratch(c.spark).root.toString() + "/csv"
    write_csv(c.part.select(F.col("p_partkey").cast("string").alias("k"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("v")), path)
    return c.spark.read.option("header", True).option("escape", '"').csv(path)


@storage("S23_json_round_trip", f"WITH {_GRAPHS} SELECT graph_id, src, dst FROM ge")
def json_round_trip(c):
    nodes, edges = _graphs(c)
    return read_graph_json(graph_json(nodes, edges))[1]


def _sites(c):
    """Calls between parts on consecutive lines, with line and receivers, in the graph of the caller's brand."""
    line = c.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    rows = line.join(after, ["l_orderkey", "l_linenumber"]).where("l_partkey <> dst").select(F.col("l_partkey").alias("src"), "dst", F.col("l_linenumber").cast("int").alias("line"), F.col("l_returnflag").alias("call_type")).distinct()
    brand = c.part.select(F.col("p_partkey").alias("src"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("graph_id"))
    return rows.join(brand, "src").select("graph_id", "src", "dst", "line", "call_type", F.array(F.concat(F.lit("/T"), F.col("dst").cast("string"))).alias("receivers"))


_SITES = "WITH si AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS graph_id, a.l_partkey AS src, b.l_partkey AS dst, CAST(a.l_linenumber AS INT) AS line, a.l_returnflag AS call_type FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN part ON p_partkey = a.l_partkey WHERE a.l_partkey <> b.l_partkey)"


def _stored_with_sites(c):
    store = GraphStore(c.spark, Scratch(c.spark).root.toString() + "/graphs")
    store.save(*_graphs(c), _sites(c))
    return store


@storage("S6_saved_call_sites", f"{_SITES} SELECT graph_id, src, count(*) AS n_sites, count(DISTINCT dst) AS n_targets FROM si GROUP BY graph_id, src")
def saved_call_sites(c):
    """Call sites as they are stored: together for each source."""
    rows = _stored_with_sites(c).table("sites")
    return rows.select("graph_id", "src", F.size("calls").cast("long").alias("n_sites"), F.size(F.array_distinct(F.transform("calls", lambda x: x.dst))).cast("long").alias("n_targets"))


@storage("S8_loaded_call_sites", f"{_SITES} SELECT graph_id, src, dst, line, call_type, '/T' || dst AS receiver FROM si")
def loaded_call_sites(c):
    return _stored_with_sites(c).sites().select("graph_id", "src", "dst", "line", "call_type", F.col("receivers")[0].alias("receiver"))


@storage("S30_dumped_graph", f"WITH {_GRAPHS}, si AS ({_SITES[12:-1]}), g AS (SELECT min(graph_id) AS id FROM ge) SELECT DISTINCT src || ' -> ' || dst AS value FROM ge WHERE graph_id = (SELECT id FROM g) UNION ALL SELECT DISTINCT src || ':' FROM si WHERE graph_id = (SELECT id FROM g)")
def dumped_graph(c):
    """The lines of a dumped graph: its edges, then its sources (here without their call sites)."""
    store = _stored_with_sites(c)
    path = Scratch(c.spark).root.toString() + "/dump"
    store.dump(store.table("nodes").agg(F.min("graph_id")).first()[0], path)
    return c.spark.read.text(path).select(F.regexp_replace("value", r"^(\d+:) .*", "$1").alias("value"))


@storage("S7_loaded_graph", f"WITH {_GRAPHS}, g AS (SELECT min(graph_id) AS id FROM ge) SELECT DISTINCT src, dst FROM ge WHERE graph_id = (SELECT id FROM g)")
def loaded_graph(c):
    """One graph, read from its bucket."""
    store = GraphStore(c.spark, Scratch(c.spark).root.toString() + "/graphs")
    nodes, edges = _graphs(c)
    store.save(nodes, edges)
    return store.load(nodes.agg(F.min("graph_id")).first()[0])[1].select("src", "dst")


@storage("S10_json_files", "SELECT 'r' || id AS name, repository_base_url AS url, false AS broken FROM artifact_repositories UNION ALL SELECT NULL, NULL, true")
def json_file_rows(c):
    """Files of one JSON record each, and one that is broken."""
    path = Scratch(c.spark).root.toString() + "/files"
    rows = c.artifact_repositories.select(F.to_json(F.struct(F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"), F.col("repository_base_url").alias("url"))).alias("value"), F.col("id").alias("place"))
    rows.union(c.spark.createDataFrame([('{"name":', -99)], "value string, place long")).repartition("place").write.partitionBy("place").text(path)
    v = F.try_parse_json("json")
    return json_files(c.spark, path).select(F.try_variant_get(v, "$.name", "string").alias("name"), F.try_variant_get(v, "$.url", "string").alias("url"), "broken")


@storage("S12_json_lines", "SELECT count(*) AS n_lines, count(*) FILTER (WHERE json_valid(message)) AS n_whole FROM callable_messages WHERE trim(message) <> ''")
def json_line_rows(c):
    """Files of JSON lines, read back: records, and those that are whole."""
    path = Scratch(c.spark).root.toString() + "/lines"
    c.callable_messages.where("message IS NOT NULL").select(F.regexp_replace("message", r"\R", " ").alias("value")).write.text(path)
    return json_lines(c.spark, path).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~F.col("broken")).alias("n_whole"))


@storage("S28_indexed", "SELECT json_extract_string(message, '$.plugin_name') AS plugin, count(*) AS n FROM callable_messages WHERE json_valid(message) AND trim(message) <> '' AND message IS NOT NULL GROUP BY 1")
def indexed_messages(c):
    """The same transform for files and for a topic; here for files."""
    path = Scratch(c.spark).root.toString() + "/lines"
    c.callable_messages.where("message IS NOT NULL").select(F.regexp_replace("message", r"\R", " ").alias("value")).write.text(path)
    count = lambda r: r.groupBy(F.try_variant_get(F.try_parse_json("json"), "$.plugin_name", "string").alias("plugin")).agg(F.count(F.lit(1)).alias("n"))
    return indexed(c.spark, count, files=path)


@storage("S2_forges", "SELECT forge, count(*) AS n FROM packages WHERE forge <> 'debian' GROUP BY forge")
def forges(c):
    """A table of each forge as one; the filter leaves one of them unread."""
    p = c.packages.drop("forge")
    tables = {f: p.join(c.packages.where(F.col("forge") == f).select("id"), "id", "left_semi") for f in ("mvn", "debian", "PyPI")}
    return by_forge(tables).where("forge <> 'debian'").groupBy("forge").agg(F.count(F.lit(1)).alias("n"))


@storage("S24_stored_chains", "SELECT package_name AS package, package_version AS version, count(*) AS n FROM vpurls GROUP BY ALL")
def stored_chains(c):
    """Chains of each vulnerable version, stored twice and read back."""
    repo = ChainRepository(c.spark, Scratch(c.spark).root.toString() + "/chains")
    per = c.vulnerabilities_purls.groupBy(F.col("package_name").alias("package"), F.col("package_version").alias("version")).agg(F.count(F.lit(1)).alias("n"))
    rows = per.select("package", "version", F.to_json(F.struct("n")).alias("json"))
    repo.store(rows)
    repo.store(rows)
    return repo.load().select("package", "version", F.get_json_object("json", "$.n").cast("long").alias("n"))


@storage("S11_coordinates", "SELECT split_part(package_name, ':', 1) AS \"group\", split_part(package_name, ':', 2) AS artifact, package_version AS version FROM (SELECT DISTINCT package_name, package_version FROM vpurls) WHERE len(string_split(package_name || ':' || package_version, ':')) = 3")
def coordinates(c):
    path = Scratch(c.spark).root.toString() + "/coordinates"
    c.vulnerabilities_purls.select(F.concat_ws(":", "package_name", "package_version").alias("value")).distinct().write.text(path)
    return read_coordinates(c.spark, path)


QUERIES, SQL = storage.queries, storage.sql
