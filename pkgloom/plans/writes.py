"""Relational writes (W1-W30): the new state of each table after an upsert, as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgloom.functions import json_ops
from pkgloom.operators.graph import renumber
from pkgloom.operators.upsert import append_new, append_strict, from_lists, get_or_create, ids_in_order, upsert
from pkgloom.plans.reads import affected_versions, in_intervals
from pkgloom.plans.registry import Registry, micros

writes = Registry()

_SEEN = "(SELECT package_name, forge, min(package_version) AS project_name, 'seen' AS repository FROM vpurls GROUP BY ALL)"


@writes(
    "W1_upsert_packages",
    f"SELECT coalesce(p.package_name, x.package_name) AS package_name, coalesce(p.forge, x.forge) AS forge, CASE WHEN x.package_name IS NOT NULL THEN x.project_name ELSE p.project_name END AS project_name, CASE WHEN x.package_name IS NOT NULL THEN x.repository ELSE p.repository END AS repository FROM packages p FULL JOIN {_SEEN} x ON x.package_name = p.package_name AND x.forge = p.forge",
)
def upsert_packages(c):
    batch = c.vulnerabilities_purls.groupBy("package_name", "forge").agg(F.min("package_version").alias("project_name")).withColumn("repository", F.lit("seen"))
    return upsert(c.packages.select("package_name", "forge", "project_name", "repository"), batch, ["package_name", "forge"])


@writes(
    "W2_get_or_create_packages",
    "SELECT x.package_name AS name, coalesce(p.id, t.top + dense_rank() OVER (PARTITION BY p.id IS NULL ORDER BY x.package_name)) AS id FROM (SELECT DISTINCT package_name FROM (SELECT package_name FROM vpurls UNION SELECT p_name FROM part)) x LEFT JOIN (SELECT package_name, min(id) AS id FROM packages GROUP BY 1) p ON p.package_name = x.package_name, (SELECT max(id) AS top FROM packages) t",
)
def create_packages(c):
    names = c.vulnerabilities_purls.select(F.col("package_name").alias("name")).union(c.part.select("p_name"))
    stored = c.packages.groupBy(F.col("package_name").alias("name")).agg(F.min("id").alias("id"))
    return get_or_create(stored, names)


@writes("W4_get_or_create_repositories", "SELECT x.url AS name, coalesce(a.id, t.top + dense_rank() OVER (PARTITION BY a.id IS NULL ORDER BY x.url)) AS id FROM (SELECT DISTINCT repository AS url FROM packages WHERE repository IS NOT NULL UNION SELECT repository_base_url FROM artifact_repositories) x LEFT JOIN artifact_repositories a ON a.repository_base_url = x.url, (SELECT max(id) AS top FROM artifact_repositories) t")
def create_repositories(c):
    a = c.artifact_repositories.select(F.col("repository_base_url").alias("name"), "id")
    return get_or_create(a, c.packages.select(F.col("repository").alias("name")).union(a.select("name")))


_VERSIONS = "(SELECT package_id, version, cg_generator, min(created_at) AS created_at, max(metadata) AS metadata FROM package_versions GROUP BY ALL)"


@writes(
    "W5_upsert_versions",
    f"""SELECT v.package_id, v.version, v.cg_generator, epoch_us(coalesce(x.created_at, v.created_at)) AS created_us, json_extract_string(v.metadata, '$.commitTag') AS commit_tag, CASE WHEN x.package_id IS NOT NULL AND v.metadata IS NOT NULL THEN 'yes' ELSE json_extract_string(v.metadata, '$.named') END AS named
    FROM {_VERSIONS} v LEFT JOIN (SELECT package_id, version, cg_generator, TIMESTAMP '2024-01-01' AS created_at FROM {_VERSIONS} w WHERE version IN (SELECT package_version FROM vpurls)) x ON x.package_id = v.package_id AND x.version = v.version AND x.cg_generator IS NOT DISTINCT FROM v.cg_generator""",
)
def upsert_versions(c):
    """created_at is overwritten, metadata concatenated; a null metadata stays null."""
    v = c.table("package_versions").groupBy("package_id", "version", "cg_generator").agg(F.min("created_at").alias("created_at"), F.max("metadata").alias("metadata"))
    named = c.vulnerabilities_purls.select(F.col("package_version").alias("version")).distinct()
    batch = v.join(named, "version", "left_semi").select("package_id", "version", "cg_generator", F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"), F.lit('{"named":"yes"}').alias("metadata"))
    out = upsert(v, batch, ["package_id", "version", "cg_generator"], {"metadata": "concat"})
    return out.select("package_id", "version", "cg_generator", micros("created_at").alias("created_us"), json_ops.pointer("metadata", "/commitTag").alias("commit_tag"), json_ops.pointer("metadata", "/named").alias("named"))


@writes("W6_outbound_licenses", "SELECT pv.id, json_extract_string(pv.metadata, '$.commitTag') AS commit_tag, CASE WHEN p.forge = 'mvn' THEN 'Apache-2.0' ELSE json_extract_string(pv.metadata, '$.license') END AS license FROM pv JOIN packages p ON p.id = pv.package_id")
def outbound_licenses(c):
    """An update by join; a null metadata counts as an empty object."""
    p = c.packages.select(F.col("id").alias("pid"), "forge")
    j = c.package_versions.join(p, F.col("pid") == F.col("package_id"))
    md = F.when(F.col("forge") == "mvn", json_ops.concat("metadata", F.lit('{"license":"Apache-2.0"}'), null_is_empty=True)).otherwise(F.col("metadata"))
    return j.withColumn("md", md).select("id", json_ops.pointer("md", "/commitTag").alias("commit_tag"), json_ops.pointer("md", "/license").alias("license"))


@writes("W7_file_licenses", "SELECT f.id, max(l.license) AS license FROM files f LEFT JOIN (SELECT 's' || s_suppkey || '/file.java' AS tail, 'L' || (s_suppkey % 3) AS license FROM supplier) l ON lower(f.path) LIKE '%/' || l.tail GROUP BY f.id")
def file_licenses(c):
    """The last two segments of a path, compared without case: cut out and joined."""
    tail = F.lower(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/"))
    lic = c.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("/file.java")).alias("tail"), F.concat(F.lit("L"), (F.col("s_suppkey") % 3).cast("string")).alias("license"))
    return c.files.withColumn("tail", tail).join(lic, "tail", "left").groupBy("id").agg(F.max("license").alias("license"))


@writes("W14_upsert_callables", "SELECT id, is_internal_call OR id IN (SELECT target_id FROM call_sites WHERE call_type = 'static') AS is_internal_call, line_start, line_end FROM callables")
def upsert_callables(c):
    hit = c.call_sites.where("call_type = 'static'").select(F.col("target_id").alias("id")).distinct().withColumn("is_internal_call", F.lit(True))
    hit = hit.join(c.callables.select("id"), "id", "left_semi")
    return upsert(c.callables.select("id", "is_internal_call", "line_start", "line_end"), hit, ["id"])


@writes("W17_upsert_edges", "SELECT source_id, target_id, CAST(line + CASE WHEN call_type = 'static' THEN 100 ELSE 0 END AS INT) AS line, CASE WHEN call_type = 'static' THEN 'special' ELSE call_type END AS call_type FROM call_sites")
def upsert_edges(c):
    e = c.call_sites.select("source_id", "target_id", "line", "call_type")
    batch = e.where("call_type = 'static'").select("source_id", "target_id", (F.col("line") + 100).cast("int").alias("line"), F.lit("special").alias("call_type"))
    return upsert(e, batch, ["source_id", "target_id"])


@writes("W20_namespaces", "SELECT x.name, coalesce(d.id, t.top + dense_rank() OVER (PARTITION BY d.id IS NULL ORDER BY x.name)) AS id FROM (SELECT p_brand AS name FROM part UNION SELECT p_type FROM part) x LEFT JOIN (SELECT p_type AS name, dense_rank() OVER (ORDER BY p_type) AS id FROM (SELECT DISTINCT p_type FROM part)) d ON d.name = x.name, (SELECT count(DISTINCT p_type) AS top FROM part) t")
def namespaces(c):
    types = c.part.select(F.col("p_type").alias("name")).distinct()
    stored = get_or_create(types.select("name", F.lit(0).cast("long").alias("id")).limit(0), types)
    return get_or_create(stored, c.part.select(F.col("p_brand").alias("name")).union(types))


@writes("W22_count_retries", "SELECT user_id, 1 + count(*) FILTER (WHERE event_type = 'error') AS retries FROM events GROUP BY user_id")
def count_retries(c):
    old = c.events.select("user_id").distinct().withColumn("retries", F.lit(1).cast("long"))
    batch = c.events.where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("retries"))
    return upsert(old, batch, ["user_id"], {"retries": "add"})


@writes(
    "W24_quality_metadata",
    "SELECT s.id AS target, count(*) AS n_hits FROM (SELECT id, module_id, line_start AS at FROM callables) s JOIN callables cl ON cl.module_id = s.module_id AND s.at BETWEEN cl.line_start AND cl.line_end GROUP BY s.id",
)
def quality_metadata(c):
    """How many callables of a module a measured line falls into; an update is right where it is one."""
    points = c.callables.select("module_id", F.struct(F.col("line_start"), F.col("id")).alias("p"))
    flat = points.select("module_id", F.col("p.line_start").alias("at"), F.col("p.id").alias("target"))
    hits = in_intervals(flat.select("module_id", "at").distinct(), c.callables.select("id", "module_id", "line_start", "line_end"), "module_id", "at", "line_start", "line_end")
    per = hits.groupBy("module_id", F.col("_at").alias("at")).agg(F.count(F.lit(1)).alias("n_hits"))
    return flat.join(per, ["module_id", "at"]).select("target", "n_hits")


@writes("W28_inject_vulnerabilities", "SELECT a.version_id, v.external_id AS key, v.external_id AS id, json_extract_string(pv.metadata, '$.commitTag') AS commit_tag FROM (SELECT DISTINCT x.vulnerability_id, pv.id AS version_id FROM packages p JOIN pv ON pv.package_id = p.id JOIN vpurls x ON x.package_name = p.package_name AND x.package_version = pv.version AND x.forge = p.forge) a JOIN vulnerabilities v ON v.id = a.vulnerability_id JOIN pv ON pv.id = a.version_id")
def inject_vulnerabilities(c):
    """metadata.vulnerabilities[id] = {id}, other keys kept."""
    v = c.vulnerabilities.select(F.col("id").alias("vulnerability_id"), "external_id")
    j = affected_versions(c).join(v, "vulnerability_id").join(c.package_versions.select(F.col("id").alias("version_id"), "metadata"), "version_id")
    md = json_ops.put_nested("metadata", "vulnerabilities", F.col("external_id"), F.to_json(F.struct(F.col("external_id").alias("id"))))
    m = F.try_variant_get(F.try_parse_json("md"), "$.vulnerabilities", "map<string,variant>")
    j = j.withColumn("md", md)
    return j.select("version_id", F.explode(m).alias("key", "value"), json_ops.pointer("md", "/commitTag").alias("commit_tag")).select("version_id", "key", F.try_variant_get("value", "$.id", "string").alias("id"), "commit_tag")


@writes("W30_flatten_licenses", "SELECT external_id, ord - 1 AS n, cwe FROM (SELECT external_id, unnest(l) AS cwe, generate_subscripts(l, 1) AS ord FROM (SELECT external_id, from_json(json_extract(statement, '$.cwe_ids'), '[\"VARCHAR\"]') AS l FROM vulnerabilities WHERE json_type(statement, '$.cwe_ids') = 'ARRAY')) WHERE cwe IS NOT NULL")
def flatten_list(c):
    """Every element of a list in its own row with its place (each keeps its own value)."""
    l = F.try_variant_get(F.try_parse_json("statement"), "$.cwe_ids", "array<variant>")
    rows = c.vulnerabilities.select("external_id", F.posexplode(l).alias("n", "v"))
    return rows.select("external_id", F.col("n").cast("long").alias("n"), F.try_variant_get("v", "$", "string").alias("cwe")).where("cwe IS NOT NULL")


_LISTED = "(SELECT package_name, forge, 'v' || max(vulnerability_id) AS project_name FROM vpurls GROUP BY ALL)"


@writes("W3_insert_package_lists", f"SELECT coalesce(p.package_name, x.package_name) AS package_name, coalesce(p.forge, x.forge) AS forge, CASE WHEN x.package_name IS NOT NULL THEN x.project_name ELSE p.project_name END AS project_name FROM packages p FULL JOIN {_LISTED} x ON x.package_name = p.package_name AND x.forge = p.forge")
def insert_package_lists(c):
    """Each vulnerability brings parallel lists of names and forges; the last one that names a package is its project."""
    x = c.vulnerabilities_purls.where("vulnerability_id IS NOT NULL").groupBy("vulnerability_id").agg(F.collect_list("package_name").alias("package_name"), F.collect_list("forge").alias("forge"))
    rows = from_lists(x, ["package_name", "forge"], ["vulnerability_id"])
    batch = rows.groupBy("package_name", "forge").agg(F.concat(F.lit("v"), F.max("vulnerability_id").cast("string")).alias("project_name"))
    return upsert(c.packages.select("package_name", "forge", "project_name"), batch, ["package_name", "forge"])


_DEPENDENCY = "package_version_id, dependency_id, array_to_string(version_range, '|') AS ranges"


@writes(
    "W8_upsert_dependencies",
    f"""WITH s AS (SELECT {_DEPENDENCY}, max(alternative_group) AS alt, max(metadata) AS md FROM deps WHERE package_version_id IN (SELECT id FROM pv WHERE created_at < TIMESTAMP '2019-01-01') GROUP BY ALL),
    b AS (SELECT {_DEPENDENCY}, min(coalesce(alternative_group, 0)) + 1 AS alt FROM deps WHERE list_contains(dependency_type, 'runtime') OR list_contains(dependency_type, 'test') GROUP BY ALL)
    SELECT coalesce(s.package_version_id, b.package_version_id) AS package_version_id, coalesce(s.dependency_id, b.dependency_id) AS dependency_id, coalesce(s.ranges, b.ranges) AS ranges, CASE WHEN b.dependency_id IS NOT NULL THEN b.alt ELSE s.alt END AS alternative_group,
      CASE WHEN b.dependency_id IS NULL THEN NULL WHEN s.dependency_id IS NULL OR s.md IS NOT NULL THEN 'yes' END AS seen, json_extract_string(s.md, '$.optional') AS optional, s.dependency_id IS NOT NULL AS stored
    FROM s FULL JOIN b ON s.package_version_id = b.package_version_id AND s.dependency_id = b.dependency_id AND s.ranges IS NOT DISTINCT FROM b.ranges""",
)
def upsert_dependencies(c):
    """Dependencies of versions before 2019 are stored; those of two scopes arrive. The list of ranges is part of the key; metadata is concatenated."""
    keys = ["package_version_id", "dependency_id", "version_range"]
    old = c.package_versions.where("created_at < TIMESTAMP_NTZ '2019-01-01 00:00:00'").select(F.col("id").alias("package_version_id")).distinct()
    stored = c.dependencies.join(old, "package_version_id", "left_semi").groupBy(*keys).agg(F.max("alternative_group").alias("alternative_group"), F.max("metadata").alias("metadata")).withColumn("stored", F.lit(True))
    scoped = c.dependencies.where(F.array_contains("dependency_type", "runtime") | F.array_contains("dependency_type", "test"))
    batch = scoped.groupBy(*keys).agg((F.min(F.coalesce("alternative_group", F.lit(0))) + 1).alias("alternative_group")).withColumn("metadata", F.lit('{"seen":"yes"}'))
    out = upsert(stored, batch, keys, {"metadata": "concat"})
    return out.select("package_version_id", "dependency_id", F.array_join("version_range", "|").alias("ranges"), "alternative_group", json_ops.pointer("metadata", "/seen").alias("seen"), json_ops.pointer("metadata", "/optional").alias("optional"), F.coalesce("stored", F.lit(False)).alias("stored"))


@writes("W9_virtual_implementations", "SELECT DISTINCT dependency_id AS virtual_id, package_version_id FROM deps WHERE alternative_group IS NOT NULL OR list_contains(dependency_type, 'test')")
def virtual_implementations(c):
    """Pairs that are stored are kept once, new ones added."""
    d = c.dependencies.select(F.col("dependency_id").alias("virtual_id"), "package_version_id", "alternative_group", "dependency_type")
    pairs = lambda rows: rows.select("virtual_id", "package_version_id")
    return append_new(pairs(d.where("alternative_group IS NOT NULL")).distinct(), pairs(d.where(F.array_contains("dependency_type", "test"))), ["virtual_id", "package_version_id"])


@writes("W10_upsert_modules", "SELECT id, CASE WHEN final THEN 'batch' ELSE access END AS access, CASE WHEN final AND access = 'R' THEN 'both' WHEN final THEN 'batch' WHEN access = 'R' THEN 'stored' END AS whose FROM modules WHERE access IN ('A', 'R') OR final")
def upsert_modules(c):
    """Four columns are overwritten, metadata concatenated with null as empty."""
    m = c.modules.where("access IN ('A', 'R')")
    stored = m.select("id", "package_version_id", "module_name_id", "final", "access", F.when(F.col("access") == "R", '{"a":"stored"}').alias("metadata"))
    batch = c.modules.where("final").select("id", "package_version_id", "module_name_id", "final", F.lit("batch").alias("access"), F.lit('{"b":"batch"}').alias("metadata"))
    out = upsert(stored, batch, ["id"], {"metadata": "concat_null"})
    a, b = json_ops.pointer("metadata", "/a"), json_ops.pointer("metadata", "/b")
    return out.select("id", "access", F.when(a.isNotNull() & b.isNotNull(), "both").otherwise(F.coalesce(a, b)).alias("whose"))


_BINARY = "SELECT l_orderkey AS package_version_id, 'lib' || l_suppkey || '.so' AS path, max(l_shipdate) AS at FROM lineitem WHERE {w} GROUP BY ALL"
_FILES = "WITH s AS (" + _BINARY.format(w="l_returnflag = 'R'") + "), b AS (" + _BINARY.format(w="l_linestatus = 'F'") + ") SELECT coalesce(s.package_version_id, b.package_version_id) AS package_version_id, coalesce(s.path, b.path) AS path, epoch_us(coalesce(b.at, s.at)) AS created_us, {c} FROM s FULL JOIN b ON s.package_version_id = b.package_version_id AND s.path = b.path"


def _binaries(c, where: str):
    path = F.concat(F.lit("lib"), F.col("l_suppkey").cast("string"), F.lit(".so"))
    return c.lineitem.where(where).groupBy(F.col("l_orderkey").alias("package_version_id"), path.alias("path")).agg(F.max("l_shipdate").alias("created_at"))


@writes("W11_binary_modules", _FILES.format(c="CASE WHEN s.path IS NOT NULL AND b.path IS NOT NULL THEN '12' WHEN b.path IS NOT NULL THEN '2' ELSE '1' END AS sides"))
def binary_modules(c):
    """created_at is overwritten, metadata concatenated."""
    stored = _binaries(c, "l_returnflag = 'R'").withColumn("metadata", F.lit('{"one":1}'))
    batch = _binaries(c, "l_linestatus = 'F'").withColumn("metadata", F.lit('{"two":2}'))
    out = upsert(stored, batch, ["package_version_id", "path"], {"metadata": "concat"})
    sides = F.concat_ws("", json_ops.pointer("metadata", "/one"), json_ops.pointer("metadata", "/two"))
    return out.select("package_version_id", "path", micros("created_at").alias("created_us"), sides.alias("sides"))


@writes("W12_module_contents", "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS module_id, l_orderkey * 100000 + l_suppkey AS file_id FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'F'")
def insert_contents(c):
    """Pairs of returned lines are stored, those of finished lines arrive; many are both."""
    k = F.col("l_orderkey")
    pairs = lambda rows: rows.select((k * 10 + F.col("l_linenumber")).alias("module_id"), (k * 100_000 + F.col("l_suppkey")).alias("file_id"))
    return append_new(pairs(c.lineitem.where("l_returnflag = 'R'")).distinct(), pairs(c.lineitem.where("l_linestatus = 'F'")), ["module_id", "file_id"])


@writes("W13_insert_files", _FILES.format(c="CASE WHEN b.path IS NOT NULL THEN 'new' ELSE 'old' END AS checksum"))
def insert_files(c):
    """A file with a checksum overwrites it and created_at; one that brings its path only changes nothing that is stored."""
    keys = ["package_version_id", "path"]
    stored = _binaries(c, "l_returnflag = 'R'").withColumn("checksum", F.lit("old"))
    full = upsert(stored, _binaries(c, "l_linestatus = 'F'").withColumn("checksum", F.lit("new")), keys)
    paths = stored.select(*keys, F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("string").alias("checksum"))
    out = append_new(full, paths, keys)
    return out.select(*keys, micros("created_at").alias("created_us"), "checksum")


@writes("W15_callable_metadata", "SELECT id, line_start, CASE WHEN id IN (SELECT source_id FROM call_sites) THEN 'calls' END AS does FROM callables")
def callable_metadata(c):
    """Only metadata changes; the other columns of a stored callable stay."""
    stored = c.callables.select("id", "line_start", F.lit(None).cast("string").alias("metadata"))
    batch = c.call_sites.select(F.col("source_id").alias("id")).distinct().withColumn("metadata", F.lit('{"does":"calls"}'))
    out = upsert(stored, batch, ["id"], {"metadata": "concat_null"})
    return out.select("id", "line_start", json_ops.pointer("metadata", "/does").alias("does"))


_STORED = "(SELECT uri, dense_rank() OVER (ORDER BY uri) AS id FROM (SELECT DISTINCT uri FROM callables WHERE is_internal_call))"


@writes("W16_insert_callable_lists", "SELECT module_id, count(*) AS n, min(uri) AS first_uri, max(line_end) AS last_line FROM callables GROUP BY module_id")
def insert_callable_lists(c):
    """Callables as parallel lists for each module, taken apart and inserted; internal ones are stored before, with a wrong line end."""
    lists = c.callables.groupBy("module_id").agg(F.collect_list(F.struct("uri", "line_end")).alias("l")).select("module_id", F.col("l.uri").alias("uri"), F.col("l.line_end").alias("line_end"))
    stored = c.callables.where("is_internal_call").select("module_id", "uri", F.lit(-1).alias("line_end")).distinct()
    out = upsert(stored, from_lists(lists, ["uri", "line_end"], ["module_id"]).groupBy("module_id", "uri").agg(F.max("line_end").alias("line_end")), ["module_id", "uri"])
    return out.groupBy("module_id").agg(F.count(F.lit(1)).alias("n"), F.min("uri").alias("first_uri"), F.max("line_end").alias("last_line"))


@writes("W18_callable_ids", f"SELECT c.id AS place, c.uri AS name, coalesce(s.id, t.top + dense_rank() OVER (PARTITION BY s.id IS NULL ORDER BY c.uri)) AS id FROM callables c LEFT JOIN {_STORED} s ON s.uri = c.uri, (SELECT max(id) AS top FROM {_STORED}) t")
def callable_ids(c):
    """The id of every callable of a batch, by its place: stored ones by URI, new ones above them."""
    internal = c.callables.where("is_internal_call").select(F.col("uri").alias("name")).distinct()
    stored = get_or_create(internal.select("name", F.lit(0).cast("long").alias("id")).limit(0), internal)
    return ids_in_order(stored, c.callables.select(F.col("id").alias("place"), F.col("uri").alias("name")), "place")


@writes(
    "W19_callables_separately",
    "WITH known AS (SELECT uri, min(id) AS id FROM callables WHERE NOT is_internal_call AND type = 'internalBinary' GROUP BY uri), ext AS (SELECT c.uri, coalesce(k.id, -dense_rank() OVER (PARTITION BY k.id IS NULL ORDER BY c.uri)) AS id FROM (SELECT DISTINCT uri FROM callables WHERE NOT is_internal_call) c LEFT JOIN known k ON k.uri = c.uri) SELECT c.id AS place, CASE WHEN c.is_internal_call THEN c.id ELSE e.id END AS id, c.is_internal_call AS internal FROM callables c LEFT JOIN ext e ON e.uri = c.uri",
)
def callables_separately(c):
    """Internal callables are rows of their own; external ones are one per URI: looked up, and added where no version has named them."""
    internal = c.callables.where("is_internal_call").select(F.col("id").alias("place"), "id", F.lit(True).alias("internal"))
    ext = c.callables.where("NOT is_internal_call").select(F.col("id").alias("place"), F.col("uri").alias("name"), "type")
    known = ext.where("type = 'internalBinary'").groupBy("name").agg(F.min("place").alias("id"))
    new = ext.select("name").distinct().join(known, "name", "left_anti")
    numbered = renumber(new.withColumnRenamed("name", "node")).select(F.col("node").alias("name"), (-F.col("number") - 1).alias("id"))
    return internal.unionByName(ext.join(known.unionByName(numbered), "name").select("place", "id", F.lit(False).alias("internal")))


@writes("W21_insert_ingested", "SELECT package_name || ':' || package_version AS key, min(vulnerability_id) AS first_id FROM vpurls GROUP BY 1")
def insert_ingested(c):
    """Artifacts of the Maven forge are stored; the batch brings the others. A key that is stored already would be an error."""
    rows = c.vulnerabilities_purls.select(F.concat_ws(":", "package_name", "package_version").alias("key"), "vulnerability_id", "forge").where("key IS NOT NULL")
    per = rows.groupBy("key").agg(F.min("vulnerability_id").alias("first_id"), F.max((F.col("forge") == "mvn").cast("int")).alias("mvn"))
    return append_strict(per.where("mvn = 1").select("key", "first_id"), per.where("mvn = 0").select("key", "first_id"), ["key"])


@writes("W23_prune_retries", "SELECT user_id, count(*) AS retries FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING max(value) > 100) GROUP BY user_id")
def prune_retries(c):
    """Retry counts of users whose largest purchase got through are deleted."""
    retries = c.events.where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("retries"))
    through = c.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("top")).where("top > 100")
    return retries.join(through, "user_id", "left_anti")


@writes("W25_upsert_vulnerabilities", "SELECT external_id, CASE WHEN feed_id <= 5 THEN feed_id + 10 ELSE feed_id END AS feed_id, CASE WHEN feed_id <= 5 THEN 'again' WHEN statement IS NULL THEN NULL ELSE 'stored' END AS whose FROM vulnerabilities WHERE feed_id <= 5 OR feed_id >= 4")
def upsert_vulnerabilities(c):
    """Feeds from 4 on are stored, feeds up to 5 deliver again under new numbers: some statements are new, some overwritten, some kept."""
    v = c.vulnerabilities.select("external_id", "feed_id", "statement")
    stored = v.where("feed_id >= 4").withColumn("whose", F.when(F.col("statement").isNotNull(), "stored"))
    batch = v.where("feed_id <= 5").withColumns({"feed_id": F.col("feed_id") + 10, "whose": F.lit("again")})
    return upsert(stored, batch, ["external_id"]).select("external_id", "feed_id", "whose")


@writes("W26_insert_purls", "SELECT purl, count(*) AS n FROM vulnerabilities_purls GROUP BY purl")
def insert_purls(c):
    """A plain insert: the batch of one forge is added to the rest, repeated rows and all."""
    x = c.table("vulnerabilities_purls").select("vulnerability_id", "purl", "forge")
    rows = x.where("forge = 'mvn'").unionByName(x.where("forge <> 'mvn' OR forge IS NULL"))
    return rows.groupBy("purl").agg(F.count(F.lit(1)).alias("n"))


_LINKS = "SELECT DISTINCT x.vulnerability_id, pv.id AS version_id, x.forge FROM packages p JOIN pv ON pv.package_id = p.id JOIN vpurls x ON x.package_name = p.package_name AND x.package_version = pv.version AND x.forge = p.forge"


@writes("W27_link_vulnerabilities", f"SELECT DISTINCT vulnerability_id, version_id FROM ({_LINKS}) WHERE vulnerability_id IN (SELECT id FROM vulnerabilities WHERE feed_id <= 5 OR feed_id >= 4)")
def link_vulnerabilities(c):
    """Links of feeds from 4 on are stored, those of feeds up to 5 arrive; feeds 4 and 5 are both."""
    feed = c.vulnerabilities.select(F.col("id").alias("vulnerability_id"), "feed_id")
    links = affected_versions(c).join(feed, "vulnerability_id")
    pairs = lambda rows: rows.select("vulnerability_id", "version_id")
    return append_new(pairs(links.where("feed_id >= 4")).distinct(), pairs(links.where("feed_id <= 5")), ["vulnerability_id", "version_id"])


@writes(
    "W29_delete_vulnerabilities",
    f"""WITH gone AS (SELECT id, external_id FROM vulnerabilities WHERE feed_id <= 4), links AS ({_LINKS})
    SELECT 'vulnerability' AS kind, id::VARCHAR AS key, 1 AS n FROM vulnerabilities WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'purl', purl, count(*) FROM vpurls WHERE vulnerability_id NOT IN (SELECT id FROM gone) GROUP BY purl
    UNION ALL SELECT 'link', version_id::VARCHAR, count(DISTINCT vulnerability_id) FROM links WHERE vulnerability_id NOT IN (SELECT id FROM gone) GROUP BY version_id
    UNION ALL SELECT 'metadata', version_id::VARCHAR, count(DISTINCT vulnerability_id) FILTER (WHERE vulnerability_id NOT IN (SELECT id FROM gone)) FROM links GROUP BY version_id""",
)
def delete_vulnerabilities(c):
    """Vulnerabilities of the first four feeds go, with their purls, their links to versions and their keys in the versions' metadata."""
    v = c.vulnerabilities.select(F.col("id").alias("vulnerability_id"), "external_id", "feed_id")
    gone = v.where("feed_id <= 4").select("vulnerability_id", "external_id")
    purls, links = c.vulnerabilities_purls, affected_versions(c)
    stays = lambda rows: rows.join(gone, "vulnerability_id", "left_anti")
    row = lambda kind, key, n: [F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), n.alias("n")]
    one = F.lit(1).cast("long")
    injected = links.join(v.select("vulnerability_id", "external_id"), "vulnerability_id").groupBy("version_id").agg(F.map_from_entries(F.collect_set(F.struct("external_id", "vulnerability_id"))).alias("m"))
    removed = links.join(gone, "vulnerability_id").groupBy("version_id").agg(F.collect_set("external_id").alias("r"))
    # a version's vulnerabilities are few: the keys of one JSON object
    stripped = injected.join(removed, "version_id", "left").withColumn("m", F.map_filter("m", lambda k, _: ~F.coalesce(F.array_contains("r", k), F.lit(False))))
    parts = [
        stays(v).select(*row("vulnerability", "vulnerability_id", one)),
        stays(purls).groupBy("purl").agg(F.count(F.lit(1)).alias("c")).select(*row("purl", "purl", F.col("c"))),
        stays(links).groupBy("version_id").agg(F.count(F.lit(1)).alias("c")).select(*row("link", "version_id", F.col("c"))),
        stripped.select(*row("metadata", "version_id", F.size("m").cast("long"))),
    ]
    return reduce(DataFrame.unionByName, parts)


QUERIES, SQL = writes.queries, writes.sql
