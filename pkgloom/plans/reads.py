"""Relational reads (R1-R55): the canned queries of the metadata store, set-oriented over whole tables.

Point look-ups of the store become joins that answer for every key at once; a caller narrows them with where().
Names compare without case, pages have a total order, and rows that came twice count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgloom.plans.registry import Registry, micros
from pkgloom.sources.catalog import Catalog

reads = Registry()


def coordinate(name: str | Column = "package_name", version: str | Column = "version") -> Column:
    return F.concat_ws(":", name, version)


def versions_of_packages(c: Catalog, *columns: str) -> DataFrame:
    """packages joined with their versions: pid, package_name, forge, id, version and the columns of the version named."""
    p = c.packages.select(F.col("id").alias("pid"), "package_name", "forge")
    return p.join(c.versions("package_id", "version", *columns), F.col("pid") == F.col("package_id")).drop("package_id")


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


@reads("R1_module_content", "SELECT module_id, min(file_id) AS file_id FROM module_contents GROUP BY module_id")
def module_content(c):
    return c.module_contents.groupBy("module_id").agg(F.min("file_id").alias("file_id"))


@reads("R2_retry_count", "SELECT user_id, event_type, count(*) AS retries FROM events GROUP BY user_id, event_type")
def retry_count(c):
    return c.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("retries"))


@reads("R3_ingested", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def ingested(c):
    return c.customer.join(c.events, F.col("user_id") == F.col("c_custkey"), "left_semi").select("c_custkey")


@reads("R4_package_exists", "SELECT package_name FROM packages p WHERE EXISTS (SELECT 1 FROM pv WHERE pv.package_id = p.id)")
def package_exists(c):
    v = c.package_versions.select("package_id")
    return c.packages.join(v, F.col("package_id") == F.col("id"), "left_semi").select("package_name")


@reads("R5_modules_exist", "SELECT pv.id FROM pv WHERE EXISTS (SELECT 1 FROM modules m JOIN module_names n ON n.id = m.module_name_id WHERE m.package_version_id = pv.id)")
def modules_exist(c):
    named = c.modules.join(c.module_names.select(F.col("id").alias("nid")), F.col("module_name_id") == F.col("nid"))
    return c.package_versions.select("id").join(named.select("package_version_id"), F.col("package_version_id") == F.col("id"), "left_semi")


@reads(
    "R6_last_version",
    """SELECT package_name, version, repository_base_url FROM (
       SELECT p.package_name, pv.version, a.repository_base_url, row_number() OVER (PARTITION BY p.id ORDER BY pv.created_at DESC NULLS LAST, pv.id DESC) AS rn
       FROM packages p LEFT JOIN pv ON pv.package_id = p.id LEFT JOIN artifact_repositories a ON a.id = pv.artifact_repository_id) WHERE rn = 1""",
)
def last_version(c):
    """The latest version of every package: one compact state per package instead of a sort of its versions."""
    latest = c.table("package_versions").groupBy("package_id").agg(F.max(F.struct("created_at", "id", "version", "artifact_repository_id")).alias("v"))
    j = c.packages.join(latest, F.col("package_id") == F.col("id"), "left").select("package_name", "v.version", "v.artifact_repository_id")
    return j.join(F.broadcast(c.artifact_repositories), F.col("artifact_repository_id") == F.col("id"), "left").select("package_name", "version", "repository_base_url")


@reads("R7_packages_page", "SELECT id, package_name, forge FROM packages ORDER BY id LIMIT 10 OFFSET 20")
def packages_page(c):
    return page(c.packages.select("id", "package_name", "forge"), ["id"], 20, 10)


@reads("R8_package_version", "SELECT pv.id, package_name, version, cg_generator, repository_base_url FROM packages p JOIN pv ON pv.package_id = p.id LEFT JOIN artifact_repositories a ON a.id = pv.artifact_repository_id")
def package_version(c):
    a = c.artifact_repositories.withColumnRenamed("id", "aid")
    return versions_of_packages(c, "cg_generator", "artifact_repository_id").join(F.broadcast(a), F.col("artifact_repository_id") == F.col("aid"), "left").select("id", "package_name", "version", "cg_generator", "repository_base_url")


@reads("R9_versions_of_package", "SELECT package_name, count(*) AS n_versions, count(DISTINCT version) AS n_distinct FROM packages p JOIN pv ON pv.package_id = p.id GROUP BY package_name")
def versions_of_package(c):
    return versions_of_packages(c).groupBy("package_name").agg(F.count(F.lit(1)).alias("n_versions"), F.count_distinct("version").alias("n_distinct"))


@reads(
    "R10_package_dependencies",
    "SELECT pv.id, p.package_name, q.package_name AS depends_on, array_to_string(d.version_range, '|') AS ranges FROM packages p JOIN pv ON pv.package_id = p.id JOIN deps d ON d.package_version_id = pv.id JOIN packages q ON q.id = d.dependency_id",
)
def package_dependencies(c):
    d = c.dependencies.select("package_version_id", "dependency_id", F.array_join("version_range", "|").alias("ranges"))
    q = c.packages.select(F.col("id").alias("qid"), F.col("package_name").alias("depends_on"))
    return versions_of_packages(c).select("id", "package_name").join(d, F.col("package_version_id") == F.col("id")).join(q, F.col("dependency_id") == F.col("qid")).select("id", "package_name", "depends_on", "ranges")


def modules_of_packages(c: Catalog) -> DataFrame:
    v = versions_of_packages(c).select(F.col("id").alias("vid"), "package_name", "version")
    m = c.modules.select(F.col("id").alias("mid"), "package_version_id", "module_name_id", "final", "access")
    n = c.module_names.select(F.col("id").alias("nid"), "name")
    return v.join(m, F.col("package_version_id") == F.col("vid")).join(n, F.col("module_name_id") == F.col("nid"))


_MODULES = "FROM packages p JOIN pv ON pv.package_id = p.id JOIN modules m ON m.package_version_id = pv.id JOIN module_names n ON n.id = m.module_name_id"


@reads("R11_package_modules", f"SELECT package_name, version, m.id AS module_id, name, final, access {_MODULES}")
def package_modules(c):
    return modules_of_packages(c).select("package_name", "version", F.col("mid").alias("module_id"), "name", "final", "access")


@reads("R12_module_name", "SELECT m.id, name FROM modules m JOIN module_names n ON n.id = m.module_name_id")
def module_name(c):
    return c.modules.join(c.module_names.select(F.col("id").alias("nid"), "name"), F.col("module_name_id") == F.col("nid")).select("id", "name")


@reads("R13_module_metadata", f"SELECT package_name, version, lower(name) AS namespace, min(m.id) AS module_id {_MODULES} GROUP BY ALL")
def module_metadata(c):
    return modules_of_packages(c).groupBy("package_name", "version", F.lower("name").alias("namespace")).agg(F.min("mid").alias("module_id"))


@reads("R14_module_files", f"SELECT m.id AS module_id, f.id AS file_id, path {_MODULES} JOIN module_contents mc ON mc.module_id = m.id JOIN files f ON f.id = mc.file_id")
def module_files(c):
    """Files of a module through the content table."""
    f = c.files.select(F.col("id").alias("fid"), "path")
    return modules_of_packages(c).join(c.module_contents, F.col("module_id") == F.col("mid")).join(f, F.col("file_id") == F.col("fid")).select("module_id", "file_id", "path")


@reads("R14b_module_files_by_version", f"SELECT m.id AS module_id, f.id AS file_id, path {_MODULES} JOIN files f ON f.package_version_id = pv.id")
def module_files_by_version(c):
    """The variant that returns every file of the module's version."""
    f = c.files.select(F.col("id").alias("file_id"), F.col("package_version_id").alias("fv"), "path")
    return modules_of_packages(c).join(f, F.col("fv") == F.col("vid")).select(F.col("mid").alias("module_id"), "file_id", "path")


PARTIAL_URI = r"^/([^/]+)/([^.]+)\.([^(]+)\(([^)]*)\)(.+)$"


def uri_parts(uri: str | Column) -> dict[str, Column]:
    """Namespace, class, method, arguments and return type of a partial URI."""
    return {k: F.regexp_extract(uri, PARTIAL_URI, i + 1) for i, k in enumerate(("namespace", "class_name", "method", "args", "returns"))}


@reads(
    "R15_module_callables",
    f"""SELECT cl.id, package_name, regexp_extract(uri, '^/([^/]+)/', 1) AS namespace, regexp_extract(uri, '^/[^/]+/([^.]+)\\.', 1) AS class_name, regexp_extract(uri, '\\.(m[0-9]+)\\(', 1) AS method {_MODULES}
    JOIN callables cl ON cl.module_id = m.id""",
)
def module_callables(c):
    cl = c.callables.select("id", "module_id", "uri")
    parts = uri_parts("uri")
    j = modules_of_packages(c).join(cl, F.col("module_id") == F.col("mid")).where(F.col("uri").rlike(PARTIAL_URI))
    return j.select("id", "package_name", parts["namespace"].alias("namespace"), parts["class_name"].alias("class_name"), parts["method"].alias("method"))


@reads("R16_binary_modules", f"SELECT package_name, version, count(*) AS n_modules, count(DISTINCT f.id) AS n_files {_MODULES} LEFT JOIN module_contents mc ON mc.module_id = m.id LEFT JOIN files f ON f.id = mc.file_id GROUP BY ALL")
def binary_modules(c):
    f = c.files.select(F.col("id").alias("fid"))
    j = modules_of_packages(c).join(c.module_contents, F.col("module_id") == F.col("mid"), "left").join(f, F.col("file_id") == F.col("fid"), "left")
    return j.groupBy("package_name", "version").agg(F.count(F.lit(1)).alias("n_modules"), F.count_distinct("fid").alias("n_files"))


def callables_of_packages(c: Catalog) -> DataFrame:
    v = versions_of_packages(c).select(F.col("id").alias("vid"), "package_name", "version", "forge")
    m = c.modules.select(F.col("id").alias("mid"), "package_version_id")
    return v.join(m, F.col("package_version_id") == F.col("vid")).join(c.callables, F.col("module_id") == F.col("mid"))


_CALLABLES = "FROM packages p JOIN pv ON pv.package_id = p.id JOIN modules m ON m.package_version_id = pv.id JOIN callables cl ON cl.module_id = m.id"


@reads("R17_package_callables", f"SELECT cl.id, package_name, version, uri, is_internal_call, line_start, line_end {_CALLABLES}")
def package_callables(c):
    return callables_of_packages(c).select("id", "package_name", "version", "uri", "is_internal_call", "line_start", "line_end")


@reads("R18_first_internal_callable", f"SELECT pv.id AS version_id, min(cl.id) AS callable_id {_CALLABLES} WHERE is_internal_call GROUP BY pv.id")
def first_internal_callable(c):
    return callables_of_packages(c).where("is_internal_call").groupBy(F.col("vid").alias("version_id")).agg(F.min("id").alias("callable_id"))


@reads("R19_internal_ids", f"SELECT cl.id {_CALLABLES} WHERE is_internal_call AND cl.id IN (SELECT source_id FROM call_sites)")
def internal_ids(c):
    wanted = c.call_sites.select(F.col("source_id").alias("id"))
    return callables_of_packages(c).where("is_internal_call").join(wanted, "id", "left_semi").select("id")


@reads("R20_callable_by_digest", f"SELECT package_name, version, sha1(uri) AS digest, min(cl.id) AS id {_CALLABLES} GROUP BY ALL")
def callable_by_digest(c):
    return callables_of_packages(c).groupBy("package_name", "version", F.sha1(F.col("uri").cast("binary")).alias("digest")).agg(F.min("id").alias("id"))


@reads("R21_callables_json", """SELECT id, '{"uri":"' || uri || '","type":"' || type || '"}' AS json FROM callables WHERE id IN (SELECT target_id FROM call_sites)""")
def callables_json(c):
    wanted = c.call_sites.select(F.col("target_id").alias("id"))
    return c.callables.join(wanted, "id", "left_semi").select("id", F.to_json(F.struct("uri", "type")).alias("json"))


@reads("R22_maven_coordinate", "SELECT pv.id, package_name || ':' || version AS coordinate FROM packages p JOIN pv ON pv.package_id = p.id")
def maven_coordinate(c):
    return versions_of_packages(c).select("id", coordinate().alias("coordinate"))


def affected_versions(c: Catalog) -> DataFrame:
    """(vulnerability_id, version_id): the versions that a package URL names."""
    v = versions_of_packages(c).select(F.col("id").alias("version_id"), "package_name", "version", "forge")
    x = c.vulnerabilities_purls.select("vulnerability_id", F.col("package_name").alias("n"), F.col("package_version").alias("w"), F.col("forge").alias("f"))
    return v.join(x, (F.col("n") == F.col("package_name")) & (F.col("w") == F.col("version")) & (F.col("f") == F.col("forge"))).select("vulnerability_id", "version_id").distinct()


_AFFECTED = "(SELECT DISTINCT x.vulnerability_id, pv.id AS version_id FROM packages p JOIN pv ON pv.package_id = p.id JOIN vpurls x ON x.package_name = p.package_name AND x.package_version = pv.version AND x.forge = p.forge)"


@reads("R23_vulnerable_versions", f"SELECT DISTINCT version_id FROM {_AFFECTED}")
def vulnerable_versions(c):
    return affected_versions(c).select("version_id").distinct()


@reads("R24_vulnerable_callables", f"SELECT cl.id AS callable_id, string_agg(DISTINCT v.external_id, ',' ORDER BY v.external_id) AS statements FROM {_AFFECTED} a JOIN modules m ON m.package_version_id = a.version_id JOIN callables cl ON cl.module_id = m.id JOIN vulnerabilities v ON v.id = a.vulnerability_id GROUP BY cl.id")
def vulnerable_callables(c):
    m = c.modules.select(F.col("id").alias("mid"), "package_version_id")
    cl = c.callables.select(F.col("id").alias("callable_id"), "module_id")
    v = c.vulnerabilities.select(F.col("id").alias("vulnerability_id"), "external_id")
    j = affected_versions(c).join(v, "vulnerability_id").join(m, F.col("package_version_id") == F.col("version_id")).join(cl, F.col("module_id") == F.col("mid"))
    return j.groupBy("callable_id").agg(F.array_join(F.array_sort(F.collect_set("external_id")), ",").alias("statements"))


@reads("R24b_unrelated_statements", f"SELECT count(*) AS n_pairs FROM {_AFFECTED} a JOIN modules m ON m.package_version_id = a.version_id JOIN callables cl ON cl.module_id = m.id")
def unrelated_statements(c):
    """The variant without the tie between a callable and its statement, as a count of the pairs it would form."""
    m = c.modules.select(F.col("id").alias("mid"), "package_version_id")
    per_version = m.join(c.callables.groupBy("module_id").agg(F.count(F.lit(1)).alias("n")), F.col("module_id") == F.col("mid")).groupBy("package_version_id").agg(F.sum("n").alias("n"))
    j = affected_versions(c).groupBy("version_id").agg(F.count(F.lit(1)).alias("k")).join(per_version, F.col("package_version_id") == F.col("version_id"))
    return j.agg(F.coalesce(F.sum(F.col("n") * F.col("k")), F.lit(0)).cast("long").alias("n_pairs"))


@reads("R25_package_files", "SELECT package_name, version, f.id AS file_id, path FROM packages p JOIN pv ON pv.package_id = p.id JOIN files f ON f.package_version_id = pv.id")
def package_files(c):
    f = c.files.select(F.col("id").alias("file_id"), "package_version_id", "path")
    return versions_of_packages(c).join(f, F.col("package_version_id") == F.col("id")).select("package_name", "version", "file_id", "path")


@reads("R26_package_edges", f"SELECT package_name, version, source_id, target_id, line, call_type {_CALLABLES} JOIN call_sites s ON s.source_id = cl.id")
def package_edges(c):
    return callables_of_packages(c).join(c.call_sites, F.col("source_id") == F.col("id")).select("package_name", "version", "source_id", "target_id", "line", "call_type")


@reads("R27_version_id", "SELECT package_name, version, min(pv.id) AS id FROM packages p JOIN pv ON pv.package_id = p.id GROUP BY ALL")
def version_id(c):
    return versions_of_packages(c).groupBy("package_name", "version").agg(F.min("id").alias("id"))


@reads("R28_ids_of_coordinates", "SELECT x.package_name, x.package_version, pv.id FROM (SELECT DISTINCT package_name, package_version FROM vpurls WHERE forge = 'mvn') x JOIN packages p ON p.package_name = x.package_name AND p.forge = 'mvn' JOIN pv ON pv.package_id = p.id AND pv.version = x.package_version")
def ids_of_coordinates(c):
    wanted = c.vulnerabilities_purls.where("forge = 'mvn'").select("package_name", "package_version").distinct()
    v = versions_of_packages(c).where("forge = 'mvn'").select(F.col("package_name").alias("n"), "version", "id")
    return wanted.join(v, (F.col("n") == F.col("package_name")) & (F.col("version") == F.col("package_version"))).select("package_name", "package_version", "id")


@reads("R29_edges_metadata", "SELECT s.* FROM call_sites s JOIN (SELECT target_id AS source_id, source_id AS target_id FROM call_sites UNION SELECT source_id, target_id FROM call_sites WHERE call_type = 'static') w ON w.source_id = s.source_id AND w.target_id = s.target_id")
def edges_metadata(c):
    wanted = c.call_sites.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")).union(c.call_sites.where("call_type = 'static'").select("source_id", "target_id"))
    return c.call_sites.join(wanted, ["source_id", "target_id"], "left_semi").select("source_id", "target_id", "line", "call_type")


@reads("R30_full_uris", f"SELECT cl.id, 'cg://' || forge || '!' || package_name || '$' || version || uri AS full_uri {_CALLABLES}")
def full_uris(c):
    return callables_of_packages(c).select("id", F.concat(F.lit("cg://"), "forge", F.lit("!"), "package_name", F.lit("$"), "version", "uri").alias("full_uri"))


@reads("R31_metadata_by_uri", f"SELECT forge, package_name, version, uri, count(*) AS n, max(line_end) AS last_line {_CALLABLES} GROUP BY ALL")
def metadata_by_uri(c):
    return callables_of_packages(c).groupBy("forge", "package_name", "version", "uri").agg(F.count(F.lit(1)).alias("n"), F.max("line_end").alias("last_line"))


@reads("R32_search_names", "SELECT package_name FROM packages p WHERE package_name LIKE '%parent%' AND EXISTS (SELECT 1 FROM pv WHERE pv.package_id = p.id)")
def search_names(c):
    v = c.package_versions.select("package_id")
    return c.packages.where(F.col("package_name").contains("parent")).join(v, F.col("package_id") == F.col("id"), "left_semi").select("package_name")


@reads("R33_dependency_net", "SELECT p.forge, p.package_name, epoch_us(pv.created_at) AS at_us, count(*) AS n_dependencies FROM packages p JOIN pv ON pv.package_id = p.id JOIN deps d ON d.package_version_id = pv.id WHERE pv.created_at IS NOT NULL GROUP BY ALL")
def dependency_net(c):
    d = c.dependencies.select("package_version_id")
    j = versions_of_packages(c, "created_at").where("created_at IS NOT NULL").join(d, F.col("package_version_id") == F.col("id"))
    return j.groupBy("forge", "package_name", micros("created_at").alias("at_us")).agg(F.count(F.lit(1)).alias("n_dependencies"))


@reads("R34_call_graph_at", "SELECT p.forge, p.package_name, epoch_us(pv.created_at) AS at_us, count(*) AS n_modules FROM packages p JOIN pv ON pv.package_id = p.id JOIN modules m ON m.package_version_id = pv.id WHERE pv.created_at IS NOT NULL GROUP BY ALL")
def call_graph_at(c):
    m = c.modules.select("package_version_id")
    j = versions_of_packages(c, "created_at").where("created_at IS NOT NULL").join(m, F.col("package_version_id") == F.col("id"))
    return j.groupBy("forge", "package_name", micros("created_at").alias("at_us")).agg(F.count(F.lit(1)).alias("n_modules"))


@reads("R35_vulnerabilities_page", "SELECT id, external_id FROM vulnerabilities ORDER BY id LIMIT 10 OFFSET 10")
def vulnerabilities_page(c):
    return page(c.vulnerabilities.select("id", "external_id"), ["id"], 10, 10)


@reads("R36_version_vulnerabilities", f"SELECT a.version_id, v.external_id FROM {_AFFECTED} a JOIN vulnerabilities v ON v.id = a.vulnerability_id")
def version_vulnerabilities(c):
    v = c.vulnerabilities.select(F.col("id").alias("vulnerability_id"), "external_id")
    return affected_versions(c).join(v, "vulnerability_id").select("version_id", "external_id")


@reads("R37_purl_vulnerabilities", "SELECT purl, external_id FROM vpurls x JOIN vulnerabilities v ON v.id = x.vulnerability_id")
def purl_vulnerabilities(c):
    v = c.vulnerabilities.select("id", "external_id")
    return c.vulnerabilities_purls.join(v, F.col("id") == F.col("vulnerability_id")).select("purl", "external_id")


@reads("R38_callables_of_vulnerability", f"SELECT v.external_id, 'cg://' || p.forge || '!' || p.package_name || '$' || pv.version || cl.uri AS full_uri {_CALLABLES} JOIN {_AFFECTED} a ON a.version_id = pv.id JOIN vulnerabilities v ON v.id = a.vulnerability_id WHERE cl.is_internal_call")
def callables_of_vulnerability(c):
    v = c.vulnerabilities.select(F.col("id").alias("vulnerability_id"), "external_id")
    j = callables_of_packages(c).where("is_internal_call").join(affected_versions(c), F.col("version_id") == F.col("vid")).join(v, "vulnerability_id")
    return j.select("external_id", F.concat(F.lit("cg://"), "forge", F.lit("!"), "package_name", F.lit("$"), "version", "uri").alias("full_uri"))


@reads("R40_callable_gid", f"SELECT 'cg://' || forge || '!' || package_name || '$' || version || uri AS full_uri, min(cl.id) AS gid {_CALLABLES} GROUP BY ALL")
def callable_gid(c):
    return full_uris(c).groupBy("full_uri").agg(F.min("id").alias("gid"))


@reads("R41_callable_names", f"SELECT cl.id, CASE WHEN NOT is_internal_call THEN uri ELSE 'cg://' || forge || '!' || package_name || '$' || version || uri END AS name {_CALLABLES}")
def callable_names(c):
    """External callables have no package in their name."""
    full = F.concat(F.lit("cg://"), "forge", F.lit("!"), "package_name", F.lit("$"), "version", "uri")
    return callables_of_packages(c).select("id", F.when(~F.col("is_internal_call"), F.col("uri")).otherwise(full).alias("name"))


@reads("R42_uris_of_graph", f"SELECT DISTINCT cl.id, uri {_CALLABLES} WHERE cl.id IN (SELECT source_id FROM call_sites UNION SELECT target_id FROM call_sites)")
def uris_of_graph(c):
    ids = c.call_sites.select(F.col("source_id").alias("id")).union(c.call_sites.select("target_id"))
    return callables_of_packages(c).select("id", "uri").join(ids, "id", "left_semi").distinct()


@reads("R43_dependency_version_ids", "SELECT d.package_version_id, pv.id AS dependency_version_id FROM deps d JOIN pv ON pv.package_id = d.dependency_id AND list_contains(d.version_range, pv.version)")
def dependency_version_ids(c):
    """Dependencies that name a version exactly: a join on the coordinate, not on the package alone."""
    named = c.dependencies.select("package_version_id", "dependency_id", F.explode("version_range").alias("v"))
    v = c.package_versions.select("package_id", "version", F.col("id").alias("dependency_version_id"))
    return named.distinct().join(v, (F.col("package_id") == F.col("dependency_id")) & (F.col("version") == F.col("v"))).select("package_version_id", "dependency_version_id")


@reads("R44_created_at", "SELECT pv.id, package_name, version, coalesce(epoch_us(created_at) // 1000, -1) AS created_ms FROM (SELECT id AS pid, package_name FROM packages) p JOIN pv ON pv.package_id = p.pid")
def created_ms(c):
    return versions_of_packages(c, "created_at").select("id", "package_name", "version", F.coalesce(F.floor(micros("created_at") / 1000), F.lit(-1)).cast("long").alias("created_ms"))


@reads(
    "R45_dependency_list",
    """SELECT pv.id, p.package_name, regexp_replace(pv.version, '\\s', '', 'g') AS version, count(d.dependency_id) AS n_dependencies
       FROM packages p RIGHT JOIN pv ON pv.package_id = p.id LEFT JOIN deps d ON d.package_version_id = pv.id AND pv.created_at IS NOT NULL GROUP BY ALL""",
)
def dependency_list(c):
    """Right join to versions, then a left join whose condition also tests a column of the left side."""
    p = c.packages.select(F.col("id").alias("pid"), "package_name")
    v = p.join(c.package_versions, F.col("pid") == F.col("package_id"), "right")
    d = c.dependencies.select("package_version_id", "dependency_id")
    j = v.join(d, (F.col("package_version_id") == F.col("id")) & F.col("created_at").isNotNull(), "left")
    return j.groupBy("id", "package_name", F.regexp_replace("version", r"\s", "").alias("version")).agg(F.count("dependency_id").alias("n_dependencies"))


@reads("R46_vulnerability_lookups", "SELECT DISTINCT x.package_name, coalesce(p.id, -1) AS package_id FROM vpurls x LEFT JOIN packages p ON p.package_name = x.package_name AND p.forge = x.forge")
def vulnerability_lookups(c):
    p = c.packages.select("id", F.col("package_name").alias("n"), F.col("forge").alias("f"))
    x = c.vulnerabilities_purls.select("package_name", "forge").distinct()
    return x.join(p, (F.col("n") == F.col("package_name")) & (F.col("f") == F.col("forge")), "left").select("package_name", F.coalesce("id", F.lit(-1)).alias("package_id")).distinct()


@reads("R47_file_by_substring", "SELECT f.id AS file_id, min(s.s_suppkey) AS supplier FROM files f JOIN supplier s ON f.path LIKE '%/s' || s.s_suppkey || '/%' GROUP BY f.id")
def file_by_substring(c):
    """A stored part of a path: the part is cut out of the path and joined, where a substring test would be a cross join."""
    s = c.supplier.select("s_suppkey")
    f = c.files.select(F.col("id").alias("file_id"), F.explode(F.split("path", "/")).alias("part"))
    return f.join(s, F.col("part") == F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).groupBy("file_id").agg(F.min("s_suppkey").alias("supplier"))


def in_intervals(points: DataFrame, intervals: DataFrame, key: str, at: str, low: str, high: str, width: int = 16) -> DataFrame:
    """Rows of ``intervals`` (key, low, high) with the points of the same key inside; both ends count.

    Intervals are put into bins of ``width``, so that a key with many intervals and points is spread over its bins.
    Null keys, points or ends meet nothing.
    """
    binned = intervals.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    p = points.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.floor(F.col(at) / width).alias("_b"))
    return binned.join(p, (F.col(key) == F.col("_k")) & (F.col("_bin") == F.col("_b")) & (F.col("_at") >= F.col(low)) & (F.col("_at") <= F.col(high))).drop("_bin", "_b", "_k")


@reads("R48_callables_at_line", "SELECT a.id AS callable_id, b.at AS line FROM callables a JOIN (SELECT DISTINCT module_id, line_end AS at FROM callables) b ON b.module_id = a.module_id AND b.at BETWEEN a.line_start AND a.line_end")
def callables_at_line(c):
    points = c.callables.select("module_id", F.col("line_end").alias("at")).distinct()
    return in_intervals(points, c.callables.select("id", "module_id", "line_start", "line_end"), "module_id", "at", "line_start", "line_end").select(F.col("id").alias("callable_id"), F.col("_at").alias("line"))


@reads("R49_uris_of_patch", "SELECT DISTINCT f.path, cl.uri FROM files f JOIN module_contents mc ON mc.file_id = f.id JOIN callables cl ON cl.module_id = mc.module_id, (SELECT unnest([3, 7, 20]) AS line) l WHERE l.line BETWEEN cl.line_start AND cl.line_end")
def uris_of_patch(c):
    lines = c.spark.createDataFrame([(3,), (7,), (20,)], "line int")
    hit = c.callables.join(F.broadcast(lines), F.col("line").between(F.col("line_start"), F.col("line_end")))
    j = hit.select("module_id", "uri").distinct().join(c.module_contents, "module_id").join(c.files.select(F.col("id").alias("fid"), "path"), F.col("file_id") == F.col("fid"))
    return j.select("path", "uri").distinct()


@reads("R50_ids_for_uri", "SELECT uri, m.package_version_id, min(cl.id) AS id, count(*) AS n FROM callables cl JOIN modules m ON m.id = cl.module_id GROUP BY uri, m.package_version_id")
def ids_for_uri(c):
    m = c.modules.select(F.col("id").alias("mid"), "package_version_id")
    return c.callables.join(m, F.col("module_id") == F.col("mid")).groupBy("uri", "package_version_id").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


@reads("R51_stored_metadata", "SELECT id, json_extract_string(metadata, '$.commitTag') AS commit_tag, TRY_CAST(json_extract_string(metadata, '$.size') AS BIGINT) AS size FROM pv WHERE metadata IS NOT NULL")
def stored_metadata(c):
    v = F.try_parse_json("metadata")
    return c.package_versions.where("metadata IS NOT NULL").select("id", F.try_variant_get(v, "$.commitTag", "string").alias("commit_tag"), F.try_variant_get(v, "$.size", "long").alias("size"))


@reads("R52_hierarchy_fetch", "SELECT DISTINCT m.id, m.module_name_id, n.name FROM call_sites s JOIN callables cl ON cl.id = s.source_id JOIN modules m ON m.id = cl.module_id JOIN module_names n ON n.id = m.module_name_id")
def hierarchy_fetch(c):
    wanted = c.callables.join(c.call_sites.select(F.col("source_id").alias("id")), "id", "left_semi").select(F.col("module_id").alias("id"))
    n = c.module_names.select(F.col("id").alias("nid"), "name")
    return c.modules.join(wanted, "id", "left_semi").join(n, F.col("module_name_id") == F.col("nid")).select("id", "module_name_id", "name")


@reads("R53_attributes_by_uri", f"SELECT package_name, version, count(*) AS n_uris, max(cl.type) AS type, min(line_start) AS first_line {_CALLABLES} GROUP BY ALL")
def attributes_by_uri(c):
    return callables_of_packages(c).groupBy("package_name", "version").agg(F.count(F.lit(1)).alias("n_uris"), F.max("type").alias("type"), F.min("line_start").alias("first_line"))


@reads("R54_statement_attributes", "SELECT id, coalesce(json_extract_string(statement, '$.severity'), json_extract_string(statement, '$[0].severity')) AS severity, json_extract_string(statement, '$.id') AS statement_id FROM vulnerabilities")
def statement_attributes(c):
    v = F.try_parse_json("statement")
    severity = F.coalesce(F.try_variant_get(v, "$.severity", "string"), F.try_variant_get(v, "$[0].severity", "string"))
    return c.vulnerabilities.select("id", severity.alias("severity"), F.try_variant_get(v, "$.id", "string").alias("statement_id"))


@reads("R55_coordinates_vulnerabilities", f"SELECT x.package_name, x.package_version, coalesce(string_agg(DISTINCT v.external_id, ',' ORDER BY v.external_id), '') AS found FROM (SELECT DISTINCT package_name, package_version FROM vpurls) x LEFT JOIN (SELECT p.package_name, pv.version, a.vulnerability_id FROM packages p JOIN pv ON pv.package_id = p.id JOIN {_AFFECTED} a ON a.version_id = pv.id) k ON k.package_name = x.package_name AND k.version = x.package_version LEFT JOIN vulnerabilities v ON v.id = k.vulnerability_id GROUP BY ALL")
def coordinates_vulnerabilities(c):
    wanted = c.vulnerabilities_purls.select("package_name", "package_version").distinct()
    v = c.vulnerabilities.select(F.col("id").alias("vulnerability_id"), "external_id")
    known = versions_of_packages(c).select(F.col("package_name").alias("n"), "version", F.col("id").alias("version_id")).join(affected_versions(c), "version_id").join(v, "vulnerability_id")
    j = wanted.join(known, (F.col("n") == F.col("package_name")) & (F.col("version") == F.col("package_version")), "left")
    return j.groupBy("package_name", "package_version").agg(F.array_join(F.array_sort(F.collect_set("external_id")), ",").alias("found"))


QUERIES, SQL = reads.queries, reads.sql
