"""Scalar functions (F1-F25) applied to whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgloom.functions import json_ops, uri
from pkgloom.operators import source_text as src
from pkgloom.plans.registry import Registry, micros

scalars = Registry()


@scalars("F1_percent_codes", "SELECT DISTINCT uri, replace(replace(uri, '%2F', '/'), '%25', '%') AS decoded, replace(replace(replace(replace(regexp_extract(uri, '\\((.*)\\)', 1), '%', '%25'), '/', '%2F'), ',', '%2C'), '$', '%24') AS encoded FROM callables")
def percent_codes(c):
    u = c.callables.select("uri").distinct()
    return u.select("uri", uri.percent_decode("uri").alias("decoded"), uri.percent_encode_args(F.regexp_extract("uri", r"\((.*)\)", 1)).alias("encoded"))


@scalars("F2_uri_parts", "SELECT DISTINCT uri, regexp_extract(uri, '^/([^/]+)/', 1) AS namespace, regexp_extract(uri, '^/[^/]+/([^.]+)', 1) AS class_name, regexp_extract(uri, '\\.([^(]+)\\(', 1) AS method, regexp_extract(uri, '\\(([^)]*)\\)', 1) AS args, regexp_extract(uri, '\\)(.+)$', 1) AS returns FROM callables")
def uri_parts(c):
    return c.callables.select("uri").distinct().select("uri", *[x.alias(k) for k, x in uri.split_partial_uri("uri").items()])


@scalars("F2b_full_uris", "SELECT pv.id, 'cg://' || p.forge || '!' || p.package_name || '$' || pv.version || '/ns/T' AS full_uri, p.forge, p.package_name AS product, pv.version, '/ns/T' AS partial FROM packages p JOIN pv ON pv.package_id = p.id")
def full_uris(c):
    p = c.packages.select(F.col("id").alias("pid"), F.col("forge").alias("f"), "package_name")
    j = c.package_versions.join(p, F.col("pid") == F.col("package_id")).select("id", uri.full_uri("f", "package_name", "version", F.lit("/ns/T")).alias("full_uri"))
    return j.select("id", "full_uri", *[x.alias(k) for k, x in uri.split_full_uri("full_uri").items()])


_NS = "regexp_extract(uri, '^/([^/]+)/', 1)"


@scalars("F3_canonical_uris", f"SELECT DISTINCT replace(uri, 'java.lang', {_NS}) AS uri, regexp_replace(replace(uri, 'java.lang', {_NS}), '\\(.*\\)', '(String)') AS canonical, replace(uri, 'java.lang', {_NS}) AS back, uri AS foreign_types, 'cg://mvn!g:a$1/' || {_NS} || '/Other.x()' AS resolved, 'cg://mvn!g:a$1' || uri AS rooted, regexp_extract(uri, '^/[^/]+/(.*)$', 1) AS relative FROM callables")
def canonical_uris(c):
    """Types of the callable's own namespace are written without it, and read back; types of another stay."""
    ns = F.regexp_extract("uri", r"^/([^/]+)/", 1)
    u = c.callables.select("uri").distinct().select(F.col("uri").alias("plain"), F.replace("uri", F.lit("java.lang"), ns).alias("uri"))
    base = F.concat(F.lit("cg://mvn!g:a$1"), F.col("plain"))
    return u.select(
        "uri", uri.canonicalize("uri").alias("canonical"), uri.decanonicalize(uri.canonicalize("uri")).alias("back"), uri.canonicalize("plain").alias("foreign_types"),
        uri.resolve(base, F.lit("Other.x()")).alias("resolved"), uri.resolve(F.lit("cg://mvn!g:a$1/q/R.y()"), F.col("plain")).alias("rooted"), uri.relativize(base, F.col("plain")).alias("relative"),
    )


@scalars("F4_string_cuts", "SELECT package_name, split_part(package_name, ':', 2) AS after_first, split_part(split_part(package_name, '.', 2), ':', 1) AS between, trim(package_name, chr(10) || chr(9) || ' ') AS trimmed FROM packages")
def string_cuts(c):
    n = F.col("package_name")
    return c.packages.select("package_name", F.split_part(n, F.lit(":"), F.lit(2)).alias("after_first"), F.split_part(F.split_part(n, F.lit("."), F.lit(2)), F.lit(":"), F.lit(1)).alias("between"), F.btrim(n, F.lit("\n\t ")).alias("trimmed"))


@scalars("F5_purls", "SELECT DISTINCT purl, regexp_extract(purl, '^pkg:([^/]+)/', 1) AS type, CASE regexp_extract(purl, '^pkg:([^/]+)/', 1) WHEN 'maven' THEN 'mvn' WHEN 'deb' THEN 'debian' WHEN 'pypi' THEN 'PyPI' END AS ecosystem, package_name AS package, regexp_extract(purl, '@(.*)$', 1) AS version FROM vpurls")
def purls(c):
    p = uri.purl_parts("purl")
    return c.vulnerabilities_purls.select("purl").distinct().select("purl", p["type"].alias("type"), p["ecosystem"].alias("ecosystem"), uri.purl_package("purl").alias("package"), p["version"].alias("version"))


@scalars("F7_digests", "SELECT id, sha1(external_id) AS digest FROM vulnerabilities")
def digests(c):
    return c.vulnerabilities.select("id", F.sha1(F.col("external_id").cast("binary")).alias("digest"))


@scalars("F8_callable_names", "SELECT p_partkey, replace(p_brand, '#', '_') || '$' || p_type || '.' || CASE WHEN p_size % 5 = 0 THEN '<init>' ELSE 'm' || p_size END || '(' AS name FROM part")
def callable_names(c):
    """Paths of two owners and a method; every fifth method is a constructor, written as its owner again."""
    owner = F.replace("p_brand", F.lit("#"), F.lit("_"))
    path = F.concat_ws("::", owner, "p_type", F.when(F.col("p_size") % 5 == 0, F.col("p_type")).otherwise(F.concat(F.lit("m"), F.col("p_size").cast("string"))))
    return c.part.select("p_partkey", uri.callable_name(path).alias("name"))


@scalars("F9_epochs", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN epoch_us(ts) // 1000000 * 1000 ELSE epoch_us(ts) // 1000 END AS millis FROM events")
def epochs(c):
    """Seconds, milliseconds or -1, as the producers write them."""
    us = micros("ts")
    raw = F.when(F.col("event_type") == "error", F.lit(-1)).when(F.col("event_type") == "view", F.floor(us / 1_000_000)).otherwise(F.floor(us / 1000)).cast("long")
    return c.events.withColumn("raw", raw).select("event_id", uri.epoch_millis("raw").alias("millis"))


@scalars("F10_dates", "SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS latest, strftime(min(o_orderdate), '%Y-%m-%d') AS first FROM orders GROUP BY o_custkey")
def dates(c):
    d = lambda x: F.date_format(x, "yyyy-MM-dd")
    return c.orders.groupBy("o_custkey").agg(d(F.max("o_orderdate")).alias("latest"), d(F.min("o_orderdate")).alias("first"))


@scalars("F11_ratios", "SELECT l_returnflag, round(count(*) FILTER (WHERE l_linestatus = 'F') / count(*)::DOUBLE, 3) AS ratio, round(avg(l_quantity), 3) AS mean FROM lineitem GROUP BY l_returnflag")
def ratios(c):
    return c.lineitem.groupBy("l_returnflag").agg(F.round(F.count_if(F.col("l_linestatus") == "F") / F.count(F.lit(1)), 3).alias("ratio"), F.round(F.avg("l_quantity"), 3).alias("mean"))


@scalars("F12_logs", "SELECT p_partkey, round(log2(p_size + 2), 9) AS lg, CAST(ceil(log2(p_size + 1)) AS BIGINT) AS bucket, round(sqrt(p_size * p_size + 1), 9) AS norm FROM part")
def logs(c):
    s = F.col("p_size")
    return c.part.select("p_partkey", F.round(F.log2(s + 2), 9).alias("lg"), F.ceil(F.log2(s + 1)).alias("bucket"), F.round(F.sqrt(s * s + 1), 9).alias("norm"))


@scalars("F13_bits", "SELECT p_partkey, (p_partkey << 8) | p_size AS packed, ((p_partkey << 8) | p_size) & 255 AS low FROM part")
def bits(c):
    p = F.shiftleft("p_partkey", 8).bitwiseOR(F.col("p_size").cast("long"))
    return c.part.select("p_partkey", p.alias("packed"), p.bitwiseAND(F.lit(255).cast("long")).alias("low"))


@scalars("F14_arrays", "SELECT package_version_id, dependency_id, array_to_string(list_slice(version_range, -2, -1), '|') AS last_two, len(version_range) AS n, list_contains(version_range, '2.12.0') AS has, array_to_string(list_concat(version_range, dependency_type), '|') AS joined FROM deps WHERE version_range IS NOT NULL AND dependency_type IS NOT NULL")
def arrays(c):
    d = c.dependencies.where("version_range IS NOT NULL AND dependency_type IS NOT NULL")
    r = F.col("version_range")
    last = F.when(F.size(r) < 2, r).otherwise(F.slice(r, -2, 2))
    return d.select("package_version_id", "dependency_id", F.array_join(last, "|").alias("last_two"), F.size(r).cast("long").alias("n"), F.array_contains(r, "2.12.0").alias("has"), F.array_join(F.concat(r, F.col("dependency_type")), "|").alias("joined"))


@scalars("F15_maps", "SELECT p_brand, count(DISTINCT p_type) AS n_types, min(p_type) AS first_type FROM part GROUP BY p_brand")
def maps(c):
    m = F.map_from_entries(F.array_sort(F.collect_set(F.struct("p_type", F.lit(1)))))
    return c.part.groupBy("p_brand").agg(m.alias("m")).select("p_brand", F.size("m").cast("long").alias("n_types"), F.element_at(F.map_keys("m"), 1).alias("first_type"))


@scalars("F16_json", "SELECT id, json_exists(metadata, '$.size') AS has_size, coalesce(json_extract_string(metadata, '$.forge'), '?') AS forge, json_extract_string(metadata, '$.commitTag') AS tag, (SELECT count(*) FROM (SELECT unnest(json_keys(metadata)) AS k) WHERE k NOT IN ('size')) AS n_other FROM pv WHERE metadata IS NOT NULL")
def json_functions(c):
    v = c.package_versions.where("metadata IS NOT NULL")
    rest = F.size(F.map_keys(json_ops.as_map(json_ops.without_key("metadata", "size")))).cast("long")
    return v.select("id", json_ops.has_key("metadata", "size").alias("has_size"), F.coalesce(json_ops.pointer("metadata", "/forge"), F.lit("?")).alias("forge"), json_ops.pointer("metadata", "/commitTag").alias("tag"), rest.alias("n_other"))


@scalars("F18_repository_urls", "SELECT id, regexp_extract(repository, '(https?://[a-z.]*git[a-z.]*/[^\"\\s]+)', 1) AS url FROM packages WHERE repository IS NOT NULL")
def repository_urls(c):
    return c.packages.where("repository IS NOT NULL").select("id", F.regexp_extract("repository", r"(https?://[a-z.]*git[a-z.]*/[^\"\s]+)", 1).alias("url"))


@scalars("F19_enums", "SELECT id, CASE upper(coalesce(json_extract_string(statement, '$.severity'), json_extract_string(statement, '$[0].severity'))) WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'MODERATE' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END AS severity FROM vulnerabilities")
def enums(c):
    ranks = F.create_map(*[F.lit(x) for kv in {"LOW": 1, "MEDIUM": 2, "MODERATE": 2, "HIGH": 3, "CRITICAL": 4}.items() for x in kv])
    s = F.upper(F.coalesce(json_ops.pointer("statement", "/severity"), json_ops.pointer("statement", "/0/severity")))
    return c.vulnerabilities.select("id", F.coalesce(F.try_element_at(ranks, s), F.lit(0)).alias("severity"))


@scalars("F20_file_names", "SELECT package_name, regexp_replace(package_name, '[^a-zA-Z0-9._-]', '-', 'g') AS safe, left(package_name, 1) || '/' || package_name AS shard FROM packages")
def file_names(c):
    return c.packages.select("package_name", uri.file_name("package_name").alias("safe"), F.concat(F.left("package_name", F.lit(1)), F.lit("/"), "package_name").alias("shard"))


def source_counts_of(documents: DataFrame) -> DataFrame:
    """``documents`` with the counts of F21."""
    code = documents.withColumn("_code", src.stripped(F.col("text"))).withColumn("is_code", src.declares_type(F.col("_code")))
    java = F.when(F.col("is_code"), F.col("_code"))
    code = code.withColumn("_tests", src.unit_tests(java)).withColumn("mock_import", (F.size("_tests") > 0) & src.imports_mock(F.col("text")))
    return code.select(
        *documents.columns, F.coalesce(F.length("_code"), F.lit(0)).cast("long").alias("n_stripped"), "is_code", F.coalesce(src.function_count(java), F.lit(0).cast("long")).alias("n_functions"), F.size("_tests").cast("long").alias("n_tests"), "mock_import",
        F.when(F.col("mock_import"), F.size(src.with_mock(F.col("_tests")))).otherwise(0).cast("long").alias("n_tests_with_mock"),
    )


@scalars("F21_source_counts", "SELECT doc_id, length(regexp_replace(text, '//[^\\n]*', '', 'g')) AS n_stripped, len(regexp_extract_all(text, 'int [a-z]\\w*\\(')) AS n_methods FROM documents WHERE text LIKE '%public final class%'")
def source_counts(c):
    """Source text without its line comments, and the int methods of it: as its SQL, a public final class only. F21_source_statistics has all."""
    t = F.col("text")
    d = c.documents.where(t.contains("public final class"))
    return d.select("doc_id", F.length(F.regexp_replace(t, r"//[^\n]*", "")).cast("long").alias("n_stripped"), F.regexp_count(t, F.lit(r"int [a-z]\w*\(")).cast("long").alias("n_methods"))


@scalars("F21_source_statistics")
def source_statistics(c):
    """Every document: its length without comments and, where it declares a Java type, its functions, unit tests and tests with mocks; 0 elsewhere."""
    return source_counts_of(c.documents).select("doc_id", "n_stripped", "is_code", "n_functions", "n_tests", "mock_import", "n_tests_with_mock")


@scalars("F22_license_keys", "SELECT lower(p_type) || '|' || p_brand AS key, count(*) AS n FROM part GROUP BY 1")
def license_keys(c):
    return c.part.groupBy(F.concat_ws("|", F.lower("p_type"), "p_brand").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@scalars("F23_artifact_urls", "SELECT pv.id, rtrim(a.repository_base_url, '/') || '/' || replace(split_part(p.package_name, ':', 1), '.', '/') || '/' || split_part(p.package_name, ':', 2) || '/' || pv.version || '/' || split_part(p.package_name, ':', 2) || '-' || pv.version || '.jar' AS url FROM pv JOIN packages p ON p.id = pv.package_id JOIN artifact_repositories a ON a.id = pv.artifact_repository_id WHERE p.package_name LIKE '%:%'")
def artifact_urls(c):
    p = c.packages.where(F.col("package_name").contains(":")).select(F.col("id").alias("package_id"), "package_name")
    a = c.artifact_repositories.select(F.col("id").alias("artifact_repository_id"), "repository_base_url")
    j = c.package_versions.join(p, "package_id").join(F.broadcast(a), "artifact_repository_id")
    return j.select("id", uri.artifact_url("repository_base_url", F.concat_ws(":", "package_name", "version")).alias("url"))


@scalars("F24_revision_json", """SELECT pv.id, '{"id":' || pv.id || ',"version":"' || version || '","createdAt":' || epoch_us(created_at) // 1000 || '}' AS json FROM pv WHERE created_at IS NOT NULL""")
def revision_json(c):
    v = c.package_versions.where("created_at IS NOT NULL")
    return v.select("id", F.to_json(F.struct("id", "version", F.floor(micros("created_at") / 1000).alias("createdAt"))).alias("json"))


@scalars("F25_vulnerability_views", "SELECT id, external_id, length(json_extract_string(statement, '$.description')) AS n_description, json_exists(statement, '$.purls') AS has_purls FROM vulnerabilities")
def vulnerability_views(c):
    return c.vulnerabilities.select("id", "external_id", F.length(json_ops.pointer("statement", "/description")).cast("long").alias("n_description"), json_ops.has_key("statement", "purls").alias("has_purls"))


QUERIES, SQL = scalars.queries, scalars.sql
