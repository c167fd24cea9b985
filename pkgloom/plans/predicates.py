"""Filters (P1-P21) on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pkgloom.functions import json_ops
from pkgloom.operators.predicates import FilterStack, full_match, metadata_contains, metadata_equals, metadata_matches, pointer_matches
from pkgloom.plans.registry import Registry

predicates = Registry()


@predicates("P1_metadata_source", "SELECT cl.id, pv.metadata IS NOT NULL AS has_metadata FROM callables cl JOIN modules m ON m.id = cl.module_id LEFT JOIN pv ON pv.id = m.package_version_id")
def metadata_source(c):
    """The package metadata of every callable, by way of its module."""
    m = c.modules.select(F.col("id").alias("module_id"), "package_version_id")
    v = c.package_versions.select(F.col("id").alias("package_version_id"), "metadata")
    return c.callables.select("id", "module_id").join(m, "module_id").join(v, "package_version_id", "left").select("id", F.col("metadata").isNotNull().alias("has_metadata"))


@predicates("P2_has_key", "SELECT id FROM pv WHERE json_exists(metadata, '$.commitTag')")
def has_key(c):
    return c.package_versions.where(metadata_contains(F.col("metadata"), "commitTag")).select("id")


@predicates("P3_key_equals", "SELECT id FROM pv WHERE json_extract_string(metadata, '$.packagingType') = 'pom'")
def key_equals(c):
    return c.package_versions.where(metadata_equals(F.col("metadata"), "packagingType", "pom")).select("id")


@predicates("P4_key_matches", "SELECT id FROM pv WHERE regexp_full_match(json_extract_string(metadata, '$.commitTag'), 'v[0-9.]+')")
def key_matches(c):
    return c.package_versions.where(metadata_matches(F.col("metadata"), "commitTag", r"v[0-9.]+")).select("id")


@predicates("P5_pointer", "SELECT id FROM vulnerabilities WHERE regexp_full_match(json_extract_string(statement, '$.cwe_ids[0]'), 'CWE-1.*')")
def pointer(c):
    return c.vulnerabilities.where(pointer_matches(F.col("statement"), "/cwe_ids/0", "CWE-1.*")).select("id")


@predicates("P7_identifier_matches", "SELECT pv.id FROM pv JOIN packages p ON p.id = pv.package_id WHERE regexp_full_match(p.package_name, '.*:.*-parent') AND regexp_full_match(pv.version, '[0-9.]+')")
def identifier_matches(c):
    p = c.packages.select(F.col("id").alias("package_id"), "package_name")
    return c.package_versions.join(p, "package_id").where(full_match(F.col("package_name"), ".*:.*-parent") & full_match(F.col("version"), "[0-9.]+")).select("id")


@predicates("P10_filter_stack", "SELECT id FROM pv WHERE NOT (coalesce(json_exists(metadata, '$.commitTag'), false) AND coalesce(json_extract_string(metadata, '$.packagingType') = 'pom', false)) AND (version LIKE '%-rc%' OR version LIKE '%.Final')")
def filter_stack(c):
    md, v = F.col("metadata"), F.col("version")
    s = FilterStack().push(metadata_contains(md, "commitTag")).push(metadata_equals(md, "packagingType", "pom")).and_().not_()
    s.push(v.contains("-rc")).push(v.endswith(".Final")).or_()
    return c.package_versions.where(s.column()).select("id")


@predicates("P15_created_since", "SELECT id FROM pv WHERE created_at >= TIMESTAMP '2018-06-01'")
def created_since(c):
    return c.package_versions.where(F.col("created_at") >= F.lit("2018-06-01").cast("timestamp_ntz")).select("id")


@predicates("P16_without_case", "SELECT lower(lang) AS lang, count(*) AS n FROM documents GROUP BY 1")
def without_case(c):
    return c.documents.groupBy(F.lower("lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@predicates("P17_text_tests", "SELECT package_name FROM packages WHERE package_name LIKE 'example.b%' AND (package_name ILIKE '%CLIENT%' OR package_name LIKE '%-api' OR package_name LIKE '%-core')")
def text_tests(c):
    n = F.col("package_name")
    return c.packages.where(n.startswith("example.b") & (n.ilike("%CLIENT%") | n.endswith("-api") | n.endswith("-core"))).select("package_name")


@predicates("P18_null_defaults", "SELECT id, coalesce(project_name, '') AS project_name, repository IS NOT NULL AS has_repository FROM packages")
def null_defaults(c):
    return c.packages.select("id", F.coalesce("project_name", F.lit("")).alias("project_name"), F.col("repository").isNotNull().alias("has_repository"))


@predicates("P19_type_guards", "SELECT id, json_type(statement, '$.scoreCVSS3') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AS is_number, json_type(statement, '$.patches') = 'ARRAY' AS is_array FROM vulnerabilities WHERE json_exists(statement, '$.scoreCVSS3') AND json_exists(statement, '$.patches')")
def type_guards(c):
    v = F.try_parse_json("statement")
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    rows = c.vulnerabilities.where(json_ops.has_key("statement", "scoreCVSS3") & json_ops.has_key("statement", "patches"))
    return rows.select("id", kind("$.scoreCVSS3").rlike("^(BIGINT|DECIMAL|DOUBLE)").alias("is_number"), kind("$.patches").startswith("ARRAY").alias("is_array"))


@predicates("P20_excluded_namespaces", "SELECT id FROM callables WHERE NOT (uri LIKE '/ns1%' OR uri LIKE '/ns20/%')")
def excluded_namespaces(c):
    u = F.col("uri")
    return c.callables.where(~(u.startswith("/ns1") | u.startswith("/ns20/"))).select("id")


@predicates("P21_internal_edges", "SELECT source_id, target_id FROM call_sites s JOIN callables a ON a.id = s.source_id JOIN callables b ON b.id = s.target_id WHERE a.is_internal_call AND b.is_internal_call")
def internal_edges(c):
    i = c.callables.where("is_internal_call").select("id")
    return c.call_sites.select("source_id", "target_id").join(i.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(i.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


QUERIES, SQL = predicates.queries, predicates.sql
