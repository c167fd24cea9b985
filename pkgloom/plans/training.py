"""Queries of the general training-data operators (p1 to p6), over the whole tables under ``sf_dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgloom.operators.dates_in_messages import dated_values
from pkgloom.operators.dedup import keep_first, new_messages, repeated, with_digest
from pkgloom.operators.drift import consistent_table, field_changes, profile_fields
from pkgloom.operators.hierarchy import coordinate_links, descendants, further_parents, hierarchies, place
from pkgloom.operators.nested import flatten, flatten_chain, merged_schema, stages_and_lines
from pkgloom.operators.skew import compact, eager_join, heavy_keys, joined_sum
from pkgloom.plans.registry import micros
from pkgloom.session import cut, table

HEAVY_SHARE = 0.04


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_changes(profile_fields(table(spark, sf_dir, "pom_messages")))


def p1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in one table under the oldest names."""
    return consistent_table(table(spark, sf_dir, "pom_messages"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(with_digest(table(spark, sf_dir, "pom_messages"))).select(F.col("ord").alias("record_id"))


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row kept of each message."""
    return keep_first(with_digest(table(spark, sf_dir, "pom_messages"))).select(F.col("ord").alias("record_id"))


def p2_new_in_last_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each topic partition's last source file that bring a message no earlier file has, each message once."""
    messages = table(spark, sf_dir, "pom_messages")
    last = messages.groupBy("topic_partition").agg(F.max("source_file").alias("source_file")).select("source_file").distinct()
    digests = cut(with_digest(messages, carry="source_file"))
    batch, stored = digests.join(last, "source_file", "left_semi"), digests.join(last, "source_file", "left_anti")
    return new_messages(batch, stored).select(F.col("ord").alias("record_id"))


def _package_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = compact(table(spark, sf_dir, "package_versions"), "package_id", "version", low=("created_at",), high=("created_at",))
    named = compact(table(spark, sf_dir, "dependencies"), "dependency_id", "dependency", sums=("alternative_group",))
    return eager_join(versions, named, "full")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(_package_states(spark, sf_dir), "version_rows", HEAVY_SHARE).select(F.col("key").alias("package_id"))


def p3_per_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every package its versions, the dependencies that name it, and the size of their join, never formed."""
    s = _package_states(spark, sf_dir).where("key IS NOT NULL")
    return s.select(
        F.col("key").alias("package_id"),
        F.coalesce("version_rows", F.lit(0)).alias("n_versions"),
        F.coalesce("dependency_rows", F.lit(0)).alias("n_named"),
        F.col("pairs").alias("n_pairs"),
        micros("version_min_created_at").alias("first_us"),
        micros("version_max_created_at").alias("last_us"),
    )


def p3_joined_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and sum of alternative_group of the join of all versions of a package with all dependencies that name it."""
    s = _package_states(spark, sf_dir).where("pairs > 0")
    return s.select(F.col("key").alias("package_id"), F.col("pairs").alias("n_pairs"), joined_sum(F.col("dependency_sum_alternative_group"), F.col("version_rows")).alias("sum_alternative"), joined_sum(F.col("dependency_n_alternative_group"), F.col("version_rows")).alias("n_alternative"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated_values(*(table(spark, sf_dir, t) for t in ("vulnerabilities", "pom_messages", "feeds")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages_and_lines(table(spark, sf_dir, "callable_messages"), table(spark, sf_dir, "vulnerabilities"))


def p5_child_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every table that the envelopes and the statements fall into, with its links; fields as JSON, keys in order."""
    both = {"callable_messages": flatten_chain(table(spark, sf_dir, "callable_messages"), "record_id", "message", whole=True), "vulnerabilities": flatten(table(spark, sf_dir, "vulnerabilities"), "id", "statement")}
    rows = [df.withColumn("origin", F.lit(origin)) for origin, df in both.items()]
    fields = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields"))))
    return rows[0].unionByName(rows[1]).select("origin", "table_name", "record_key", "row_id", "parent_id", "parent_no", "child_no", "plain", fields.alias("fields"))


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of p5_child_rows with their numbers of rows and of parents."""
    rows = p5_child_rows(spark, sf_dir)
    return rows.groupBy("origin", "table_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("plain").isNotNull()).alias("n_plain"), F.approx_count_distinct("parent_id").alias("about_n_parents"))


def p5_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged schema of the statements: every path, the types it has, and how often."""
    return merged_schema(table(spark, sf_dir, "vulnerabilities"), "statement")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchies(coordinate_links(table(spark, sf_dir, "pom_messages")))


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of all coordinates."""
    placed = place(coordinate_links(table(spark, sf_dir, "pom_messages")))
    out = descendants(placed, placed.nodes.select(F.col("name").alias("node")), chunk=256)  # many ancestors in a chunk: small ones
    return out.withColumnsRenamed({"node": "coordinate"})


def p6_further_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parents that a coordinate names beside the one that counts."""
    return further_parents(coordinate_links(table(spark, sf_dir, "pom_messages")))


QUERIES = {f.__name__: f for f in (p1_found, p1_table, p2_found, p2_kept, p2_new_in_last_batch, p3_found, p3_per_package, p3_joined_sums, p4_found, p5_found, p5_child_rows, p5_tables, p5_schema, p6_found, p6_descendants, p6_further_parents)}

_COUNTED = """
    (SELECT package_id, count(*) AS n_versions, min(epoch_us(created_at)) AS first_us, max(epoch_us(created_at)) AS last_us
     FROM package_versions WHERE package_id IS NOT NULL GROUP BY package_id) v
    FULL JOIN (SELECT dependency_id, count(*) AS n_named FROM dependencies WHERE dependency_id IS NOT NULL GROUP BY dependency_id) d
    ON v.package_id = d.dependency_id"""

SQL = {
    "p3_joined_sums": "SELECT v.package_id, count(*) AS n_pairs, CAST(sum(d.alternative_group) AS BIGINT) AS sum_alternative, count(d.alternative_group) AS n_alternative FROM package_versions v JOIN dependencies d ON d.dependency_id = v.package_id GROUP BY v.package_id",
    "p3_found": f"SELECT package_id FROM package_versions WHERE package_id IS NOT NULL GROUP BY package_id HAVING count(*) > {HEAVY_SHARE} * (SELECT count(*) FROM package_versions)",
    "p3_per_package": f"SELECT coalesce(package_id, dependency_id) AS package_id, coalesce(n_versions, 0) AS n_versions, coalesce(n_named, 0) AS n_named, coalesce(n_versions * n_named, 0) AS n_pairs, first_us, last_us FROM {_COUNTED}",
}
