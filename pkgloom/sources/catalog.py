"""The tables of the metadata store, read lazily, and call-graph tables derived from the star schema.

Packages, versions, dependencies, repositories and vulnerabilities are tables of their own. Modules, callables, call
sites and files have no table; they are derived: an order line is a module of the version with the order's number, a
(line, part) a callable of it, and consecutive lines of an order call each other. VIEWS_SQL says the same in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Catalog:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def package_versions(self) -> DataFrame:
        """One row per id: deliveries that came twice, whole and unchanged, count once."""
        return self.table("package_versions").dropDuplicates(["id"])

    def versions(self, *columns: str) -> DataFrame:
        """id and some columns of the versions, each once: the scan reads these columns only, and hashes them."""
        return self.table("package_versions").select("id", *columns).distinct()

    @cached_property
    def dependencies(self) -> DataFrame:
        return self.table("dependencies").distinct()

    @cached_property
    def vulnerabilities_purls(self) -> DataFrame:
        return self.table("vulnerabilities_purls").distinct()

    @cached_property
    def module_names(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", F.lit(""), "p_brand", "p_name").alias("name"))

    @cached_property
    def modules(self) -> DataFrame:
        """id, package_version_id, module_name_id, final, access."""
        lines = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("module_name_id"), F.max("l_returnflag").alias("access"))
        return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("package_version_id"), "module_name_id", (F.col("l_linenumber") == 1).alias("final"), "access")

    @cached_property
    def callables(self) -> DataFrame:
        """id, module_id, uri, is_internal_call, line_start, line_end, type."""
        c = F.col
        one = self.table("lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_quantity").cast("int").alias("q"), F.max(F.col("l_returnflag") != "R").alias("internal"))
        return one.select(
            (c("l_orderkey") * 10_000_000 + c("l_linenumber") * 1_000_000 + c("l_partkey")).alias("id"),
            (c("l_orderkey") * 10 + c("l_linenumber")).alias("module_id"),
            F.concat(F.lit("/ns"), (c("l_partkey") % 25).cast("string"), F.lit("/Type"), (c("l_partkey") % 200).cast("string"), F.lit(".m"), c("l_partkey").cast("string"), F.lit("(%2Fjava.lang%2FString)%2Fint")).alias("uri"),
            c("internal").alias("is_internal_call"),
            c("l_linenumber").cast("int").alias("line_start"),
            (c("l_linenumber") + c("q")).cast("int").alias("line_end"),
            F.when(c("l_linenumber") == 1, "internalBinary").otherwise("externalProduct").alias("type"),
        )

    @cached_property
    def call_sites(self) -> DataFrame:
        """source_id, target_id, line, call_type: consecutive lines of an order."""
        a = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus").distinct()
        b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to_part")).distinct()
        j = a.join(b, ["l_orderkey", "l_linenumber"])
        key = F.col("l_orderkey") * 10_000_000
        return (
            j.select((key + F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("source_id"), (key + (F.col("l_linenumber") + 1) * 1_000_000 + F.col("to_part")).alias("target_id"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_linestatus").alias("status"))
            .groupBy("source_id", "target_id", "line")
            .agg(F.max(F.col("status") == "F").alias("f"))
            .select("source_id", "target_id", "line", F.when(F.col("f"), "static").otherwise("dynamic").alias("call_type"))
        )

    @cached_property
    def files(self) -> DataFrame:
        """id, package_version_id, path."""
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 100_000 + F.col("l_suppkey")).alias("id"), F.col("l_orderkey").alias("package_version_id"), F.concat(F.lit("src/main/s"), F.col("l_suppkey").cast("string"), F.lit("/File.java")).alias("path")
        ).distinct()

    @cached_property
    def module_contents(self) -> DataFrame:
        """module_id, file_id."""
        k = F.col("l_orderkey")
        return self.table("lineitem").select((k * 10 + F.col("l_linenumber")).alias("module_id"), (k * 100_000 + F.col("l_suppkey")).alias("file_id")).distinct()

    @cached_property
    def part_edges(self) -> DataFrame:
        """A sparse directed graph src, dst without loops: parts on consecutive lines of an order."""
        a = self.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
        b = self.table("lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
        return a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct()

    @cached_property
    def supplier_calls(self) -> DataFrame:
        """src, dst without loops, as often as they occur: suppliers on consecutive lines of an order. Lines are shuffled once, by order."""
        lines = self.table("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_suppkey").alias("src"))
        following = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1)
        calls = lines.dropna().withColumn("next", F.collect_set("src").over(following))
        return calls.select("src", F.explode("next").alias("dst")).where("src <> dst")

    @cached_property
    def supplier_edges(self) -> DataFrame:
        """A dense directed graph src, dst without loops: suppliers on consecutive lines of an order."""
        return self.supplier_calls.distinct()


VIEWS_SQL = """
pv AS (SELECT DISTINCT * FROM package_versions),
deps AS (SELECT DISTINCT * FROM dependencies),
vpurls AS (SELECT DISTINCT * FROM vulnerabilities_purls),
module_names AS (SELECT p_partkey AS id, '/' || p_brand || '/' || p_name AS name FROM part),
modules AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS package_version_id, min(l_partkey) AS module_name_id, l_linenumber = 1 AS final, max(l_returnflag) AS access
            FROM lineitem GROUP BY l_orderkey, l_linenumber),
callables AS (SELECT l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS id, l_orderkey * 10 + l_linenumber AS module_id,
              '/ns' || (l_partkey % 25) || '/Type' || (l_partkey % 200) || '.m' || l_partkey || '(%2Fjava.lang%2FString)%2Fint' AS uri,
              min(l_returnflag) <> 'R' AS is_internal_call, l_linenumber AS line_start, CAST(l_linenumber + CAST(trunc(max(l_quantity)) AS INT) AS INT) AS line_end,
              CASE WHEN l_linenumber = 1 THEN 'internalBinary' ELSE 'externalProduct' END AS type
              FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey),
call_sites AS (SELECT a.l_orderkey * 10000000 + a.l_linenumber * 1000000 + a.l_partkey AS source_id, a.l_orderkey * 10000000 + b.l_linenumber * 1000000 + b.l_partkey AS target_id,
               a.l_linenumber AS line, CASE WHEN min(a.l_linestatus) = 'F' THEN 'static' ELSE 'dynamic' END AS call_type
               FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1, 2, 3),
files AS (SELECT DISTINCT l_orderkey * 100000 + l_suppkey AS id, l_orderkey AS package_version_id, 'src/main/s' || l_suppkey || '/File.java' AS path FROM lineitem),
module_contents AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS module_id, l_orderkey * 100000 + l_suppkey AS file_id FROM lineitem),
part_edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
supplier_edges AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey)
"""
