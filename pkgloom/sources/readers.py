"""Where rows come from beside parquet: databases, JSON files and topics, folders of vulnerable chains."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgloom.functions.uri import file_name
from pkgloom.session import Folder, cut
from pkgloom.streaming.lanes import kafka_stream

FETCH_ROWS = 10_000
BUCKETS = 64


def jdbc_options(url: str, table: str, user: str | None = None, password_variable: str = "PGPASSWORD", fetch: int = FETCH_ROWS, split: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> dict[str, str]:
    """Options of a database read: rows in batches of ``fetch``; with ``split`` (a number column) in ``parts`` ranges at once.

    The password comes from the environment, never from the code.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch), "pushDownPredicate": "true"}
    if user:
        options["user"] = user
    if os.environ.get(password_variable):
        options["password"] = os.environ[password_variable]
    if split:
        options |= {"partitionColumn": split, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return options


def jdbc_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table of a database; filters and column choices go to the database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()


def by_forge(sources: dict[str, DataFrame]) -> DataFrame:
    """One table of several databases, one for each forge, with a column forge; a filter on it leaves the others unread."""
    return reduce(DataFrame.unionByName, [df.withColumn("forge", F.lit(forge)) for forge, df in sources.items()])


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, json, broken) of a folder of JSON files, one row a file."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("json"), F.try_parse_json("value").isNull().alias("broken"))


def json_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(file, json, broken) of files with a JSON record on each line; blank lines are no record. As a batch or a stream."""
    rows = (spark.readStream if stream else spark.read).text(path)
    return rows.where(F.trim("value") != "").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("json"), F.try_parse_json("value").isNull().alias("broken"))


def indexed(spark: SparkSession, transform: Callable[[DataFrame], DataFrame], files: str | None = None, servers: str | None = None, topic: str | None = None) -> DataFrame:
    """``transform`` of records (json), the same for files of JSON lines and for a topic."""
    if files is not None:
        return transform(json_lines(spark, files).where("NOT broken").select("json"))
    return transform(kafka_stream(spark, servers, [topic]).select(F.col("value").alias("json")))


class ChainRepository:
    """Vulnerable call chains (package, version, json), one record for each package and version, in folders by a hash of both.

    The file name that a record would have as a file of its own is kept beside it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Folder(spark)

    def _all(self) -> DataFrame:
        schema = "package string, version string, file string, json string, bucket int"
        return self.spark.read.schema(schema).parquet(self.root) if self.files.names(self.root) else self.spark.createDataFrame([], schema)

    @staticmethod
    def _bucket(package, version):
        return F.pmod(F.xxhash64(package, version), F.lit(BUCKETS)).cast("int")

    def store(self, chains: DataFrame) -> None:
        """Adds chains; those of a package and version that are stored already are replaced."""
        rows = chains.select("package", "version", F.concat(file_name(F.concat_ws("-", "package", "version")), F.lit(".json")).alias("file"), "json").withColumn("bucket", self._bucket(F.col("package"), F.col("version")))
        rows = cut(rows)
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
        kept = self._all().where(F.col("bucket").isin(touched)).join(rows.select("package", "version"), ["package", "version"], "left_anti")
        cut(kept.unionByName(rows)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.root)

    def load(self, package: str | None = None, version: str | None = None) -> DataFrame:
        """(package, version, file, json) of all chains, or of those of a package, or of one version: then one folder is read."""
        rows = self._all()
        if package is not None:
            rows = rows.where(F.col("package") == package)
        if version is not None:
            rows = rows.where(F.col("version") == version)
        if package is not None and version is not None:
            at = self.spark.range(1).select(self._bucket(F.lit(package), F.lit(version))).first()[0]
            rows = rows.where(F.col("bucket") == at)
        return rows.drop("bucket")
