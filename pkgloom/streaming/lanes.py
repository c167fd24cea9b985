"""Streaming ingestion: consume, process, produce, with priority lanes, replay protection, error routing and envelopes.

A plugin is a function from a DataFrame of records (key, lane, value) to one with the columns of RESULT: any number of
output rows per record, or an error. Each micro-batch is written under its batch id, so a batch that is run again after
a failure replaces its own output: records are processed at least once and counted once. What was done and what was
seen lies under a root that the caller names; a run that is ended and started again on the same root goes on there.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgloom.session import Folder, Scratch, cut

PRIORITY, NORMAL = "priority", "normal"
RETRIES = 3
LARGEST_PAYLOAD = 1_000_000
BUCKETS = 32  # of digests
COMPACT_EVERY = 100  # batches after which the folders of seen digests are merged
RESULT = ("key", "payload", "error")
RECORDS = "key long, lane string, value string"


def envelope(payload: Column, source: Column, plugin: str, version: str, at: Column, error: Column | None = None) -> Column:
    """JSON of an output record: when and by what it was made, the input it was made from, payload or error."""
    fields = [F.floor(F.unix_micros(at) / 1_000_000).alias("consumed_at"), F.lit(plugin).alias("plugin_name"), F.lit(version).alias("plugin_version"), source.alias("input")]
    fields.append(payload.alias("payload") if error is None else F.struct(error.alias("message")).alias("error"))
    return F.to_json(F.struct(*fields))


def unwrap_payload(value: Column) -> Column:
    """The payload of a record: its 'payload', else 'input.payload', else 'input', else the record itself."""
    v = F.try_parse_json(value)
    get = lambda p: F.to_json(F.try_variant_get(v, p, "variant"))
    return F.coalesce(get("$.payload"), get("$.input.payload"), get("$.input"), F.to_json(v))


def offload(results: DataFrame, folder: str, largest: int = LARGEST_PAYLOAD) -> DataFrame:
    """Payloads longer than ``largest`` are written to a folder of their own under ``folder`` and replaced by a record that links to them.

    The results are computed once; what other calls wrote under ``folder`` stays.
    """
    rows, here = cut(results), f"{folder}/call={uuid.uuid4().hex}"
    big = F.length("payload") > largest
    rows.where(big).select("key", "payload").write.parquet(here)
    link = F.to_json(F.struct(F.lit(here).alias("dir"), F.col("key").cast("string").alias("link")))
    return rows.withColumn("payload", F.when(big, link).otherwise(F.col("payload")))


def retried(f: Callable[[], None], retries: int = RETRIES, wait_s: float = 0.1) -> None:
    """Runs ``f``, again after a failure, ``retries`` times in all."""
    for n in range(1, retries + 1):
        try:
            return f()
        except Exception:
            if n == retries:
                raise
            time.sleep(wait_s * n)


class Lanes:
    """A consumer with its state: digests seen and results, each by batch, under ``root``.

    root: a folder that all executors share and that outlives the run; without one, the state ends with the driver.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or Scratch(spark).root.toString()).rstrip("/")
        self.files = Folder(spark)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _digests(self) -> dict[str, dict[int, str]]:
        """'batch' and 'upto' (merged up to a batch): number -> folder of the digests seen."""
        out: dict[str, dict[int, str]] = {"batch": {}, "upto": {}}
        for name in self.files.names(self.path("seen")):
            kind, _, number = name.removeprefix("part=").partition("-")
            out[kind][int(number)] = f"{self.path('seen')}/{name}"
        return out

    def _seen(self, before: int) -> DataFrame | None:
        """(digest, bucket) of all batches before ``before``: the last merged folder and the batches after it."""
        found = self._digests()
        upto = max((n for n in found["upto"] if n < before), default=-1)
        parts = [path for n, path in found["upto"].items() if n == upto] + [path for n, path in found["batch"].items() if upto < n < before]
        if not parts:
            return None
        return self.spark.read.schema("digest binary, part string, bucket int").option("basePath", self.path("seen")).parquet(*parts).drop("part")

    def _compact(self, number: int) -> None:
        """Merges the digests of all batches up to ``number`` into one folder, moved into place in one step."""
        seen = self._seen(number + 1)
        if seen is None:
            return
        self.files.replace(seen.distinct().repartition("bucket").sortWithinPartitions("digest"), self.path(f"seen/part=upto-{number}"), "bucket")
        found = self._digests()
        for path in [p for n, p in found["batch"].items() if n <= number] + [p for n, p in found["upto"].items() if n < number]:
            self.files.delete(path)

    def _batch(self, df: DataFrame, number: int, plugin: Callable[[DataFrame], DataFrame], dedup: bool) -> None:
        order = "order" if "order" in df.columns else "key"
        marked = df.withColumn("digest", F.unhex(F.sha1(F.col("value").cast("binary"))))
        if dedup:
            marked = cut(marked.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).cast("int")))
            first = marked.groupBy("digest", "bucket").agg(F.min(order).alias("first"))
            known = self._seen(number)
            first = first.withColumn("known", F.lit(None).cast("boolean"))
            if known is not None:
                touched = [r[0] for r in marked.select("bucket").distinct().collect()]  # BUCKETS at most; other buckets are not read
                again = known.where(F.col("bucket").isin(touched)).select("digest").distinct().withColumn("k", F.lit(True))
                first = first.drop("known").join(again.withColumnRenamed("k", "known"), "digest", "left")
            first = cut(first)
            tagged = marked.join(first.select("digest", "first", "known"), "digest", "left")
            tagged = tagged.withColumn("again", F.coalesce(F.col("known").isNotNull() | (F.col(order) > F.col("first")), F.lit(False)))
            first.where("digest IS NOT NULL").select("digest", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path('seen')}/part=batch-{number}")
        else:
            tagged = marked.withColumn("again", F.lit(False))
        for lane in (PRIORITY, NORMAL):
            part = tagged.where(F.col("lane") == lane)
            done = plugin(part.where("NOT again").select("key", "value")).select("key", F.col("payload").cast("string"), F.col("error").cast("string"))
            if dedup:
                done = done.unionByName(part.where("again").select("key", F.lit(None).cast("string").alias("payload"), F.lit("seen before").alias("error")))
            done.write.mode("overwrite").parquet(f"{self.path('results')}/batch={number}/lane={lane}")
        if dedup and number % COMPACT_EVERY == COMPACT_EVERY - 1:
            self._compact(number)

    def consume(self, records: DataFrame, plugin: Callable[[DataFrame], DataFrame], dedup: bool = True) -> None:
        """Runs the stream ``records`` (key, lane, value, optionally order) through ``plugin`` until its source is used up.

        Priority records of a batch are processed and written before the normal ones. With dedup, a value whose
        digest was stored by an earlier batch, or stands twice in a batch, goes to the errors; of several in a batch the
        one with the smallest ``order`` (by default: key) is the first. Null values are never repetitions.
        """
        run = lambda df, number: retried(lambda: self._batch(df, number, plugin, dedup))
        query = records.writeStream.foreachBatch(run).option("checkpointLocation", self.path("progress")).trigger(availableNow=True).start()
        query.awaitTermination()

    def results(self) -> DataFrame:
        """batch, lane, key, payload, error of every batch done."""
        schema = "key long, payload string, error string, batch int, lane string"
        if not self.files.names(self.path("results")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path("results"))

    def outputs(self) -> DataFrame:
        return self.results().where("error IS NULL").select("key", "lane", "payload")

    def errors(self) -> DataFrame:
        return self.results().where("error IS NOT NULL").select("key", "lane", "error")


class StreamedTable:
    """A table kept by merging each batch into it: one version per batch, moved into place whole.

    A batch that is run again finds its version there and changes nothing; the last two versions are kept.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema, self.files = spark, root.rstrip("/"), schema, Folder(spark)

    def _versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self.files.names(f"{self.root}/table") if n.startswith("v="))

    def read(self) -> DataFrame:
        versions = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/table/v={versions[-1]}") if versions else self.spark.createDataFrame([], self.schema)

    def consume(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Merges each batch of the stream ``rows``: merge(table, batch) is the table after it."""

        def batch(df: DataFrame, number: int) -> None:
            versions = self._versions()
            if versions and versions[-1] >= number:
                return
            self.files.replace(merge(self.read(), df), f"{self.root}/table/v={number}")
            for v in versions[:-1]:
                self.files.delete(f"{self.root}/table/v={v}")

        query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start()
        query.awaitTermination()


def table_stream(spark: SparkSession, sf_dir: str, name: str, key: str | None = None, files: int = 4) -> DataFrame:
    """A table read as a stream of its files, one file a batch.

    A folder of files is streamed as it is. A single file can be dealt out, in the order of ``key``, over ``files`` files.
    """
    at = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(at)
    if key is not None and Folder(spark).is_file(at):
        at = f"{Scratch(spark).root.toString()}/{name}"
        cuts = table.approxQuantile(key, [i / files for i in range(1, files)], 0.01)
        edges = [None, *sorted(set(cuts)), None]
        for low, high in zip(edges, edges[1:]):
            inside = F.lit(True) if low is None else F.col(key) > low
            inside = inside if high is None else inside & (F.col(key) <= high)
            if low is None:
                inside = inside | F.col(key).isNull()
            table.where(inside).coalesce(1).write.mode("append").parquet(at)
            time.sleep(0.05)  # files are taken in the order in which they were written
    elif Folder(spark).is_file(at):
        at = f"{sf_dir}/{name}.parque[t]"  # a pattern may match a single file
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(at)


def kafka_stream(spark: SparkSession, servers: str, topics: list[str], starting: str = "earliest", per_trigger: int = 10_000) -> DataFrame:
    """(key, lane, value, order) of Kafka topics, topics with 'priority' in their name being the priority lane."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", starting).option("maxOffsetsPerTrigger", per_trigger).load()
    return kafka_records(raw)


def kafka_records(raw: DataFrame) -> DataFrame:
    """Kafka's columns as records; they are ordered by the time of the broker, then topic, partition and offset."""
    lane = F.when(F.col("topic").contains(PRIORITY), PRIORITY).otherwise(NORMAL)
    return raw.select(F.xxhash64("topic", "partition", "offset").alias("key"), lane.alias("lane"), F.col("value").cast("string").alias("value"), F.struct("timestamp", "topic", "partition", "offset").alias("order"))


def kafka_rows(results: DataFrame, topic: str) -> DataFrame:
    """(topic, key, value) as Kafka takes them: outputs go to ``topic``.out, errors to ``topic``.err."""
    bad = F.col("error").isNotNull()
    return results.select(F.concat(F.lit(topic), F.when(bad, ".err").otherwise(".out")).alias("topic"), F.col("key").cast("string").alias("key"), F.when(bad, F.col("error")).otherwise(F.col("payload")).alias("value"))


def to_kafka(results: DataFrame, servers: str, topic: str, largest: int = 50_000_000) -> None:
    """Sends the results of a batch; called from foreachBatch before the batch is committed, so delivery is at least once."""
    kafka_rows(results, topic).write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.max.request.size", str(largest)).save()
