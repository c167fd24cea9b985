"""Streaming queries (T1-T17) over the events, each run to the end of its source and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgloom.operators.dependencies import constraint_sets, direct_dependents
from pkgloom.operators.upsert import last_of_each, upsert
from pkgloom.plans.dependencies import SETS_SQL, cache_file
from pkgloom.plans.registry import Registry, micros
from pkgloom.session import Scratch, cut
from pkgloom.streaming.lanes import NORMAL, PRIORITY, Lanes, StreamedTable, envelope, kafka_rows, offload, table_stream, unwrap_payload

streams = Registry()

_VALUE = "event_type || ':' || user_id || ':' || coalesce(props, '')"
_RECORDS = f"rec AS (SELECT event_id AS key, CASE WHEN event_type = 'purchase' THEN 'priority' ELSE 'normal' END AS lane, {_VALUE} AS value, event_type, value AS amount FROM events), fst AS (SELECT value, min(key) AS k FROM rec GROUP BY value)"


def _records(c) -> DataFrame:
    e = table_stream(c.spark, c.sf_dir, "events", "event_id")
    lane = F.when(F.col("event_type") == "purchase", PRIORITY).otherwise(NORMAL)
    return e.select(F.col("event_id").alias("key"), lane.alias("lane"), F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.coalesce("props", F.lit(""))).alias("value"))


def _plugin(df: DataFrame) -> DataFrame:
    """Cuts a record into its parts; an 'error' event can't be processed."""
    bad = F.col("value").startswith("error")
    return df.select("key", F.upper("value").alias("payload"), F.when(bad, F.lit("no such plugin input")).alias("error"))


@streams("T1_consumed", f"WITH {_RECORDS} SELECT lane, count(*) AS n, count(DISTINCT upper(value)) AS n_payloads FROM rec WHERE event_type <> 'error' GROUP BY lane")
def consumed(c):
    lanes = Lanes(c.spark)
    lanes.consume(_records(c), _plugin, dedup=False)
    return lanes.outputs().groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("payload").alias("n_payloads"))


@streams("T2_priority_lanes", f"WITH {_RECORDS} SELECT key, lane FROM rec WHERE event_type <> 'error'")
def priority_lanes(c):
    lanes = Lanes(c.spark)
    lanes.consume(_records(c), _plugin, dedup=False)
    return lanes.outputs().select("key", "lane")


@streams("T4_seen_before", f"WITH {_RECORDS} SELECT rec.key, lane FROM rec JOIN fst ON fst.value = rec.value WHERE rec.key > fst.k")
def seen_before(c):
    lanes = Lanes(c.spark)
    lanes.consume(_records(c), _plugin)
    return lanes.errors().where("error = 'seen before'").select("key", "lane")


@streams("T5_error_routing", f"WITH {_RECORDS} SELECT lane, CASE WHEN rec.key > fst.k THEN 'seen before' ELSE 'no such plugin input' END AS error, count(*) AS n FROM rec JOIN fst ON fst.value = rec.value WHERE rec.key > fst.k OR event_type = 'error' GROUP BY 1, 2")
def error_routing(c):
    lanes = Lanes(c.spark)
    lanes.consume(_records(c), _plugin)
    return lanes.errors().groupBy("lane", "error").agg(F.count(F.lit(1)).alias("n"))


@streams("T9_many_outputs", f"WITH {_RECORDS} SELECT key, unnest(string_split(value, ':')) AS part FROM rec")
def many_outputs(c):
    """One record, several outputs."""
    lanes = Lanes(c.spark)
    lanes.consume(_records(c), lambda df: df.select("key", F.explode(F.split("value", ":")).alias("payload"), F.lit(None).cast("string").alias("error")), dedup=False)
    return lanes.outputs().select("key", F.col("payload").alias("part"))


@streams("T10_envelopes", f"WITH {_RECORDS} SELECT key, 'Upper' AS plugin_name, value AS input, upper(value) AS payload FROM rec")
def envelopes(c):
    lanes = Lanes(c.spark)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    lanes.consume(_records(c), lambda df: df.select("key", envelope(F.upper("value"), F.col("value"), "Upper", "0.1.0", at).alias("payload"), F.lit(None).cast("string").alias("error")), dedup=False)
    v = F.try_parse_json("payload")
    return lanes.outputs().select("key", *[F.try_variant_get(v, f"$.{k}", "string").alias(k) for k in ("plugin_name", "input", "payload")])


@streams("T11_offloaded", f"WITH {_RECORDS} SELECT count(*) FILTER (WHERE length(value) > 16) AS n_linked, count(*) FILTER (WHERE length(value) <= 16) AS n_direct FROM rec")
def offloaded(c):
    folder = f"{Scratch(c.spark).root.toString()}/payloads"
    rows = c.events.select(F.col("event_id").alias("key"), F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.coalesce("props", F.lit(""))).alias("payload"))
    out = offload(rows, folder, 16)
    linked = F.col("payload").startswith('{"dir"')
    return out.agg(F.count_if(linked).alias("n_linked"), F.count_if(~linked).alias("n_direct"))


@streams("T12_lazy_ingestion", "SELECT DISTINCT x.package_name || ':' || x.package_version AS key FROM vpurls x WHERE NOT EXISTS (SELECT 1 FROM packages p JOIN pv ON pv.package_id = p.id WHERE p.package_name = x.package_name AND pv.version = x.package_version)")
def lazy_ingestion(c):
    """Coordinates that were asked for and are not ingested yet."""
    key = lambda a, b: F.concat_ws(":", a, b).alias("key")
    wanted = c.vulnerabilities_purls.select(key("package_name", "package_version")).distinct()
    p = c.packages.select(F.col("id").alias("package_id"), "package_name")
    have = c.package_versions.join(p, "package_id").select(key("package_name", "version"))
    return wanted.join(have, "key", "left_anti")


@streams("T14_unwrapped_payloads", "SELECT record_id, json_extract_string(message, '$.payload.dir') AS dir FROM callable_messages WHERE json_type(message, '$.payload') = 'OBJECT'")
def unwrapped_payloads(c):
    m = c.callable_messages.withColumn("p", unwrap_payload(F.col("message")))
    own = F.schema_of_variant(F.try_variant_get(F.try_parse_json("message"), "$.payload", "variant")).startswith("OBJECT")
    return m.where(own).select("record_id", F.try_variant_get(F.try_parse_json("p"), "$.dir", "string").alias("dir"))


@streams("T15_stream_lookup", "SELECT e.event_id, c.c_mktsegment FROM events e JOIN customer c ON c.c_custkey = e.user_id")
def stream_lookup(c):
    """Each streamed record with what a table knows about it."""
    lanes = Lanes(c.spark)
    static = c.customer.select(F.col("c_custkey").cast("string").alias("user"), "c_mktsegment")
    lanes.consume(_records(c), lambda df: df.withColumn("user", F.split_part("value", F.lit(":"), F.lit(2))).join(static, "user").select("key", F.col("c_mktsegment").alias("payload"), F.lit(None).cast("string").alias("error")), dedup=False)
    return lanes.outputs().select(F.col("key").alias("event_id"), F.col("payload").alias("c_mktsegment"))


@streams("T16_incremental_upsert", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id")
def incremental_upsert(c):
    """A table of the last event of each user, kept by upserts of each batch."""
    kept = StreamedTable(c.spark, Scratch(c.spark).root.toString(), "user_id long, event_type string, ts timestamp_ntz, event_id long")

    def merge(table: DataFrame, batch: DataFrame) -> DataFrame:
        last = last_of_each(batch.select("user_id", "event_type", "ts", "event_id").unionByName(table), ["user_id"], ["ts", "event_id"])
        return upsert(table, last, ["user_id"])

    kept.consume(table_stream(c.spark, c.sf_dir, "events", "event_id"), merge)
    return kept.read().select("user_id", F.col("event_type").alias("last_type"), micros("ts").alias("last_us"))


@streams("T2_lane_order", f"WITH {_RECORDS} SELECT lane, CASE WHEN lane = 'priority' THEN 0 ELSE 1 END AS place, count(*) AS n FROM rec GROUP BY lane")
def lane_order(c):
    """In every batch the place of each lane by the time its files were written, and the records it had."""
    lanes = Lanes(c.spark)
    lanes.consume(_records(c), _plugin, dedup=False)
    written = lanes.results().select("batch", "lane", F.col("_metadata.file_modification_time").alias("at"))
    per = written.groupBy("batch", "lane").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    placed = per.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("at", F.col("lane") == NORMAL)) - 1)
    return placed.groupBy("lane", "place").agg(F.sum("n").alias("n"))


@streams("T3_restarted", f"WITH {_RECORDS} SELECT rec.key, lane, CASE WHEN rec.key > fst.k THEN 'seen before' WHEN event_type = 'error' THEN 'no such plugin input' ELSE 'done' END AS outcome FROM rec JOIN fst ON fst.value = rec.value")
def restarted(c):
    """A consumer that is ended after each half of its source and started anew on the same root: each record once."""
    root = Scratch(c.spark).root.toString()
    source = f"{root}/source"
    rows = c.events.select(F.col("event_id").alias("key"), F.when(F.col("event_type") == "purchase", PRIORITY).otherwise(NORMAL).alias("lane"), F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.coalesce("props", F.lit(""))).alias("value"))
    half = rows.approxQuantile("key", [0.5], 0.01)[0]
    for part in (rows.where(F.col("key") <= half), rows.where(F.col("key") > half), rows.limit(0)):
        part.coalesce(1).write.mode("append").parquet(source)
        lanes = Lanes(c.spark, f"{root}/state")
        lanes.consume(c.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source), _plugin)
    return lanes.results().select("key", "lane", F.coalesce("error", F.lit("done")).alias("outcome"))


@streams("S14_kafka_rows", f"WITH {_RECORDS} SELECT 'plug' || CASE WHEN event_type = 'error' THEN '.err' ELSE '.out' END AS topic, key::VARCHAR AS key, CASE WHEN event_type = 'error' THEN 'no such plugin input' ELSE upper(value) END AS value FROM rec")
def sent_rows(c):
    """What a batch sends to Kafka: outputs and errors to topics of their own."""
    lanes = Lanes(c.spark)
    lanes.consume(_records(c), _plugin, dedup=False)
    return kafka_rows(lanes.results(), "plug")


_AFFECTED = "SELECT DISTINCT v.id FROM packages p JOIN pv v ON v.package_id = p.id JOIN vpurls x ON x.package_name = p.package_name AND x.package_version = v.version AND x.forge = p.forge"


@streams(
    "T17_invalidation_stream",
    f"WITH {SETS_SQL}, aff AS ({_AFFECTED}), hit AS (SELECT s.source AS id FROM matched m JOIN sets s ON s.package_id = m.package_id AND s.r = m.r WHERE m.target IN (SELECT id FROM aff) UNION SELECT id FROM aff) SELECT DISTINCT left(p.package_name, 1) || '/' || split_part(p.package_name, ':', 1) || '/' || split_part(p.package_name, ':', 2) || '/' || v.version || '.json' AS path FROM hit JOIN pv v ON v.id = hit.id JOIN packages p ON p.id = v.package_id",
)
def invalidation_stream(c):
    """Cache files that newly reported vulnerabilities make stale, batch by batch: of the version named and its direct dependents.

    Sets, uses and the files of all versions are written once, before the stream; a batch reads of them what it names.
    """
    scratch = Scratch(c.spark)
    uses, sets = (scratch.write(x)[0] for x in constraint_sets(c.dependencies))
    v = c.versions("package_id", "version")
    known, _ = scratch.write(v.join(c.packages.select(F.col("id").alias("package_id"), "package_name", "forge"), "package_id").withColumn("path", cache_file("package_name", "version")))
    stale = StreamedTable(c.spark, Scratch(c.spark).root.toString(), "path string")

    def merge(table: DataFrame, batch: DataFrame) -> DataFrame:
        named = batch.select("package_name", F.col("package_version").alias("version"), "forge").distinct()
        roots = cut(known.join(named, ["package_name", "version", "forge"]).select("id", "package_id", "version", "path").distinct())
        found = direct_dependents(uses, sets, roots.select("package_id", "version")).withColumnRenamed("node", "id")
        return table.unionByName(known.join(found, "id", "left_semi").select("path")).unionByName(roots.select("path")).distinct()

    stale.consume(table_stream(c.spark, c.sf_dir, "vulnerabilities_purls", "vulnerability_id"), merge)
    return stale.read()


@streams("N14_listened_packages", "SELECT DISTINCT x.vulnerability_id, v.id AS version_id FROM packages p JOIN pv v ON v.package_id = p.id JOIN vpurls x ON x.package_name = p.package_name AND x.package_version = v.version AND x.forge = p.forge")
def listened_packages(c):
    """Each package version that arrives, with the vulnerabilities known for it."""
    known = c.vulnerabilities_purls.select("vulnerability_id", "package_name", "forge", F.col("package_version").alias("version")).distinct()
    known = known.join(c.packages.select(F.col("id").alias("package_id"), "package_name", "forge"), ["package_name", "forge"]).select("vulnerability_id", "package_id", "version")
    found = StreamedTable(c.spark, Scratch(c.spark).root.toString(), "vulnerability_id long, version_id long")
    found.consume(table_stream(c.spark, c.sf_dir, "package_versions", "id"), lambda table, batch: table.unionByName(batch.join(known, ["package_id", "version"]).select("vulnerability_id", F.col("id").alias("version_id"))).distinct())
    return found.read()


QUERIES, SQL = streams.queries, streams.sql
