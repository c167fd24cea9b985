"""Streaming state: restarts, merged digests, order of arrival, versions of a streamed table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pkgloom.streaming import lanes as L

ROWS = [(i, "priority" if i % 3 == 0 else "normal", f"v{i % 7}") for i in range(20)] + [(50, "normal", None), (51, "normal", None), (52, "odd lane", "x")]


def _upper(df):
    return df.select("key", F.upper("value").alias("payload"), F.when(F.col("value") == "v5", "bad").alias("error"))


def _write(spark, rows, folder):
    spark.createDataFrame(rows, L.RECORDS).coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder):
    return spark.readStream.schema(L.RECORDS).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("compact_every", [1, 2, 100])
def test_restart_goes_on(spark, tmp_path, monkeypatch, compact_every):
    monkeypatch.setattr(L, "COMPACT_EVERY", compact_every)
    source, root = f"{tmp_path}/in", f"{tmp_path}/state"
    for part in (ROWS[:8], ROWS[8:15], ROWS[15:], ROWS[:3]):  # a consumer of its own for each
        _write(spark, part, source)
        lanes = L.Lanes(spark, root)
        lanes.consume(_stream(spark, source), _upper)
    out = sorted((r["key"], r["payload"]) for r in lanes.outputs().collect())
    assert out == sorted([(i, f"V{i}") for i in range(7) if i != 5] + [(50, None), (51, None)])
    errors = sorted((r["key"], r["error"]) for r in lanes.errors().collect())
    assert errors == sorted([(5, "bad")] + [(i, "seen before") for i in [*range(7, 20), 0, 1, 2]])


def test_batch_run_again_replaces_itself(spark, tmp_path):
    lanes = L.Lanes(spark, str(tmp_path))
    df = spark.createDataFrame(ROWS, L.RECORDS)
    for _ in range(3):
        lanes._batch(df, 0, _upper, True)
    assert lanes.outputs().count() == 8 and lanes.errors().where("error = 'seen before'").count() == 13
    lanes._batch(df.where("value = 'v1'"), 1, _upper, True)
    assert lanes.results().where("batch = 1 AND error = 'seen before'").count() == 3


def test_first_by_order_of_arrival(spark, tmp_path):
    raw = spark.createDataFrame([("t", 0, 9, "2024-01-01 00:00:02", "a"), ("t", 1, 3, "2024-01-01 00:00:01", "a"), ("priority-t", 0, 1, "2024-01-01 00:00:03", "b")], "topic string, partition int, offset long, timestamp string, value string")
    records = L.kafka_records(raw.withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    lanes = L.Lanes(spark, str(tmp_path))
    lanes._batch(records, 0, lambda df: df.select("key", F.col("value").alias("payload"), F.lit(None).cast("string").alias("error")), True)
    first = records.where("order.partition = 1").first()["key"]
    assert {r["key"] for r in lanes.outputs().where("payload = 'a'").collect()} == {first}
    assert lanes.outputs().where("lane = 'priority'").count() == 1
    sent = {tuple(r) for r in L.kafka_rows(lanes.results(), "p").select("topic", "value").collect()}
    assert sent == {("p.out", "a"), ("p.out", "b"), ("p.err", "seen before")}


def test_streamed_table(spark, tmp_path):
    source = f"{tmp_path}/in"
    for part in ([(1, "normal", "a")], [(2, "normal", "b"), (1, "normal", "c")], []):
        _write(spark, part, source)
        t = L.StreamedTable(spark, f"{tmp_path}/t", "key long, n long")
        t.consume(_stream(spark, source), lambda table, batch: table.unionByName(batch.select("key", F.lit(1).cast("long").alias("n"))).groupBy("key").agg(F.sum("n").alias("n")))
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, 2), (2, 1)]
    assert L.StreamedTable(spark, f"{tmp_path}/none", "key long").read().count() == 0 and L.Lanes(spark, f"{tmp_path}/none").outputs().count() == 0


def test_offloading_keeps_what_is_there(spark, tmp_path):
    df = spark.createDataFrame([(1, "x" * 50), (2, "y"), (3, None)], "key long, payload string")
    for _ in range(2):
        out = {r["key"]: r["payload"] for r in L.offload(df, str(tmp_path), 10).collect()}
        assert out[2] == "y" and out[3] is None and '"link":"1"' in out[1]
    assert spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path)).count() == 2
