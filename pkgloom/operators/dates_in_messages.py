"""Date values of the vulnerability statements and the POM messages, as text with their place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgloom.operators.drift import field_aliases, profile_fields
from pkgloom.operators.jsonio import parse_object, parse_value
from pkgloom.operators.timestamps import utc_micros

SCHEMA = "record_key long, feed_id int, field_name string, item_no int, value string"


def unwrap(v) -> list[dict]:
    """The statements in a parsed value: itself, or the objects of a list."""
    return [x for x in as_list(v) if isinstance(x, dict)]


def as_list(v) -> list:
    """A list, a bare element as the only one, nothing for null."""
    return v if isinstance(v, list) else [] if v is None else [v]


def _text(v) -> str | None:
    if isinstance(v, str):
        return v
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(v)
    return None


def _rows(batches: Iterator[pa.RecordBatch], found) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string())
    for batch in batches:
        cols: list[list] = [[] for _ in types]
        for key, feed, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            for name, no, v in found(*rest):
                v = _text(v)
                if v:
                    for c, x in zip(cols, (key, feed, name, no, v)):
                        c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["record_key", "feed_id", "field_name", "item_no", "value"])


def statement_dates(vulnerabilities: DataFrame) -> DataFrame:
    """published_date, last_modified_date and patches.patch_date of each statement, item_no the patch's place in its list.

    A value that is a list of several statements has the dates of each.
    """

    def found(text: str | None):
        for s in unwrap(parse_value(text)):
            for k in ("published_date", "last_modified_date"):
                yield k, 0, s.get(k)
            for i, patch in enumerate(as_list(s.get("patches"))):
                if isinstance(patch, dict):
                    yield "patch_date", i, patch.get("patch_date")

    return vulnerabilities.select("id", "feed_id", "statement").mapInArrow(lambda b: _rows(b, found), SCHEMA)


def message_dates(messages: DataFrame) -> DataFrame:
    """payload.date of each message, under any name it was given in its topic partition."""
    names = field_aliases(profile_fields(messages, within={"", "payload."}), ["payload", "payload.date"])

    def found(text: str | None, part: int | None):
        m, of = parse_object(text), names.of(part)
        payload = m and next((m[k] for k in of["payload"] if k in m), None)
        if isinstance(payload, dict):
            yield "date", 0, next((payload[k] for k in of["payload.date"] if k in payload), None)

    return messages.select("record_id", "feed_id", "message", F.col("topic_partition").cast("int")).mapInArrow(lambda b: _rows(b, found), SCHEMA)


def dated_values(vulnerabilities: DataFrame, messages: DataFrame, feeds: DataFrame) -> DataFrame:
    """origin, record_key, field_name, item_no, utc_us: one row for each value that names a date.

    A row whose feed is null or unknown is read as UTC with days first. feeds is a table of a few rows and is
    broadcast; should a feed occur twice, its smallest zone and order count.
    """
    values = statement_dates(vulnerabilities).withColumn("origin", F.lit("vulnerabilities")).unionByName(message_dates(messages).withColumn("origin", F.lit("pom_messages")))
    zones = feeds.where("feed_id IS NOT NULL").groupBy("feed_id").agg(F.min("zone_id").alias("zone_id"), F.min("date_order").alias("date_order"))
    zoned = values.join(F.broadcast(zones), "feed_id", "left")
    return utc_micros(zoned, "value", "zone_id", "date_order").where("utc_us IS NOT NULL").select("origin", "record_key", "field_name", "item_no", "utc_us")
