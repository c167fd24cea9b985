"""Messages delivered more than once: one copy of each, whole tables and batch by batch.

Two messages are the same if the identifying values are equal as JSON values, however they are written. Each
message is reduced to a 128-bit digest of their canonical form in one Arrow pass, so payloads never shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgloom.operators.drift import field_aliases, profile_fields
from pkgloom.operators.jsonio import canonical, parse_exact
from pkgloom.session import cut

IDENTITY = ("plugin_name", "created_at", "consumed_at", "payload")


def message_digest(text: str | None, names: list[list[str]]) -> bytes | None:
    """Digest of the identifying values of a message; None for text that is no JSON object.

    names: for each value the keys it may stand under. A missing key counts as null.
    """
    m = parse_exact(text)
    if m is None:
        return None
    parts: list[str] = []
    for keys in names:
        canonical(next((m[k] for k in keys if k in m), None), parts)
        parts.append("\n")
    return blake2b("".join(parts).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def with_digest(messages: DataFrame, order: str = "record_id", message: str = "message", identity: tuple[str, ...] = IDENTITY, part: str = "topic_partition", carry: str | None = None) -> DataFrame:
    """(ord, digest) of every message that is a JSON object, and a text column ``carry``; renamed keys are found by field_aliases."""
    aliases = field_aliases(profile_fields(messages, part, message, within={""}), list(identity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int | None, list[list[str]]] = {}
        for batch in batches:
            parts = batch.column(2).to_pylist()
            for p in set(parts) - names.keys():
                names[p] = [aliases.of(p)[k] for k in identity]
            digests = [message_digest(t, names[p]) for t, p in zip(batch.column(1).to_pylist(), parts)]
            keep = pa.array([d is not None for d in digests])
            columns = {"ord": batch.column(0), "digest": pa.array(digests, pa.binary())} | ({carry: batch.column(3)} if carry else {})
            yield pa.RecordBatch.from_pydict(columns).filter(keep)

    wanted = [F.col(order).cast("long").alias("ord"), F.col(message).cast("string").alias("m"), F.col(part).cast("int").alias("p")] + ([F.col(carry).cast("string")] if carry else [])
    return messages.select(*wanted).mapInArrow(run, "ord long, digest binary" + (f", `{carry}` string" if carry else ""))


def repeated(digests: DataFrame) -> DataFrame:
    """(ord) of the rows whose digest already stands in a row with a smaller ord.

    The first of each digest comes from an aggregation that combines on the map side, and the rest by an
    anti-join on the row's own order, which is unique: no task ever holds a whole group of copies.
    Rows that share both digest and ord are one delivery; none of them is a repetition of the other.
    """
    stored = cut(digests.where("ord IS NOT NULL"))
    firsts = stored.groupBy("digest").agg(F.min("ord").alias("ord")).select("ord")
    return stored.select("ord").join(firsts, "ord", "left_anti").select("ord")


def keep_first(digests: DataFrame) -> DataFrame:
    """(digest, ord): exactly one row for each message, the earliest."""
    return digests.groupBy("digest").agg(F.min("ord").alias("ord"))


def new_messages(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """(digest, ord) of the messages of a new batch that are not stored yet, each once."""
    return keep_first(batch).join(stored.select("digest"), "digest", "left_anti")
