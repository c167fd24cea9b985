"""Insert-or-update on plain tables: the new state of a table, given the old state and a batch.

Parquet has no MERGE; the new state is a full join of both sides by the conflict key, each column merged by its rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgloom.functions import json_ops
from pkgloom.operators.graph import renumber

Rule = Callable[[Column, Column], Column]
RULES: dict[str, Rule] = {
    "keep": lambda old, new: old,
    "concat": lambda old, new: json_ops.concat(old, new),
    "concat_null": lambda old, new: json_ops.concat(old, new, null_is_empty=True),
    "add": lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)),
}


def last_of_each(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in ``order``: a compact state per key, so that a hot key needs no sort of its rows."""
    rest = [c for c in batch.columns if c not in keys]
    packed = batch.groupBy(*keys).agg(F.max(F.struct(*order, *[F.col(c).alias(f"v_{c}") for c in rest])).alias("s"))
    return packed.select(*keys, *[F.col(f"s.v_{c}").alias(c) for c in rest])


def upsert(old: DataFrame, batch: DataFrame, keys: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """The rows of ``old`` and ``batch`` (one row per key each), merged on ``keys``.

    A column without a rule is overwritten by the batch's value. Null keys are values that meet each other.
    Columns that only the old table has are kept, null for new keys.
    """
    rules = rules or {}
    a, b = old.alias("a"), batch.alias("b")
    on = None
    for k in keys:
        e = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = e if on is None else on & e
    marked = a.withColumn("_old", F.lit(True)).alias("a").join(b.withColumn("_new", F.lit(True)).alias("b"), on, "full")
    has_old, has_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    out = [F.when(has_old, F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    for c in old.columns:
        if c in keys:
            continue
        if c not in batch.columns:
            out.append(F.col(f"a.{c}").alias(c))
            continue
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        merged = RULES[rules[c]](x, y) if c in rules else y
        out.append(F.when(has_old & has_new, merged).when(has_new, y).otherwise(x).alias(c))
    return marked.select(*out)


def get_or_create(dictionary: DataFrame, names: DataFrame, key: str = "name", id_col: str = "id") -> DataFrame:
    """(key, id) for every name: its stored id, or a new one above all stored ids, in name order. Null names have none."""
    wanted = names.select(key).where(F.col(key).isNotNull()).distinct()
    stored = dictionary.select(key, id_col)
    new = wanted.join(stored, key, "left_anti")
    top = dictionary.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    numbered = renumber(new.withColumnRenamed(key, "node")).join(F.broadcast(top)).select(F.col("node").alias(key), (F.col("number") + 1 + F.col("top")).alias(id_col))
    return wanted.join(stored, key).unionByName(numbered)


def append_new(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those of the batch whose key is new, each key once."""
    return stored.unionByName(batch.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def from_lists(batch: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows of parallel lists: one row per place. Lists of different length in a row are an error; a null list is empty."""
    sizes = F.array(*[F.greatest(F.size(c), F.lit(0)) for c in columns])
    even = F.array_max(sizes) == F.array_min(sizes)
    zipped = F.when(F.assert_true(even, F.lit("lists of different length: " + ", ".join(columns))).isNull(), F.arrays_zip(*columns))
    return batch.select(*(keep or []), F.inline(zipped))


def append_strict(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and the batch's; a key that the batch has twice, or that is stored already, is an error when the result is read."""
    marked = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    per = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("_new").alias("_any"), F.max(F.struct(*[c for c in stored.columns if c not in keys])).alias("_r") if len(stored.columns) > len(keys) else F.lit(None).alias("_r"))
    checked = per.where(F.assert_true((F.col("_n") == 1) | (F.col("_any") == 0), F.lit("a key is stored already")).isNull())
    return checked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in stored.columns])


def ids_in_order(dictionary: DataFrame, batch: DataFrame, place: str, key: str = "name", id_col: str = "id") -> DataFrame:
    """(place, key, id) of every row of the batch: the stored id of its key, or a new one; repeated keys share theirs."""
    return batch.select(place, key).join(get_or_create(dictionary, batch, key, id_col), key).select(place, key, id_col)
