"""A few keys holding most records: per-key results by eager aggregation through joins.

Joining two detail tables on a hot key multiplies its rows before they are summed. Instead both inputs are
pre-aggregated by the key (with map-side combine, so a hot key leaves one compact state per task), the states
are joined one to one, and counts and sums of the join are computed algebraically from the states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact(df: DataFrame, key: str, prefix: str, sums: tuple[str, ...] = (), low: tuple[str, ...] = (), high: tuple[str, ...] = ()) -> DataFrame:
    """One state per key: {prefix}_rows and, for the columns named, non-null counts with sums, minima, maxima."""
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_rows")]
    aggs += [F.sum(c).alias(f"{prefix}_sum_{c}") for c in sums] + [F.count(c).alias(f"{prefix}_n_{c}") for c in sums]
    aggs += [F.min(c).alias(f"{prefix}_min_{c}") for c in low] + [F.max(c).alias(f"{prefix}_max_{c}") for c in high]
    return df.groupBy(F.col(key).alias("key")).agg(*aggs)


def eager_join(left: DataFrame, right: DataFrame, how: str = "full") -> DataFrame:
    """The states of two inputs side by side, with pairs = rows of the inner join of their details.

    Null keys meet nothing, as in SQL: their states stay apart and have no pairs.
    """
    joined = left.withColumnRenamed("key", "lk").join(right.withColumnRenamed("key", "rk"), F.col("lk") == F.col("rk"), how)
    l_rows = next(c for c in left.columns if c.endswith("_rows"))
    r_rows = next(c for c in right.columns if c.endswith("_rows"))
    return joined.withColumn("key", F.coalesce("lk", "rk")).withColumn("pairs", F.coalesce(F.col(l_rows) * F.col(r_rows), F.lit(0))).drop("lk", "rk")


def joined_sum(side_sum: Column, other_rows: Column) -> Column:
    """Sum of a left column over the join: its pre-aggregated sum times the matching rows of the other side."""
    return side_sum * F.coalesce(other_rows, F.lit(0))


def heavy_keys(states: DataFrame, rows: str, share: float) -> DataFrame:
    """The states of the keys that hold more than ``share`` of all rows; the total comes from the states, null key included."""
    total = states.agg(F.sum(rows).alias("total_rows"))
    return states.join(F.broadcast(total), F.col(rows) > F.lit(share) * F.col("total_rows"), "inner").where(F.col("key").isNotNull())
