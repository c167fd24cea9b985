"""Call-graph stitching: calls through receiver types resolved over the class hierarchy of all packages.

types: (type, parent, idx), idx the place of the parent among the type's supers (classes before interfaces).
dictionary: (type, signature, gid), the methods a type defines. calls: (source, external, call_type, receiver,
signature). All are tables; the closure of the hierarchy is the only loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgloom.operators.graph import renumber
from pkgloom.session import Scratch

LAST = "/java.lang/Object"
# Byte-code instructions and the kind of call they make.
CALL_TYPES = {"invokevirtual": "VIRTUAL", "invokeinterface": "INTERFACE", "invokestatic": "STATIC", "invokespecial": "SPECIAL", "invokedynamic": "DYNAMIC"}


def call_type(instruction: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CALL_TYPES.items() for x in kv]), F.lower(instruction))


def receiver_types(text: Column) -> Column:
    """The types of a receiver text '[a,b]'."""
    inner = F.regexp_replace(text, r"[\[\]\s]", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))


def ancestors(types: DataFrame) -> DataFrame:
    """(type, ancestor, place): all ancestors, place ordering them as a walk that lists a type's own parents first,
    then what the first parent's walk lists, then the second's. A type met twice has its first place; a cyclic
    hierarchy ends where a path meets a type again. The root of all types comes last.

    Each round carries only the pairs whose best place got better, one row for each type and ancestor.
    """
    scratch = Scratch(types.sparkSession)
    links, _ = scratch.write(types.where("parent IS NOT NULL AND parent <> type").groupBy("type", "parent").agg(F.min(F.lpad(F.col("idx").cast("string"), 6, "0")).alias("i")))
    path = F.array("type", "parent").alias("path")
    best, at = scratch.write(links.select("type", F.col("parent").alias("ancestor"), F.concat(F.lit("0"), "i").alias("place"), path))
    better, left = best, 1
    while left:
        on = links.withColumnRenamed("type", "child").join(better, F.col("parent") == F.col("type")).where(~F.array_contains("path", F.col("child")))
        found = on.select(F.col("child").alias("type"), "ancestor", F.concat(F.lit("1"), "i", "place").alias("place"), F.concat(F.array("child"), "path").alias("path"))
        first = found.groupBy("type", "ancestor").agg(F.min(F.struct("place", "path")).alias("f")).select("type", "ancestor", "f.*")
        old = best.select("type", "ancestor", F.col("place").alias("known"))
        better, at_better, left = scratch.counted(first.join(old, ["type", "ancestor"], "left").where("known IS NULL OR place < known").select("type", "ancestor", "place", "path"))
        if left:
            after, at_after = scratch.write(best.join(better.select("type", "ancestor"), ["type", "ancestor"], "left_anti").unionByName(better))
            scratch.drop(at)
            best, at = after, at_after
    return best.select("type", "ancestor", F.when(F.col("ancestor") == LAST, F.lit("z")).otherwise(F.col("place")).alias("place"))


def dispatch(calls: DataFrame, dictionary: DataFrame, above: DataFrame) -> DataFrame:
    """(source, external, receiver, signature, target, stage) of every call that resolves.

    Virtual and interface calls go to the receiver itself, else to the first ancestor that defines the signature, else
    to all descendants that do. Static and special calls go to the exact type. Dynamic calls resolve to nothing.
    Distinct (receiver, signature) pairs are resolved once, however many calls share them.
    """
    asked = calls.where("call_type IN ('VIRTUAL', 'INTERFACE', 'STATIC', 'SPECIAL')").select("receiver", "signature", F.col("call_type").isin("VIRTUAL", "INTERFACE").alias("walks")).distinct()
    d = dictionary.select(F.col("type").alias("t"), F.col("signature").alias("sig"), "gid")
    own = asked.join(d, (F.col("t") == F.col("receiver")) & (F.col("sig") == F.col("signature"))).select("receiver", "signature", "walks", F.col("gid").alias("target"), F.lit(1).alias("stage"))
    open1 = asked.where("walks").join(own.select("receiver", "signature").distinct(), ["receiver", "signature"], "left_anti")
    up = open1.join(above, F.col("type") == F.col("receiver")).join(d, (F.col("t") == F.col("ancestor")) & (F.col("sig") == F.col("signature")))
    inherited = up.groupBy("receiver", "signature", "walks").agg(F.min(F.struct("place", "gid")).alias("b")).select("receiver", "signature", "walks", F.col("b.gid").alias("target"), F.lit(2).alias("stage"))
    open2 = open1.join(inherited.select("receiver", "signature"), ["receiver", "signature"], "left_anti")
    below = open2.join(above.select(F.col("type").alias("child"), F.col("ancestor").alias("receiver")), "receiver").join(d, (F.col("t") == F.col("child")) & (F.col("sig") == F.col("signature")))
    overridden = below.select("receiver", "signature", "walks", F.col("gid").alias("target"), F.lit(3).alias("stage")).distinct()
    resolved = own.unionByName(inherited).unionByName(overridden)
    c = calls.withColumn("walks", F.col("call_type").isin("VIRTUAL", "INTERFACE")).where("call_type <> 'DYNAMIC'")
    return c.join(resolved, ["receiver", "signature", "walks"]).select("source", "external", "receiver", "signature", "target", "stage")


def merged_edges(resolved: DataFrame) -> DataFrame:
    """(src, dst) without repetition; a call whose source is external is a callback and points the other way."""
    turn = F.col("external")
    return resolved.select(F.when(turn, F.col("target")).otherwise(F.col("source")).alias("src"), F.when(turn, F.col("source")).otherwise(F.col("target")).alias("dst")).distinct()


def unresolved(calls: DataFrame, resolved: DataFrame) -> DataFrame:
    """(receiver, signature, gid): external nodes with negative ids for what no type defines."""
    asked = calls.where("call_type <> 'DYNAMIC'").select("receiver", "signature").distinct()
    missing = asked.join(resolved.select("receiver", "signature").distinct(), ["receiver", "signature"], "left_anti")
    numbered = renumber(missing.select(F.struct("receiver", "signature").alias("node")))
    return numbered.select("node.receiver", "node.signature", (-F.col("number") - 1).alias("gid"))


def combine_origins(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """(src, dst, origin): all static calls, and the dynamic ones whose ends both occur among the static calls."""
    known = static.select(F.explode(F.array("src", "dst")).alias("n")).distinct()
    inside = dynamic.select("src", "dst").distinct().join(known.withColumnRenamed("n", "src"), "src", "left_semi").join(known.withColumnRenamed("n", "dst"), "dst", "left_semi")
    j = static.select("src", "dst").distinct().withColumn("s", F.lit(True)).join(inside.withColumn("d", F.lit(True)), ["src", "dst"], "full")
    origin = F.when(F.col("s").isNotNull() & F.col("d").isNotNull(), "staticAndDynamic").when(F.col("s").isNotNull(), "static").otherwise("dynamic")
    return j.select("src", "dst", origin.alias("origin"))
