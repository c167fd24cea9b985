"""Call-graph records (JSON of three languages) into tables of modules, callables and edges.

Objects keyed by data (types, ids, files) are read as maps and exploded, so the schema does not depend on the records.
Every function takes rows (graph, json) and leaves out records that are null, broken or have no such part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgloom.operators.stitching import call_type, receiver_types

_METHOD = "struct<uri:string,metadata:string,files:array<string>>"
_METHODS = f"struct<methods:map<string,{_METHOD}>>"
_TYPE = f"struct<access:string,`final`:boolean,superClasses:array<string>,superInterfaces:array<string>,sourceFile:string,methods:map<string,{_METHOD}>>"
_HEAD = "forge:string,product:string,version:string,generator:string,timestamp:bigint"
JAVA = f"struct<{_HEAD},cha:struct<internalTypes:map<string,{_TYPE}>,externalTypes:map<string,{_TYPE}>,resolvedTypes:map<string,{_TYPE}>>,`call-sites`:array<array<string>>>"
_CALLS = "graph:struct<internalCalls:array<array<string>>,externalCalls:array<array<string>>,resolvedCalls:array<array<string>>>"
C = f"struct<{_HEAD},architecture:string,functions:struct<internal:struct<binaries:map<string,{_METHODS}>,static_functions:{_METHODS}>,`external`:struct<products:map<string,{_METHODS}>,static_functions:map<string,{_METHODS}>,undefined:{_METHODS}>>,{_CALLS}>"
_MODULE = "struct<sourceFile:string,namespaces:map<string,struct<namespace:string,metadata:string>>>"
PYTHON = f"struct<{_HEAD},modules:map<string,map<string,{_MODULE}>>,{_CALLS}>"

CALLABLE_COLUMNS = ("graph", "scope", "module", "local_id", "uri", "line_start", "line_end", "defined", "access")


def parsed(records: DataFrame, form: str) -> DataFrame:
    """(graph, r) of (graph, json)."""
    return records.select("graph", F.from_json("json", form).alias("r")).where("r IS NOT NULL")


def heads(records: DataFrame, form: str) -> DataFrame:
    """(graph, forge, product, version, generator, timestamp): -1 where a record has no timestamp."""
    r = parsed(records, form)
    return r.select("graph", *[F.col(f"r.{k}").alias(k) for k in ("forge", "product", "version", "generator")], F.coalesce("r.timestamp", F.lit(-1)).alias("timestamp"))


def _callable(rows: DataFrame, scope: Column, module: Column, local_id: Column, uri: Column, metadata: Column) -> DataFrame:
    """Callables with their metadata peeled; line numbers may be texts, a missing 'defined' is false."""
    md = F.try_parse_json(metadata)
    get = lambda k, t: F.try_variant_get(md, f"$.{k}", t)
    return rows.select("graph", scope.alias("scope"), module.alias("module"), local_id.cast("long").alias("local_id"), uri.alias("uri"), get("first", "string").try_cast("int").alias("line_start"), get("last", "string").try_cast("int").alias("line_end"), F.coalesce(get("defined", "boolean"), F.lit(False)).alias("defined"), get("access", "string").alias("access"))


def java_modules(records: DataFrame) -> DataFrame:
    """(graph, scope, module, access, final, source_file, supers): types with their supers, classes before interfaces."""
    r, out = parsed(records, JAVA), []
    for scope in ("internal", "external", "resolved"):
        t = r.select("graph", F.explode(f"r.cha.{scope}Types").alias("module", "t"))
        none = F.array().cast("array<string>")
        out.append(t.select("graph", F.lit(scope).alias("scope"), "module", "t.access", "t.final", F.col("t.sourceFile").alias("source_file"), F.concat(F.coalesce("t.superClasses", none), F.coalesce("t.superInterfaces", none)).alias("supers")))
    return reduce(DataFrame.unionByName, out)


def java_callables(records: DataFrame) -> DataFrame:
    """CALLABLE_COLUMNS of the methods of all types."""
    r, out = parsed(records, JAVA), []
    for scope in ("internal", "external", "resolved"):
        t = r.select("graph", F.explode(f"r.cha.{scope}Types").alias("module", "t")).select("graph", "module", F.explode("t.methods").alias("id", "m"))
        out.append(_callable(t, F.lit(scope), F.col("module"), F.col("id"), F.col("m.uri"), F.col("m.metadata")))
    return reduce(DataFrame.unionByName, out)


def java_edges(records: DataFrame) -> DataFrame:
    """(graph, source, target, receivers): one row per pair, the records of all its program counters together, in order."""
    r = parsed(records, JAVA).select("graph", F.explode("r.`call-sites`").alias("c"))
    sites = r.select("graph", F.col("c")[0].try_cast("long").alias("source"), F.col("c")[1].try_cast("long").alias("target"), F.from_json(F.coalesce(F.try_element_at("c", F.lit(3)), F.lit("{}")), "map<string,struct<line:int,type:string,receiver:string>>").alias("m"))
    flat = sites.select("graph", "source", "target", F.explode_outer("m").alias("pc", "s"))
    one = F.when(F.col("s").isNotNull(), F.struct(F.col("s.line").alias("line"), call_type(F.col("s.type")).alias("call_type"), receiver_types(F.col("s.receiver")).alias("types")))
    return flat.groupBy("graph", "source", "target").agg(F.sort_array(F.collect_list(one)).alias("receivers"))


def c_callables(records: DataFrame) -> DataFrame:
    """CALLABLE_COLUMNS of a C graph; the module of a function is its first file, of a binary's or product's its name where it has no file."""
    r, out = parsed(records, C), []
    for scope, kind in (("internal", "binaries"), ("external", "products"), ("external", "static_functions")):
        t = r.select("graph", F.explode(f"r.functions.{scope}.{kind}").alias("owner", "f")).select("graph", "owner", F.explode("f.methods").alias("id", "m"))
        out.append((scope, t))
    for scope, kind in (("internal", "static_functions"), ("external", "undefined")):
        out.append((scope, r.select("graph", F.lit(kind).alias("owner"), F.explode(f"r.functions.{scope}.{kind}.methods").alias("id", "m"))))
    module = F.concat(F.coalesce(F.try_element_at("m.files", F.lit(1)), F.col("owner")), F.lit("_module"))
    return reduce(DataFrame.unionByName, [_callable(t, F.lit(s), module, F.col("id"), F.col("m.uri"), F.col("m.metadata")) for s, t in out])


def python_callables(records: DataFrame) -> DataFrame:
    """CALLABLE_COLUMNS of a Python graph: every namespace; those ending in () are functions."""
    r = parsed(records, PYTHON).select("graph", F.explode("r.modules").alias("scope", "ms")).select("graph", "scope", F.explode("ms").alias("module", "m")).select("graph", "scope", "module", F.explode("m.namespaces").alias("id", "n"))
    return _callable(r, F.col("scope"), F.col("module"), F.col("id"), F.col("n.namespace"), F.col("n.metadata"))


def plain_edges(records: DataFrame, form: str) -> DataFrame:
    """(graph, scope, source, target) of the internal, external and resolved calls of a C or Python graph."""
    r, out = parsed(records, form), []
    for scope in ("internal", "external", "resolved"):
        e = r.select("graph", F.explode(f"r.graph.{scope}Calls").alias("c"))
        out.append(e.select("graph", F.lit(scope).alias("scope"), F.col("c")[0].try_cast("long").alias("source"), F.col("c")[1].try_cast("long").alias("target")))
    return reduce(DataFrame.unionByName, out).distinct()
