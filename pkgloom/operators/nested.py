"""Deeply nested records into related flat tables that keep parent-child links.

The merged schema of all records is inferred first: every path with the JSON types seen there. It decides which paths
are child tables (those that are an array in any record). Then every record is taken apart once: each array level becomes
a child table whose rows carry their own surrogate key, that of their parent and their ordinal; a list directly in a list
is a level of its own, named with []; objects that are no arrays stay with the row they belong to. A chain of objects
that hold one another under the same key, as text or not, is one table with the depth as ordinal, with child tables of
its own.

In paths a dot, slash, colon, bracket or backslash of a key itself is written after a backslash, so that no two keys
meet. No value is lost: every plain value is in one row, every array element is one row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgloom.operators.dates_in_messages import as_list, unwrap
from pkgloom.operators.jsonio import kind, parse_object, parse_value

_SPECIAL = re.compile(r"[.\\/:\[\]]")
SCHEMA = "table_name string, record_key long, row_id string, parent_id string, parent_no int, child_no int, plain string, fields map<string,string>"
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())]
_NAMES = ["table_name", "record_key", "row_id", "parent_id", "parent_no", "child_no", "plain", "fields"]


def scalar_text(v) -> str | None:
    """Text of a plain value: whole numbers without a fraction, booleans as true and false; None for the rest."""
    if v is None or isinstance(v, (dict, list)):
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
        return str(int(v))
    return str(v)


def escaped(key: str) -> str:
    """A key as a step of a path; the empty key is a lone backslash."""
    return _SPECIAL.sub(r"\\\g<0>", key) or "\\"


def _plain_fields(obj: dict, arrays: set[str], table: str, prefix: str = "") -> list[tuple[str, str]]:
    """The plain values of an object and of the objects in it that are not behind an array."""
    out: list[tuple[str, str]] = []
    for k, v in obj.items():
        step = prefix + escaped(k)
        path = f"{table}.{step}" if table else step
        if path in arrays:
            continue
        if isinstance(v, dict):
            out += _plain_fields(v, arrays, table, step + ".")
        else:
            t = scalar_text(v)
            if t is not None:
                out.append((step, t))
    return out


def _elements(v, path: str, at: str, row_id: str, no: int, arrays: set[str]) -> Iterator[tuple]:
    """The rows of the array ``v`` (or of a bare element, its only one) and of what lies in it."""
    for i, x in enumerate(as_list(v)):
        if x is None:
            continue
        own = f"{row_id}/{at}:{i}"
        yield path, own, row_id, no, i, scalar_text(x), _plain_fields(x, arrays, path) if isinstance(x, dict) else None
        if isinstance(x, dict):
            yield from _take_apart(x, path, own, i, arrays)
        elif isinstance(x, list):
            yield from _elements(x, path + "[]", "[]", own, i, arrays)


def _take_apart(obj: dict, table: str, row_id: str, no: int, arrays: set[str], within: str = "") -> Iterator[tuple]:
    """Child rows of every array inside ``obj``; a bare element under a name that is an array elsewhere is its only one."""
    for k, v in obj.items():
        step = within + escaped(k)
        path = f"{table}.{step}" if table else step
        if path in arrays:
            yield from _elements(v, path, step, row_id, no, arrays)
        elif isinstance(v, dict):
            yield from _take_apart(v, table, row_id, no, arrays, step + ".")


def _stages(text: str | None, key: str) -> Iterator[tuple[int, dict]]:
    """(depth, envelope) along a chain of envelopes; an inner one may be passed on as text."""
    v, depth = parse_object(text), 0
    while isinstance(v, dict):
        yield depth, v
        v, depth = v.get(key), depth + 1
        while isinstance(v, str):  # text may hold text; each step is shorter
            v = parse_value(v)


def _mapped(df: DataFrame, key: str, text: str, rows: Callable[[int, str | None], Iterator[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(keys), 1000):
                cols: list[list] = [[] for _ in _TYPES]
                for k, t in zip(keys[at : at + 1000], texts[at : at + 1000]):
                    for row in rows(k, t):
                        for c, x in zip(cols, row):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)


def _note(v, path: str, seen: dict[tuple[str, str], int]) -> None:
    """Counts the JSON types under each path; array elements count under the array's path with []."""
    t = kind(v) or "null"
    seen[path, t] = seen.get((path, t), 0) + 1
    if t == "object":
        base = path[:-2] if path.endswith("[]") else path
        for k, x in v.items():
            _note(x, f"{base}.{escaped(k)}" if base else escaped(k), seen)
    elif t == "array":
        for x in v:
            _note(x, path + "[]", seen)


def merged_schema(df: DataFrame, text: str, parts: Callable[[str | None], Iterator] | None = None) -> DataFrame:
    """(path, type, n): every path of the JSON records in ``text``, the types it has, and how often.

    parts: the objects of a record to look at (by default its statements).
    """
    parts = parts or statements

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], int] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for obj in parts(t):
                    _note(obj, "", seen)
        keys = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["path", "type", "n"])

    rows = df.select(F.col(text).cast("string")).mapInArrow(run, "path string, type string, n long")
    return rows.where("path <> ''").groupBy("path", "type").agg(F.sum("n").alias("n"))


def array_paths(schema: DataFrame) -> set[str]:
    """The paths of the merged schema that are an array in any record: its child tables."""
    return {r[0] for r in schema.where("type = 'array'").select("path").distinct().collect()}


def statements(text: str | None) -> list[dict]:
    """The objects of a record: itself, or those of the list it is."""
    return unwrap(parse_value(text))


def flatten(df: DataFrame, key: str, text: str, only: set[str] | None = None) -> DataFrame:
    """The child tables of the JSON records in ``text``, as rows of SCHEMA; table '' holds the records themselves.

    only: the tables wanted (None: all).

    Records that are no object or list of objects have no rows; of a list of several objects each is a record with its
    place in child_no and in its row_id. Null elements have no row but keep their place.
    """
    arrays = array_paths(merged_schema(df, text))

    def rows(k: int, t: str | None) -> Iterator[tuple]:
        if k is None:
            return
        found = statements(t)
        for i, s in enumerate(found):
            own = str(k) if len(found) == 1 else f"{k}#{i}"
            if only is None or "" in only:
                yield "", k, own, None, None, i, None, _plain_fields(s, arrays, "")
            for path, row, parent, parent_no, no, plain, fields in _take_apart(s, "", own, i, arrays):
                if only is None or path in only:
                    yield path, k, row, parent, parent_no, no, plain, fields

    return _mapped(df, key, text, rows)


def flatten_chain(df: DataFrame, key: str, text: str, inner: str = "input", whole: bool = False) -> DataFrame:
    """One table ``inner`` of the nested envelopes, child_no the number of steps inwards, parent_no one less.

    whole: with the child tables of the arrays in the envelopes, named ``inner`` and their path. An ``inner`` that holds no
    envelope is a field of the one that has it.
    """

    def parts(t: str | None) -> Iterator[tuple[int, dict]]:
        chain = list(_stages(t, inner))
        for depth, envelope in chain:
            last = depth == len(chain) - 1
            yield depth, envelope if last else {a: b for a, b in envelope.items() if a != inner}

    arrays = {f"{inner}.{p}" for p in array_paths(merged_schema(df, text, lambda t: (e for _, e in parts(t))))} if whole else set()

    def rows(k: int, t: str | None) -> Iterator[tuple]:
        if k is None:
            return
        own = str(k)
        for depth, envelope in parts(t):
            parent, own = own, f"{own}/{inner}:{depth}"
            yield inner, k, own, parent if depth else None, depth - 1, depth, None, _plain_fields(envelope, arrays, inner)
            for path, row, above, above_no, no, plain, fields in _take_apart(envelope, inner, own, depth, arrays) if arrays else ():
                yield path, k, row, above, above_no, no, plain, fields

    return _mapped(df, key, text, rows)


def first_payload_with(df: DataFrame, key: str, text: str, wanted: str, inner: str = "input") -> DataFrame:
    """(key, payload) of every record: JSON of the outermost ``payload`` along its chain that has ``wanted`` and no null there; null if none has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                payloads = (e.get("payload") for _, e in _stages(t, inner))
                hit = next((p for p in payloads if isinstance(p, dict) and p.get(wanted) is not None), None)
                out.append(None if hit is None else json.dumps(hit, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "payload"])

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "key long, payload string")


def stages_and_lines(callables: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """child_kind, record_key, parent_no, child_no, label, detail: envelopes with a plugin name, and changed lines."""
    chain = flatten_chain(callables, "record_id", "message")
    stages = chain.select(
        F.lit("stage").alias("child_kind"), "record_key", "parent_no", "child_no", F.col("fields")["plugin_name"].alias("label"), F.coalesce(F.col("fields")["payload.dir"], F.lit("")).alias("detail")
    ).where("label <> ''")
    flat = flatten(vulnerabilities, "id", "statement", {"patches", "patches.new_changed_line_numbers"})
    patches = flat.where("table_name = 'patches'").select(F.col("row_id").alias("patch_row"), F.col("fields")["filename"].alias("label"))
    lines = flat.where("table_name <> 'patches' AND plain IS NOT NULL").join(patches, F.col("parent_id") == F.col("patch_row"), "left")
    lines = lines.select(F.lit("line").alias("child_kind"), "record_key", "parent_no", "child_no", F.coalesce("label", F.lit("")).alias("label"), F.col("plain").alias("detail"))
    return stages.unionByName(lines)
