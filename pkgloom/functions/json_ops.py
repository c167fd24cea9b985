"""Operations on JSON texts as columns; numbers and nested values pass through unchanged as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_map(json: Column | str) -> Column:
    """map<string,variant> of a JSON object; null for null or broken text."""
    return F.try_parse_json(_c(json)).try_cast("map<string,variant>")


def concat(a: Column | str, b: Column | str, null_is_empty: bool = False) -> Column:
    """Shallow a || b, the right side winning. A null side gives null, or counts as {} if null_is_empty."""
    x, y = as_map(a), as_map(b)
    if null_is_empty:
        empty = F.lit("{}")
        x, y = F.coalesce(x, as_map(empty)), F.coalesce(y, as_map(empty))
    keys = F.map_keys(y)
    kept = F.map_filter(x, lambda k, _: ~F.array_contains(keys, k))
    return F.to_json(F.map_concat(kept, y))


def without_key(json: Column | str, key: Column | str) -> Column:
    return F.to_json(F.map_filter(as_map(json), lambda k, _: k != key))


def only_keys(json: Column | str, keys: list[str]) -> Column:
    return F.to_json(F.map_filter(as_map(json), lambda k, _: k.isin(keys)))


def put_nested(json: Column | str, outer: str, key: Column, value: Column) -> Column:
    """json with outer.key = value (a JSON text), other keys of ``outer`` kept; null counts as {}."""
    base = F.coalesce(_c(json), F.lit("{}"))
    inner = F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(base), f"$.{outer}", "variant")), F.lit("{}"))
    one = F.to_json(F.create_map(key, F.parse_json(value)))
    return concat(base, F.to_json(F.create_map(F.lit(outer), F.parse_json(concat(inner, one)))))


def pointer(json: Column | str, pointer_text: str, as_type: str = "string") -> Column:
    """The value at an RFC 6901 pointer, null where there is none."""
    path = "$"
    for step in pointer_text.split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        path += f"[{step}]" if step.isdigit() else f"['{step}']"
    return F.try_variant_get(F.try_parse_json(_c(json)), path, as_type)


def has_key(json: Column | str, key: str) -> Column:
    """Whether the object has the key, null or not; false for no object."""
    return F.coalesce(F.array_contains(F.map_keys(as_map(json)), key), F.lit(False))
