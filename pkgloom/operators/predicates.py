"""A stack of filters in reverse Polish order over metadata and identifiers, compiled to one column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pkgloom.functions import json_ops


def full_match(x: Column, pattern: str) -> Column:
    """Whether the whole text matches; null is no match."""
    return F.coalesce(x.rlike(f"^(?:{pattern})$"), F.lit(False))


def metadata_contains(md: Column, key: str) -> Column:
    """The top-level key is present, null or not."""
    return json_ops.has_key(md, key)


def metadata_equals(md: Column, key: str, value: str) -> Column:
    return F.coalesce(json_ops.pointer(md, "/" + key.replace("~", "~0").replace("/", "~1")) == value, F.lit(False))


def metadata_matches(md: Column, key: str, pattern: str) -> Column:
    return full_match(json_ops.pointer(md, "/" + key.replace("~", "~0").replace("/", "~1")), pattern)


def pointer_matches(md: Column, pointer: str, pattern: str) -> Column:
    return full_match(json_ops.pointer(md, pointer), pattern)


class FilterStack:
    """push, and_, or_, not_, clear; what is left on the stack holds together, an empty stack lets all pass."""

    def __init__(self) -> None:
        self._stack: list[Column] = []

    def push(self, predicate: Column) -> FilterStack:
        self._stack.append(predicate)
        return self

    def _pop(self, n: int) -> list[Column]:
        if len(self._stack) < n:
            raise ValueError(f"{n} filters needed, {len(self._stack)} on the stack")
        out = self._stack[-n:]
        del self._stack[-n:]
        return out

    def and_(self) -> FilterStack:
        a, b = self._pop(2)
        return self.push(a & b)

    def or_(self) -> FilterStack:
        a, b = self._pop(2)
        return self.push(a | b)

    def not_(self) -> FilterStack:
        (a,) = self._pop(1)
        return self.push(~a)

    def clear(self) -> FilterStack:
        self._stack.clear()
        return self

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, self._stack, F.lit(True))
