"""Counts over Java source text: functions, unit tests and tests with mocks, comments left out.

The patterns are those of the reference's repository analyzer, which reads Java only and takes what its function
pattern finds, calls after two spaces included.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

BLOCK_COMMENT = r"/\*([\S\s]+?)\*/"
FUNCTION = r"(public|protected|private|static|\s) +[\w<>\[\]]+\s+(\w+) *\([^)]*\) *(\{?|[^;])"
TYPE = r"(?<![\w$.])(class|interface|enum|record)\s+[A-Za-z_$][\w$]*\s*(<[^{;]*>\s*)?(\([^){;]*\)\s*)?((extends|implements|permits)\s[^{;]*)?\{"
MOCK_IMPORT = "import[^;]*Mock.*;"
MOCK = r"\.mock\(|\.when\(|\.spy\(|\.doNothing\(|replayAll\(\)|verifyAll\(\)|\.createMock\(|@Mocked|new Expectations\(\)"
_TEST = re.compile(r"@Test(\([^\n\r\u0085\u2028\u2029]*\))?[^a-zA-Z0-9]")
_BRACE = re.compile("[{}]")


def bodies(text: str) -> list[str]:
    """The unit tests of a text without comments, each from its annotation to the brace that closes its method."""
    starts = [m.start() for m in _TEST.finditer(text)]
    out = []
    for start, end in zip(starts, [*starts[1:], len(text)]):
        depth, at = 0, start
        for m in _BRACE.finditer(text, start, end):
            depth, at = depth + (1 if m[0] == "{" else -1), m.end()
            if depth == 0:
                break
        out.append(text[start:at])
    return out


@F.arrow_udf(returnType=ArrayType(StringType()))
def _bodies(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else bodies(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, BLOCK_COMMENT, ""), "//.*", "")


def declares_type(code: Column) -> Column:
    return F.coalesce(code.rlike(TYPE), F.lit(False))


def function_count(code: Column) -> Column:
    return F.regexp_count(code, F.lit(FUNCTION)).cast("long")


def unit_tests(code: Column) -> Column:
    """Texts without the annotation are not sent to Python."""
    return F.coalesce(_bodies(F.when(code.contains("@Test"), code)), F.array().cast("array<string>"))


def imports_mock(text: Column) -> Column:
    return F.coalesce(F.split(text, "class", 2)[0].rlike(MOCK_IMPORT), F.lit(False))


def with_mock(tests: Column) -> Column:
    return F.filter(tests, lambda t: t.rlike(MOCK))
