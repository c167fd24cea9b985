"""JSON text shared by the message operators: strict parsing and value-exact canonical form."""

from __future__ import annotations

import json
from decimal import Decimal, InvalidOperation

TYPES = ("string", "number", "boolean", "object", "array")
BIT = {t: 1 << i for i, t in enumerate(TYPES)}


def kind(v) -> str | None:
    """JSON type of a parsed value; None for null."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, str):
        return "string"
    if isinstance(v, dict):
        return "object"
    if isinstance(v, list):
        return "array"
    return "number"


def _no_constant(name: str):
    raise ValueError(name)


_plain = json.JSONDecoder(parse_constant=_no_constant)


class _Num(str):
    """A number kept as its written text."""

    __slots__ = ()


_exact = json.JSONDecoder(parse_constant=_no_constant, parse_int=_Num, parse_float=_Num)


def _decode(decoder: json.JSONDecoder, text: str | None) -> dict | None:
    if not text:
        return None
    try:
        v = decoder.decode(text)
    except (ValueError, RecursionError):
        return None
    return v if type(v) is dict else None


def parse_object(text: str | None) -> dict | None:
    """The JSON object in ``text``, or None for null, empty, broken or non-object text."""
    return _decode(_plain, text)


def parse_value(text: str | None):
    """Any JSON value in ``text``; None for null, empty or broken text."""
    if not text:
        return None
    try:
        return _plain.decode(text)
    except (ValueError, RecursionError):
        return None


def parse_exact(text: str | None) -> dict | None:
    """As parse_object, but numbers keep their written digits."""
    return _decode(_exact, text)


def canonical_number(text: str) -> str:
    """One spelling for each numeric value: 1, 1.0, 10e-1 and 1E0 are equal; -0 is 0."""
    if text.isdigit():
        core = text.rstrip("0")
        if not core:
            return "0"
        return text if len(core) == len(text) else f"{core}e{len(text) - len(core)}"
    try:
        d = Decimal(text)
    except InvalidOperation:
        return text
    if not d:
        return "0"
    sign, digits, exp = d.as_tuple()
    while digits[-1] == 0:  # without a context, so that no digit is rounded off
        digits, exp = digits[:-1], exp + 1
    return f"{'-' * sign}{''.join(map(str, digits))}e{exp}" if exp else f"{'-' * sign}{''.join(map(str, digits))}"


def canonical(v, out: list[str]) -> None:
    """Append to ``out`` a text that two values of parse_exact share exactly when they are equal as JSON values."""
    if v is None:
        out.append("n")
    elif v is True:
        out.append("t")
    elif v is False:
        out.append("f")
    elif type(v) is _Num:
        out.append("#" + canonical_number(v))
    elif type(v) is str:
        out.append(f"s{len(v)}:")
        out.append(v)
    elif type(v) is dict:
        out.append("{")
        for k in sorted(v):
            out.append(f"{len(k)}:{k}")
            canonical(v[k], out)
        out.append("}")
    else:
        out.append("[")
        for x in v:
            canonical(x, out)
        out.append("]")
