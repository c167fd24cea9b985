"""Maven versions and version constraints as columns.

A version becomes a text key whose byte order is the version order, so that ranges are ordinary comparisons, joins and
sorts on strings stay in generated code, and the latest version is a max.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Qualifiers in their order; all other words stand between 'sp' and the numbers.
QUALIFIERS = {"alpha": "A", "beta": "B", "milestone": "C", "rc": "D", "cr": "D", "snapshot": "E", "": "F", "ga": "F", "final": "F", "release": "F", "sp": "G"}
SHORT = {"a": "alpha", "b": "beta", "m": "milestone"}  # before a digit only
RELEASE = "F"


def version_key(version: Column | str) -> Column:
    """Order-preserving key: equal for equal versions (1, 1.0, 1-ga), null for null, and 'F' for an empty version."""
    v = F.lower(F.trim(F.col(version) if isinstance(version, str) else version))
    tokens = F.regexp_extract_all(v, F.lit(r"((?:^|[.\-_+])?(?:[0-9]+|[a-z]+))"), F.lit(1))
    words = F.create_map(*[F.lit(x) for kv in QUALIFIERS.items() for x in kv])
    shorts = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])

    def code(t: Column, i: Column) -> Column:
        body = F.regexp_replace(t, r"^[.\-_+]", "")
        dotted = F.startswith(t, F.lit(".")) | (i == 0)
        digits = F.regexp_replace(body, "^0+", "")
        number = F.concat(F.when(dotted, "J").otherwise("I"), F.lpad(F.length(digits).cast("string"), 2, "0"), digits)
        following = F.try_element_at(tokens, i + 2)
        word = F.when(following.rlike("^[0-9]"), F.coalesce(F.try_element_at(shorts, body), body)).otherwise(body)
        text = F.coalesce(F.try_element_at(words, word), F.concat(F.lit("H"), word, F.lit("!")))
        return F.concat(F.when(dotted, "").otherwise("|"), F.when(body.rlike("^[0-9]"), number).otherwise(text))

    joined = F.array_join(F.transform(tokens, code), "")
    trimmed = F.regexp_replace(F.regexp_replace(joined, r"(?:\|?(?:J00|I00|F))+(?=\||$)", ""), r"\|", "")
    return F.when(v.isNotNull(), F.concat(trimmed, F.lit(RELEASE)))


def constraint(spec: Column) -> dict[str, Column]:
    """Parts of one constraint: bracketed, lower and upper text ('' for none), whether the ends count."""
    s = F.regexp_replace(spec, r"\s", "")
    inner = F.regexp_replace(s, r"[\[\]()]", "")
    comma = F.contains(s, F.lit(","))
    return {
        "bracketed": s.rlike(r"^[\[(]"),
        "lower": F.when(comma, F.split_part(inner, F.lit(","), F.lit(1))).otherwise(inner),
        "upper": F.when(comma, F.split_part(inner, F.lit(","), F.lit(2))).otherwise(inner),
        "lower_in": s.startswith("["),
        "upper_in": s.endswith("]"),
    }


def split_constraints(spec: Column) -> Column:
    """Array of constraints of a text: null is '*', a text that begins with '$' is one, brackets are kept whole."""
    many = F.regexp_extract_all(F.regexp_replace(spec, r"\s", ""), F.lit(r"([\[(][^\[\]()]*[\])]|[^,\[\]()]+)"), F.lit(1))
    return F.when(spec.isNull(), F.array(F.lit("*"))).when(spec.startswith("$"), F.array(spec)).otherwise(many)


def dotted_range(spec: Column) -> dict[str, Column]:
    """lower and upper of '[lo..hi]': blanks cut, null for an open end, both the same without dots; null for more than one '..'."""
    inner = F.regexp_replace(spec, r"^\s*\[|\]\s*$", "")
    parts = F.split(inner, r"\.\.")
    one = F.when(F.size(parts) == 1, F.trim(parts[0]))
    end = lambda i: F.when(F.size(parts) == 2, F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")))
    return {"lower": F.coalesce(one, end(0)), "upper": F.coalesce(one, end(1))}
