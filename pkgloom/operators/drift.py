"""Schemas that drift between releases of a producer: change report, rename chains, one consistent table.

Each message is walked once (Arrow batches). What leaves the walk is a profile of the schema, not data: per
(partition, version, field) a count, the JSON types seen and a hashed histogram of value features, written out in
partial rows. Counts and types are summed first; they say which fields vanished or appeared between neighbouring
versions, and only the histograms of those are read again, summed and shuffled.

Every pair of neighbouring versions is then matched by similarity flooding. Both schemas are graphs: fields with edges
to the object they stand in, to the parts of their name, to their type and to the features of their values. The
nodes of the propagation graph are pairs of fields that may correspond, among them the objects and fields that both
versions share (known, so their score stays 1), and pairs of name parts, types and features that occur on both sides.
It starts from the likeness of the names alone; scores flow along the edges until they no longer move, so that features
many pairs lay claim to count less and an object is known by what it holds. The converged scores alone decide: the
best consistent pairs that reach RENAMED become renames.

Null, empty, broken or non-object messages, and messages without a version, are left out of every result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby
from math import sqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgloom.operators.jsonio import BIT, kind, parse_object
from pkgloom.session import Scratch

BINS = 509
FLOW = 0.9  # of a score that comes from the neighbours; the rest is what it started from
LABELS = {"value": 0.75, "name": 0.1, "type": 0.1, "parent": 0.05}  # weights of the edges of a pair of fields
BARE_NAME = 0.5  # of the name where neither field holds values or fields
RENAMED = 0.35  # converged score from which a pair corresponds
VERSION_NAME = 0.5  # likeness to the version's key from which another key may hold the version
NO_PARTITION = -(2**31)
_VERSION = re.compile(r"\d+(?:\.\d+)+(?:[.\-+]\w+)*")
_RUN = re.compile(r"([a9])\1+")
_WORD = re.compile(r"[^\W\d_]{2,}")
_NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
NO_NUMBER = 64  # beside the type bits of a field: some plain value of it is not the text of a number
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

PROFILE_SCHEMA = "part int, version string, path string, parent string, n long, types int, bins array<int>, ws array<float>"
CHANGE_SCHEMA = "topic_partition int, plugin_version string, old_field string, new_field string, change_kind string"


class _Bins(dict):
    """token -> its bin, computed once; emptied when full."""

    def __missing__(self, token: str) -> int:
        b = crc32(token.encode("utf-8", "surrogatepass")) % (BINS - 1) + 1
        if len(token) < 200:  # long ones are hashed again each time rather than kept
            if len(self) > 200_000:
                self.clear()
            self[token] = b
        return b


class _Letters(dict):
    """Code point -> 'a' for letters, '9' for digits, itself else."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        out = self[code] = "a" if ch.isalpha() else "9" if ch.isdigit() else ch
        return out


_bins, _letters = _Bins(), _Letters()


def _features(text: str) -> list[tuple[int, float]]:
    """Hashed features of a scalar: its shape and its words; of a number its length and leading digits."""
    if not text:
        return [(0, 1.0)]
    if text.isascii() and text.isdigit():
        return [(_bins[f"d{len(text)}"], 1.0), (_bins[f"d{len(text)}:{text[:2]}"], 0.5)]
    words = _WORD.findall(text)
    out = [(_bins[_RUN.sub(r"\1", text.translate(_letters))], 1.0)]
    if words:
        weight = 1.0 / len(words)
        out += [(_bins[w], weight) for w in words]
    return out


def name_similarity(a: str, b: str) -> float:
    """0 to 1: shared name parts (camel, snake), with credit for one part that begins another."""
    if a == b:
        return 1.0
    x, y = ([p.lower() for p in _NAME_PART.findall(s)] for s in (a, b))
    if not x or not y:
        return 0.0
    if x == y:
        return 0.98

    def best(p: str, others: list[str]) -> float:
        top = 0.0
        for q in others:
            if p == q:
                return 1.0
            k = 0
            while k < min(len(p), len(q)) and p[k] == q[k]:
                k += 1
            top = max(top, 0.9 * k / max(len(p), len(q)) if k >= 3 else 0.0, 0.8 if k >= 3 and k == min(len(p), len(q)) else 0.0)
        return top

    one, two = sum(best(p, y) for p in x) / len(x), sum(best(q, x) for q in y) / len(y)
    return 0.5 * max(one, two) + 0.5 * min(one, two)


def version_of(message: dict, key: str = "plugin_version") -> tuple[str, str] | None:
    """(key, version) of a message, also where the version stands under another name of the top level that is like ``key``."""
    v = message.get(key)
    if isinstance(v, str) and v:
        return key, v
    best = max(((name_similarity(key, k), k) for k, v in message.items() if isinstance(v, str) and _VERSION.fullmatch(v)), default=(0.0, ""))
    return (best[1], message[best[1]]) if best[0] >= VERSION_NAME else None


def version_key(version: str) -> tuple:
    """Orders versions by their numbers, compared as numbers; a pre-release stands before its release."""
    digits = tuple(int(x) for x in re.findall(r"\d+", re.split(r"[-+]", version)[0]))
    return digits, "-" not in version, tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.findall(r"\d+|[^\W\d]+", version)), version


def _walk(obj: dict, parent: str, within: set[str] | None, acc: dict) -> None:
    for k, v in obj.items():
        path = parent + k
        slot = acc.get(path)
        if slot is None:
            slot = acc[path] = [parent, 0, 0, {}]
        slot[1] += 1
        if v is None:
            continue
        t = kind(v)
        slot[2] |= BIT[t]
        if t == "object":
            if within is None or path + "." in within:
                _walk(v, path + ".", within, acc)
        elif t == "array":
            plain = []
            for x in v:
                if type(x) is dict:
                    if within is None or path + "[]." in within:
                        _walk(x, path + "[].", within, acc)
                elif type(x) is list:
                    _walk_nested(x, path + "[]", within, acc)
                elif x is not None:
                    plain.append(x)
            bag = slot[3]
            for x in plain:
                bag[str(x)] = bag.get(str(x), 0) + 1
        else:
            bag, text = slot[3], v if t == "string" else ("true" if v is True else "false" if v is False else repr(v))
            bag[text] = bag.get(text, 0) + 1


def _walk_nested(items: list, path: str, within: set[str] | None, acc: dict) -> None:
    for x in items:
        if type(x) is dict:
            if within is None or path + "[]." in within:
                _walk(x, path + "[].", within, acc)
        elif type(x) is list:
            _walk_nested(x, path + "[]", within, acc)


def _profiler(within, version_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}
        seen = 0
        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = parse_object(text)
                v = m and version_of(m, version_name)
                if not v:
                    continue
                seen += 1
                _walk(m, "", within, acc.setdefault((part, v[1]), {}))
            if seen > 20_000:  # bounds the worker's memory, not the result: partial profiles add up
                yield from _emit(acc)
                acc, seen = {}, 0
        yield from _emit(acc)

    return run


def _emit(acc: dict) -> Iterator[pa.RecordBatch]:
    cols: list[list] = [[] for _ in range(8)]
    for (part, version), fields in acc.items():
        for path, (parent, n, types, bag) in fields.items():
            hist: dict[int, float] = {}
            if any(not (text.isdigit() or _NUMBER.fullmatch(text)) for text in bag):
                types |= NO_NUMBER
            for text, times in bag.items():
                for b, w in _features(text):
                    hist[b] = hist.get(b, 0.0) + w * times
            for c, x in zip(cols, (part, version, path, parent, n, types, list(hist), list(hist.values()))):
                c.append(x)
    if cols[0]:
        types_of = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types_of)], names=["part", "version", "path", "parent", "n", "types", "bins", "ws"])


def profile_fields(messages: DataFrame, part: str = "topic_partition", message: str = "message", within: set[str] | None = None, version_name: str = "plugin_version") -> DataFrame:
    """Schema profile of JSON messages: partial rows per (part, version, field), written to the shared folder.

    within: the object prefixes to enter ("" is always entered; e.g. {"payload."}); None enters everything.
    Messages of a null partition form a partition of their own.
    """
    raw = messages.select(F.coalesce(F.col(part).cast("int"), F.lit(NO_PARTITION)).alias("part"), F.col(message).cast("string").alias("message"))
    return Scratch(messages.sparkSession).write(raw.mapInArrow(_profiler(within, version_name), PROFILE_SCHEMA))[0]


class Field:
    __slots__ = ("parent", "n", "types", "hist")

    def __init__(self, parent: str, n: int = 0, types: int = 0, hist: dict[int, float] | None = None):
        self.parent, self.n, self.types, self.hist = parent, n, types & ~NO_NUMBER, hist or {}


def value_parts(a: Field, b: Field) -> dict[int, float]:
    """Shares of the cosine of both value histograms by bin, without the bin of empty texts."""
    x, y = ({k: v for k, v in f.hist.items() if k} for f in (a, b))
    if not x and not y:
        return {0: 1.0} if a.hist and b.hist else {}
    if not x or not y:
        return {}
    size = sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return {k: v * y[k] / size for k, v in x.items() if k in y}


def value_similarity(a: Field, b: Field) -> float | None:
    """Cosine of the value histograms without the bin of empty texts; None where neither field holds a plain value."""
    return sum(value_parts(a, b).values()) if a.hist or b.hist else None


def _nested(f: Field) -> int:
    return f.types & (BIT["object"] | BIT["array"])


def _kids(schema: dict[str, Field]) -> dict[str, dict[str, str]]:
    """Path of an object or of an array of objects ('' for the message) -> last key -> path of the fields directly inside."""
    out: dict[str, dict[str, str]] = {}
    for p, f in schema.items():
        out.setdefault(_object(f.parent), {})[p[len(f.parent) :]] = p
    return out


def _object(prefix: str) -> str:
    """The path of the field whose insides begin with ``prefix``."""
    prefix = prefix[:-1] if prefix.endswith(".") else prefix
    while prefix.endswith("[]"):
        prefix = prefix[:-2]
    return prefix


class Propagation:
    """The propagation graph of two schemas and its fixed point.

    pairs: (old path, new path) -> place; ("", "") is the message itself.
    """

    def __init__(self, old: dict[str, Field], new: dict[str, Field]):
        self.old, self.new = old, new
        self.kids = _kids(old), _kids(new)
        self.pairs: dict[tuple[str, str], int] = {}
        self.start: list[float] = []
        self.parent: list[int] = []
        self.edges: dict[str, list[tuple[int, int, float]]] = {"name": [], "type": [], "value": []}  # pair, attribute, weight
        self.inner: list[tuple[int, int, int, float]] = []  # pair, place of one of its fields in self.slots, pair of that field, weight
        self.slots = 0
        self.attributes: dict[tuple, int] = {}
        self.candidates = [(a, b) for a in self._lone(old, new) for b in self._lone(new, old) if old[a].parent == new[b].parent]
        if self.candidates:
            self._pair("", "", -1, sorted({_object(old[a].parent) for a, _ in self.candidates}))

    @staticmethod
    def _lone(one: dict[str, Field], other: dict[str, Field]) -> list[str]:
        return [p for p, f in one.items() if p not in other and _there(f.parent, other)]

    def _attribute(self, *key) -> int:
        return self.attributes.setdefault(key, len(self.attributes))

    def _pair(self, a: str, b: str, parent: int, shared: list[str]) -> int:
        """Adds a pair and what lies inside it; ``shared``: the objects of both schemas that hold candidates."""
        at = self.pairs[a, b] = len(self.start)
        self.parent.append(parent)
        if not a:
            self.start.append(1.0)
        else:
            fa, fb = self.old[a], self.new[b]
            x, y = a[len(fa.parent) :], b[len(fb.parent) :]
            named = name_similarity(x, y)
            self.start.append(named)
            alike = 1.0 if fa.types == fb.types or not fa.types or not fb.types else 0.9 if not (_nested(fa) | _nested(fb)) else 0.3
            self.edges["type"].append((at, self._attribute("type", min(fa.types, fb.types), max(fa.types, fb.types)), alike))
            words = sorted({p.lower() for p in _NAME_PART.findall(x)} & {p.lower() for p in _NAME_PART.findall(y)}) or [f"{x} {y}"]
            self.edges["name"] += [(at, self._attribute("name", w), named / len(words)) for w in words]
            if a != b:
                self.edges["value"] += [(at, self._attribute("value", k), w) for k, w in value_parts(fa, fb).items()]
        within, same = (self.kids[0].get(a, {}), self.kids[1].get(b, {})), a == b
        if not same:
            combos = [(x, y) for x in within[0].values() for y in within[1].values()]
        elif a in shared or any(_inside(s, a) for s in shared):
            both = within[0].keys() & within[1].keys()
            combos = [(within[0][k], within[1][k]) for k in sorted(both)]
            if a in shared:
                combos += [(x, y) for x, y in self.candidates if _object(self.old[x].parent) == a]
        else:
            combos = []
        slots: dict[tuple[int, str], int] = {}
        found = [(x, y, self._pair(x, y, at, shared)) for x, y in combos]
        for side, fields in enumerate(within):
            for p in fields.values():
                slots[side, p] = self.slots
                self.slots += 1
        each = 1.0 / max(len(slots), 1)
        self.inner += [(at, slots[side, p], q, each) for x, y, q in found for side, p in ((0, x), (1, y))]
        return at

    def scores(self, rounds: int | None = None, tolerance: float = 1e-6) -> np.ndarray:
        """The converged score of each pair, in 0 to 1; ``rounds`` stops earlier, for comparison (0: names alone).

        A pair's score is a tenth what it started from and nine tenths the weighted sum of its labels: the features it
        shares, the best partners of the fields inside it, its name parts, its type, and the pair it stands in. A
        feature's score is the mean of the pairs that share it, that of a name part or type the best of them. Each round
        changes no score by more than 0.9 of the largest change before, so the fixed point exists, is unique and is
        reached.
        """
        n, k = len(self.start), len(self.attributes)
        parent = np.array(self.parent)
        shared = np.array([a == b for a, b in self.pairs])
        holds = np.array([bool(self.kids[0].get(a) or self.kids[1].get(b)) for a, b in self.pairs])
        valued = np.array([a != b and bool(self.old[a].hist or self.new[b].hist) for a, b in self.pairs])
        named = np.where(holds | valued, LABELS["name"], BARE_NAME)
        pair, attribute, weight, best_of = {}, {}, {}, {"name": True, "type": True, "value": False}
        for label, rows in self.edges.items():
            pair[label], attribute[label], weight[label] = (np.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (int, int, float)))
        total = np.zeros(k)
        np.add.at(total, attribute["value"], weight["value"])
        slot_of, slot, inside, share = (np.array(c, t) for c, t in zip(zip(*self.inner) if self.inner else ((), (), (), ()), (int, int, int, float)))
        _, first = np.unique(slot, return_index=True)
        start = np.where(shared, 1.0, np.array(self.start))
        score, done = start.copy(), 0
        while rounds is None or done < rounds:
            done += 1
            flow = {}
            for label, best in best_of.items():
                into = np.zeros(k)
                if best:
                    np.maximum.at(into, attribute[label], score[pair[label]])
                else:
                    np.add.at(into, attribute[label], weight[label] * score[pair[label]])
                    into = np.divide(into, total, out=np.zeros(k), where=total > 0)
                flow[label] = np.zeros(n)
                np.add.at(flow[label], pair[label], weight[label] * ((1 - FLOW) + FLOW * into)[attribute[label]])
            best_inside, within = np.zeros(self.slots), np.zeros(n)
            np.maximum.at(best_inside, slot, score[inside])
            np.add.at(within, slot_of[first], share[first] * best_inside[slot[first]])
            value = np.where(valued & holds, (flow["value"] + within) / 2, flow["value"] + within)
            after = (1 - FLOW) * start + FLOW * (named * flow["name"] + LABELS["type"] * flow["type"] + LABELS["parent"] * score[parent] + LABELS["value"] * value)
            after[shared] = 1.0
            moved = np.abs(after - score).max()
            score = after
            if moved < tolerance:
                break
        return score


def _inside(path: str, outer: str) -> bool:
    """Whether the object ``path`` lies in ``outer``."""
    return not outer or path.startswith((outer + ".", outer + "[]"))


def match_schemas(old: dict[str, Field], new: dict[str, Field], rounds: int | None = None) -> list[tuple[str, str]]:
    """Renamed fields (old path, new path) between two schemas, by the converged scores of their propagation graph.

    Candidates are the fields that vanished and those that appeared in the same object. Of the pairs that reach RENAMED
    the best are taken first, each field once; a plain field and one that holds others never correspond.
    """
    graph = Propagation(old, new)
    if not graph.candidates:
        return []
    score = graph.scores(rounds)
    ranked = sorted((-round(float(score[graph.pairs[p]]), 9), p) for p in graph.candidates)
    out, used_a, used_b = [], set(), set()
    for s, (a, b) in ranked:
        plain = bool(_nested(old[a])) != bool(_nested(new[b])) and old[a].types and new[b].types
        if -s >= RENAMED and not plain and a not in used_a and b not in used_b:
            out.append((a, b))
            used_a.add(a)
            used_b.add(b)
    return out


def _there(parent: str, schema: dict[str, Field]) -> bool:
    return not parent or _object(parent) in schema


def compare_schemas(old: dict[str, Field], new: dict[str, Field], rounds: int | None = None) -> list[tuple[str, str, str]]:
    """(old_field, new_field, change_kind) from ``old`` to ``new``; nothing inside an added, removed or renamed field."""
    renamed = match_schemas(old, new, rounds)
    left, right = {a for a, _ in renamed}, {b for _, b in renamed}
    out = [(a, b, "renamed") for a, b in renamed]
    out += [(a, "", "removed") for a, f in old.items() if a not in new and a not in left and _there(f.parent, new)]
    out += [("", b, "added") for b, f in new.items() if b not in old and b not in right and _there(f.parent, old)]
    for a, b in [(p, p) for p in old if p in new] + renamed:
        if old[a].types and new[b].types and old[a].types != new[b].types:
            out.append((b, b, "type"))
    return out


def _version_order(version: Column) -> list[Column]:
    """Columns that sort versions as version_key does; digits of any length are compared as numbers."""

    def number(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+(?=.)", "")
        return F.struct(F.length(digits).alias("n"), digits.alias("d"))

    def token(x: Column) -> Column:
        digit = x.rlike(r"^\d")
        return F.struct(F.when(digit, 0).otherwise(1).alias("k"), F.when(digit, number(x)).otherwise(number(F.lit("0"))).alias("n"), F.when(digit, "").otherwise(x).alias("t"))

    main = F.split(version, r"[-+]", 2)[0]
    words = F.regexp_extract_all(version, F.lit(r"(\d+|[^\W\d_]+)"), 1)
    return [F.transform(F.regexp_extract_all(main, F.lit(r"(\d+)"), 1), number), ~F.contains(version, F.lit("-")), F.transform(words, token), version]


def version_pairs(profile: DataFrame) -> DataFrame:
    """part, version, path, parent, n, types, role, at: the fields of each version, as the new side of the pair of versions
    that ends with it (at: itself) and as the old side of the next one (at: that version)."""
    fields = profile.groupBy("part", "version", "path", "parent").agg(F.sum("n").alias("n"), F.bit_or("types").alias("types"))
    w = Window.partitionBy("part").orderBy(*_version_order(F.col("version")))  # a row per version
    around = profile.select("part", "version").distinct().withColumns({"before": F.lag("version").over(w), "after": F.lead("version").over(w)})
    sides = F.array(
        F.struct(F.lit("new").alias("role"), F.when(F.col("before").isNotNull(), F.col("version")).alias("at")),
        F.struct(F.lit("old").alias("role"), F.col("after").alias("at")),
    )
    roles = around.select("part", "version", F.inline(sides)).where("at IS NOT NULL")
    return fields.join(roles, ["part", "version"])


def _histograms(profile: DataFrame, fields: DataFrame) -> DataFrame:
    """part, version, path, bins, ws of the wanted ``fields`` (part, version, path), summed."""
    rows = profile.select("part", "version", "path", "bins", "ws").join(fields.distinct(), ["part", "version", "path"], "left_semi")
    flat = rows.select("part", "version", "path", F.inline(F.arrays_zip(F.col("bins").alias("bin"), F.col("ws").alias("w"))))
    summed = flat.groupBy("part", "version", "path", "bin").agg(F.sum("w").alias("w"))
    packed = summed.groupBy("part", "version", "path").agg(F.collect_list(F.struct("bin", "w")).alias("h"))  # at most BINS
    return packed.select("part", "version", "path", F.col("h.bin").alias("bins"), F.col("h.w").alias("ws"))


_SIDE = ("path", "parent", "n", "types", "bins", "ws")


def _field(parent: str, n: int, types: int, bins, ws) -> Field:
    return Field(parent, n, types, dict(zip(bins, ws)) if bins is not None else None)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) of sorted batches; the key is the first columns."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, key=lambda r: r[:keys])


def field_changes(profile: DataFrame) -> DataFrame:
    """Every schema change between neighbouring versions of each partition, with the columns of CHANGE_SCHEMA.

    A group is a pair of neighbouring versions: two schemas, whatever the number of messages. Histograms are read only
    for fields that stand in one of the two.
    """
    pairs, _ = Scratch(profile.sparkSession).write(version_pairs(profile))
    sided = pairs.groupBy("part", "at", "path").agg(F.count(F.lit(1)).alias("sides"), F.max("version").alias("version"))
    lone = sided.where("sides = 1").select("part", "version", "path")
    full = pairs.join(_histograms(profile, lone), ["part", "version", "path"], "left").select("part", "at", "role", *_SIDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for (part, at), group in _groups(batches, 2):
            sides: dict[str, dict[str, Field]] = {"old": {}, "new": {}}
            for _, _, role, path, *rest in group:
                sides[role][path] = _field(*rest)
            rows += [(None if part == NO_PARTITION else part, at, a, b, k) for a, b, k in compare_schemas(sides["old"], sides["new"])]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.string()) for i, c in enumerate(cols)], names=["topic_partition", "plugin_version", "old_field", "new_field", "change_kind"])

    return full.repartition("part", "at").sortWithinPartitions("part", "at").mapInArrow(run, CHANGE_SCHEMA)


class Aliases(dict):
    """Wanted field -> the last keys it bears in any partition, its own first; ``of`` has those of one partition."""

    def __init__(self, names: dict[str, list[str]], by_part: dict[int, dict[str, list[str]]]):
        super().__init__(names)
        self.by_part = by_part

    def of(self, part: int | None) -> dict[str, list[str]]:
        return self.by_part.get(NO_PARTITION if part is None else part, self)


def _chain(wanted: list[str], renames: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Last keys of each wanted field along the rename chains; a field follows the names of its parent."""
    names: dict[str, list[str]] = {}
    for w in sorted(wanted, key=lambda w: w.count(".")):
        above = _parent(w)[:-1]
        parents = {_parent(w)} | {_parent(above) + k + "." for k in names.get(above, [])}
        names[w] = [w[len(_parent(w)) :]]
        for k in names[w]:  # grows
            for a, b in renames:
                for x, y in ((a, b), (b, a)):
                    if _parent(x) in parents and x[len(_parent(x)) :] == k and y[len(_parent(y)) :] not in names[w]:
                        names[w].append(y[len(_parent(y)) :])
    return {w: names[w] for w in wanted}


def field_aliases(profile: DataFrame, wanted: list[str]) -> Aliases:
    """For each wanted field, the names (last keys) it bears, per partition; its own name first.

    A partition's names come from its own rename chains. In a partition that never had the wanted name the names of
    the other partitions count, and if it has none of those, the field that matches best in a pooled profile of the
    partitions that have one. What reaches the driver is a row per partition, wanted field and name.
    """
    parents = sorted({_parent(w) for w in wanted})
    tops = profile.where(F.col("parent").isin(parents)).groupBy("part", "path", "parent").agg(F.sum("n").alias("n"), F.bit_or("types").alias("types"))
    present: dict[int, set[str]] = {}
    renames: dict[int, list[tuple[str, str]]] = {}
    found = [tuple(r) for r in field_changes(profile).where("change_kind = 'renamed'").select("topic_partition", "old_field", "new_field").distinct().collect()]
    for part, a, b in sorted(found, key=str):
        renames.setdefault(NO_PARTITION if part is None else part, []).append((a, b))
    pooled = _chain(wanted, sorted({(a, b) for r in renames.values() for a, b in r}))
    bases = {w: {_parent(w) + k for k in pooled[w]} for w in wanted}
    rows = tops.where(F.col("path").isin(sorted(set().union(*bases.values())))).select("part", "path")
    for part, path in rows.union(profile.select("part", F.lit("")).distinct()).collect():
        present.setdefault(part, set()).add(path)
    lacking = {w: [p for p, has in sorted(present.items()) if not has & bases[w]] for w in wanted}
    having = {w: [p for p, has in sorted(present.items()) if has & bases[w]] for w in wanted}
    by_part = {p: _chain(wanted, renames.get(p, [])) for p in present}
    for p, has in present.items():
        for w in wanted:
            if w not in has:
                by_part[p][w] += [k for k in pooled[w] if k not in by_part[p][w]]
    for w in wanted:
        if not lacking[w] or not having[w]:
            continue
        for p, k in _best_match(profile, _parent(w), having[w], lacking[w], bases[w]):
            by_part[p][w].append(k)
            if k not in pooled[w]:
                pooled[w].append(k)
    return Aliases(pooled, by_part)


def _best_match(profile: DataFrame, parent: str, having: list[int], lacking: list[int], bases: set[str]) -> list[tuple[int, str]]:
    """(partition, key) of the field inside ``parent`` that corresponds to one of ``bases``, for the partitions that have none."""
    level = profile.where(F.col("parent") == parent)

    def schemas(parts: list[int], pool: bool) -> DataFrame:
        rows = level.where(F.col("part").isin(parts)).withColumn("part", F.lit(0) if pool else F.col("part"))
        flat = rows.select("part", "path", F.inline(F.arrays_zip(F.col("bins").alias("bin"), F.col("ws").alias("w")))).groupBy("part", "path", "bin").agg(F.sum("w").alias("w"))
        packed = flat.groupBy("part", "path").agg(F.collect_list(F.struct("bin", "w")).alias("h"))
        fields = rows.groupBy("part", "path", "parent").agg(F.sum("n").alias("n"), F.bit_or("types").alias("types"))
        return fields.join(packed, ["part", "path"], "left").select("part", "path", "parent", "n", "types", F.col("h.bin").alias("bins"), F.col("h.w").alias("ws"))

    known = {r["path"]: _field(*(r[c] for c in _SIDE[1:])) for r in schemas(having, True).collect()}  # one level of a schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for (part,), group in _groups(batches, 1):
            old, new = dict(known), {path: _field(*rest) for _, path, *rest in group}
            steps = _object(parent).split(".") if parent else []
            for i in range(len(steps)):  # the level hangs on shared objects
                p = ".".join(steps[: i + 1])
                old[p] = new[p] = Field(_parent(p), 1, BIT["object"])
            found += [(part, b[len(parent) :]) for a, b in match_schemas(old, new) if a in bases]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string())], names=["part", "name"])

    return [tuple(r) for r in schemas(lacking, False).repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, name string").collect()]


def _parent(path: str) -> str:
    return path[: path.rfind(".") + 1]


class Canon:
    """Canonical names: per (canonical parent, key) the oldest name of the field, from the renames of all partitions."""

    def __init__(self, renames: list[tuple[str, str]]):
        self.key: dict[tuple[str, str], str] = {}
        for a, b in sorted(renames, key=lambda p: (p[0].count("."), p)):  # outer objects first
            parent = self.parent(_parent(a))
            old, new = a[len(_parent(a)) :], b[len(_parent(b)) :]
            root = self.key.get((parent, old), old)
            if new != root:
                self.key[parent, new] = root
        for parent, k in list(self.key):
            seen = {k}
            while (parent, self.key[parent, k]) in self.key and self.key[parent, k] not in seen:  # a later pair may have named the root anew
                seen.add(self.key[parent, k])
                self.key[parent, k] = self.key[parent, self.key[parent, k]]

    def parent(self, path: str) -> str:
        """A parent prefix ('', 'a.', 'a[].b.') with each step under its canonical name."""
        out = ""
        for step in path.split(".")[:-1]:
            name, marks = step.rstrip("[]"), step[len(step.rstrip("[]")) :]
            out += self.key.get((out, name), name) + marks + "."
        return out

    def path(self, path: str) -> str:
        p = self.parent(_parent(path))
        k = path[len(_parent(path)) :]
        return p + self.key.get((p, k), k)

    def value(self, v, parent: str):
        """A value with all keys inside it under their canonical names; where two meet, the canonical one wins."""
        if type(v) is dict:
            out = {}
            for k, x in v.items():
                name = self.key.get((parent, k), k)
                if name not in out or name == k:
                    out[name] = self.value(x, f"{parent}{name}.")
            return out
        if type(v) is list:
            inner = parent[:-1] + "[]." if parent else parent
            return [self.value(x, inner) for x in v]
        return v


def consistent_table(messages: DataFrame, key: str = "record_id", part: str = "topic_partition", message: str = "message") -> DataFrame:
    """One row per message, one column per field: every message under the oldest names, types unified.

    Columns are the fields outside arrays, in name order, '.' written as '__'. A field that is a number in any version,
    and whose texts all are numbers too, is a double; other plain values are text; arrays are JSON text with canonical
    names inside. No value is lost to a cast. Messages that are no JSON object have no row.
    """
    profile = profile_fields(messages, part, message)
    renames = [tuple(r) for r in field_changes(profile).where("change_kind = 'renamed'").select("old_field", "new_field").distinct().collect()]
    canon = Canon(renames)
    types: dict[str, int] = {}
    for r in profile.groupBy("path").agg(F.bit_or("types").alias("types")).collect():
        if "[]" not in r["path"]:
            p = canon.path(r["path"])
            types[p] = types.get(p, 0) | r["types"]
    fields = sorted(p for p, t in types.items() if t & ~BIT["object"] or not t)
    numeric = {p for p in fields if types[p] & BIT["number"] and not types[p] & (BIT["array"] | BIT["boolean"] | NO_NUMBER)}

    def text(v) -> str | None:
        if v is None or isinstance(v, str):
            return v
        if isinstance(v, bool):
            return "true" if v else "false"
        return json.dumps(v, ensure_ascii=False, sort_keys=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = parse_object(t)
                if m is not None:
                    keys.append(k)
                    rows.append(canon.value(m, ""))
            cols = []
            for f in fields:
                steps, values = f.split("."), []
                for row in rows:
                    v = row
                    for s in steps:
                        v = v.get(s) if type(v) is dict else None
                    values.append(None if type(v) is dict else text(v))
                cols.append(pa.array(values, pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *cols], names=["key", *[f"f{i}" for i in range(len(fields))]])

    raw = messages.select(F.col(key).cast("long"), F.col(message).cast("string")).mapInArrow(run, "key long" + "".join(f", f{i} string" for i in range(len(fields))))
    out = [F.col("key").alias(key)]
    for i, f in enumerate(fields):
        c = F.col(f"f{i}")
        out.append((c.try_cast("double") if f in numeric else c).alias(f.replace(".", "__")))
    return raw.select(*out)
