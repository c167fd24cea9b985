"""The general training-data operators against brute force and on hostile rows."""

from __future__ import annotations

import json
import random
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pkgloom.operators.dates_in_messages import dated_values
from pkgloom.operators.dedup import keep_first, message_digest, new_messages, repeated, with_digest
from pkgloom.operators.drift import Field, Propagation, _version_order, compare_schemas, consistent_table, field_aliases, field_changes, match_schemas, name_similarity, profile_fields, version_key, version_of
from pkgloom.operators.jsonio import BIT
from pkgloom.operators.hierarchy import descendants, further_parents, hierarchies, parse_coordinate, place
from pkgloom.operators.jsonio import canonical_number
from pkgloom.operators.nested import flatten, flatten_chain, merged_schema, scalar_text, stages_and_lines
from pkgloom.operators.skew import compact, eager_join, heavy_keys
from pkgloom.operators.timestamps import utc_micros

# ---- drift


def _message(version: str, n: int, **change) -> str:
    m = {"plugin_version": version, "plugin_name": "Reader", "created_at": 1609459200 + n, "payload": {"groupId": f"g{n % 7}", "repoUrl": f"https://git.example/p{n}.git" if n % 2 else "", "deps": [{"name": f"d{n}", "optional": False}]}}
    for k, v in change.items():
        m[k] = v
    return json.dumps(m)


def _drift_rows():
    rows = [(0, _message("0.9.0", n)) for n in range(40)]
    for n in range(40):
        m = json.loads(_message("0.10.0", n))
        m["plugin"] = m.pop("plugin_name")
        m["payload"]["repositoryUrl"] = m["payload"].pop("repoUrl")
        m["payload"]["checksum"] = f"{n:016x}"
        m["payload"]["deps"][0]["optional"] = "false"
        rows.append((0, json.dumps(m)))
    for n in range(40):
        m = json.loads(_message("0.10.1", n))
        m["plugin"] = m.pop("plugin_name")
        m["version"] = m.pop("plugin_version")
        m["payload"].pop("repoUrl")
        m["payload"]["checksum"] = f"{n:016x}"
        m["payload"]["deps"] = [{"name": f"d{n}", "optional": "false"}]
        rows.append((0, json.dumps(m)))
    return rows + [(0, None), (0, ""), (0, "{broken"), (0, "[1]"), (0, '{"no":"version"}'), (None, _message("0.1.0", 1))]


def test_field_changes(spark):
    df = spark.createDataFrame(_drift_rows(), "topic_partition int, message string").withColumn("path", F.lit("clash")).withColumn("bin", F.lit(1))
    got = {tuple(r) for r in field_changes(profile_fields(df)).collect()}
    assert got == {
        (0, "0.10.0", "plugin_name", "plugin", "renamed"),
        (0, "0.10.0", "payload.repoUrl", "payload.repositoryUrl", "renamed"),
        (0, "0.10.0", "", "payload.checksum", "added"),
        (0, "0.10.0", "payload.deps[].optional", "payload.deps[].optional", "type"),
        (0, "0.10.1", "plugin_version", "version", "renamed"),
        (0, "0.10.1", "payload.repositoryUrl", "", "removed"),
    }


def test_field_aliases(spark):
    df = spark.createDataFrame(_drift_rows() + [(1, r) for _, r in _drift_rows()[80:120]], "topic_partition int, message string")
    names = field_aliases(profile_fields(df, within={""}), ["plugin_name", "plugin_version", "created_at"])
    assert names == {"plugin_name": ["plugin_name", "plugin"], "plugin_version": ["plugin_version", "version"], "created_at": ["created_at"]}


def test_consistent_table(spark):
    rows = [(i, p, m) for i, (p, m) in enumerate(_drift_rows())]
    df = spark.createDataFrame(rows, "record_id long, topic_partition int, message string")
    t = consistent_table(df)
    assert t.columns == ["record_id", "created_at", "payload__checksum", "payload__deps", "payload__groupId", "payload__repoUrl", "plugin_name", "plugin_version"]
    got = {r["record_id"]: r for r in t.collect()}
    assert len(got) == 122  # messages that are objects
    assert {r["plugin_version"] for r in got.values()} == {"0.9.0", "0.10.0", "0.10.1", "0.1.0", None}
    assert got[41]["payload__repoUrl"] == "https://git.example/p1.git" and got[41]["plugin_name"] == "Reader" and got[41]["created_at"] == 1609459201
    assert json.loads(got[3]["payload__deps"]) == [{"name": "d3", "optional": False}]


def test_empty_drift(spark):
    df = spark.createDataFrame([], "topic_partition int, message string")
    assert field_changes(profile_fields(df)).count() == 0
    assert field_aliases(profile_fields(df), ["a"]) == {"a": ["a"]}


def test_version_order():
    assert sorted(["0.10.0", "0.9.1", "0.9.0-rc1", "0.9.0", "1.0"], key=version_key) == ["0.9.0-rc1", "0.9.0", "0.9.1", "0.10.0", "1.0"]


def test_names():
    assert name_similarity("created_at", "createdAt") > 0.9
    assert name_similarity("created_at", "created") > name_similarity("created_at", "consumed_at")
    assert compare_schemas({}, {}) == []


def _schema(spec: dict) -> dict[str, Field]:
    """path -> histogram of a plain field, or 'object' / 'array' of objects."""
    out = {}
    for path, v in spec.items():
        parent = path[: path.rfind(".") + 1]
        out[path] = Field(parent, 10, BIT[v] if isinstance(v, str) else BIT["string"], {} if isinstance(v, str) else v)
    return out


def test_flooding_outvotes_names_and_single_values():
    """'maker' goes on as 'producer'; 'makers' is new and only sounds alike."""
    old = _schema({"maker": "object", "maker.login": {1: 5.0, 2: 5.0}, "maker.since": {3: 9.0}, "maker.site": {4: 4.0}, "id": {}})
    new = _schema({"makers": "object", "makers.count": {7: 5.0}, "makers.limit": {8: 2.0}, "producer": "object", "producer.login": {1: 5.0, 2: 4.0}, "producer.since": {3: 9.0}, "producer.page": {4: 4.0}, "id": {}})
    assert match_schemas(old, new) == [("maker", "producer")]
    assert match_schemas(old, new, rounds=0) == [("maker", "makers")]
    assert sorted(compare_schemas(old, new)) == [("", "makers", "added"), ("maker", "producer", "renamed")]


def test_flooding_by_values_alone():
    old = _schema({"p": "object", "p.repository": {5: 8.0, 6: 2.0}, "p.gone": {9: 4.0}})
    new = _schema({"p": "object", "p.resolvedFrom": {5: 7.0, 6: 2.0}, "p.goner": {11: 4.0}})
    assert match_schemas(old, new) == [("p.repository", "p.resolvedFrom")]
    assert match_schemas(old, new, rounds=0) == [("p.gone", "p.goner")]


def test_flooding_converges_to_one_point():
    rng = random.Random(5)
    old = _schema({f"a{i}": {rng.randrange(20): rng.random() + 0.1 for _ in range(6)} for i in range(12)} | {"o": "object"} | {f"o.x{i}": {i: 1.0} for i in range(4)})
    new = _schema({f"b{i}": {rng.randrange(20): rng.random() + 0.1 for _ in range(6)} for i in range(12)} | {"q": "array"} | {f"q[].y{i}": {i: 1.0} for i in range(4)})
    graph = Propagation(old, new)
    far, further = graph.scores(400, 0.0), graph.scores(500, 0.0)
    assert abs(far - further).max() < 1e-12 and abs(graph.scores() - far).max() < 1e-4 and 0 <= far.min() and far.max() <= 1
    assert abs(graph.scores(1) - far).max() > 0.01


def test_version_needs_a_name_like_it():
    assert version_of({"ip": "10.0.0.1"}) is None
    assert version_of({"ip": "10.0.0.1", "version": "1.2.3"}) == ("version", "1.2.3")


def test_version_columns_sort_as_the_key(spark):
    versions = ["0.9.0-rc1", "0.9.0", "0.9.1", "0.10.0", "1.0", "1.0.0", "01.0", "2.0+b", "2.0", "2.0-alpha2", "2.0-alpha10", "123456789012345678901234567890.1", "v", "3.1.a"]
    rng = random.Random(3)
    rng.shuffle(versions)
    df = spark.createDataFrame([(v,) for v in versions], "version string")
    assert [r[0] for r in df.orderBy(*_version_order(F.col("version"))).collect()] == sorted(versions, key=version_key)


def test_aliases_of_a_partition(spark):
    """'when' is the time in partition 0, something else in partition 1; partition 2 never had the first name."""

    def m(version, n, **keys):
        return json.dumps({"plugin_version": version, "note": f"n{n}", **keys})

    rows = [(0, m("1.0", n, made=f"2020-01-{n % 28 + 1:02d}")) for n in range(30)] + [(0, m("1.1", n, when=f"2020-01-{n % 28 + 1:02d}")) for n in range(30)]
    rows += [(1, m("1.0", n, made=f"2020-01-{n % 28 + 1:02d}", when="late" if n % 2 else "early")) for n in range(30)]
    rows += [(2, m("1.0", n, day=f"2020-01-{n % 28 + 1:02d}", other="x y")) for n in range(30)]
    names = field_aliases(profile_fields(spark.createDataFrame(rows, "topic_partition int, message string")), ["made"])
    assert names.of(0)["made"] == ["made", "when"] and names.of(1)["made"] == ["made"]
    assert names.of(2)["made"] == ["made", "when", "day"] and names.of(99)["made"] == names["made"]


# ---- dedup


@given(st.decimals(allow_nan=False, allow_infinity=False, places=4), st.integers(0, 5))
@settings(max_examples=50, deadline=None)
def test_canonical_number(d, zeros):
    written = {f"{d}" if "." not in f"{d}" else f"{d}{'0' * zeros}", f"{d:E}"}
    assert len({canonical_number(w) for w in written}) == 1


def test_numbers_differ():
    assert len({canonical_number(x) for x in ("9007199254740993", "9007199254740992", "1", "10", "0.1", "-1")}) == 6
    assert canonical_number("-0.0") == canonical_number("0") == canonical_number("0e5")


NAMES = [["plugin_name", "plugin"], ["payload"]]


def test_digest_is_by_value():
    a = message_digest('{"plugin_name":"R","payload":{"x":1,"y":"é"},"host":1}', NAMES)
    assert a == message_digest('{ "payload": {"y":"\\u00e9", "x":1.0}, "plugin": "R" }', NAMES)
    for other in ('{"plugin_name":"R","payload":{"x":"1","y":"é"}}', '{"plugin_name":"R","payload":{"x":true,"y":"é"}}', '{"plugin_name":"R","payload":{"x":1,"y":"é","z":null}}', '{"plugin_name":"R","payload":[{"x":1,"y":"é"}]}'):
        assert message_digest(other, NAMES) != a
    assert message_digest('{"payload":"\\ud800"}', NAMES) is not None
    assert [message_digest(x, NAMES) for x in (None, "", "nul", "[]", '{"a":NaN}')] == [None] * 5


def test_dedup(spark):
    m = _message("0.1.0", 3)
    rows = [(5, m), (2, json.dumps(json.loads(m), indent=1)), (9, m), (4, _message("0.1.0", 4)), (7, None), (8, "{"), (None, m), (2, m)]
    df = spark.createDataFrame(rows, "record_id long, message string").withColumn("topic_partition", F.lit(0)).withColumn("digest", F.lit("clash")).withColumn("ord", F.lit(0))
    d = with_digest(df)
    assert sorted(r[0] for r in repeated(d).collect()) == [5, 9]
    assert sorted(r[1] for r in keep_first(d).collect()) == [2, 4]
    first = d.where("ord = 4")
    assert sorted(r[1] for r in new_messages(d, first).collect()) == [2]


# ---- skew


def test_eager_join(spark):
    rng = random.Random(1)
    left = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([None, 1, 2, 3])) for _ in range(300)]
    right = [(rng.choice([1, 1, 2, 4, None]),) for _ in range(100)]
    a = compact(spark.createDataFrame(left, "k long, x long"), "k", "a", sums=("x",))
    b = compact(spark.createDataFrame(right, "k long"), "k", "b")
    got = {r["key"]: r["pairs"] for r in eager_join(a, b).collect() if r["key"] is not None}
    assert got == {k: sum(1 for x, _ in left for (y,) in right if x == y == k) for k in (1, 2, 3, 4)}
    heavy = [r["key"] for r in heavy_keys(a, "a_rows", 0.3).collect()]
    assert heavy == [1]
    empty = compact(spark.createDataFrame([], "k long, x long"), "k", "a", sums=("x",))
    assert heavy_keys(empty, "a_rows", 0.3).count() == 0 and eager_join(empty, b).count() == b.count()


# ---- timestamps


def _us(text: str, zone: str = "UTC") -> int:
    return int(datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone)).timestamp() * 1_000_000)


CASES = [
    ("2019-01-24", "Europe/Berlin", None, _us("2019-01-24T00:00:00", "Europe/Berlin")),
    ("2012-09-14 16:57:09 UTC", "Asia/Tokyo", None, _us("2012-09-14T16:57:09")),
    ("2015-03-04T11:03:10+01:00[Europe/Berlin]", "UTC", None, _us("2015-03-04T10:03:10")),
    ("2015-07-04T11:03:10[Europe/Berlin]", "UTC", None, _us("2015-07-04T09:03:10")),
    ("Aug 14, 2017 10:36:10 AM EDT", "UTC", None, _us("2017-08-14T14:36:10")),
    ("Jul 8, 2010 12:04:49 AM", "UTC", None, _us("2010-07-08T00:04:49")),
    ("Jul 8, 2010 12:04:49 PM", "UTC", None, _us("2010-07-08T12:04:49")),
    ("Mon, 25 Jul 2016 08:42:53 -0400", "UTC", None, _us("2016-07-25T12:42:53")),
    ("Tue Sep  8 00:59:44 2009", "UTC", None, _us("2009-09-08T00:59:44")),
    ("20220611T054702Z", "Asia/Kolkata", None, _us("2022-06-11T05:47:02")),
    ("20151107", "Asia/Kolkata", None, _us("2015-11-06T18:30:00")),
    ("05/03/2016", "UTC", "dmy", _us("2016-03-05T00:00:00")),
    ("05/03/2016 01:02:03", "UTC", "mdy", _us("2016-05-03T01:02:03")),
    ("2016/05/03", "UTC", "ymd", _us("2016-05-03T00:00:00")),
    ("July 17, 2011", "UTC", None, _us("2011-07-17T00:00:00")),
    ("16 Jul 2010", "UTC", None, _us("2010-07-16T00:00:00")),
    ("2009-12-25T04:05:58.689075+05:30", "UTC", None, _us("2009-12-24T22:35:58.689075")),
    ("1398554169", "Asia/Tokyo", None, 1398554169000000),
    ("1496392368110", "Asia/Tokyo", None, 1496392368110000),
    ("1678538633357753", "Asia/Tokyo", None, 1678538633357753),
    (" 2014-06-21T03:40 ", "UTC", None, _us("2014-06-21T03:40:00")),
    # twice: the earlier instant; skipped: moved ahead by the gap
    ("2016-10-30 02:30:00", "Europe/Berlin", None, _us("2016-10-30T00:30:00")),
    ("2016-03-27 02:30:00", "Europe/Berlin", None, _us("2016-03-27T01:30:00")),
    ("2016-02-29", None, None, _us("2016-02-29T00:00:00")),
    ("2019-01-24T10:00:00", "Nowhere/Atall", None, _us("2019-01-24T10:00:00")),
] + [(x, "UTC", None, None) for x in (None, "", "  ", "unknown", "-", "n/a", "0000-00-00", "2015-02-29", "2016-13-01", "2016-04-31", "2016-04-30 25:00:00", "2016-04-30 10:61:00", "12", "20151307", "13:00:00", "x" * 100_000, "31/31/2016", "Jul 8, 2010 13:00:00 AM")]


def test_utc_micros(spark):
    df = spark.createDataFrame([(i, v, z, o) for i, (v, z, o, _) in enumerate(CASES)], "i int, value string, zone_id string, date_order string").withColumn("__tz", F.lit(1))
    out = utc_micros(df, "value", "zone_id", "date_order")
    assert out.columns == ["i", "value", "zone_id", "date_order", "__tz", "utc_us"]
    got = {r["i"]: r["utc_us"] for r in out.collect()}
    assert {CASES[i][0]: got[i] for i in got} == {v: u for v, _, _, u in CASES}


def test_zones_and_bounds_are_parameters(spark):
    rows = [("2019-01-24T10:00:00 Mars/Base", "UTC"), ("2019-01-24T10:00:00[Mars/Base]", "UTC"), ("2019-01-24T10:00:00", "Mars/Base"), ("2019-01-24T10:00:00", None), ("100000000", "UTC"), ("2016-12-31T23:59:60Z", "UTC"), ("2016-12-31T23:59:61Z", "UTC")]
    df = spark.createDataFrame([(i, v, z) for i, (v, z) in enumerate(rows)], "i int, value string, zone string").withColumn("o", F.lit(None).cast("string"))
    noon = _us("2019-01-24T10:00:00")
    assert [r["utc_us"] for r in utc_micros(df, "value", "zone", "o").orderBy("i").collect()] == [None, None, noon, noon, None, None, None]
    other = utc_micros(df, "value", "zone", "o", default_zone=None, numbers=(90_000_000, 4_102_444_800), leap_seconds=True)
    assert [r["utc_us"] for r in other.orderBy("i").collect()] == [None, None, None, None, 100_000_000_000_000, _us("2017-01-01T00:00:00"), None]


def test_days(spark):
    rng = random.Random(3)
    days = [datetime(rng.randint(1, 9999), rng.randint(1, 12), rng.randint(1, 28), tzinfo=timezone.utc) for _ in range(300)]
    df = spark.createDataFrame([(d.strftime("%Y").zfill(4) + d.strftime("-%m-%d"),) for d in days], "value string").withColumns({"z": F.lit("UTC"), "o": F.lit(None).cast("string")})
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    got = {r["value"]: r["utc_us"] for r in utc_micros(df, "value", "z", "o").collect()}
    assert got == {d.strftime("%Y").zfill(4) + d.strftime("-%m-%d"): (d - epoch).days * 86_400_000_000 for d in days}


def test_dated_values(spark):
    v = spark.createDataFrame([(1, 2, '[{"published_date":"2019-01-24","patches":[null,{"patch_date":1398554169}]}]'), (2, None, '{"last_modified_date":"05/03/2016","patches":{"patch_date":"n/a"}}'), (3, 1, "{"), (4, 1, None)], "id long, feed_id int, statement string")
    m = spark.createDataFrame([(7, 2, '{"plugin_version":"1.0.0","payload":{"date":"2019-07-24T00:00:00"}}'), (8, 9, '{"plugin_version":"1.0.0","payload":"x"}'), (9, 9, "")], "record_id long, feed_id int, message string").withColumn("topic_partition", F.lit(0))
    f = spark.createDataFrame([(2, "Europe/Berlin", "dmy")], "feed_id int, zone_id string, date_order string")
    got = {tuple(r) for r in dated_values(v, m, f).collect()}
    assert got == {
        ("vulnerabilities", 1, "published_date", 0, _us("2019-01-23T23:00:00")),
        ("vulnerabilities", 1, "patch_date", 1, 1398554169000000),
        ("vulnerabilities", 2, "last_modified_date", 0, _us("2016-03-05T00:00:00")),
        ("pom_messages", 7, "date", 0, _us("2019-07-23T22:00:00")),
    }


# ---- nested


def test_nested(spark):
    inner = json.dumps({"plugin_name": "A", "payload": {"dir": "/a"}})
    calls = [(1, json.dumps({"plugin_name": "C", "input": {"plugin_name": "", "input": inner}})), (2, json.dumps({"plugin_name": "D", "payload": "", "input": "nonsense"})), (3, None), (4, "{"), (5, "[]"), (None, inner)]
    c = spark.createDataFrame(calls, "record_id long, message string").withColumn("label", F.lit("clash"))
    s = [(1, json.dumps([{"patches": [None, {"filename": "f", "new_changed_line_numbers": [1, None, "2", 3.0]}]}])), (2, json.dumps({"patches": {"new_changed_line_numbers": 7}})), (3, json.dumps({"patches": None})), (4, ""), (5, json.dumps({"patches": [{"filename": None, "new_changed_line_numbers": []}]}))]
    v = spark.createDataFrame(s, "id long, statement string")
    assert sorted(tuple(r) for r in stages_and_lines(c, v).collect()) == sorted(
        [("stage", 1, -1, 0, "C", ""), ("stage", 1, 1, 2, "A", "/a"), ("stage", 2, -1, 0, "D", ""), ("line", 1, 1, 0, "f", "1"), ("line", 1, 1, 2, "f", "2"), ("line", 1, 1, 3, "f", "3"), ("line", 2, 0, 0, "", "7")]
    )
    assert flatten(v.limit(0), "id", "statement").count() == 0 and flatten_chain(c.limit(0), "record_id", "message").count() == 0


def test_links_are_whole(spark):
    v = spark.createDataFrame([(1, json.dumps({"a": [{"b": [{"c": [1, 2]}, {"c": 3}]}, {"b": []}], "o": {"k": [{"x": "y"}]}}))], "id long, statement string")
    rows = flatten(v, "id", "statement").collect()
    ids = {r["row_id"] for r in rows}
    assert all(r["parent_id"] in ids for r in rows if r["parent_id"] is not None) and len(ids) == len(rows)
    assert sorted((r["table_name"], r["child_no"], r["plain"]) for r in rows if r["table_name"] == "a.b.c") == [("a.b.c", 0, "1"), ("a.b.c", 0, "3"), ("a.b.c", 1, "2")]


def _leaves(v) -> list[str]:
    """Every plain value in a parsed value, as text."""
    if isinstance(v, dict):
        return [x for y in v.values() for x in _leaves(y)]
    if isinstance(v, list):
        return [x for y in v for x in _leaves(y)]
    t = scalar_text(v)
    return [] if t is None else [t]


SHAPES = [
    {"a": [[{"x": 1}, {"x": 2}], [3]]},
    {"a.b": 1, "a": {"b": 2}},
    {"a": [{"b": [[["deep"]], None, []]}, "bare", {"b": "only"}]},
    {"x": {"k": [1]}, "y": {"k": [2]}, "k": [3], "x.k": [4]},
    {"a": [], "b": {}, "": [5, {"": [6]}], "/:[": {"\\\\": 7}},
    {"a:0/b": [1], "a": [{"b": [2]}]},
    {"a": {"q": "an object where others have a list"}},
]


def test_no_shape_loses_a_value(spark):
    rows = [(i, json.dumps(s)) for i, s in enumerate(SHAPES)] + [(100, json.dumps([*SHAPES, None, 7])), (101, "[]"), (102, json.dumps([[{"lost": "no object"}]]))]
    df = spark.createDataFrame(rows, "id long, statement string")
    got: dict = {}
    ids = []
    for r in flatten(df, "id", "statement").collect():
        got.setdefault(r["record_key"], []).extend([r["plain"]] * (r["plain"] is not None) + list((r["fields"] or {}).values()))
        ids.append((r["row_id"], r["parent_id"]))
    assert {k: sorted(v) for k, v in got.items()} == {**{i: sorted(_leaves(s)) for i, s in enumerate(SHAPES)}, 100: sorted(_leaves(SHAPES))}
    assert len({i for i, _ in ids}) == len(ids) and {p for _, p in ids if p is not None} <= {i for i, _ in ids}
    chains = [(1, json.dumps({"plugin_name": "C", "deps": [[{"n": 1}], "x"], "input": {"deps": [2], "input": json.dumps({"p": {"deps": ["y"]}, "input": ["end"]})}})), (2, json.dumps({"input": "text"}))]
    flat = flatten_chain(spark.createDataFrame(chains, "record_id long, message string"), "record_id", "message", whole=True).collect()
    values = sorted(x for r in flat for x in [r["plain"]] * (r["plain"] is not None) + list((r["fields"] or {}).values()))
    assert values == sorted(["C", "1", "x", "2", "y", "end", "text"])
    assert {r["table_name"] for r in flat} == {"input", "input.deps", "input.deps[]", "input.p.deps", "input.input"}


def test_merged_schema(spark):
    df = spark.createDataFrame([(1, '{"a":[{"b":1},null,"x"],"c.d":null}'), (2, '[{"a":{"b":"t"}},{"a":[[true]]}]'), (3, None), (4, "{")], "id long, statement string")
    got = {tuple(r) for r in merged_schema(df, "statement").collect()}
    assert got == {("a", "array", 2), ("a", "object", 1), ("a[]", "object", 1), ("a[]", "null", 1), ("a[]", "string", 1), ("a[]", "array", 1), ("a[][]", "boolean", 1), ("a.b", "number", 1), ("a.b", "string", 1), ("c\\.d", "null", 1)}


def test_dates_of_several_statements(spark):
    v = spark.createDataFrame([(1, None, '[{"published_date":"2019-01-24"},{"published_date":"2019-01-25","patches":[{"patch_date":"2020-01-01"}]},3]')], "id long, feed_id int, statement string")
    m = spark.createDataFrame([], "record_id long, topic_partition int, feed_id int, message string")
    f = spark.createDataFrame([], "feed_id int, zone_id string, date_order string")
    got = sorted((r["field_name"], r["utc_us"]) for r in dated_values(v, m, f).collect())
    assert got == [("patch_date", _us("2020-01-01T00:00:00")), ("published_date", _us("2019-01-24T00:00:00")), ("published_date", _us("2019-01-25T00:00:00"))]


# ---- hierarchy


def brute_hierarchy(links: list[tuple[str | None, str | None]]) -> set[tuple]:
    parent: dict[str, str] = {}
    nodes: set[str] = set()
    for a, b in links:
        if a is None:
            continue
        nodes |= {a} | ({b} if b is not None else set())
        if b is not None:
            parent[a] = min(b, parent.get(a, b))
    kids: dict[str, list[str]] = {}
    for a, b in parent.items():
        kids.setdefault(b, []).append(a)
    out = set()
    for n in nodes:
        below, todo = set(), list(kids.get(n, []))
        while todo:
            x = todo.pop()
            if x not in below:
                below.add(x)
                todo += kids.get(x, [])
        below.discard(n)
        path, x, cyclic = [n], n, False
        while x in parent:
            x = parent[x]
            if x in path:
                cyclic = True
                break
            path.append(x)
        out.add((n, "", -1, "", len(below)) if cyclic else (n, path[-1], len(path) - 1, " > ".join(path[::-1]), len(below)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_hierarchies(spark, seed):
    rng = random.Random(seed)
    links: list[tuple[str | None, str | None]] = [(None, "x"), (None, None), ("self", "self"), ("below", "self"), ("alone", None), ("a", "b"), ("a", "c")]
    links += [(f"d{i}", f"d{i - 1}") for i in range(1, 80)]  # a deep chain
    links += [(f"s{i}", "star") for i in range(150)]  # a wide parent
    links += [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [(f"h{i}", f"c{i % 7}") for i in range(9)] + [(f"hh{i}", f"h{i % 9}") for i in range(20)]
    links += [(f"r{i}", f"r{rng.randrange(0, 60)}" if rng.random() < 0.9 else None) for i in range(60)]
    links += links[:50]
    df = spark.createDataFrame(links, "node string, parent string").withColumn("id", F.lit(1))
    rows = [tuple(r) for r in hierarchies(df, chunk=[8, 64, 8192, 3][seed], buckets=[64, 4, 1, 16][seed]).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_hierarchy(links)
    chosen = spark.createDataFrame([("star",), ("d3",), ("c2",), ("h4",), ("self",), ("nowhere",), (None,), ("r0",), ("star",), ("b",)], "node string")
    pairs = [tuple(r) for r in descendants(place(df), chosen, chunk=[8, 64, 8192, 3][seed]).collect()]
    parent = {a: min(b for x, b in links if x == a and b is not None) for a in {a for a, b in links if a is not None and b is not None}}
    want = set()
    for n in {a for a, _ in links if a} | {b for _, b in links if b}:
        x, seen = n, {n}
        while x in parent:
            x = parent[x]
            if x in seen:
                break
            want.add((x, n))
            seen.add(x)
    wanted = {r[0] for r in chosen.collect()}
    assert len(pairs) == len(set(pairs)) and set(pairs) == {p for p in want if p[0] in wanted}
    assert [tuple(r) for r in further_parents(df).where("node = 'a'").collect()] == [("a", "b", "c")]


def test_no_hierarchy(spark):
    df = spark.createDataFrame([], "node string, parent string")
    assert hierarchies(df).count() == 0


def test_coordinates():
    same = {parse_coordinate(x) for x in ("g.x:a:1", " g.x : a : 1\n", "g.x:a:pom:1", "pkg:maven/g.x/a@1", "pkg:maven/g.x/a@1?type=pom")}
    assert same == {"g.x:a:1"}
    assert [parse_coordinate(x) for x in (None, "", "a:b", 7, "a::1", "pkg:maven/a")] == [None] * 6
