"""Call-graph records of three languages."""

from __future__ import annotations

import json

import pytest

from pkgloom.operators import ingest as i
from pkgloom.operators.stitching import ancestors

JAVA = {
    "forge": "mvn", "product": "org.kiln:glaze", "version": "4.1.0", "generator": "hand",
    "cha": {
        "internalTypes": {"/kiln/Oven": {"access": "public", "final": True, "superClasses": ["/kiln/Heater", "/java.lang/Object"], "superInterfaces": ["/kiln/Timed"], "sourceFile": "Oven.java", "methods": {"11": {"uri": "/kiln/Oven.fire(%2Fjava.lang%2Fint)V", "metadata": {"first": 140, "last": 163, "defined": True, "access": "public"}}, "12": {"uri": "/kiln/Oven.cool()V", "metadata": {}}}}},
        "externalTypes": {"/clay/Pot": {"methods": {"31": {"uri": "/clay/Pot.crack()V", "metadata": {}}}}},
    },
    "call-sites": [["11", "31", {"4": {"line": 151, "type": "invokevirtual", "receiver": "[/clay/Pot,/clay/Jug]"}, "8": {"line": 158, "type": "invokestatic", "receiver": "[/clay/Pot]"}}], ["11", "12", {}], ["12", "31", {"2": {"line": 171, "type": "unheard of", "receiver": "[]"}}]],
}
PYTHON = {
    "product": "tidewatch", "timestamp": 1600000000,
    "modules": {"internal": {"/harbour/": {"sourceFile": "harbour.py", "namespaces": {"21": {"namespace": "/harbour/", "metadata": {"first": 1, "last": 88}}, "22": {"namespace": "/harbour/ebb()", "metadata": {"first": "34", "last": 41}}}}}, "external": {"moon": {"sourceFile": "", "namespaces": {"23": {"namespace": "//moon//moon.phase", "metadata": {}}}}}},
    "graph": {"internalCalls": [["21", "22"], ["21", "22"]], "externalCalls": [["22", "23"]]},
}
C = {
    "product": "sundial", "architecture": "riscv64",
    "functions": {
        "internal": {"binaries": {"dial": {"methods": {"51": {"uri": "/dial;C/cast_shadow()", "files": ["gnomon.c"], "metadata": {"first": "203", "last": "219", "defined": True, "access": "public"}}}}}, "static_functions": {"methods": {"52": {"uri": "/;noon.c;wind()", "metadata": {"first": "unknown"}}}}},
        "external": {"products": {"libsky": {"methods": {"53": {"uri": "//libsky/;C/azimuth()", "files": []}}}}, "undefined": {"methods": {"54": {"uri": "///nowhere;C/dusk()"}}}},
    },
    "graph": {"internalCalls": [["51", "52"]], "resolvedCalls": [["51", "54"]]},
}


@pytest.fixture(scope="module")
def records(spark):
    def rows(record):
        return spark.createDataFrame([(1, json.dumps(record)), (2, None), (3, "{"), (4, "{}"), (5, "")], "graph long, json string")

    return {"java": rows(JAVA), "c": rows(C), "python": rows(PYTHON)}


def test_java(spark, records):
    r = records["java"]
    mods = {m["module"]: m for m in i.java_modules(r).collect()}
    assert mods["/kiln/Oven"]["supers"] == ["/kiln/Heater", "/java.lang/Object", "/kiln/Timed"] and mods["/clay/Pot"]["supers"] == [] and mods["/kiln/Oven"]["final"]
    calls = {c["local_id"]: c for c in i.java_callables(r).collect()}
    assert (calls[11]["line_start"], calls[11]["line_end"], calls[11]["defined"], calls[11]["scope"]) == (140, 163, True, "internal")
    assert calls[12]["line_start"] is None and not calls[31]["defined"]
    edges = {(e["source"], e["target"]): e["receivers"] for e in i.java_edges(r).collect()}
    assert [(x["line"], x["call_type"], x["types"]) for x in edges[11, 31]] == [(151, "VIRTUAL", ["/clay/Pot", "/clay/Jug"]), (158, "STATIC", ["/clay/Pot"])]
    assert edges[11, 12] == [] and edges[12, 31][0]["call_type"] is None and edges[12, 31][0]["types"] == []
    assert {h["graph"]: h["timestamp"] for h in i.heads(r, i.JAVA).collect()}[1] == -1
    supers = i.java_modules(r).selectExpr("module AS type", "posexplode(supers) AS (idx, parent)")
    assert {a["ancestor"] for a in ancestors(supers).collect()} == {"/kiln/Heater", "/java.lang/Object", "/kiln/Timed"}


def test_c(records):
    calls = {c["local_id"]: c for c in i.c_callables(records["c"]).collect()}
    assert (calls[51]["module"], calls[51]["line_start"], calls[51]["scope"]) == ("gnomon.c_module", 203, "internal")
    assert calls[52]["line_start"] is None and calls[53]["module"] == "libsky_module" and calls[54]["module"] == "undefined_module"
    assert {(e["scope"], e["source"], e["target"]) for e in i.plain_edges(records["c"], i.C).collect()} == {("internal", 51, 52), ("resolved", 51, 54)}


def test_python(records):
    calls = {c["local_id"]: c for c in i.python_callables(records["python"]).collect()}
    assert calls[22]["uri"] == "/harbour/ebb()" and calls[22]["line_start"] == 34 and calls[23]["scope"] == "external"
    assert sorted((e["source"], e["target"]) for e in i.plain_edges(records["python"], i.PYTHON).collect()) == [(21, 22), (22, 23)]
