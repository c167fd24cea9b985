"""Label propagation and orders of a graph whose nodes fit in a task: arcs in files, a few numbers for each node in memory.

A task runs a whole propagation, so that a round is a pass over arrays and no job; what has no order of rounds, as gap costs,
goes by files of arcs. The tables are lazy: the propagations of a union run beside each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgloom.operators.all_pairs import Stored, _read

NODES = 4_000_000  # of a graph that is ordered in tasks
LINKS = 100_000_000
KEPT_LINKS = 32_000_000  # that a task keeps in memory; the rest is read in every round
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxhash64(seed: int, *longs: np.ndarray) -> np.ndarray:
    """As the SQL function of that name for bigint columns followed by an int."""
    h = np.full(len(longs[0]), 42, np.uint64)
    for x in longs:
        h = h + _P5 + np.uint64(8) ^ _rotated(x.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
        h = _mixed(_rotated(h, 27) * _P1 + _P4)
    h = h + _P5 + np.uint64(4) ^ np.array([seed & 0xFFFFFFFF], np.uint64) * _P1
    return _mixed(_rotated(h, 23) * _P2 + _P3).view(np.int64)


class _Range(NamedTuple):
    """Sources from ``low`` up to, not including, ``end``, and the files that hold their arcs."""

    low: int
    end: int | None
    paths: list[str]


def _groups(files: list[tuple[str, int, int]]) -> list[_Range]:
    """Ranges of sources of about a file each; a source whose arcs are in several files is in one range."""
    lows = sorted({low for _, low, _ in files})
    return [_Range(low, end, [p for p, a, b in files if b >= low and (end is None or a < end)]) for low, end in zip(lows, [*lows[1:], None])]


def _ids(node_files: list[str]) -> np.ndarray:
    return np.sort(np.concatenate([_read(f, ["node"])[0] for f in node_files]))


def _arcs(ids: np.ndarray, group: _Range) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst) of a range as numbers of nodes."""
    out = []
    for path in group.paths:
        src, dst = _read(path, ["src", "dst"])
        use = (src >= group.low) & (True if group.end is None else src < group.end)
        out.append([np.searchsorted(ids, x[use]).astype(np.int32) for x in (src, dst)])
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """The place of each row in the order of the keys, the first key first."""
    places = np.empty(len(keys[0]), np.int64)
    places[np.lexsort(keys[::-1])] = np.arange(len(places))
    return places


def _best(to: np.ndarray, near: np.ndarray, volume: np.ndarray, gamma: float, ids: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their best labels) for arcs from neighbours that have the labels ``near``."""
    n = len(ids)
    key = np.sort(to.astype(np.int64) * n + near)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    f = np.diff(np.r_[starts, len(key)])
    node, label = np.divmod(key[starts], n)
    v = f - gamma * (volume[label] + 1 - f)

    def best(of: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        return of == np.repeat(np.maximum.reduceat(of, starts), np.diff(np.r_[starts, len(node)]))

    top = best(v)
    node, label = node[top], label[top]
    top = best(xxhash64(seed, ids[label], ids[node]))
    node, label = node[top], label[top]
    last = np.r_[node[1:] != node[:-1], True]
    return node[last], label[last]


def propagated(links: Stored, gamma: float, rounds: int, gain: float, seed: int) -> DataFrame:
    """(node, label, number): the labels, and the places of the nodes in the order of label and node. ``links`` has both directions and no loops."""
    node_files, groups = links.node_files, _groups(links.arc_files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(b.num_rows for b in batches):
            return
        ids = _ids(node_files)
        n = len(ids)
        kept, size = {}, 0
        label, quiet = np.arange(n, dtype=np.int32), 0
        for r in range(rounds):
            volume, may, new = np.bincount(label, minlength=n), xxhash64(seed + r, ids) % 2 == 0, label.copy()
            for k, group in enumerate(groups):
                to, near = kept[k] if k in kept else _arcs(ids, group)
                if k not in kept and size + len(to) <= KEPT_LINKS:
                    kept[k], size = (to, near), size + len(to)
                use = may[to]
                if use.any():
                    node, best = _best(to[use], label[near[use]], volume, gamma, ids, seed)
                    new[node] = best
            moved, label = int((new != label).sum()), new
            quiet = quiet + 1 if moved <= gain * n else 0
            if quiet == 2:
                break
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label]), pa.array(_ranks(label, np.arange(n)))], names=["node", "label", "number"])

    # one of the two partitions is empty; single ones would be one task in a union
    return links.scratch.spark.range(0, 1, 1, 2).mapInArrow(run, "node long, label long, number long")


def _column(ids: np.ndarray, files: list[str], name: str) -> np.ndarray:
    """A column of a table (node, ...) in the order of ``ids``; -1 where there is no row."""
    out = np.full(len(ids), -1, np.int64)
    for f in files:
        node, x = _read(f, ["node", name])
        out[np.searchsorted(ids, node)] = x
    return out


def gap_costs(arcs: Stored, order: list[str]) -> DataFrame:
    """(cost): as ``log_gap_cost`` in ``graph``, for an order in files."""
    spark, node_files, groups = arcs.scratch.spark, arcs.node_files, _groups(arcs.arc_files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [k for b in batches for k in b.column(0).to_pylist()]
        if not mine:
            return
        ids = _ids(node_files)
        number, cost = _column(ids, order, "number"), 0
        span = len(ids) + 1
        for k in mine:
            src, dst = _arcs(ids, groups[k])
            s, t = number[src], number[dst]
            use = (s >= 0) & (t >= 0)
            s, t = np.divmod(np.sort(s[use] * span + t[use]), span)
            if len(s):
                first = np.r_[True, s[1:] != s[:-1]]
                gap = np.abs(t - np.where(first, s, np.r_[0, t[:-1]]))
                cost += int(np.ceil(np.log2(np.maximum(gap, 1))).sum())
        yield pa.RecordBatch.from_arrays([pa.array([cost], pa.int64())], names=["cost"])

    tasks = max(1, min(len(groups), spark.sparkContext.defaultParallelism))
    return spark.range(0, len(groups), 1, tasks).mapInArrow(run, "cost long").agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))


def combined(links: Stored, layers: list[list[str]]) -> DataFrame:
    """(node, number): the labels of the last layer combined with those of each layer and again of the last, the nodes in their order."""
    return links.scratch.spark.range(0, 1, 1, 1).mapInArrow(partial(_combined, links.node_files, layers), "node long, number long")


def _combined(node_files: list[str], layers: list[list[str]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not sum(b.num_rows for b in batches):
        return
    ids = _ids(node_files)
    read = lambda files: np.searchsorted(ids, _column(ids, files, "label"))
    best = read(layers[-1])
    label = best
    for files in layers:
        for major in (read(files), best):
            first = label[major]
            at = np.lexsort((label, major, first))
            new = np.r_[False, (major[at][1:] != major[at][:-1]) | (label[at][1:] != label[at][:-1])]
            label = np.empty_like(label)
            label[at] = np.cumsum(new)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_ranks(label, np.arange(len(ids))))], names=["node", "number"])
