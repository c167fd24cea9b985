"""Measures over all pairs of nodes that never write a pair: searches by blocks of sources.

The arcs are written once, in the order of their sources, to the shared folder. A task takes blocks of sources, keeps for
every node which sources of the block have reached it (a bit each, or a number of paths) and reads those files of arcs whose
nodes stand on the frontier. What leaves a task is one row for each node. A block is as wide as its state
may be large, and files are read one at a time, so memory does not grow with the arcs.

Shares of paths are counted within what a block reaches, held in memory up to ``HELD_ARCS`` arcs. Each level goes the cheapest
way: from the frontier's nodes along their arcs, from the nodes not yet reached back along theirs, or for all sources of
the block at once, a row for each node, in the narrowest numbers that hold the sums.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgloom.session import Scratch

FILE_ARCS = 500_000
KEPT_ARCS = 6_000_000  # of the files that a task keeps in memory
STATE = 24_000_000  # bytes of one array of a block
CELLS = 4_000_000  # of a dense part of the matrix
HELD_ARCS = 24_000_000  # of what a block reaches; beyond, files are read for each level
PART = 1024  # nodes of components that are searched together
SPREAD = 250_000  # arcs taken at a time
TILE, ROWS = 8192, 512  # rows added together: from so many nodes, to so many
PAIR_NS, ROW_NS, BYTE_NS, CELL_NS = 12.0, 10.0, 0.2, 10.0  # costs: an arc for one source; an arc for all, and a byte of its row; a cell of the state
INTEGERS = {"tinyint", "smallint", "int", "bigint"}


class Stored(NamedTuple):
    """Distinct arcs in files (path, first and last source) and their nodes, as tables and for tasks."""

    scratch: Scratch
    nodes: DataFrame
    n: int
    node_files: list[str]
    arc_files: list[tuple[str, int, int]]


def stored(edges: DataFrame) -> Stored:
    """Writes the arcs (src, dst: integers; they may repeat), each once, and their nodes."""
    kinds = {k: t for k, t in edges.dtypes if k in ("src", "dst")}
    if not set(kinds.values()) <= INTEGERS:
        raise TypeError(f"nodes are integers here, not {kinds}; number them first")
    scratch = Scratch(edges.sparkSession)
    found, at, m = scratch.counted(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").sortWithinPartitions("src", "dst"))
    # repeats go where the ranges are made, so that arcs are shuffled once
    arcs, _ = scratch.write(found.repartitionByRange(-(-m // FILE_ARCS) or 1, "src", "dst").distinct().sortWithinPartitions("src", "dst"))
    scratch.drop(at)
    nodes, _, n = scratch.counted(arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    path = F.col("_metadata.file_path")
    arc_files = sorted((r["p"], r["low"], r["high"]) for r in arcs.groupBy(path.alias("p")).agg(F.min("src").alias("low"), F.max("src").alias("high")).collect())
    node_files = sorted(r["p"] for r in nodes.select(path.alias("p")).distinct().collect())
    return Stored(scratch, nodes, n, node_files, arc_files)


def _read(path: str, columns: list[str]) -> list[np.ndarray]:
    fs, at = FileSystem.from_uri(path)
    got = pq.read_table(at, columns=columns, filesystem=fs, use_threads=False)
    return [got.column(c).to_numpy() for c in columns]


class _Arcs:
    """The files of arcs as a task sees them: by numbers of nodes, the last used kept."""

    def __init__(self, node_files: list[str], arc_files: list[tuple[str, int, int]]):
        self.ids = np.sort(np.concatenate([_read(f, ["node"])[0] for f in node_files]))
        self.gapless = len(self.ids) > 0 and self.ids[-1] - self.ids[0] + 1 == len(self.ids)
        self.files = [(path, *np.searchsorted(self.ids, (low, high))) for path, low, high in arc_files]
        self.kept: OrderedDict[str, tuple] = OrderedDict()

    def _load(self, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if path in self.kept:
            self.kept.move_to_end(path)
            return self.kept[path]
        s, d = ((x - self.ids[0] if self.gapless else np.searchsorted(self.ids, x)).astype(np.int32) for x in _read(path, ["src", "dst"]))
        self.kept[path] = s, d, np.argsort(d, kind="stable").astype(np.int32)
        while len(self.kept) > 1 and sum(len(x[0]) for x in self.kept.values()) > KEPT_ARCS:
            self.kept.popitem(last=False)
        return s, d, self.kept[path][2]

    def between(self, src: np.ndarray, dst: np.ndarray, forward: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(from, to) of the arcs of each file whose ends are marked in both arrays, in the order of ``to``; backward: from dst to src."""
        marked = np.flatnonzero(src)
        for path, low, high in self.files:
            k = np.searchsorted(marked, low)
            if k == len(marked) or marked[k] > high:
                continue
            s, d, by_dst = self._load(path)
            use = src[s] & dst[d]
            if forward:
                use = by_dst[use[by_dst]]
                a, b = s[use], d[use]
            else:
                a, b = d[use], s[use]
            if len(a):
                yield a, b


def _carry(arcs: Iterator[tuple[np.ndarray, np.ndarray]], x: np.ndarray, out: np.ndarray, add: np.ufunc) -> np.ndarray:
    """Adds the rows of ``x`` at the arcs' beginnings to those of ``out`` at their ends; which ends had any."""
    reached = np.zeros(len(out), bool)
    step = max(1, STATE // (x.shape[1] * x.itemsize))
    for a, b in arcs:
        reached[b] = True
        if add is np.add and _dense(a, b, x, out):
            continue
        for k in range(0, len(a), step):
            to = b[k : k + step]
            starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            ends = to[starts]
            out[ends] = add(out[ends], add.reduceat(x[a[k : k + step]], starts, axis=0))
    return np.flatnonzero(reached)


def _dense(a: np.ndarray, b: np.ndarray, x: np.ndarray, out: np.ndarray) -> bool:
    """Carries sums by a product of matrices, if the arcs fill enough of theirs."""
    rows, cols = np.unique(a), np.unique(b)
    if len(rows) * len(cols) > min(CELLS, 32 * len(a)):
        return False
    m = np.zeros((len(cols), len(rows)))
    m[np.searchsorted(cols, b), np.searchsorted(rows, a)] = 1.0
    out[cols] += m @ x[rows]
    return True


def _by_blocks(g: Stored, width: int, work: Callable[[_Arcs, Iterator[tuple[int, int]]], Iterator[pa.RecordBatch]], schema: str, tasks: int | None = None) -> DataFrame:
    """The rows of ``work``(arcs, blocks of sources as ranges of node numbers) over all blocks, written."""
    spark, n = g.scratch.spark, g.n
    blocks = -(-n // width)
    node_files, arc_files = g.node_files, g.arc_files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = (k for batch in batches for k in batch.column(0).to_pylist())
        first = next(mine, None)
        if first is None:
            return
        ranges = ((k * width, min(n, (k + 1) * width)) for k in (first, *mine))
        yield from work(_Arcs(node_files, arc_files), ranges)

    tasks = max(1, min(blocks, tasks or max(48, 4 * spark.sparkContext.defaultParallelism)))
    return g.scratch.write(spark.range(0, blocks, 1, tasks).mapInArrow(run, schema))[0]


def distance_sums(g: Stored, max_depth: int | None = None) -> DataFrame:
    """(node, n, s, h): from how many nodes a node is reached, itself included, and the sums of their distances and of 1 / distance."""
    width = 64 * max(1, min(64, STATE // (8 * max(g.n, 1))))

    def work(arcs: _Arcs, ranges: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        n = len(arcs.ids)
        count, total, inverse = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        for low, high in ranges:
            bit = np.arange(high - low)
            full = np.zeros(width // 64, np.uint64)
            np.bitwise_or.at(full, bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
            seen, new = np.zeros((n, width // 64), np.uint64), np.zeros((n, width // 64), np.uint64)
            new[low + bit, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
            seen[low:high] = new[low:high]
            unfilled = np.ones(n, bool)
            at, depth = np.arange(low, high), 0
            while True:
                c = np.bitwise_count(new[at]).sum(axis=1, dtype=np.int64)
                count[at] += c
                total[at] += depth * c
                inverse[at] += c / depth if depth else 0.0
                unfilled[at] = (seen[at] != full).any(axis=1)
                if not len(at) or depth == max_depth:
                    break
                depth += 1
                active = np.zeros(n, bool)
                active[at] = True
                found = np.zeros_like(new)
                ends = _carry(arcs.between(active, unfilled), new, found, np.bitwise_or)
                found[ends] &= ~seen[ends]
                seen[ends] |= found[ends]
                at, new = ends[found[ends].any(axis=1)], found
        hit = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (arcs.ids, count, total, inverse)], names=["node", "n", "s", "h"])

    parts = _by_blocks(g, width, work, "node long, n long, s long, h double")
    return parts.groupBy("node").agg(*[F.sum(x).alias(x) for x in ("n", "s", "h")])


class _Ends:
    """The other ends of the arcs of each node: those of node k are ``ends[ptr[k] : ptr[k + 1]]``, in order."""

    def __init__(self, ptr: np.ndarray, ends: np.ndarray):
        self.ptr, self.ends, self.degree = ptr, ends, np.diff(ptr)
        self.tiles: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None

    def arcs(self, cells: np.ndarray, w: int) -> int:
        """How many arcs the cells have, of many estimated by some; only for the choice of a way."""
        step = len(cells) // SPREAD + 1
        return int(self.degree[cells[::step] // w].sum()) * step

    def spread(self, cells: np.ndarray, w: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(which cells, their numbers of arcs, the cells at the other ends) for parts of ``cells`` (node * w + source)."""
        node = cells // w
        count = self.degree[node]
        upto = np.cumsum(count)
        k = 0
        while k < len(cells):
            end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + SPREAD, "right")))
            c = count[k:end]
            starts = np.cumsum(c) - c
            at = np.arange(c.sum()) + np.repeat(self.ptr[node[k:end]] - starts, c)
            yield slice(k, end), c, self.ends[at] * np.int64(w) + np.repeat(cells[k:end] % w, c)
            k = end

    def gathered(self, cells: np.ndarray, w: int, x: np.ndarray) -> np.ndarray:
        """For each cell the sum of ``x`` at the other ends."""
        out = np.zeros(len(cells))
        some = np.flatnonzero(self.degree[cells // w])
        for part, c, far in self.spread(cells[some], w):
            out[some[part]] = np.add.reduceat(x[far], np.cumsum(c) - c)
        return out

    def rows(self, x: np.ndarray, out: np.ndarray) -> None:
        """Adds to each row of ``out`` those of ``x`` at the other ends, the k-th ends of many nodes at a time; by tiles of ``x`` that stay in the cache."""
        n, w = out.shape
        if self.tiles is None:
            tiles = -(-n // TILE)
            count = np.zeros((n, tiles), np.int32)
            for low in range(0, n, TILE):  # so many nodes at a time
                high = min(n, low + TILE)
                node = np.repeat(np.arange(high - low), self.degree[low:high])
                key = node * tiles + self.ends[self.ptr[low] : self.ptr[high]] // TILE
                count[low:high] = np.bincount(key, minlength=(high - low) * tiles).reshape(-1, tiles)
            start = self.ptr[:-1, None] + np.cumsum(count, axis=1) - count
            self.tiles = []
            for t in range(tiles):
                order = np.argsort(-count[:, t], kind="stable")[: np.count_nonzero(count[:, t])]
                self.tiles.append((order, start[order, t], count[order, t]))
        total, more = np.empty((ROWS, w), x.dtype), np.empty((ROWS, w), x.dtype)
        for order, start, count in self.tiles:
            for low in range(0, len(order), ROWS):
                node, first, c = order[low : low + ROWS], start[low : low + ROWS], count[low : low + ROWS]
                np.take(x, self.ends[first], axis=0, out=total[: len(node)], mode="clip")
                for k, have in enumerate((len(c) - np.searchsorted(c[::-1], np.arange(1, c[0]), "right")).tolist(), 1):
                    np.take(x, self.ends[first[:have] + k], axis=0, out=more[:have], mode="clip")
                    np.add(total[:have], more[:have], out=total[:have])
                out[node] += total[: len(node)]


def _ends(src: np.ndarray, dst: np.ndarray, n: int) -> _Ends:
    key = src * np.int64(n) + dst
    key.sort()
    return _Ends(np.r_[0, np.cumsum(np.bincount(key // n, minlength=n))], (key % n).astype(np.int32))


class _Part:
    """Nodes without arcs to others, by numbers of their own, with the arcs among them."""

    def __init__(self, nodes: np.ndarray, out: _Ends):
        self.nodes, self.n, self.out = nodes, len(nodes), out
        self.into = _ends(out.ends, np.repeat(np.arange(self.n), out.degree), self.n)

    def _by_row(self, w: int, bytes_: int) -> float:
        return len(self.out.ends) * max(ROW_NS, w * bytes_ * BYTE_NS) + self.n * w * CELL_NS

    def forward(self, front: np.ndarray, paths: np.ndarray, place: np.ndarray, x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells first reached from the frontier, their numbers of paths)"""
        high = paths[front].max() * self.into.degree.max()
        kind = np.uint16 if high < 2**16 else np.float32 if high < 2**24 else np.float64
        arcs = self.out.arcs(front, w)
        by_arc, by_row = arcs * PAIR_NS, self._by_row(w, kind().itemsize)
        if min(by_arc, by_row) > len(place) * CELL_NS:
            unseen = np.flatnonzero(place == 0)
            if self.into.arcs(unseen, w) * PAIR_NS < min(by_arc, by_row):
                x[front] = paths[front]
                found = self.into.gathered(unseen, w, x)
                x[front] = 0.0
                return unseen[found > 0], found[found > 0]
        if by_row < by_arc:
            rows, found = np.zeros((self.n, w), kind), np.zeros((self.n, w), kind)
            rows.reshape(-1)[front] = paths[front]
            self.into.rows(rows, found)
            found = found.reshape(-1)
            new = np.flatnonzero((found > 0) & (place == 0))
            return new, found[new].astype(float)
        few, cells = arcs * 4 <= len(x), [front[:0]]
        for part, c, far in self.out.spread(front, w):
            value = np.repeat(paths[front[part]], c)
            if few:
                free = place[far] == 0
                far, value = far[free], value[free]
                cells.append(far)
            np.add.at(x, far, value)
        new = np.unique(np.concatenate(cells)) if few else np.flatnonzero((x > 0) & (place == 0))
        found = x[new]
        if few:
            x[new] = 0.0
        else:
            x[:] = 0.0
        return new, found

    def backward(self, at: np.ndarray, value: np.ndarray, up: np.ndarray, x: np.ndarray, w: int) -> np.ndarray:
        """For the cells ``up`` the sums of the values of those cells ``at`` that their arcs lead to."""
        by_out, by_in, by_row = self.out.arcs(up, w) * PAIR_NS, self.into.arcs(at, w) * PAIR_NS, self._by_row(w, 8)
        if by_row < min(by_out, by_in):
            rows, got = np.zeros((self.n, w)), np.zeros((self.n, w))
            rows.reshape(-1)[at] = value
            self.out.rows(rows, got)
            return got.reshape(-1)[up]
        if by_out <= by_in:
            x[at] = value
            got = self.out.gathered(up, w, x)
            x[at] = 0.0
            return got
        touched = []
        for part, c, far in self.into.spread(at, w):
            np.add.at(x, far, np.repeat(value[part], c))
            if by_in <= len(x) * PAIR_NS:
                touched.append(far)
        got = x[up]
        if by_in > len(x) * PAIR_NS:
            x[:] = 0.0
        for far in touched:
            x[far] = 0.0
        return got

    def shares(self, sources: np.ndarray) -> np.ndarray:
        """What hangs on each node in the searches from ``sources``."""
        w, total = max(1, min(256, STATE // (4 * self.n))), np.zeros(self.n)
        for k in range(0, len(sources), w):
            total += self._block(sources[k : k + w])
        return total

    def _block(self, sources: np.ndarray) -> np.ndarray:
        w = len(sources)
        place, paths, x = np.zeros(self.n * w, np.int32), np.zeros(self.n * w), np.zeros(self.n * w)  # distance + 1, 0 where a source has not come
        levels = [np.sort(sources * w + np.arange(w))]
        place[levels[0]] = paths[levels[0]] = 1
        left = len(place) - w
        while left and len(levels[-1]):
            new, found = self.forward(levels[-1], paths, place, x, w)
            place[new], paths[new] = len(levels) + 1, found
            levels.append(new)
            left -= len(new)
        del place
        behind = np.zeros(self.n * w)  # what hangs on a node
        for depth in range(len(levels) - 1, 1, -1):
            at, up = levels.pop(), levels[-1]
            if len(at):
                behind[up] = paths[up] * self.backward(at, (1.0 + behind[at]) / paths[at], up, x, w)
        return behind.reshape(self.n, w).sum(axis=1)


def _components(arcs: _Ends) -> np.ndarray:
    """For each node the smallest of its component, in either direction of the arcs."""
    label = np.arange(len(arcs.degree))
    some = np.flatnonzero(arcs.degree)
    while len(some):
        was = label.copy()
        low = np.minimum(np.minimum.reduceat(label[arcs.ends], arcs.ptr[some]), label[some])
        np.minimum.at(label, was[some], low)
        np.minimum.at(label, arcs.ends, np.repeat(low, arcs.degree[some]))
        label = label[label]
        if (label == was).all():
            break
    return label


class _Reached:
    """What a block of sources reaches, in parts that are not connected; kept for the blocks that follow."""

    def __init__(self, arcs: _Arcs):
        self.arcs, self.local, self.bounds, self.parts = arcs, np.full(len(arcs.ids), -1), np.zeros(1, int), []

    def parts_of(self, low: int, high: int) -> list[tuple[_Part, np.ndarray]] | None:
        """The parts with their numbers of the sources from ``low`` to ``high``; None if there are too many arcs."""
        if (self.local[low:high] < 0).any() and not self._search(low, high):
            return None
        at = self.local[low:high]
        which = np.searchsorted(self.bounds, at, "right") - 1
        return [(self.parts[p], at[which == p] - self.bounds[p]) for p in np.unique(which)]

    def _search(self, low: int, high: int) -> bool:
        n = len(self.local)
        self.parts, keys, m = [], [], 0
        self.local[:] = -1
        seen, every = np.zeros(n, bool), np.ones(n, bool)
        seen[low:high] = True
        new = seen.copy()
        while new.any():
            at, new = new, np.zeros(n, bool)
            for d, s in self.arcs.between(at, every, forward=False):
                m += len(s)
                if m > HELD_ARCS:
                    return False
                keys.append(s * np.int64(n) + d)
                new[d] = True
            new &= ~seen
            seen |= new
        self.arcs.kept.clear()
        nodes = np.flatnonzero(seen)
        key = np.concatenate([*keys, np.zeros(0, np.int64)])
        del keys
        number = np.zeros(n, np.int32)
        number[nodes] = np.arange(len(nodes))
        arcs = _ends(number[key // n], number[key % n], len(nodes))
        component = _components(arcs)
        part, size = np.zeros(len(nodes), int), 0
        first, sizes = np.unique(component, return_counts=True)
        of, p = np.zeros(len(first), int), 0
        for k, c in enumerate(sizes.tolist()):
            if size and size + c > PART:
                p, size = p + 1, 0
            of[k], size = p, size + c
        part = of[np.searchsorted(first, component)]
        if p:
            nodes = nodes[np.argsort(part, kind="stable")]
            number[nodes] = np.arange(len(nodes))
            arcs = _ends(number[key // n], number[key % n], len(nodes))
        del key
        self.bounds = np.r_[0, np.cumsum(np.bincount(part))]
        self.local[nodes] = np.arange(len(nodes))
        for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            x, y = arcs.ptr[a], arcs.ptr[b]
            self.parts.append(_Part(nodes[a:b], _Ends(arcs.ptr[a : b + 1] - x, arcs.ends[x:y] - np.int32(a)) if p else arcs))
        return True


def path_shares(g: Stored) -> DataFrame:
    """(node, betweenness): the sum over pairs of other nodes of the share of shortest paths through a node; every node that is on none has 0."""
    tasks = max(1, 2 * g.scratch.spark.sparkContext.defaultParallelism)
    width = max(1, min(256, -(-g.n // tasks)))

    def work(arcs: _Arcs, ranges: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        total, reached = np.zeros(len(arcs.ids)), _Reached(arcs)
        for low, high in ranges:
            parts = reached.parts_of(low, high)
            if parts is None:
                _shares_from_files(arcs, low, high, total)
                continue
            for part, sources in parts:
                total[part.nodes] += part.shares(sources)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(arcs.ids[hit]), pa.array(total[hit])], names=["node", "b"])

    parts = _by_blocks(g, width, work, "node long, b double", tasks)
    per = parts.groupBy("node").agg(F.sum("b").alias("b"))
    return g.nodes.join(per, "node", "left").select("node", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def _shares_from_files(arcs: _Arcs, begin: int, end: int, total: np.ndarray) -> None:
    """Adds to ``total`` what hangs on each node in the searches from the nodes ``begin`` to ``end``, with files of arcs read for each level."""
    n = len(arcs.ids)
    width = max(1, min(256, STATE // (8 * n)))
    for low in range(begin, end, width):
        w = min(end - low, width)
        one = np.arange(w)
        place = np.zeros((n, w), np.int32)  # distance + 1, 0 where a source has not come
        paths, unfilled = np.zeros((n, w)), np.ones(n, bool)
        place[low + one, one] = paths[low + one, one] = 1
        levels = [np.arange(low, low + w)]
        unfilled[low : low + w] = (place[low : low + w] == 0).any(axis=1)
        while len(levels[-1]):
            at, depth = levels[-1], len(levels)
            active, x, found = np.zeros(n, bool), np.zeros((n, w)), np.zeros((n, w))
            active[at] = True
            x[at] = np.where(place[at] == depth, paths[at], 0.0)
            ends = _carry(arcs.between(active, unfilled), x, found, np.add)
            new = (found[ends] > 0) & (place[ends] == 0)
            place[ends] += np.where(new, depth + 1, 0).astype(np.int32)
            paths[ends] += np.where(new, found[ends], 0.0)
            unfilled[ends] = (place[ends] == 0).any(axis=1)
            levels.append(ends[new.any(axis=1)])
        behind = np.zeros((n, w))  # what hangs on a node
        for depth in range(len(levels) - 2, 0, -1):
            at, up = levels[depth], levels[depth - 1]
            x, got = np.zeros((n, w)), np.zeros((n, w))
            src, dst = np.zeros(n, bool), np.zeros(n, bool)
            src[up] = dst[at] = True
            here = place[at] == depth + 1
            x[at] = np.where(here, (1.0 + behind[at]) / np.where(here, paths[at], 1.0), 0.0)
            ends = _carry(arcs.between(src, dst, forward=False), x, got, np.add)
            behind[ends] += np.where(place[ends] == depth, paths[ends] * got[ends], 0.0)
        behind[low + one, one] = 0.0
        rows = np.unique(np.concatenate(levels))
        total[rows] += behind[rows].sum(axis=1)
