"""Encoding of a corpus with a public byte-level BPE tokenizer, by a tokenization automaton.

The merges are compiled once, in rank order, by successive gadgets. The states are the labels: after an arc the
automaton is in the state of its label. The gadget of a merge (u, v) -> w cuts the arc v out of the state u and adds the
state w, which begins as the state v is at that moment: w ends as v does, and later gadgets of v no longer reach into it.
What is compiled is a table for each state: the left edges that are cut there, each with the rank that cut it. An arc t
leaves a state unless a left edge of t is cut there while t's own merges still show it. States that no gadget tells
apart share one table.

Exactly one path spells each word, and each prefix of it, so every place in a word has one state. A word is encoded in
one pass over its bytes: a byte trie of the labels, read from their ends, gives the arcs that may lead to a place, and
the tables of the states before them say which one does. Nothing is taken back, and the work for a byte is bounded by
the longest label. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS, CACHE_CHARS = 250_000, 200  # bounds of a worker's memory, not of the result

# The public pattern that splits text before the merges, and the same for pure ASCII.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else the next free code point."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in visible}
    for n, b in enumerate(sorted(set(range(256)) - set(visible))):
        out[chr(256 + n)] = b
    return out


def read_merges(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(byte ids, merges) of a byte-level BPE vocabulary file: the id of each byte, and rows u, v, w in rank order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, alphabet = model["vocab"], byte_alphabet()
    single = np.zeros(256, np.int32)
    for ch, b in alphabet.items():
        single[b] = vocab[ch]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return single, np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32).reshape(-1, 3)


class TokenizationAutomaton:
    """The compiled merges: a table of cut left edges for each state, and the byte trie of the arc labels."""

    def __init__(self, single: np.ndarray, merges: np.ndarray):
        self.bytes_of: dict[int, bytes] = {int(t): bytes([b]) for b, t in enumerate(single)}
        cut: dict[int, dict[int, int]] = {t: {} for t in self.bytes_of}  # state -> left edge -> rank of the gadget
        edges: dict[int, tuple[tuple[int, int], ...]] = {t: ((t, len(merges)),) for t in self.bytes_of}  # label -> its left edges, each with the rank until which it shows
        dead: set[int] = set()  # labels that the gadgets never build from their own bytes
        for r, (u, v, w) in enumerate(merges.tolist()):
            if w not in self.bytes_of:
                self.bytes_of[w] = self.bytes_of[u] + self.bytes_of[v]
                (first, _), *rest = edges[u]
                # a merge goes from left to right: its own gadget may still cut the left part, so that shows until r
                edges[w] = ((w, len(merges)), (first, r), *rest)
                if u in dead or v in dead or any(cut[u].get(x, until + 1) <= until for x, until in edges[v]):
                    dead.add(w)
                cut[w] = cut[v]  # shared until a gadget tells them apart
            if v not in cut[u]:
                cut[u] = cut[u] | {v: r}
        self.root: dict = {}  # trie of the labels from their ends: byte -> the label spelled so far or -1, its edges, what follows
        live = [t for t in self.bytes_of if t not in dead]
        for t in live:
            node = self.root
            *ahead, first = reversed(self.bytes_of[t])
            for x in ahead:
                node = node.setdefault(x, (-1, (), {}))[2]
            node[first] = t, edges[t], node[first][2] if first in node else {}
        by_label = lambda d, none: [d.get(t, none) for t in range(max(self.bytes_of) + 1)]
        self.length = by_label({t: len(b) for t, b in self.bytes_of.items()}, 0)
        self.longest = max(self.length)
        self.cut, self.edges, self.live = by_label(cut, {}), by_label(edges, ()), set(live)

    def leaves(self, state: int, t: int) -> bool:
        """Whether the arc t leaves the state."""
        cut = self.cut[state]
        return t in self.live and not any(cut.get(v, until + 1) <= until for v, until in self.edges[t])

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one path that spells ``word``."""
        return memoryview(next(self.encode_sorted([word]))).cast("i").tolist()

    def encode_sorted(self, words: Iterable[bytes]) -> Iterator[bytes]:
        """The paths of ``words`` as int32: the state of each place, from left to right, then the path read off.

        What a word shares with the beginning of the one before it is not read again.
        """
        root, longest, cuts, length = self.root, self.longest, self.cut, self.length
        last, before = [-1], b""  # the state of each place
        for word in words:
            n, same = len(word), 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            del last[same + 1 :]
            before, back = word, word[::-1]
            for end in range(same + 1, n + 1):
                node, at = root, end
                for x in back[n - end : n - end + longest]:
                    t, edges, node = node[x]  # the one arc that leads here is met before the trie ends
                    at -= 1
                    if t >= 0:
                        if not at:
                            break
                        cut = cuts[last[at]]
                        for v, until in edges:
                            if v in cut and cut[v] <= until:
                                break
                        else:
                            break
                last.append(t)
            out = []
            while n:
                t = last[n]
                out.append(t)
                n -= length[t]
            out.reverse()
            yield array("i", out).tobytes()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes on the arcs."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Words(dict):
    """word -> the bytes of its ids as int32, filled on demand and emptied when full."""

    def __init__(self, automaton: TokenizationAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        return next(self.automaton.encode_sorted([word.encode()]))

    def fill(self, words: set[str]) -> None:
        """Encodes those of ``words`` that are not known yet and not too long to keep."""
        new = words - self.keys()
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = words
        wanted = sorted(w for w in new if len(w) <= CACHE_CHARS)
        self.update(zip(wanted, self.automaton.encode_sorted(map(str.encode, wanted))))


_ready: dict[int, _Words] = {}


def _words(single: np.ndarray, merges: np.ndarray) -> _Words:
    key = hash((single.tobytes(), merges.tobytes()))
    if key not in _ready:
        _ready.clear()
        _ready[key] = _Words(TokenizationAutomaton(single, merges))
    return _ready[key]


def split_words(text: str) -> list[str]:
    return SPLIT_ASCII.findall(text) if text.isascii() else SPLIT.findall(text)


def encode_texts(texts: list[str | None], words: _Words) -> pa.ListArray:
    split = [split_words(t) if t else [] for t in texts]
    words.fill(set().union(*split))
    offsets, data, n = [0], [], 0
    get = words.__getitem__
    for ws in split:
        b = b"".join(map(get, ws))
        n += len(b) >> 2
        data.append(b)
        offsets.append(n)
    values = pa.Array.from_buffers(pa.int32(), n, [None, pa.py_buffer(b"".join(data))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def token_ids(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): each text's ids, without special tokens; strings that look like special tokens are plain text.

    Null and empty texts have an empty list. vocabulary: path of the file on the driver; its merges (less than 1 MB,
    whatever the corpus) are broadcast and compiled once per worker.
    """
    tables = documents.sparkSession.sparkContext.broadcast(read_merges(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(*tables.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = encode_texts(part.column(1).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return documents.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` long, ids array<int>")


def texts_of_ids(ids: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, text): the inverse of token_ids; a null or empty list gives the empty text."""
    tables = ids.sparkSession.sparkContext.broadcast(read_merges(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _words(*tables.value).automaton
        for batch in batches:
            texts = [automaton.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return ids.select(F.col(key).cast("long").alias(key), "ids").mapInArrow(run, f"`{key}` long, text string")
