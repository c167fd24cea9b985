"""Evaluation texts leaking into training text, by a prefix-filtered set join with exact verification.

A document leaks an item if at least ``run`` words in a row of the item stand in a row in the document. The sets are
the item's windows of ``run`` words. All words of a window must be in the document, so by the prefix filter it is
enough to look at one of them: the rarest in the whole corpus. Pass 1 counts in how many documents each word of the
items stands; pass 2 looks for the rarest word of each window in every document and extends each hit over the item's
words on both sides, exactly. Words in the first or last places of a document bound the windows that fit.

The items are held-out questions, a table that does not grow with the corpus. They are taken in blocks of bounded
size and broadcast; more items mean more blocks, never a larger broadcast. Texts of documents never shuffle.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 12
BLOCK_CHARS = 16_000_000

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?([a-zA-Z][\w:-]*)(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+))?)*\s*/?>|<!--.*?-->", re.DOTALL)
_LINK = re.compile(r"\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Default_Ignorable_Code_Point}]|(?=\p{Cc})[^\s]")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
_ITEM_MARK = re.compile(r"(?m)^[\s>|*#/+-]*(?:\(?\d{1,4}\s?[.):|]|\(?[a-zA-Z][.)])(?=\s)")
# Elements that end a word; all others may stand inside one.
_BREAKING = frozenset("address article aside blockquote body br caption center dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr html img li main nav ol option p pre script section select style table tbody td textarea tfoot th thead title tr ul".split())


def _without_tag(m: re.Match) -> str:
    return " " if (m[1] or "").lower() in _BREAKING else ""


def plain(text: str) -> str:
    """``text`` without markup and invisible characters, in compatible form and folded case."""
    if "](" in text:
        text = _LINK.sub("]", text)
    for _ in range(2):  # a tag may itself have been escaped
        if "<" in text:
            text = _TAG.sub(_without_tag, text)
        if "&" not in text:
            break
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold()
        return unicodedata.normalize("NFKC", text)
    return _CONTROL.sub("", text).lower()


def word_lists(text: str | None) -> list[list[str]]:
    """The words of a text; a second reading leaves out numbers and letters that number its lines, if there are any."""
    if not text:
        return []
    base = plain(text)
    out = [_WORD.findall(base)]
    if _ITEM_MARK.search(base):
        other = _WORD.findall(_ITEM_MARK.sub("", base))
        if other != out[0]:
            out.append(other)
    return out


class ItemIndex:
    """Windows of the items under their rarest word."""

    def __init__(self, items: list[tuple[int, list[str]]], frequency: dict[str, int], run: int):
        self.run, self.words = run, [w for _, w in items]
        self.ids = [i for i, _ in items]
        self.anchors: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            found = set()
            for start in range(len(words) - run + 1):
                at = min(range(start, start + run), key=lambda j: (frequency.get(words[j], 0), words[j], j))
                found.add(at)
            for at in sorted(found):
                self.anchors[words[at]].append((k, at))

    def leaked(self, words: list[str]) -> set[int]:
        """Ids of the items of which ``run`` words in a row stand in a row in ``words``."""
        out: set[int] = set()
        n, run = len(words), self.run
        if n < run:
            return out
        hits = self.anchors.keys() & set(words)
        if not hits:
            return out
        for p, w in enumerate(words):
            if w not in hits:
                continue
            for k, at in self.anchors[w]:
                if self.ids[k] in out:
                    continue
                item = self.words[k]
                a, b = 1, 1
                while a < run and a <= at and a <= p and item[at - a] == words[p - a]:
                    a += 1
                while a + b - 1 < run and at + b < len(item) and p + b < n and item[at + b] == words[p + b]:
                    b += 1
                if a + b - 1 >= run:
                    out.add(self.ids[k])
        return out


def _frequencies(documents: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """In how many documents each word of ``vocabulary`` stands."""
    wanted = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wanted.value
        counts: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    for w in words.intersection(_WORD.findall(plain(text))):
                        counts[w] = counts.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = documents.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r[0]: r[1] for r in rows}


def _leaks_of_block(documents: DataFrame, items: list[tuple[int, str]], run: int) -> DataFrame:
    prepared = [(i, words) for i, text in items for words in word_lists(text)[:1] if len(words) >= run]
    index = ItemIndex(prepared, _frequencies(documents, {w for _, words in prepared for w in words}), run)
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            docs, hits = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set().union(*(index.leaked(words) for words in word_lists(text)))
                docs += [doc] * len(found)
                hits += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

    return documents.select("doc_id", "text").mapInArrow(find, "doc_id long, item_id long")


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id): every document with the items of which it holds ``run`` words in a row.

    Null, empty and blank texts, and items of fewer words, leak nothing. Repeated rows of a document or an item add
    rows neither for the one nor for the other.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("item_text").cast("string").alias("item_text")).where("item_id IS NOT NULL AND item_text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    parts = []
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == k).collect()
        parts.append(_leaks_of_block(documents, [(r[0], r[1]) for r in block], run))
    return reduce(DataFrame.unionByName, parts).distinct()
