"""The llm operators against public libraries, brute force and hostile rows."""

from __future__ import annotations

import random
import re
import time
import unicodedata

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pkgloom.llm import spam
from pkgloom.llm.leakage import leaked_items, plain, word_lists
from pkgloom.llm.queries import QUERIES, TOKENIZERS
from pkgloom.llm.spam import FEATURES, BaggedTrees, block_features, blocks, smoothed, spam_pages, weak_labels
from pkgloom.llm.tokenize import TokenizationAutomaton, read_merges, split_words, texts_of_ids, token_ids

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def automaton():
    return TokenizationAutomaton(*read_merges(VOCABULARY))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


HOSTILE = ["", " ", "\n\n  \t x", "<|endoftext|>", "a" * 20_000, "ab" * 5_000, "it's we'll I'M", "naïve Ünïcödé 日本語テスト 🧪👩‍💻", "½ ² Ⅷ ١٢٣", "x y z\u0085w\x1c\x1d", "​﻿zero", "don't\r\n\r\nstop  now", "שלום नमस्ते"]


def test_same_ids_as_the_library(automaton, library):
    rng = random.Random(7)
    letters = "abcdefghiklmnoprstuvw ABCXYZ 0123456789 .,:;!?-_/'\"\n\téßñ日本🧪"
    texts = HOSTILE + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text, reference in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert [t for w in split_words(text) for t in automaton.encode(w.encode())] == reference.ids


def test_long_words_take_linear_time(automaton, library):
    rng = random.Random(11)
    for unit in ("日本語テスト", "abc", "".join(rng.choice("etaoinshrdlu") for _ in range(5000))):
        seconds = []
        for n in (100_000, 1_000_000):
            word = (unit * (n // len(unit.encode()) + 1)).encode()[:n].decode(errors="ignore").encode()
            began = time.perf_counter()
            ids = automaton.encode(word)
            seconds.append(time.perf_counter() - began)
            assert automaton.decode(ids) == word
        assert seconds[1] < 30 * seconds[0]
        assert ids[:2000] == library.encode(word.decode(), add_special_tokens=False).ids[:2000]


def test_every_token_is_its_own_path(automaton):
    """Each word of the vocabulary that can be built is spelled by the one arc it labels."""
    assert automaton.live == set(automaton.bytes_of)
    assert all(automaton.encode(b) == [t] for t, b in automaton.bytes_of.items())


def test_small_automaton():
    """Brute force over a vocabulary of three letters: merges applied in rank order, left to right."""
    rng = random.Random(5)
    for _ in range(30):
        names = {i: bytes([97 + i]) for i in range(3)}
        merges: list[tuple[int, int, int]] = []
        while len(merges) < 8:
            u, v = rng.choice(list(names)), rng.choice(list(names))
            if names[u] + names[v] not in names.values():
                w = len(names)
                names[w] = names[u] + names[v]
                merges.append((u, v, w))
        a = _three_letters(merges)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            ids = [x - 97 for x in word]
            for u, v, w in merges:
                i, out = 0, []
                while i < len(ids):
                    if ids[i : i + 2] == [u, v]:
                        out.append(w)
                        i += 2
                    else:
                        out.append(ids[i])
                        i += 1
                ids = out
            assert a.encode(word) == ids, (merges, word)


def _three_letters(merges):
    """The automaton of a small vocabulary; all other bytes get ids out of the way."""
    single = np.arange(1000, 1256, dtype=np.int32)
    single[[97, 98, 99]] = [0, 1, 2]
    return TokenizationAutomaton(single, np.array(merges, np.int32))


def test_token_ids(spark, library):
    rows = [(i, t) for i, t in enumerate(HOSTILE)] + [(100, None), (7, HOSTILE[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = token_ids(df, VOCABULARY)
    got = sorted((r["doc_id"], list(r["ids"])) for r in out.collect())
    assert got == sorted((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    back = {r["doc_id"]: r["text"] for r in texts_of_ids(out, VOCABULARY).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert token_ids(df.limit(0), VOCABULARY).count() == 0


# ---- leakage

ITEM = "Given that delante-codec at 8.26.29 depends on verina through an optional range, decide which of the 8150 releases may pick the next."


def test_plain():
    words = word_lists("Given that delante codec")[0]
    for text in ("Gi​ven <b>th</b>at **delante**-`codec`", "Ｇiven THAT &quot;delante&quot; co­DEC", "> given that\n> delante [codec](https://x.example/y)", "given<br>that<p class='x'>delante</p> &lt;b&gt;codec&lt;/b&gt;"):
        assert word_lists(text)[0] == words, text
    assert word_lists("1. given that\n2) delante codec")[1] == words
    assert word_lists(None) == [] and word_lists("") == []
    assert plain("x < y and z > w") == "x < y and z > w"


def _brute(docs, items, n=12):
    def words(t):
        t = unicodedata.normalize("NFKC", t or "").lower()
        return re.findall(r"[^\W_]+", t)

    out = set()
    for d, text in docs:
        w = words(text)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, item in items:
            v = words(item)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_leaked_items(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(30)] + [(30, ITEM), (31, None), (32, ""), (30, ITEM)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(60)]
    for i in range(60, 160):
        item = rng.choice(items[:30])[1].split()
        k, size = rng.randrange(0, max(1, len(item) - 10)), rng.choice([11, 12, 13, 30])
        docs.append((i, " ".join([rng.choice(vocabulary) for _ in range(10)] + item[k : k + size] + [rng.choice(vocabulary) for _ in range(10)])))
    docs += [(200, None), (201, ""), (202, " \n"), (203, ITEM), (203, ITEM), (204, "x " * 50_000 + ITEM)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    t = spark.createDataFrame(items, "item_id long, item_text string").withColumn("text", F.lit("clash"))
    expected = _brute(docs, [(i, x) for i, x in items if x])
    assert len(expected) > 20
    one = [tuple(r) for r in leaked_items(d, t).collect()]
    assert len(one) == len(set(one)) and set(one) == expected
    assert {tuple(r) for r in leaked_items(d, t, block_chars=500).collect()} == expected  # several blocks of items
    assert leaked_items(d.limit(0), t).count() == 0 and leaked_items(d, t.limit(0)).count() == 0


# ---- spam


def _prose(rng, n):
    things = ["index", "loader", "graph", "parser", "module", "cache"]
    return " ".join(f"The {rng.choice(things)} of package {rng.randrange(1000)} now checks each {rng.choice(things)} before it reaches the {rng.choice(things)}." for _ in range(n))


def _spam(rng, n):
    kind = rng.randrange(4)
    words = ["download", "crack", "license key", "coupon", "free trial", "cheap hosting"]
    if kind == 0:
        return "\n".join(f"Visit {i}: Brand{rng.randrange(3)} Pro {rng.choice(words)} https://h{rng.randrange(10**6)}.example/?q=x" for i in range(n))
    if kind == 1:
        return " ".join(f"#Brand{rng.choice('AB')}{rng.choice(words).title().replace(' ', '')}" for _ in range(4 * n))
    if kind == 2:
        return "\n".join(f"Brand{rng.choice('ab')} Suite {rng.choice(words)}" for _ in range(3 * n))
    return "\n".join(f"https://a{rng.randrange(10**6)}-b.example/{rng.choice(words).replace(' ', '-')}/{rng.randrange(10**5)}" for _ in range(n + 6))


def test_spam_pages(spark):
    rng = random.Random(2)
    docs, truth = [], set()
    for i in range(600):
        if i % 6 == 0:
            docs.append((i, _spam(rng, 12), f"https://host{i % 20}.example/a"))
            truth.add(i)
        elif i % 6 == 1:
            deps = "\n".join(f"- example.a{rng.randrange(99)}:b{rng.randrange(99)}-core:{rng.randrange(9)}.1.2 (test)" for _ in range(20))
            docs.append((i, f"{_prose(rng, 2)}\n\n{deps}", None))
        else:
            docs.append((i, _prose(rng, 6), f"https://host{i % 20}.example/b"))
    docs += [(1000, None, None), (1001, "", "x"), (1002, " \n\t ", "x"), (1003, "!!! ...", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("score", F.lit(1)).withColumn("host", F.lit("clash"))
    found = {r[0] for r in spam_pages(df).collect()}
    assert len(found & truth) >= 0.97 * len(truth) and len(found - truth) <= 3
    assert spam_pages(df.limit(0)).count() == 0
    assert spam_pages(df.where("doc_id >= 1000")).count() == 0


def test_features_and_trees():
    assert block_features("...") is None
    assert len(block_features("one word")) == len(FEATURES)
    assert blocks("a\n\nb\r\n\r\n\r\nc\n \nd") == ["a", "b", "c", "d"]
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(FEATURES)))
    y = ((x[:, 3] > 0.6) ^ (x[:, 7] > 0.5)).astype(int)
    t = BaggedTrees(x[:1500], y[:1500])
    assert ((t.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.75
    assert np.array_equal(t.predict(x), BaggedTrees(x[:1500], y[:1500]).predict(x))
    assert set(weak_labels(np.array([block_features(_prose(random.Random(1), 5)), block_features("#a #b #c #d #e #f")]))) == {0, 1}


def test_trees_decide_what_rules_leave_open(data):
    """Most blocks have no label; trained on those that have, the trees find pages of kinds that no rule names."""
    texts = pq.read_table(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet", columns=["text"]).column(0).to_pylist()
    pages = [spam._page_blocks(t) for t in texts]
    x = np.array([f for p in pages for f in p])
    y = weak_labels(x)
    known = np.unique(x[y >= 0], axis=0)
    trees = BaggedTrees(known, weak_labels(known))
    assert (y == -1).any() and trees.out_of_bag < 0.1
    at, w = np.repeat(np.arange(len(pages)), [len(p) for p in pages]), np.expm1(x[:, 0])
    share = lambda v: np.bincount(at, weights=w * v, minlength=len(pages)) / np.maximum(np.bincount(at, weights=w, minlength=len(pages)), 1)
    by_rules, by_trees = share(y == 1) > 0.5, share(trees.predict(x)) > 0.5
    assert by_trees.sum() > 1.05 * by_rules.sum() and (by_trees & by_rules).sum() >= 0.98 * by_rules.sum()


def test_hosts_move_pages(spark):
    rng = random.Random(4)
    rows = [(i, "bad", 100, 0.9 if i % 10 else 0.45) for i in range(400)]
    rows += [(1000 + i, f"h{i % 40}" if i % 7 else None, 100, rng.choice([0.02, 0.1, 0.3, 0.45, 0.55, 0.99])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, host string, words long, score double")
    mean = sum(r[3] for r in rows) / len(rows)
    odds = lambda p: np.log(min(max(p, 0.01), 0.99) / (1 - min(max(p, 0.01), 0.99)))
    of_host: dict = {}
    for _, h, _, p in rows:
        of_host.setdefault(h, []).append(p)
    rate = {h: (sum(v) + spam.HOST_PRIOR * mean) / (len(v) + spam.HOST_PRIOR) for h, v in of_host.items()}
    want = {i for i, h, _, p in rows if odds(p) + spam.HOST_WEIGHT * (odds(rate[h]) - odds(mean)) > 0}
    out = smoothed(df)
    assert out.count() == len(rows)
    got = {r[0] for r in out.where("spam").collect()}
    assert got == want
    assert 10 in got and got != {r[0] for r in rows if r[3] > 0.5}  # a page at 0.45 on a host of spam
    assert smoothed(df.limit(0)).count() == 0


def test_sample_is_never_empty():
    assert spam.sample_bound(10**13, 8000) > 10**6 and spam.sample_bound(100, 8000) == 2**62
    assert spam.sample_bound(10**30, 1) == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
