"""Keyword-stuffed pages, link collections and tag lists, by bagged decision trees smoothed over hosts.

A page is cut into blocks at blank lines. Each block has content and link features: shares, repetitions, shapes and
how far it packs; no feature looks a word up in a list. A few strict rules, one for each kind of spam and a few for
plain cases of the rest, label a part of the blocks and are silent on the others; a bag of decision trees is trained
on the labelled blocks of a bounded sample and alone judges every block of every page. A page's score is the mean
of the trees' shares over its words; its log-odds are shifted by those of its host's spam rate against the rate of all
pages, which decides pages near one half. Texts never shuffle: one small row per page goes on to the host rates, and
only pages that a host could move are joined with them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgloom.session import cut

SAMPLE_PAGES = 8_000  # pages whose blocks may train the trees
TREES = 40
DEPTH = 10
LEAST_LEAF = 3
FEATURE_SHARE = 0.2  # of the features, looked at for each split
BINS = 32
SEED = 20_240_601
HOST_WEIGHT = 0.25
HOST_PRIOR = 20.0
ODDS_BOUND = 0.01  # shares are kept between this and one less this before their log-odds are taken
SALTS = 16

_WORD = re.compile(r"[^\W_]+")
_BLOCK = re.compile(r"(?:\r\n|\r|\n)[^\S\n]*(?:\r?\n)+")
_URL = re.compile(r"(?:https?://|www\.)[^\s\"'<>()\[\]]+", re.I)
_HOST = re.compile(r"(?:https?://)?([^/\s:?#]+)", re.I)
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|code|span|tt|mark|small)>", re.I)
_TAG = re.compile(r"(?:^|\s)#[^\W\d_]\w*")
_SENTENCE = re.compile(r"[.?;:。？；]+(?=\s|$|[”’\"')])|[。？；]")
_VERSION = re.compile(r"\d+\.\d+\.\d+")
_DOTTED = re.compile(r"[^\W\d_]\.[^\W\d_]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
FEATURES = (
    "words", "distinct", "top3", "top1", "bigram_repeats", "urls", "hosts", "url_words", "tags", "caps", "bangs", "sentences", "short_words", "cjk",
    "digits", "code", "line_words", "same_start", "title", "separators", "url_lines", "mixed", "versions", "marked_lines", "code_ends", "dotted", "packed",
)


class _Classes(dict):
    """Code point -> 'a' for letters, '9' for digits, itself else."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        out = self[code] = "a" if ch.isalpha() else "9" if ch.isdigit() else ch
        return out


_classes = _Classes()


def blocks(text: str) -> list[str]:
    return [b for b in _BLOCK.split(text) if not b.isspace() and b]


def block_features(block: str) -> list[float] | None:
    """FEATURES of a block without its inline markup; None if it has no word."""
    if "<" in block:
        block = _INLINE.sub("", block)
    words = _WORD.findall(block)
    n = len(words)
    if not n:
        return None
    low = list(map(str.lower, words))
    counts = Counter(low)
    top = sorted(counts.values())[:-4:-1]
    pairs = len(set(zip(low, low[1:])))
    urls = _URL.findall(block) if "://" in block or "ww." in block.lower() else []
    hosts = {m[1].lower() for m in map(_HOST.match, urls) if m}
    tokens = block.split()
    lines = [x for x in block.splitlines() if x.strip()]
    starts = Counter([x[:4].translate(_classes) for x in lines])
    letters = sum(map(len, words))
    caps, title, digits = sum(map(str.isupper, words)), sum(map(str.istitle, words)), sum(map(str.isdigit, words))
    raw = block.encode("utf-8", "surrogatepass")
    return [
        math.log1p(n),
        len(counts) / n,
        sum(top) / n,
        top[0] / n,
        1 - pairs / (n - 1) if n > 1 else 0.0,
        len(urls) / n,
        len(hosts) / len(urls) if urls else 0.0,
        sum(len(_WORD.findall(u)) for u in urls) / n,
        len(_TAG.findall(block)) / len(tokens) if "#" in block else 0.0,
        caps / n,
        block.count("!") / n,
        len(_SENTENCE.findall(block)) / n,
        sum([c for w, c in counts.items() if len(w) <= 4 and w.isalpha()]) / n,
        0.0 if block.isascii() else len(_CJK.findall(block)) / letters,
        digits / n,
        sum(map(block.count, "(){};=<>")) / len(block),
        n / len(lines),
        max(starts.values()) / len(lines),
        title / n,
        sum(map(block.count, ",/|·•")) / n,
        sum([("://" in x or "www." in x) for x in lines]) / len(lines) if urls else 0.0,
        (n - caps - title - digits - sum(map(str.islower, words))) / n,
        len(_VERSION.findall(block)) / n,
        sum([not x[0].isalnum() for x in lines]) / len(lines),
        sum([x.rstrip()[-1] in "{};)," for x in lines]) / len(lines),
        len(_DOTTED.findall(block)) / n,
        len(zlib.compress(raw, 1)) / len(raw),
    ]


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 spam, 0 no spam, -1 unknown, for rows of FEATURES: strict rules, which are silent on most kinds of blocks.

    Blocks on which rules of both sides speak are unknown.
    """
    f = {k: x[:, i] for i, k in enumerate(FEATURES)}
    n = np.expm1(f["words"])
    spam = [
        (f["tags"] >= 0.8) & (n >= 5),
        (f["top3"] >= 0.5) & (f["distinct"] < 0.15) & (n >= 60) & (f["digits"] < 0.05),
        (f["url_lines"] >= 0.9) & (f["url_words"] >= 0.4) & (f["hosts"] >= 0.9) & (f["urls"] * n >= 8),
        (f["separators"] >= 0.15) & (f["sentences"] < 0.03) & (f["line_words"] >= 20) & (f["digits"] < 0.02),
        (f["bangs"] >= 0.1) & (f["caps"] >= 0.3) & (n >= 40),
    ]
    fair = [
        (f["short_words"] >= 0.25) & (f["top3"] < 0.35) & (f["urls"] == 0) & (f["sentences"].clip(0.03, 0.2) == f["sentences"]) & (f["bangs"] == 0) & (f["separators"] < 0.1),
        (f["digits"] >= 0.25) & (f["versions"] >= 0.08) & (f["bangs"] == 0),
        (f["code"] >= 0.04) & (f["urls"] == 0) & (f["code_ends"] >= 0.5) & (f["bangs"] == 0),
        (f["cjk"] >= 0.5) & (f["sentences"] >= 0.1) & (f["urls"] == 0) & (f["bangs"] == 0),
        (f["sentences"] >= 0.05) & (f["hosts"] > 0) & (f["hosts"] <= 0.5) & (f["url_words"] < 0.5),
        (n < 8) & (f["urls"] == 0) & (f["tags"] == 0) & (f["bangs"] == 0),
    ]
    s, g = np.any(spam, axis=0), np.any(fair, axis=0)
    return np.where(s & ~g, 1, np.where(g & ~s, 0, -1))


class BaggedTrees:
    """Decision trees on bootstrap samples with as many rows of either class; splits by Gini impurity over bins.

    The bins of a feature are quantiles of both classes, so that the rare class has bins of its own.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        """x: rows of features; y: 0 or 1. out_of_bag: the mean over both classes of the rows that the trees not grown on them get wrong."""
        rng = np.random.default_rng(seed)
        classes = [np.flatnonzero(y == k) for k in (0, 1)]
        classes = [c for c in classes if len(c)]
        steps = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.concatenate([np.quantile(x[c, j], steps) for c in classes])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])
        self.trees = []
        votes, judged = np.zeros(len(y)), np.zeros(len(y))
        for _ in range(trees):
            rows = np.concatenate([rng.choice(c, len(y) // len(classes) + 1) for c in classes])
            self.trees.append(self._grow(binned[rows], y[rows].astype(float), depth, rng))
            out = np.ones(len(y), bool)
            out[rows] = False
            votes[out] += self._leaves(self.trees[-1], x[out])
            judged += out
        wrong = (votes > judged / 2) != (y == 1)
        shares = [wrong[c[judged[c] > 0]].mean() for c in classes if (judged[c] > 0).any()]
        self.out_of_bag = float(np.mean(shares)) if shares else float("nan")

    def _grow(self, b: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut_at, left, right, value = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            me = len(feature)
            mean = float(y[rows].mean())
            for column, v in zip((feature, cut_at, left, right, value), (-1, 0.0, -1, -1, mean)):
                column.append(v)
            if depth == 0 or mean in (0.0, 1.0) or len(rows) < 2 * LEAST_LEAF:
                return me
            best = (1e-9, -1, -1)
            here = len(rows) * mean * (1 - mean)
            for j in rng.permutation(b.shape[1])[: max(1, int(b.shape[1] * FEATURE_SHARE))]:
                k = len(self.edges[j]) + 1
                if k < 2:
                    continue
                n = np.bincount(b[rows, j], minlength=k).cumsum()[:-1]
                s = np.bincount(b[rows, j], weights=y[rows], minlength=k).cumsum()[:-1]
                m, t = len(rows) - n, mean * len(rows) - s
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = here - (s - s * s / n) - (t - t * t / m)
                gain[(n < LEAST_LEAF) | (m < LEAST_LEAF)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), j, at)
            if best[1] < 0:
                return me
            goes = b[rows, best[1]] <= best[2]
            feature[me], cut_at[me] = best[1], float(self.edges[best[1]][best[2]])
            left[me] = node(rows[goes], depth - 1)
            right[me] = node(rows[~goes], depth - 1)
            return me

        node(np.arange(len(y)), depth)
        return tuple(np.array(c) for c in (feature, cut_at, left, right, value))

    @staticmethod
    def _leaves(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
        feature, cut_at, left, right, value = tree
        rows, at = np.arange(len(x)), np.zeros(len(x), int)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return value[at]
            goes = x[rows, np.maximum(f, 0)] < cut_at[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean of the trees' shares of spam, for each row."""
        total = np.zeros(len(x))
        for tree in self.trees:
            total += self._leaves(tree, x)
        return total / len(self.trees)


def _page_blocks(text: str | None) -> list[list[float]]:
    return [f for f in map(block_features, blocks(text)) if f] if text else []


def sample_bound(pages: int, sample_pages: int) -> int:
    """The 62-bit hash below which about sample_pages of ``pages`` ids fall; never 0 while any page is wanted."""
    return max(1, 2**62 * sample_pages // pages) if pages > sample_pages else 2**62


def train(documents: DataFrame, sample_pages: int = SAMPLE_PAGES) -> BaggedTrees | None:
    """Trees from the weakly labelled blocks of about ``sample_pages`` pages, taken by a hash of the id.

    What reaches the driver is bounded by sample_pages, whatever the size of the corpus; equal rows count once, so
    copies of one text cannot fill the sample. None if no block of the sample is labelled.
    """
    pages = documents.where("text IS NOT NULL").count()
    picked = documents.where(F.col("text").isNotNull() & (F.shiftrightunsigned(F.xxhash64("doc_id"), 2) < F.lit(sample_bound(pages, sample_pages))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted({tuple(f) for text in batch.column(0).to_pylist() for f in _page_blocks(text)})
            labels = weak_labels(np.array(rows)) if rows else []
            kept = [list(r) for r, y in zip(rows, labels) if y >= 0]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.list_(pa.float64()))], names=["f"])

    rows = picked.select("text").mapInArrow(run, "f array<double>").toPandas()["f"]
    if not len(rows):
        return None
    x = np.unique(np.array(rows.tolist()), axis=0)  # sorted: the order of arrival does not matter
    return BaggedTrees(x, weak_labels(x))


def page_scores(documents: DataFrame, trees: BaggedTrees) -> DataFrame:
    """(doc_id, host, words, score): score is the mean of the trees' shares of spam over the page's words."""
    shared = documents.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            features, owner = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = _page_blocks(text)
                features += found
                owner += [i] * len(found)
            n = batch.num_rows
            spam = words = np.zeros(n)
            if features:
                x = np.array(features)
                w, at = np.expm1(x[:, 0]), np.array(owner)
                words = np.bincount(at, weights=w, minlength=n)
                spam = np.bincount(at, weights=w * model.predict(x), minlength=n)
            keep = words > 0
            ids = batch.column(0).filter(pa.array(keep))
            host = batch.column(1).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([ids, host, pa.array(np.rint(words[keep]).astype("int64")), pa.array(spam[keep] / words[keep])], names=["doc_id", "host", "words", "score"])

    pages = documents.select("doc_id", F.lower(F.regexp_extract(F.coalesce("source", F.lit("")), r"^(?:\w+://)?([^/:?#]*)", 1)).alias("host"), "text")
    return pages.mapInArrow(run, "doc_id long, host string, words long, score double")


def _log_odds(share: Column) -> Column:
    p = F.least(F.greatest(share, F.lit(ODDS_BOUND)), F.lit(1 - ODDS_BOUND))
    return F.log(p / (1 - p))


def smoothed(scores: DataFrame, weight: float = HOST_WEIGHT, prior: float = HOST_PRIOR) -> DataFrame:
    """(doc_id, host, words, score, spam): the scored pages, and whether each is spam once its host's rate has its say.

    The log-odds of the page's score are shifted by ``weight`` times those of its host's mean score less those of all
    pages'; a host is taken for average until it has about ``prior`` pages. As log-odds are bounded, so is the shift:
    pages beyond it are decided by their score, and only the rest is joined with the host rates, in salted parts, so
    that a host of a third of all pages is no hot task. Null hosts count as one host.
    """
    scores = scores.withColumn("host", F.coalesce("host", F.lit("")))
    overall = scores.agg(F.avg("score").alias("mean")).first()["mean"]
    if overall is None:
        return scores.withColumn("spam", F.lit(False))
    odds = _log_odds(F.col("score"))
    furthest = weight * 2 * abs(math.log(ODDS_BOUND / (1 - ODDS_BOUND)))
    near = F.abs(odds) <= furthest
    rates = scores.groupBy("host").agg(((F.sum("score") + prior * overall) / (F.count(F.lit(1)) + prior)).alias("rate"))
    rates = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    undecided = scores.where(near).withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)).cast("int"))
    shifted = odds + weight * (_log_odds(F.col("rate")) - _log_odds(F.lit(overall)))
    moved = undecided.join(rates, ["host", "salt"]).select(*scores.columns, (shifted > 0).alias("spam"))
    return scores.where(~near).withColumn("spam", odds > 0).unionByName(moved)


def spam_pages(documents: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(doc_id) of the pages most of whose words are repeated key terms, link collections or product tags.

    Null, empty and blank texts are no pages. A page without a source counts under the host ''. Repeated rows of a
    page are judged each. With no page that any rule can label, nothing is found.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    trees = train(documents, sample_pages)
    if trees is None:
        return documents.where("false").select("doc_id")
    return smoothed(cut(page_scores(documents, trees))).where("spam").select("doc_id")
