"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words and lexicon stems, their number, how near they stand to second-person
words, shares of capitals, of fully capital words, of punctuation and of digits, repeated marks, obfuscated words
(letters mixed with marks or digits), lengths. The lexicons are a short list of English insults and what the
labelled rows teach: words and word beginnings that are far more common in toxic documents. Lexicons, trees and
calibration are fitted on at most `sample` labelled rows, taken by hash, outside the held-out quarter; scoring reads every text whole.

Null and empty texts have features of zero and so one defined score. Labels that are null are not learnt from; of
several labels of one document the largest counts. Without labels of both kinds, every score is the share of toxic ones (0.0 when there are none).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.llm.common import slices, tidy

#: Insults of general English that every lexicon holds.
INSULTS = ("clown", "disgusting", "dumb", "fool", "garbage", "idiot", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "worthless")
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur tu toi te ton ta tes vous votre vos du dich dir dein deine euch euer ihr tú ti tuyo usted ustedes vosotros".split())
FOLDS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_UNMASK = str.maketrans(FOLDS)
_WORD = re.compile(r"[^\W\d_]+")
_INNER = re.compile(r"[0134578@$!*]+")
_STRIPPED = "".join(map(chr, range(33, 48))) + ":;<=>?@[]^_`{|}~\\\u00ab\u00bb\u201c\u201d\u2019\u2026\u00a1\u00bf"
STEM = 5
NEAR = 8

FEATURES = 16


def tokens(text: str) -> list[str]:
    """Lower-case words without marks at their ends."""
    return [w.strip(_STRIPPED) for w in text.lower().split()]


class Lexicon:
    """Words and word beginnings with weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems

    @classmethod
    def learnt(cls, texts: list[Reading], toxic: np.ndarray, support: int = 5, least: float = 2.5) -> Lexicon:
        """Keeps what is in at least `support` toxic texts with log odds of `least` or more."""
        toxic_words, clean_words, toxic_stems, clean_stems = Counter(), Counter(), Counter(), Counter()
        for text, bad in zip(texts, toxic, strict=True):
            words = set(text.words)
            words.discard("")
            (toxic_words if bad else clean_words).update(words)
            (toxic_stems if bad else clean_stems).update({w[:STEM] for w in words if len(w) >= STEM})
        n, m = max(1, int(toxic.sum())), max(1, len(toxic) - int(toxic.sum()))

        def odds(bad: Counter, good: Counter) -> dict[str, float]:
            found = {w: math.log((c + 0.5) / n * m / (good[w] + 0.5)) for w, c in bad.items() if c >= support}
            return {w: x for w, x in found.items() if x >= least}

        return cls({w: 3.0 for w in INSULTS} | odds(toxic_words, clean_words), odds(toxic_stems, clean_stems))


class Reading:
    """What of a text doesn't depend on a lexicon."""

    __slots__ = ("fixed", "mixed", "raw_words", "size", "words")

    def __init__(self, text: str | None, pool: dict[str, str] | None = None):
        """pool: one copy of each word for many readings that are kept together."""
        text = text or ""
        self.words, self.size = tokens(text), max(1, len(text))
        if pool is not None:
            self.words = [pool.setdefault(w, w) for w in self.words]
        raw = text.split()
        self.raw_words = max(1, len(raw))
        self.mixed = _mixed(text)
        shouted = sum(map(str.isupper, raw))
        marks = sum(map(text.count, "!?.,;:*#$%&|@"))
        self.fixed = [_upper(text) / self.size, shouted / self.raw_words, marks / self.size, (text.count("!") + text.count("?")) / self.size, len(self.mixed) / self.raw_words]

    def features(self, lexicon: Lexicon) -> list[float]:
        words, n = self.words, max(1, len(self.words))
        unique = set(words)
        known, stems = unique & lexicon.words.keys(), {w for w in unique if w[:STEM] in lexicon.stems}
        hits = [w for w in words if w in known] if known else []
        begun = [w for w in words if w in stems] if stems else []
        either = [i for i, w in enumerate(words) if w in known or w in stems] if known or stems else []
        near = 0
        if either and not SECOND_PERSON.isdisjoint(unique):
            who, at = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON]), np.array(either)
            k = np.searchsorted(who, at)
            gap = np.minimum(np.abs(who[np.minimum(k, len(who) - 1)] - at), np.abs(who[np.maximum(k - 1, 0)] - at))
            near = int((gap <= NEAR).sum())
        unmasked = sum(1 for x in self.mixed if (w := "".join(_WORD.findall(x.lower().translate(_UNMASK)))) in lexicon.words or w[:STEM] in lexicon.stems)
        return [
            sum(lexicon.words[w] for w in hits) / n, len(hits) / n, float(len(hits)), sum(lexicon.stems[w[:STEM]] for w in begun) / n, len(begun) / n,
            float(len(begun)), len(either) / n, float(len(known)), near / n, *self.fixed, unmasked / self.raw_words, math.log1p(len(words)),
        ]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    return Reading(text).features(lexicon)


def _mixed(text: str) -> list[str]:
    """Words with marks or digits between letters."""
    out = []
    for m in _INNER.finditer(text):
        a, b = m.span()
        if a and b < len(text) and text[a - 1].isalpha() and text[b].isalpha():
            start = max(text.rfind(" ", 0, a), text.rfind("\n", 0, a)) + 1
            end = min((k for k in (text.find(" ", b), text.find("\n", b)) if k >= 0), default=len(text))
            out.append(text[start:end])
    return out


def _upper(text: str) -> int:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return int(((codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE)).sum())


class Trees:
    """Boosted regression trees for the logistic loss, grown on histograms of at most 64 bins a feature."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, leaf: int = 5, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.leaf, self.ridge = rounds, depth, rate, leaf, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start, self.edges = 0.0, []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, 33)), np.quantile(p, np.linspace(0, 1, 31)) if len(p := c[c > 0]) else []])) for c in x.T]
        share = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.start = math.log(share / (1 - share))
        bins, score = self.binned(x), np.full(len(y), self.start)
        width = 66
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            nodes = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
            at = np.zeros(len(y), np.int64)
            for node in range(nodes):
                mine = np.flatnonzero(at == node)
                if not len(mine):
                    continue
                total_g, total_h = g[mine].sum(), h[mine].sum()
                value[node] = -self.rate * total_g / (total_h + self.ridge)
                if node >= nodes // 2 or len(mine) < 2 * self.leaf:
                    continue
                best = 1e-6
                for j in range(x.shape[1]):
                    b = bins[mine, j]
                    left_g, left_h, left_n = (np.cumsum(np.bincount(b, w, width))[:-1] for w in (g[mine], h[mine], None))
                    gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - total_g**2 / (total_h + self.ridge)
                    gain[(left_n < self.leaf) | (len(mine) - left_n < self.leaf)] = 0
                    if gain.max() > best:
                        best, feature[node], cut[node] = gain.max(), j, int(gain.argmax())
                if feature[node] >= 0:
                    at[mine] = np.where(bins[mine, feature[node]] <= cut[node], 2 * node + 1, 2 * node + 2)
            self.trees.append((feature, cut, value))
            score += value[at]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins, score = self.binned(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                down = np.where(bins[rows, np.maximum(f, 0)] <= cut[at], 2 * at + 1, 2 * at + 2)
                at = np.where(f >= 0, down, at)
            score += value[at]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function nearest to y (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    return np.array([x for b in blocks for x in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in range(2)])


class Model:
    def __init__(self, texts: list[str], toxic: np.ndarray):
        self.share = float(toxic.mean()) if len(toxic) else 0.0
        self.trees, self.knots = None, None
        if not 0 < self.share < 1:
            self.lexicon = Lexicon({w: 3.0 for w in INSULTS}, {})
            return
        # what a text taught isn't seen as known in that text: its features use the lexicon of the other folds, and the
        # calibration uses trees of the other folds
        pool: dict[str, str] = {}
        read = [Reading(t, pool) for t in texts]
        y, fold = toxic.astype(float), np.arange(len(texts)) % 3
        x, raw = np.zeros((len(texts), FEATURES)), np.zeros(len(texts))
        for k in range(3):
            lexicon = Lexicon.learnt([t for t, f in zip(read, fold, strict=True) if f != k], toxic[fold != k])
            x[fold == k] = np.array([t.features(lexicon) for t, f in zip(read, fold, strict=True) if f == k]).reshape(-1, FEATURES)
        for k in range(3):
            raw[fold == k] = Trees().fit(x[fold != k], y[fold != k]).raw(x[fold == k]) if (fold != k).any() else 0.0
        self.knots = isotonic(raw, y)
        self.lexicon, self.trees = Lexicon.learnt(read, toxic), Trees().fit(x, y)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        raw = self.trees.raw(np.array([features(t, self.lexicon) for t in texts]).reshape(-1, FEATURES))
        return np.clip(np.interp(raw, *self.knots), 0.0, 1.0)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6_000) -> Model:
    """A model from at most `sample` labelled rows that are not held out; the rows with the smallest hashes."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    texts, toxic = [t or "" for t in rows["text"]], rows["toxic"].to_numpy().astype(int) > 0
    del rows
    return Model(texts, toxic)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = shared.value.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(shared.value.scores(part.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
