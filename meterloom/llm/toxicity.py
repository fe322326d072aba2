"""Severity of toxicity by cumulative-link regression on sparse text features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import mapped, spread

_WORD = re.compile(r"[^\W\d_]+")
_WORDS_KEPT = 500_000
#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) > n)]


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


@dataclass
class Severity:
    """P(grade > k) = logistic(x . weights - thresholds[k]): one set of weights for all thresholds."""

    slots: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.thresholds, -30, 30)))


def learn(rows: list[tuple[int, dict[int, float]]], size: int, grades: int, *, l2: float = 0.02, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of (grade, {slot: value}), by gradient steps of adapted size.

    Thresholds are the first one and positive gaps, so they keep their order."""
    y = np.array([grade for grade, _ in rows])
    at = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
    slot = np.array([s for _, x in rows for s in x], dtype=np.int64)
    value = np.array([v for _, x in rows for v in x.values()])
    held = np.zeros(size + grades - 1)
    held[size] = 2.0
    first, second = np.zeros_like(held), np.zeros_like(held)
    for step in range(1, rounds + 1):
        weights, gaps = held[:size], np.exp(held[size + 1 :])
        thresholds = held[size] + np.r_[0, np.cumsum(gaps)]
        x = np.bincount(at, weights[slot] * value, minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(x[:, None] - thresholds, -30, 30)))
        # P(y) = above[y - 1] - above[y], with 1 below the lowest grade and 0 above the highest.
        above = np.hstack([np.ones((len(y), 1)), p, np.zeros((len(y), 1))])
        slope = above * (1 - above)
        row = np.arange(len(y))
        chance = np.maximum(above[row, y] - above[row, y + 1], 1e-9)
        low, high = slope[row, y] / chance, slope[row, y + 1] / chance
        by_x = -(low - high) / len(y)
        by_threshold = np.array([(low * (y == k + 1) - high * (y == k)).sum() for k in range(grades - 1)]) / len(y)
        gradient = np.r_[np.bincount(slot, by_x[at] * value, minlength=size) + l2 * weights / len(y), by_threshold.sum(), [by_threshold[k + 1 :].sum() * gaps[k] for k in range(grades - 2)]]
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        held -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return held[:size], held[size] + np.r_[0, np.cumsum(np.exp(held[size + 1 :]))]


def fit(df: DataFrame, labels: DataFrame, *, fit_rows: int = 12_000, vocabulary: int = 4_000, least_documents: int = 3) -> Severity:
    """The model from texts of df (doc_id, text) and labels (doc_id, label 0 or 1).

    About fit_rows labelled rows, chosen by a hash of doc_id, are used. Labels have two levels; a toxic
    document is of grade 2 where its share of words that tell toxic from clean is above the median of
    toxic ones, and of grade 1 otherwise. Features are the `vocabulary` words and word beginnings whose
    frequencies differ most between labels. Without labelled texts of both kinds all severities are zero."""
    labels = labels.where("label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    total = labels.count()
    sample = labels.where(spread("doc_id", 3) < min(1.0, fit_rows / max(1, total)))
    texts = df.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def start() -> Callable:
        return lambda texts: ([sorted({f for w in word_counts(text) for f in features(w)}) for text in texts],)

    present = mapped(texts, ["label"], ["text"], start, "found array<string>")
    sizes = dict(sample.groupBy(F.col("label").cast("int")).count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return Severity({}, np.zeros(0), np.array([30.0, 31.0]))
    counted = present.select("label", F.explode("found").alias("feature")).groupBy("feature").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    a, b = (F.col("toxic") + 0.5) / (sizes[1] + 1.0), (F.col("n") - F.col("toxic") + 0.5) / (sizes[0] + 1.0)
    telling = F.log(a / b) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("n") - F.col("toxic") + 0.5))
    best = counted.where(F.col("n") >= least_documents).select("feature", "toxic", "n", telling.alias("z")).orderBy(F.desc(F.abs("z")), "feature").limit(vocabulary).collect()
    slots = {row.feature: i for i, row in enumerate(best)}
    strong = {row.feature for row in best if row.z > 0 and row.toxic >= 0.9 * row.n}

    def sparse() -> Callable:
        def one(text: str) -> tuple[float, list, list]:
            words = word_counts(text)
            found = _sparse(words, slots, {})
            cues = sum(n for w, n in words.items() if any(f in strong for f in features(w)))
            return cues / max(1, words.total()), list(found), list(found.values())

        return lambda texts: zip(*map(one, texts))

    rows = mapped(texts, ["label"], ["text"], sparse, "cues double, slots array<int>, counts array<double>").collect()
    rows.sort(key=lambda r: (r.label, r.cues, r.slots, r.counts))
    if len({bool(r.label) for r in rows}) < 2:
        return Severity({}, np.zeros(0), np.array([30.0, 31.0]))
    median = float(np.median([r.cues for r in rows if r.label]))
    graded = [(int(r.label) + int(bool(r.label) and r.cues > median), dict(zip(r.slots, r.counts))) for r in rows]
    return Severity(slots, *learn(graded, len(slots), 3))


def _sparse(words: Counter, slots: dict[str, int], kept: dict[str, list[int]]) -> dict[int, float]:
    found: dict[int, float] = {}
    for word, n in words.items():
        if (own := kept.get(word)) is None:
            own = kept[word] = [slots[f] for f in features(word) if f in slots]
        for slot in own:
            found[slot] = found.get(slot, 0) + n
    return {slot: math.log1p(n) for slot, n in found.items()}


def severities(df: DataFrame, model: Severity) -> DataFrame:
    """doc_id, severity (the expected grade, 0 to 2), grade (the likeliest one) and toxic (grade 1 or
    more is likelier than not) of each row of df (doc_id, text).

    Null and empty texts are scored like others; repeated rows each give a row."""

    def start() -> Callable:
        kept: dict[str, list[int]] = {}

        def graded(texts: list[str]) -> tuple:
            x = []
            for text in texts:
                if len(kept) > _WORDS_KEPT:
                    kept.clear()
                x.append(sum(model.weights[s] * v for s, v in _sparse(word_counts(text), model.slots, kept).items()))
            above = model.above(np.array(x, dtype=float))
            each = -np.diff(np.hstack([np.ones((len(x), 1)), above, np.zeros((len(x), 1))]), axis=1)
            return above.sum(axis=1), each.argmax(axis=1).astype("int32"), above[:, 0] >= 0.5

        return graded

    return mapped(df, ["doc_id"], ["text"], start, "severity double, grade int, toxic boolean")


def classify(df: DataFrame, labels: DataFrame, use: Column | None = None, **parameters) -> DataFrame:
    """severities() of df by a model of df and those rows of labels (doc_id, label) where `use` holds."""
    return severities(df, fit(df, labels.where(use) if use is not None else labels, **parameters))
