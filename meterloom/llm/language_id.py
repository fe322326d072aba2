"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import mapped, spread, written

#: Dimensions that n-grams are hashed to.
DIMENSIONS = 4096
_STEP = 1 << 20
#: Languages up to which their shares, some 40 bytes each, are sent to every task.
BROADCAST_LANGUAGES = 100_000
#: Whether a character is a letter; beyond the table Python is asked.
_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def _codes(text: str) -> np.ndarray:
    """Lower-case letters of a text, with one blank for each run of anything else."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = codes < len(_LETTER)
    letter = _LETTER[np.where(inside, codes, 0)] & inside
    if not inside.all():
        letter[~inside] = [chr(c).isalpha() for c in codes[~inside]]
    codes = np.where(letter, codes, 32)
    return codes[letter | np.r_[True, letter[:-1]]]


def counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1-, 2- and 3-grams of a whole text; None where it has no letter."""
    found, any_letter = np.zeros(DIMENSIONS), False
    text = text or ""
    for at in range(0, len(text), _STEP):
        codes = _codes(text[at : at + _STEP + 2]).astype(np.uint64)
        any_letter |= bool((codes != 32).any())
        mixed = np.zeros(len(codes), dtype=np.uint64)
        for n in range(3):
            mixed = (mixed[: len(codes) - n] * np.uint64(0x100000001B3)) ^ (codes[n:] + np.uint64(n + 1))
            slots = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
            found += np.bincount(slots.astype(np.int64), minlength=DIMENSIONS)
    return found if any_letter else None


@dataclass
class Centroids:
    """Unit vectors and, for each, its language; a language's least similarity that is believed."""

    idf: np.ndarray
    vectors: np.ndarray
    languages: np.ndarray
    least: dict[str, float]

    def weigh(self, found: np.ndarray) -> np.ndarray:
        weighed = np.log1p(found) * self.idf
        norms = np.linalg.norm(weighed, axis=-1, keepdims=True)
        return weighed / np.where(norms > 0, norms, 1)

    def nearest(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.vectors):
            return np.full(len(found), "und", dtype=object), np.zeros(len(found))
        cosines = self.weigh(found) @ self.vectors.T
        best = cosines.argmax(axis=1)
        return self.languages[best], np.clip(cosines[np.arange(len(found)), best], 0, 1)


def clustered(units: np.ndarray, *, centroids: int = 4, rounds: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Centroids of a language's unit vectors by spherical k-means, and the least cosine that is believed:
    half of what all but a thousandth of the vectors have."""
    rng = np.random.default_rng(seed)
    centres = units[rng.choice(len(units), min(centroids, len(units)), replace=False)]
    for _ in range(rounds):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = np.array([units[nearest == k].sum(axis=0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres, float(0.5 * np.quantile((units @ centres.T).max(axis=1), 0.001))


def fit(df: DataFrame, use: Column | None = None, *, rows_per_language: int = 500, **parameters) -> Centroids:
    """Centroids from df (doc_id, text, lang). Rows where `use` holds and lang is not null are eligible;
    about rows_per_language of each language are learned from, chosen by a hash of doc_id.

    Each language is a group of its own for k-means, of that many sparse rows, so tasks stay small
    whatever the languages; all languages are learned. The driver gets how many rows hold each of the
    DIMENSIONS, and the centroids: 131 KB a language, whatever the rows."""
    eligible = df.where(F.col("lang").isNotNull() & (use if use is not None else F.lit(True))).select("doc_id", "lang", "text")
    share = written(eligible.groupBy("lang").agg((rows_per_language / F.count("*")).alias("share")), "shares")
    chosen = spread("doc_id", 11) < F.col("share")
    if share.count() <= BROADCAST_LANGUAGES:
        sample = eligible.join(F.broadcast(share), "lang").where(chosen)
    else:  # ids alone go by language, texts by id
        ids = eligible.select("doc_id", "lang").join(share, "lang").where(chosen).select("doc_id", "lang").distinct()
        sample = eligible.join(ids, ["doc_id", "lang"], "left_semi")

    def start() -> Callable:
        def sparse(langs: list[str], texts: list[str]) -> tuple:
            rows = [(lang, found) for lang, text in zip(langs, texts) if (found := counts(text)) is not None]
            slots = [np.nonzero(found)[0] for _, found in rows]
            return [lang for lang, _ in rows], [s.astype(np.int32) for s in slots], [found[s].tolist() for (_, found), s in zip(rows, slots)]

        return sparse

    sample = written(mapped(sample, [], ["lang", "text"], start, "lang string, slots array<int>, n array<double>"), "sample")
    holding = np.zeros(DIMENSIONS)
    for slot, n in sample.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect():
        holding[slot] = n
    model = Centroids(np.log((1 + sample.count()) / (1 + holding)) + 1, np.zeros((0, DIMENSIONS)), np.array([], dtype=object), {})

    def learned(rows: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros((len(rows), DIMENSIONS))
        for own, slots, n in zip(found, rows["slots"], rows["n"]):
            own[slots] = n
        found = found[np.lexsort(found.T[::-1])]  # the same order whichever way the rows came
        centres, least = clustered(model.weigh(found), **parameters)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "v": list(centres), "least": least})

    found = sorted(map(tuple, sample.groupBy("lang").applyInPandas(learned, "lang string, v array<double>, least double").collect()))
    if found:
        model.vectors, model.languages = np.array([v for _, v, _ in found]), np.array([lang for lang, _, _ in found], dtype=object)
        model.least = {lang: least for lang, _, least in found}
    return model


def predict(df: DataFrame, model: Centroids, *, carry: Sequence[str] = ("doc_id",), names: Sequence[str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The columns `carry` of df, and under `names` the language, score (the cosine) and whether it is
    rejected, of each row of df (text and others).

    A null text and one without letters are `und` with score 0 and rejected. Other texts get the
    language of the nearest centroid, and are rejected where the cosine is below half of what all but
    a thousandth of that language's texts had. Repeated rows each give a row."""

    def start() -> Callable:
        def nearest(texts: list[str]) -> list[tuple]:
            found = [counts(text) for text in texts]
            langs, scores = model.nearest(np.array([np.zeros(DIMENSIONS) if x is None else x for x in found]))
            rows = [("und", 0.0, True) if x is None else (lang, float(s), bool(s < model.least.get(lang, 0))) for x, lang, s in zip(found, langs, scores)]
            return list(zip(*rows))

        return nearest

    return mapped(df, carry, ["text"], start, "{} string, {} double, {} boolean".format(*names), rows=128)
