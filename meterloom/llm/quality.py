"""A quality classifier: document statistics, random Fourier features, ridge, isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import mapped, written

STATISTICS = ("words", "word_length", "upper", "digits", "stops", "bangs", "bars", "symbols", "lines", "variety", "repeats", "commonest", "line_copies", "bare_words")
#: Groups of tasks whose sums meet first.
SHARES = 64
_KINDS = ("upper", "lower", "digit", "space", "stop", "bang", "bar", "symbol")


def _kind(c: str) -> int:
    if c.isupper():
        return 0
    if c.isalpha():
        return 1
    if c.isnumeric():
        return 2
    if c.isspace():
        return 3
    return 4 if c in ".,;:?'\"-()" else 5 if c == "!" else 6 if c == "|" else 7


#: Kinds of characters; those beyond the table count as lower-case letters.
_TABLE = np.array([_kind(chr(c)) for c in range(0x3000)], dtype=np.uint8)


def statistics(text: str | None) -> tuple[float, ...]:
    """STATISTICS of a whole text; null counts as empty."""
    text = text or ""
    kinds = np.zeros(len(_KINDS))
    for at in range(0, len(text), 1 << 20):
        codes = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds += np.bincount(np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], 1), minlength=len(_KINDS))
    words, lines = text.split(), [line for line in text.split("\n") if line.strip()]
    times, n, chars = Counter(words), max(1, len(words)), max(1, len(text))
    upper, lower, digits, _, stops, bangs, bars, symbols = kinds
    return (
        math.log1p(len(words)),
        min(40.0, (chars - kinds[3]) / n),
        upper / max(1.0, upper + lower),
        digits / chars,
        stops / n,
        bangs / n,
        bars / n,
        symbols / n,
        math.log1p(len(words) / max(1, len(lines))),
        math.log1p(len(times)) / math.log(n + 1.7),
        sum(map(str.__eq__, words, words[1:])) / n,
        (max(times.values()) if times else 0) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(map(str.isalpha, times)) / max(1, len(times)),
    )


def document_statistics(df: DataFrame, *, also: Sequence[str] = ()) -> DataFrame:
    """doc_id, columns named in `also`, and STATISTICS of each row of df (doc_id, text)."""

    def start() -> Callable:
        return lambda texts: zip(*map(statistics, texts))

    return mapped(df, ["doc_id", *also], ["text"], start, ", ".join(f"{name} double" for name in STATISTICS))


@dataclass
class Quality:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    calibrated: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        units = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(units @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw one keeps the order within a level."""
        raw = np.clip(self.raw(x), 0, 1)
        return 0.999 * np.interp(raw, self.at, self.calibrated) + 0.001 * raw


def isotonic(at: np.ndarray, means: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring violators pooled: places and levels that don't fall."""
    blocks: list[list[float]] = []
    for x, y, n in zip(at, means, sizes):
        blocks.append([x * n, y * n, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, *, waves: int = 256, width: float = 4.0, ridge: float = 0.1, bins: int = 200, seed: int = 5) -> Quality:
    """The model from statistics and labels (doc_id, label 0 or 1), whose rows all count.

    Each task sums the normal equations of its rows; sums meet by row of the matrix and a share of the
    tasks, then by row, so no group holds more than one in SHARES of them. What reaches the driver are the summed matrix and a histogram, of sizes that don't depend on the rows. Without
    labels of both kinds, every score is the mean label, or 1 where there is none."""
    train = stats.join(labels.where("label IS NOT NULL").groupBy("doc_id").agg(F.avg("label").alias("label")), "doc_id")
    train = written(train.select(*STATISTICS, F.col("label").cast("double")), "labelled")
    moments = train.agg(F.count("*").alias("n"), F.avg("label").alias("label"), *[f(name).alias(f"{kind}_{name}") for name in STATISTICS for kind, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng, d = np.random.default_rng(seed), len(STATISTICS)
    model = Quality(np.zeros(d), np.ones(d), rng.normal(size=(d, waves)) / width, rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.array([0.5]), np.array([1.0]))
    if not moments["n"]:
        return model
    model.mean = np.array([moments[f"m_{name}"] for name in STATISTICS])
    model.scale = np.array([max(moments[f"s_{name}"], 1e-6) for name in STATISTICS])
    model.calibrated = np.array([moments["label"]])
    if moments["label"] in (0.0, 1.0):
        return model

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((waves + 1, waves + 2))
        for batch in batches:
            z = model.features(batch[list(STATISTICS)].to_numpy())
            total += z.T @ np.column_stack([z, batch["label"]])
        yield pd.DataFrame({"row": np.arange(waves + 1), "share": TaskContext.get().partitionId() % SHARES, "v": list(total)})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[:1].assign(v=[np.sum(np.stack(rows["v"].to_list()), axis=0)])

    schema = "row int, share int, v array<double>"
    shares = train.mapInPandas(sums, schema).groupBy("row", "share").applyInPandas(added, schema)
    parts = shares.groupBy("row").applyInPandas(added, schema).collect()
    total = np.array([v for _, v in sorted((row, v) for row, _, v in parts)])
    model.weights = np.linalg.solve(total[:, :-1] + ridge * np.eye(waves + 1), total[:, -1])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = np.clip(model.raw(batch[list(STATISTICS)].to_numpy()), 0, 1)
            yield pd.DataFrame({"bin": np.minimum(bins - 1, (raw * bins).astype(int)), "raw": raw, "label": batch["label"].to_numpy()})

    histogram = train.mapInPandas(binned, "bin int, raw double, label double").groupBy("bin").agg(F.avg("raw"), F.avg("label"), F.count("*")).orderBy("bin").collect()
    model.at, model.calibrated = isotonic(*(np.array([row[i] for row in histogram]) for i in (1, 2, 3)))
    return model


def predict(df: DataFrame, model: Quality, *, threshold: float = 0.7, carry: Sequence[str] = ("doc_id",), names: Sequence[str] = ("score", "predicted")) -> DataFrame:
    """The columns `carry` of df, and under `names` the score and whether it reaches the threshold (1 or
    0), of each row of df (text and others)."""

    def start() -> Callable:
        def scored(texts: list[str]) -> tuple:
            scores = model.scores(np.array([statistics(text) for text in texts]))
            return scores, (scores >= threshold).astype("int32")

        return scored

    return mapped(df, carry, ["text"], start, "{} double, {} int".format(*names))


def classify(df: DataFrame, labels: DataFrame, use: Column | None = None, *, threshold: float = 0.7, also: Sequence[str] = (), **parameters) -> DataFrame:
    """doc_id, columns named in `also`, score (0 to 1) and predicted (1 from the threshold on) of each
    row of df (doc_id, text), with a model learned from the rows of labels (doc_id, label) where `use`
    holds.

    Null and empty texts are scored like others; repeated rows each give a row."""
    stats = written(document_statistics(df, also=also), "statistics")
    model = fit(stats, labels.where(use) if use is not None else labels, **parameters)

    def start() -> Callable:
        def scored(*columns: list[float]) -> tuple:
            scores = model.scores(np.column_stack(columns))
            return scores, (scores >= threshold).astype("int32")

        return scored

    return mapped(stats, ["doc_id", *also], STATISTICS, start, "score double, predicted int", rows=4096)
