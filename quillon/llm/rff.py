"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a document's whole text (shares of character classes, repetition,
word lengths, compressibility) are mapped by ``FEATURES`` random cosines, whose
inner products approximate a Gaussian kernel. Each partition of the sample sums
its part of the normal equations; the driver adds these few matrices and solves
them. Scores that each fold gets from a model fitted without it are binned, and
pooling of adjacent violators over the bins gives the calibrated probability.

The model is fitted on a bounded sample (``SAMPLE`` labelled rows); scoring is a
narrow map over documents, without a shuffle. Statistics read text alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import fresh, labelled_sample, materialise, remainder, table

FEATURES = 256
#: Labelled rows for the fit, about.
SAMPLE = 20_000
RIDGE = 1e-3
FOLDS = 4
BINS = 256
#: Partitions of the sample, whatever its size; the driver gets so many sums.
SUMS = 8
SEED = 20_240

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:'\"()?-",
    "bang": b"!",
    "bar": b"|",
    "sign": b"#$%&*+/<=>@[\\]^_`{}~",
    "line": b"\n\r",
    "blank": b" \t",
}
MARK = {name: bytes([i]) for i, name in enumerate(CLASSES)}
TABLE = bytes(next((i for i, x in enumerate(CLASSES.values()) if b in x), len(CLASSES) + (b > 127)) for b in range(256))
NAMES = [*CLASSES, "words", "word_length", "distinct", "repeated", "line_repeats", "ends", "packed", "longest"]


def statistics(text: str | None) -> list[float]:
    """A vector for any text; null and empty ones give zeros."""
    if not text:
        return [0.0] * len(NAMES)
    data = text.encode()
    kinds, n = data.translate(TABLE), len(data)
    words, lines = text.split(), text.split("\n")
    m = len(words)
    return [
        *(kinds.count(mark) / n for mark in MARK.values()),
        math.log1p(m),
        len(text) / (m + 1),
        len(set(words)) / (m + 1),
        sum(map(eq, words, words[1:])) / (m + 1),
        1 - len(set(lines)) / len(lines),
        sum(w[-1] in "!#$%&*|" for w in words) / (m + 1),
        len(zlib.compress(data, 1)) / n,
        math.log1p(max(map(len, words), default=0)),
    ]


@dataclass
class Model:
    """Everything a score needs; a few hundred KB whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return features(x, self.mean, self.scale, self.waves, self.phases)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rounded, since a matrix product's last bits depend on the rows beside it."""
        return np.round(np.interp(self.raw(x), self.edges, self.levels), 9)


def features(x, mean, scale, waves, phases) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([np.cos(z @ waves + phases) * math.sqrt(2 / waves.shape[1]), np.ones((len(z), 1))])


def isotonic(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: (centres, non-decreasing levels) of the pools."""
    pools: list[list[float]] = []
    for s, y, w in zip(scores, labels, weights):
        pools.append([s * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    total = np.array(pools)
    return total[:, 0] / total[:, 2], total[:, 1] / total[:, 2]


def _sums(rows: DataFrame, mean, scale, waves, phases) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Normal equations of each fold, summed by partition and then over these."""
    d = waves.shape[1] + 1

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {k: (np.zeros((d, d)), np.zeros(d)) for k in range(FOLDS)}
        for rows in batches:
            f = features(np.array(rows["x"].tolist()), mean, scale, waves, phases)
            for k in range(FOLDS):
                own = (rows["fold"] == k).to_numpy()
                sums[k] = (sums[k][0] + f[own].T @ f[own], sums[k][1] + f[own].T @ rows["label"].to_numpy()[own])
        yield pd.DataFrame([(k, a.tobytes(), b.tobytes()) for k, (a, b) in sums.items()], columns=["fold", "a", "b"])

    few = rows.coalesce(SUMS)  # the sample is bounded, and so is what the driver gets
    out = {k: (np.zeros((d, d)), np.zeros(d)) for k in range(FOLDS)}
    for r in sorted(few.mapInPandas(part, "fold int, a binary, b binary").collect(), key=lambda r: (r.fold, bytes(r.b))):
        a, b = out[r.fold]
        out[r.fold] = (a + np.frombuffer(r.a).reshape(d, d), b + np.frombuffer(r.b))
    return out


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", held_out=None, sample: int = SAMPLE) -> Model | float:
    """A model, or the constant score where the sample has fewer than two labels."""
    out = F.lit(False) if held_out is None else held_out

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    rows = materialise(
        labelled_sample(docs, labels, column, out, sample).select(
            "doc_id", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold"), measured("text").alias("x")
        ),
        "quality-sample",
    )
    one = rows.agg(
        F.count("*").alias("n"), F.avg("label").alias("p"),
        *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(NAMES))), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(len(NAMES))),
    ).first()
    if not one.n or one.p in (0.0, 1.0):
        return float(one.p) if one.n else 0.5
    mean = np.array([one[f"m{i}"] for i in range(len(NAMES))])
    scale = np.maximum(np.array([one[f"s{i}"] for i in range(len(NAMES))]), 1e-6)
    rnd = np.random.default_rng(SEED)
    waves, phases = rnd.normal(size=(len(NAMES), FEATURES)) / math.sqrt(len(NAMES)), rnd.uniform(0, 2 * math.pi, FEATURES)

    folds = _sums(rows, mean, scale, waves, phases)
    whole = [sum(x) for x in zip(*folds.values())]
    eye = RIDGE * one.n * np.eye(FEATURES + 1) / FEATURES
    without = np.array([np.linalg.solve(whole[0] - a + eye, whole[1] - b) for a, b in folds.values()])

    @F.pandas_udf("double")
    def unseen(x: pd.Series, fold: pd.Series) -> pd.Series:
        f = features(np.array(x.tolist()), mean, scale, waves, phases)
        return pd.Series((f * without[fold.to_numpy()]).sum(axis=1))

    scored = rows.select("label", F.least(F.greatest(unseen("x", "fold"), F.lit(-0.5)), F.lit(1.5)).alias("s"))
    bins = scored.groupBy(F.floor((F.col("s") + 0.5) * (BINS / 2)).alias("bin")).agg(F.avg("s").alias("s"), F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    edges, levels = isotonic(*(np.array([float(r[k]) for r in bins]) for k in ("s", "y", "n")))
    return Model(mean, scale, waves, phases, np.linalg.solve(whole[0] + eye, whole[1]), edges, levels)


def scored(docs: DataFrame, model: Model | float, name: str = "score") -> DataFrame:
    """``docs`` with the score of each row's whole text in column ``name``, in place of an own one of that name.

    Null and empty texts have the score of the zero vector; repeated rows have
    equal scores; all other columns pass through.
    """
    if isinstance(model, float):
        return docs.withColumn(name, F.lit(model))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(held.value.score(np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES))))

    return docs.withColumn(name, score("text"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is at least ``threshold``, columns unchanged.

    Null and empty texts have the score of the zero vector; repeated rows go or
    stay together. If all labels are alike, all rows are as the labels say;
    without labels, all stay.
    """
    name = fresh(docs, "score")
    return scored(docs, fit(docs, labels), name).where(F.col(name) >= threshold).drop(name)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    held = remainder(F.col("doc_id"), 3) == 1
    return scored(docs.select("doc_id", "text"), fit(docs, labels, held_out=held)).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
