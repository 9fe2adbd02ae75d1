"""Toxicity by maximum-scoring segments.

Words of labelled documents are counted by class; their log-odds are smoothed by
a Dirichlet prior in proportion to the words' overall counts. In a document,
words whose z-score is significant score their log-odds, toxic ones above and
clean ones below zero, and all others a small negative drift. A linear scan finds
all maximal scoring segments. A segment's score follows an extreme-value law,
whose decay comes from the clean documents' word scores: among n clean words, a
score of x is expected n * exp(-decay * x) times. Segments expected fewer than
``SIGNIFICANT`` times are the toxic passages. The margins of all segments that
are expected less than once add up to the document's evidence, which a logistic
fit turns into a probability.

Whether words count whole or by their first letters, the prior and the least
z-score are chosen among ``CHOICES``, and the logistic fit is made, by folds
inside the labelled rows of the fit: each row's evidence comes from counts
without its fold. Copies of a text are in one fold. Of ``LETTERS`` only whole
words are offered: five first letters found no row more on the tables at hand,
and each choice adds to what the driver holds.

Fitting reads a bounded sample of labelled rows; scoring is a narrow map.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import fresh, labelled_sample, materialise, remainder, table

#: Labelled rows for the fit, about.
SAMPLE = 20_000
#: Letters of a word's beginning that count (0: the whole word), pseudo-counts of the prior as a share of all counts, and the least z-score of a word that counts.
LETTERS = (0,)
CHOICES = [(letters, prior, z) for letters in LETTERS for prior in (0.1, 0.3) for z in (2.0, 3.0)]
FOLDS = 4
DRIFT = 0.1
#: Segments as good as a passage's that are expected among as many clean words.
SIGNIFICANT = 0.05
WORD = re.compile(r"\w+")


def words(text: str | None, letters: int = 0) -> list[str]:
    found = WORD.findall(text.lower()) if text else []
    return [w[:letters] for w in found] if letters else found


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of words with an informative Dirichlet prior, and their z-scores; ``n_toxic`` and ``n_clean`` are the classes' sums."""
    prior = np.maximum(share * (toxic + clean), 1e-9)
    a = n_toxic + share * (n_toxic + n_clean) + 1e-9
    b = n_clean + share * (n_toxic + n_clean) + 1e-9
    odds = np.log((toxic + prior) / np.maximum(a - toxic - prior, 1e-9)) - np.log((clean + prior) / np.maximum(b - clean - prior, 1e-9))
    return odds, odds / np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))


def segments(places: list[int], scores: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first word, one past the last).

    ``places`` and ``scores`` are the words that have a score of their own; all
    others score ``-drift``. Each candidate is held with the sums to its left and
    right ends, as in the linear-time scan over all words.
    """
    held: list[tuple[float, float, int, int, int]] = []
    total, last = 0.0, -1
    for at, score in zip(places, scores):
        left, first = total - drift * (at - last - 1), at
        right = left + score
        total, last = right, at
        if score <= 0:
            continue
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= left:
                j = held[j][4]  # the nearest earlier one that starts lower
            if j < 0 or held[j][1] >= right:
                break
            left, first = held[j][0], held[j][2]
            del held[j:]
        held.append((left, right, first, at + 1, j))
    return [(right - left, first, end) for left, right, first, end, _ in held]


def decay(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(x * score)) = 1, the tail's decay for clean words; what ``share`` leaves scores the drift."""
    rest = max(0.0, 1 - float(share.sum()))

    def excess(x: float) -> float:
        return float(share @ np.exp(np.minimum(x * scores, 600))) + rest * math.exp(-x * DRIFT) - share.sum() - rest

    low, high = 1e-6, 1e-3
    while excess(high) < 0 and high < 50:
        low, high = high, high * 1.5
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def places(text: str | None, numbers: dict[str, int], letters: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many words a text has, and the places and numbers of those that have one."""
    own = words(text, letters)
    found = np.fromiter((numbers.get(w, -1) for w in own), np.int64, len(own))
    at = np.flatnonzero(found >= 0)
    return len(own), at, found[at]


def evidence(n: int, found: list[tuple[float, int, int]], rate: float) -> float:
    """The margins of all segments expected less than once among n clean words, or the best segment's where there is none."""
    base = math.log(n + 1)
    margins = [rate * s - base for s, _, _ in found]
    return sum(m for m in margins if m > 0) or max(margins, default=-base)


@dataclass
class Model:
    #: Numbers of the words of at least the least z-score, and their log-odds.
    numbers: dict[str, int]
    odds: np.ndarray
    rate: float = 1.0
    slope: float = 1.0
    offset: float = 0.0
    choice: tuple[int, float, float] = field(default=CHOICES[0])

    def segments(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        n, at, numbers = places(text, self.numbers, self.choice[0])
        return n, segments(at.tolist(), self.odds[numbers].tolist(), DRIFT)

    def judge(self, text: str | None) -> tuple[float, list[tuple[float, int, int]]]:
        """The probability, and (expected number among as many clean words, first word, one past the last) of each toxic passage, from one scan."""
        n, found = self.segments(text)
        expected = [((n + 1) * math.exp(-self.rate * s), a, b) for s, a, b in found]
        return self.probability(evidence(n, found, self.rate)), [x for x in expected if x[0] < SIGNIFICANT]

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * x + self.offset))))

    def score(self, text: str | None) -> float:
        return self.judge(text)[0]

    def passages(self, text: str | None) -> list[tuple[float, int, int]]:
        return self.judge(text)[1]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float, float]:
    """Slope, offset and mean loss by damped Newton steps, with smoothed targets and a weak ridge."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    middle, scale = x.mean(), max(x.std(), 1e-6)
    f = np.stack([(x - middle) / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        h = f.T @ (f * (p * (1 - p) + 1e-6)[:, None]) + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, f.T @ (target - p) - 1e-3 * w), -2, 2)
    p = np.clip(1 / (1 + np.exp(-np.clip(f @ w, -30, 30))), 1e-9, 1 - 1e-9)
    loss = -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    return float(max(w[0], 0) / scale), float(w[1] - max(w[0], 0) * middle / scale), loss


def counted(rows: DataFrame) -> DataFrame:
    """(letters, word, toxic, clean): by fold, in how many different texts of each class a word, or a beginning of so many letters, is.

    Each text counts a word once and copies of a text count once, so that one
    document's habit isn't a class's.
    """

    @F.pandas_udf("array<array<string>>")
    def distinct(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [list(set(words(t, letters))) for letters in LETTERS])

    texts = rows.groupBy(F.sha2(F.col("text").cast("binary"), 256)).agg(F.max("label").alias("label"), F.first("fold").alias("fold"), F.first("text").alias("text"))
    kinds = texts.select("label", "fold", F.posexplode(distinct("text")).alias("k", "words"))
    exploded = kinds.select("label", "fold", F.element_at(F.array(*map(F.lit, LETTERS)), F.col("k") + 1).alias("letters"), F.explode("words").alias("word"))
    sums = lambda label: F.array(*(F.sum(((F.col("fold") == k) & (F.col("label") == label)).cast("long")).cast("double") for k in range(FOLDS)))
    return exploded.groupBy("letters", "word").agg(sums(1).alias("toxic"), sums(0).alias("clean"))


def without_fold(counts: np.ndarray) -> np.ndarray:
    """Sums of a row's counts by fold without each fold, and then of all."""
    whole = counts.sum(axis=-1, keepdims=True)
    return np.append(whole - counts, whole, axis=-1)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", held_out=None, sample: int = SAMPLE) -> Model | float:
    """A model, or the constant score where the sample has fewer than two labels.

    The driver gets the words that are significant with some choice and some
    fold left out; the sample bounds their number.
    """
    out = F.lit(False) if held_out is None else held_out
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int")
    rows = materialise(labelled_sample(docs, labels, column, out, sample).withColumn("fold", fold), "toxicity-sample")
    one = rows.agg(F.count("*").alias("n"), F.avg("label").alias("p")).first()
    if not one.n or one.p in (0.0, 1.0):
        return float(one.p) if one.n else 0.5

    counts = materialise(counted(rows), "toxicity-counts")
    sums = {r.letters: r for r in counts.groupBy("letters").agg(*(F.coalesce(F.sum(F.col(c)[k]), F.lit(0.0)).alias(f"{c}{k}") for c in ("toxic", "clean") for k in range(FOLDS))).collect()}
    totals = {letters: {c: without_fold(np.array([sums[letters][f"{c}{k}"] if letters in sums else 0.0 for k in range(FOLDS)])) for c in ("toxic", "clean")} for letters in LETTERS}

    @F.pandas_udf("boolean")
    def significant(letters: pd.Series, toxic: pd.Series, clean: pd.Series) -> pd.Series:
        a, b = (without_fold(np.array(x.tolist()).reshape(-1, FOLDS)) for x in (toxic, clean))
        kinds = letters.to_numpy()
        found = [(kinds == kind) & (np.abs(log_odds(a, b, totals[kind]["toxic"], totals[kind]["clean"], prior)[1]).max(axis=1) >= least) for kind, prior, least in CHOICES]
        return pd.Series(np.any(found, axis=0))

    all_kept = counts.where(significant("letters", "toxic", "clean")).toPandas().sort_values(["letters", "word"])
    names, numbers, tables, rates = {}, {}, {}, {}
    for letters in LETTERS:
        kept = all_kept[all_kept["letters"] == letters]
        names[letters] = kept["word"].tolist()
        numbers[letters] = {w: i for i, w in enumerate(names[letters])}
        own = {c: without_fold(np.array(kept[c].tolist()).reshape(-1, FOLDS)) for c in ("toxic", "clean")}
        total = totals[letters]
        for kind, prior, least in CHOICES:
            for k in range(FOLDS + 1) if kind == letters else ():
                odds, z = log_odds(own["toxic"][:, k], own["clean"][:, k], total["toxic"][k], total["clean"][k], prior)
                odds = np.where(np.abs(z) >= least, odds, -DRIFT)
                clean = own["clean"][:, k] / max(total["clean"][k], 1.0)
                tables[kind, prior, least, k], rates[kind, prior, least, k] = odds.astype(np.float32), decay(odds, clean)
    held = docs.sparkSession.sparkContext.broadcast((numbers, tables, rates))

    @F.pandas_udf("array<double>")
    def unseen(texts: pd.Series, folds: pd.Series) -> pd.Series:
        numbers, tables, rates = held.value
        out = []
        for text, k in zip(texts, folds):
            found = {letters: places(text, numbers[letters], letters) for letters in LETTERS}
            out.append([evidence(n, segments(at.tolist(), tables[*c, k][own].tolist(), DRIFT), rates[*c, k]) for c in CHOICES for n, at, own in [found[c[0]]]])
        return pd.Series(out)

    known = rows.select("label", unseen("text", "fold").alias("x")).toPandas()  # at most about SAMPLE rows of a few numbers
    x, y = np.array(known["x"].tolist()), known["label"].to_numpy(dtype=float)
    fits = [logistic(x[:, i], y) for i in range(len(CHOICES))]
    best = min(range(len(CHOICES)), key=lambda i: (round(fits[i][2], 9), i))
    odds = tables[*CHOICES[best], FOLDS]
    used = np.flatnonzero(odds != np.float32(-DRIFT))
    own_names = names[CHOICES[best][0]]
    return Model({own_names[j]: i for i, j in enumerate(used)}, odds[used], rates[*CHOICES[best], FOLDS], *fits[best][:2], CHOICES[best])


def scored(docs: DataFrame, model: Model | float, name: str = "score") -> DataFrame:
    """``docs`` with the probability of each row's whole text in column ``name``, in place of an own one of that name.

    Null and empty texts have no segment and the score that this gives; repeated
    rows have equal scores; all other columns pass through.
    """
    if isinstance(model, float):
        return docs.withColumn(name, F.lit(model))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(held.value.score).astype("float64")

    return docs.withColumn(name, score("text"))


PASSAGE = "struct<expected:double,first:long,end:long>"


def judged(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score, passages) of each row; a passage has the number of as good ones expected among as many clean words, its first word and one past its last.

    Null and empty texts have no passage; repeated rows and null ids give one
    row each; other columns are dropped. A constant model finds no passage.
    """
    if isinstance(model, float):
        return docs.select("doc_id", F.lit(model).alias("score"), F.array().cast(f"array<{PASSAGE}>").alias("passages"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(f"score double, passages array<{PASSAGE}>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            scores, found = [], []
            for text in texts:
                score, passages = held.value.judge(text)
                scores.append(score)
                found.append([{"expected": e, "first": a, "end": b} for e, a, b in passages])
            yield pd.DataFrame({"score": scores, "passages": found})

    return docs.select("doc_id", judge("text").alias("j")).select("doc_id", "j.*")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below ``threshold``, columns unchanged.

    Null and empty texts have the score of a text without segments; repeated
    rows go or stay together. If all labels are alike, all rows are as the labels
    say; without labels, all stay.
    """
    model, name = fit(docs, labels), fresh(docs, "score")
    if model == 0.5:
        return docs  # no labels
    return scored(docs, model, name).where(F.col(name) < threshold).drop(name)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    held = remainder(F.col("doc_id"), 5) == 0
    return judged(docs.select("doc_id", "text"), fit(docs, labels, held_out=held)).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), "passages"
    )
