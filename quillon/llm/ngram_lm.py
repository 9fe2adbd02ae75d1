"""Stupid-backoff bigram scores, computed relationally.

    log S(w | v) = log c(v w) - log c(v)              if the corpus has the bigram
                   log BACKOFF + log c(w) - log N     otherwise, and without BACKOFF for a first word

Every word and every bigram of the corpus is counted as itself, whatever the
corpus' size. Words of at least one in ``FREQUENT`` tokens, by arithmetic at
most ``FREQUENT``, have a number and are broadcast with their counts; any other
word is known by a hash of 63 bits. A bigram's key joins two numbers, or is a
hash of 63 bits if one of its words has none. Bigrams of two words of at least
one in ``COMMON`` tokens each are at most COMMON^2; these hot keys are counted
apart, broadcast, and looked up where the text is.

All other bigrams, and the words without a number, are exploded once: a row for
each document and key, with the number of occurrences. One shuffle by key
brings a key's rows together, so each gets its count there, and the logarithms
are summed per document. A document's base (what is known without the shuffle)
travels under a key of its own, so no key gathers the bases.

A corpus that scores itself has no unseen bigram, so its rows carry no more than
that. Rows of foreign documents also carry what they score if unseen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import ascii_lower, materialise, table

FREQUENT, COMMON = 1_000_000, 1_000
BACKOFF = 0.4
SHIFT = 21  # bits of a word's number
TOP = -(1 << 63)  # the bit that hashes have and other keys lack
UNSEEN = 0.5  # the count of a word that the corpus lacks
SMALL = 2_000_000  # characters of foreign documents up to which the corpus is asked for their keys alone
SLICE = 256  # documents that a worker takes apart at once


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): runs of anything but ASCII white space, A-Z as a-z."""
    words = F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+")
    return docs.select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def rare_words(counts: DataFrame, total: int) -> DataFrame:
    """(id, n) of the words without a number; the ids are those of ``word_id``."""
    rare = counts.where(F.col("n") * FREQUENT < total)
    return rare.groupBy(F.xxhash64("word").bitwiseOR(F.lit(TOP)).alias("id")).agg(F.sum("n").alias("n"))


def word_id(word: bytes) -> int:
    """The same as Spark's xxhash64, with the top bit set."""
    from xxhash import xxh64_intdigest

    return (xxh64_intdigest(word, 42) | 1 << 63) - (1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Vocabulary:
    """Numbers, from 1 on, and log counts of frequent words; the common ones come first."""

    def __init__(self, counts: list[tuple[bytes, int]], total: int):
        ordered = sorted(counts, key=lambda x: (-x[1], x[0]))
        self.numbers = {w: i + 1 for i, (w, _) in enumerate(ordered)}
        #: 0 stands for words without a number, whose counts come from the join.
        self.logs = np.log(np.array([1, *(n for _, n in ordered)], np.float64))
        self.log_total = math.log(max(total, 1))
        self.common = 1 + sum(n * COMMON >= total for _, n in ordered)

    def words(self, text: str | None, rare: bool = True) -> np.ndarray:
        """Numbers of a text's words; other words' ids, which are negative, or 0 without ``rare``."""
        words = text.encode().lower().split() if text else []
        numbers = self.numbers
        own = np.fromiter((numbers.get(w, 0) for w in words), np.int64, len(words))
        if rare:
            at = np.flatnonzero(own == 0)
            own[at] = np.fromiter((word_id(words[i]) for i in at), np.int64, len(at))
        return own

    def pairs(self, own: np.ndarray) -> np.ndarray:
        """Bigrams' keys; with a word that has only an id, a negative hash."""
        v, w = own[:-1], own[1:]
        keys = v << SHIFT | w
        at = np.flatnonzero((v < 0) | (w < 0))
        hashed = mixed(mixed(v[at].view(np.uint64)) + w[at].view(np.uint64)).view(np.int64)
        keys[at] = hashed | TOP
        return keys

    def hot(self, keys: np.ndarray) -> np.ndarray:
        v, w = keys >> SHIFT, keys & (1 << SHIFT) - 1
        return (v > 0) & (v < self.common) & (w > 0) & (w < self.common)


def hot_counts(docs: DataFrame, held) -> DataFrame:
    """(key, n) of bigrams of two common words: at most COMMON^2 rows, of which each task sends its own once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = held.value.common
        sums = np.zeros(size * size, np.int64)
        for batch in batches:
            for text in batch["text"]:
                keys = held.value.pairs(held.value.words(text, rare=False))
                keys = keys[held.value.hot(keys)]
                np.add.at(sums, (keys >> SHIFT) * size + (keys & (1 << SHIFT) - 1), 1)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"key": at // size << SHIFT | at % size, "n": sums[at]})

    return docs.select("text").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


SEEN = {"key": "long", "code": "int"}
#: What a row says of its key: ``code`` is four times the number of occurrences and one of these.
BIGRAM, WORD, END = 0, 1, 2
FOREIGN = {"back": "double", "v": "long", "w": "long"}


def among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which keys are in ``wanted``, which is sorted."""
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys if len(wanted) else np.zeros(len(keys), bool)


def exploded(docs: DataFrame, held, hot, foreign: bool, wanted=None) -> DataFrame:
    """(row, key, code) for each row of ``docs`` and each key in it that isn't hot, and (row, doc_id, words, known) under a key of its own.

    If all bigrams are seen, a score is the sum of the logarithms of the counts
    of its bigrams and of its first and last word, less those of all its words
    and that of N. With ``foreign``, bigrams also have ``back``, which they add
    instead if unseen, without the logarithms of the counts of their rare words
    ``v`` and ``w`` (0: not rare). With ``wanted``, a broadcast of sorted keys, other
    keys are left out.
    """
    columns = {**SEEN, **FOREIGN} if foreign else SEEN

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vocabulary = held.value
        logs, n = vocabulary.logs, vocabulary.log_total
        keys_hot, logs_hot = hot.value
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                words, known, found, ends = [], [], {c: [] for c in columns}, [0]
                for text in part.column(1):
                    own = vocabulary.words(text.as_py())
                    keys = vocabulary.pairs(own)
                    numbered = np.maximum(own, 0)
                    score = logs[numbered[[0, -1]]].sum() - logs[numbered].sum() - n if len(own) else 0.0
                    is_hot = vocabulary.hot(keys)
                    if is_hot.any():
                        places = np.flatnonzero(is_hot)
                        at = np.searchsorted(keys_hot, keys[places])
                        seen = keys_hot[np.minimum(at, len(keys_hot) - 1)] == keys[places] if len(keys_hot) else np.zeros(len(places), bool)
                        unseen = places[~seen]
                        score += logs_hot[at[seen]].sum() + (math.log(BACKOFF) - n + logs[own[unseen]] + logs[own[unseen + 1]]).sum()
                    places = np.flatnonzero(~is_hot)
                    rest, first, times = np.unique(keys[places], return_index=True, return_counts=True)
                    rare, often = np.unique(own[own < 0], return_counts=True)
                    if wanted is not None:
                        kept, kept_rare = among(rest, wanted.value), among(rare, wanted.value)
                        rest, first, times, rare, often = rest[kept], first[kept], times[kept], rare[kept_rare], often[kept_rare]
                    ends_rare = own[[0, -1]][own[[0, -1]] < 0] if len(own) else own
                    found["key"] += [rest, rare, ends_rare]
                    found["code"] += [4 * times + BIGRAM, 4 * often + WORD, np.full(len(ends_rare), 4 + END)]
                    if foreign:
                        at = places[first]
                        nothing = np.zeros(len(rare) + len(ends_rare), np.int64)
                        found["back"] += [math.log(BACKOFF) - n + logs[numbered[at]] + logs[numbered[at + 1]], nothing]
                        found["v"] += [np.minimum(own[at], 0), nothing]
                        found["w"] += [np.minimum(own[at + 1], 0), nothing]
                    words.append(len(own))
                    known.append(float(score))
                    ends.append(ends[-1] + len(rest) + len(rare) + len(ends_rare))
                offsets, kinds = pa.array(ends, pa.int32()), {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found[c])).cast(kinds[t])) for c, t in columns.items()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(known, pa.float64()), *lists], names=["doc_id", "words", "known", *columns])

    schema = "doc_id long, words long, known double, " + ", ".join(f"{c} array<{t}>" for c, t in columns.items())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, schema).select(F.monotonically_increasing_id().alias("row"), "*")
    nothing = {c: F.lit(None).cast(t).alias(c) for c, t in columns.items()} | {"key": F.xxhash64("row", F.lit("base")).alias("key"), "code": F.lit(END).alias("code")}
    base = F.array(F.struct(*nothing.values()))
    rows = own.select("row", "doc_id", "words", "known", F.posexplode(F.concat(base, F.arrays_zip(*columns))).alias("at", "g"))
    first = [F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("doc_id", "words", "known")]
    return rows.select("row", *(F.col(f"g.{c}").alias(c) for c in columns), *first)


def scored(docs: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, score, per_word) for each row of ``docs`` under the bigrams of ``corpus``; without one, under its own.

    Null, empty and wordless texts have no words, score 0 and a null
    ``per_word``. Repeated rows are scored each, and count each; null ids are
    rows like others; extra columns are ignored. A word that the corpus lacks
    counts half.
    """
    spark, foreign = docs.sparkSession, corpus is not None
    known = docs if corpus is None else corpus
    counts = materialise(word_counts(known), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = [(r.word.encode(), r.n) for r in counts.where(F.col("n") * FREQUENT >= total).toLocalIterator()]  # at most FREQUENT
    held = spark.sparkContext.broadcast(Vocabulary(frequent, total))
    often = hot_counts(known, held).toPandas().sort_values("key")  # at most COMMON^2
    hot = spark.sparkContext.broadcast((often["key"].to_numpy(np.int64), np.log(often["n"].to_numpy(np.float64))))

    rows = exploded(docs, held, hot, foreign)
    times, kind = F.shiftright("code", 2), F.col("code").bitwiseAND(3)
    occurs = F.when(kind < END, times).otherwise(0)
    if foreign:
        wanted = None
        if (docs.agg(F.sum(F.length("text"))).first()[0] or 0) <= SMALL:
            # Keys that no document has count for none; a text has fewer keys than characters.
            wanted = spark.sparkContext.broadcast(np.sort(rows.select("key").distinct().toPandas()["key"].to_numpy(np.int64)))
        rows = rows.unionByName(exploded(corpus, held, hot, False, wanted).where(kind < END).select("key", "code"), allowMissingColumns=True)
        occurs = F.when(F.col("row").isNull(), occurs).otherwise(0)
    counted = rows.withColumn("count", F.sum(occurs).over(Window.partitionBy("key")))
    weight = F.when(kind == WORD, -times).otherwise(times)
    gain = weight * F.log(F.when(F.col("count") > 0, F.col("count")).otherwise(1 if not foreign else UNSEEN))
    if foreign:
        counted = counted.where("row IS NOT NULL")
        missing = (F.col("count") == 0) & (kind == BIGRAM)
        gain = F.when(missing, times * F.col("back")).otherwise(gain)
    parts = counted.select("row", "doc_id", "words", "known", gain.alias("part"))
    if foreign:
        # The rare words of unseen bigrams: their counts come by a join of their own.
        ids = counted.where(missing).select("row", times.alias("times"), F.explode(F.array("v", "w")).alias("id")).where("id <> 0")
        more = ids.join(rare_words(counts, total), "id", "left").select("row", (F.col("times") * F.log(F.coalesce("n", F.lit(UNSEEN)))).alias("part"))
        parts = parts.unionByName(more, allowMissingColumns=True)
    sums = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("words").alias("n_words"), F.sum(F.coalesce("known", F.lit(0.0)) + F.col("part")).alias("score"))
    score = F.round("score", 6)
    return sums.select("doc_id", "n_words", score.alias("score"), F.round(F.when(F.col("n_words") > 0, score / F.col("n_words")), 6).alias("per_word"))


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM documents
), t AS (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
ones AS (SELECT w, count(*) AS c FROM t GROUP BY w),
twos AS (SELECT a.k, a.i, b.w AS v, a.w FROM t a LEFT JOIN t b ON a.k = b.k AND a.i = b.i + 1),
pairs AS (SELECT v, w, count(*) AS c FROM twos WHERE v IS NOT NULL GROUP BY v, w),
s AS (
  SELECT x.k, CASE WHEN x.v IS NULL THEN ln(o.c) - ln((SELECT count(*) FROM t))
              WHEN p.c > 0 THEN ln(p.c) - ln(q.c)
              ELSE ln({BACKOFF}) + ln(o.c) - ln((SELECT count(*) FROM t)) END AS s
  FROM twos x JOIN ones o ON o.w = x.w LEFT JOIN ones q ON q.w = x.v LEFT JOIN pairs p ON p.v = x.v AND p.w = x.w
), sums AS (SELECT k, sum(s) AS s FROM s GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(s, 0), 6) AS score,
       CASE WHEN len(ws) > 0 THEN round(round(s, 6) / len(ws), 6) END AS per_word
FROM d LEFT JOIN sums USING (k)
"""


def backoff_of_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items scored under the documents: text of its own, whose words and bigrams the documents may lack."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("doc_id"), "text")
    return scored(items, table(spark, sf_dir, "documents"))


_TOKENS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+')"
BACKOFF_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, {_TOKENS} AS ws FROM documents), t AS (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
b AS (SELECT row_number() OVER () AS k, item_id AS doc_id, {_TOKENS} AS ws FROM benchmark), u AS (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM b),
ones AS (SELECT w, count(*) AS c FROM t GROUP BY w), n AS (SELECT greatest(count(*), 1) AS n FROM t),
pairs AS (SELECT x.w AS v, y.w, count(*) AS c FROM t x JOIN t y ON x.k = y.k AND x.i + 1 = y.i GROUP BY x.w, y.w),
s AS (
  SELECT x.k, CASE WHEN y.w IS NOT NULL AND p.c > 0 THEN ln(p.c) - ln(q.c)
              ELSE ln(coalesce(o.c, {UNSEEN})) - ln((SELECT n FROM n)) + CASE WHEN y.w IS NULL THEN 0 ELSE ln({BACKOFF}) END END AS s
  FROM u x LEFT JOIN u y ON x.k = y.k AND x.i = y.i + 1 LEFT JOIN ones o ON o.w = x.w LEFT JOIN ones q ON q.w = y.w LEFT JOIN pairs p ON p.v = y.w AND p.w = x.w
), sums AS (SELECT k, sum(s) AS s FROM s GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(s, 0), 6) AS score, CASE WHEN len(ws) > 0 THEN round(round(s, 6) / len(ws), 6) END AS per_word FROM b LEFT JOIN sums USING (k)
"""
