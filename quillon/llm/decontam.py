"""Benchmark decontamination by a broadcast set of normalised test n-grams.

A window is a run of ``WIDTH`` consecutive words of a benchmark item, or the
whole item where it has fewer words. The windows of all items form a hash set
that is broadcast; documents are scanned in one narrow pass, so nothing of
them is shuffled. A document's words become numbers of a vocabulary that only
holds benchmark words (0: not one of them), a rolling hash over these numbers
proposes windows, and the numbers themselves verify each proposal.

The set is broadcast only while the benchmark has at most ``MAX_WORDS`` words,
which is counted first. A larger benchmark is cut into slices below that bound,
and each slice is broadcast in turn. Text is read for each slice, but only row
numbers, hit words and items of the rows that it hits are written, and they are
brought together by row number at the end.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import fresh, materialise, table

WIDTH = 10
#: Words of benchmark text in one broadcast; about 1 KB of executor memory for each ten words.
MAX_WORDS = 1_000_000

#: Words of lower-cased UTF-8: digits, a-z and all beyond ASCII.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only."""
    return WORDS.findall(text.encode().lower()) if text else []


class WindowSet:
    """The windows of some items, by window length."""

    def __init__(self, items, width: int = WIDTH):
        self.vocabulary: dict[bytes, int] = {}
        self.owners: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], dtype=np.uint32)
            n = min(width, len(numbers))
            for i in range(len(numbers) - n + 1 if n else 0):
                self.owners[n][numbers[i : i + n].tobytes()].add(item_id)
        self.owners = {n: dict(x) for n, x in self.owners.items()}
        self.hashes = {n: np.unique(np.concatenate([self.roll(np.frombuffer(w, np.uint32), n) for w in x])) for n, x in self.owners.items()}

    @staticmethod
    def roll(numbers: np.ndarray, n: int) -> np.ndarray:
        wide, h = numbers.astype(np.uint64), np.zeros(len(numbers) - n + 1, np.uint64)
        for k in range(n):
            h *= STEP
            h += wide[k : k + len(h)]
            h ^= h >> np.uint64(29)
        return h

    def scan(self, found: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items whose windows occur."""
        numbers = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.uint32, len(found))
        hit, items = np.zeros(len(found) + 1, np.int32), set()
        gaps = np.concatenate([[0], np.cumsum(numbers == 0)])
        for n, owners in self.owners.items():
            if len(numbers) < n:
                continue
            starts = np.flatnonzero(gaps[n:] == gaps[:-n])  # windows of benchmark words only
            if not len(starts):
                continue
            rolled = self.roll(numbers, n)[starts]
            table = self.hashes[n]
            at = np.minimum(np.searchsorted(table, rolled), len(table) - 1)
            for i in starts[table[at] == rolled]:
                if owner := owners.get(numbers[i : i + n].tobytes()):
                    hit[i] += 1
                    hit[i + n] -= 1
                    items |= owner
        return np.cumsum(hit[:-1]) > 0, items


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


FOUND = "n_words long, runs array<array<int>>, items array<string>"


def _scan(windows) -> callable:
    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                w = words(text)
                hit, items = windows.value.scan(w)
                out.append((len(w), runs(hit), sorted(items - {None})))
            yield pd.DataFrame(out, columns=["n_words", "runs", "items"])

    return scan


def _merged() -> callable:
    @F.pandas_udf("array<array<int>>")
    def merge(lists: pd.Series) -> pd.Series:
        out = []
        for found in lists:
            spans = []
            for a, b in sorted((int(a), int(b)) for part in found for a, b in part):
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
            out.append([list(x) for x in spans])
        return pd.Series(out, dtype=object)

    return merge


def _sliced(items: DataFrame, width: int, max_words: int) -> tuple[DataFrame, int]:
    """(item_id, text, slice), written once, and the number of slices; a slice has at most ``max_words`` words.

    Items are cut into pieces of at most half as many words, each with the words
    that the last windows of the one before begin with, so that each window lies in
    one piece. Pieces are then dealt out by the running sum of their words.
    """
    most = max(max_words // 2, 2 * width)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for item_id, text in zip(batch["item_id"], batch["text"]):
                own = words(text)
                for at in range(0, max(len(own) - width + 1, min(len(own), 1)), most - width + 1):
                    piece = own[at : at + most]
                    out.append((item_id, b" ".join(piece).decode(), part, total, len(piece)))
                    total += len(piece)
            yield pd.DataFrame(out, columns=["item_id", "text", "part", "before", "n"])

    pieces = materialise(items.mapInPandas(cut, "item_id string, text string, part int, before long, n long"), "decontam-pieces")
    before, sums = 0, {}
    for r in sorted(pieces.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # one row for each partition
        sums[r.part] = before
        before += r.n
    starts = F.create_map(*(F.lit(x) for pair in sums.items() for x in pair)) if sums else F.create_map().cast("map<int,int>")
    # A piece starts in its slice and has half a slice's words at most; pieces that start in the same half meet.
    return pieces.select("item_id", "text", F.floor((F.element_at(starts, F.col("part")) + F.col("before")) / F.lit(most)).cast("int").alias("slice")), -(-before // most)


def scan(docs: DataFrame, benchmark: DataFrame, name: str, width: int = WIDTH, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with a struct ``name``: number of words, runs of hit words, and ids (as text) of the items found.

    Null or empty texts, of documents or items, have no words and hit nothing.
    Items with a null id hit words but have no name in the list; items that share
    an id are one. Repeated rows are each scanned; other columns pass through, so
    ``name`` should be new (``fresh`` gives such a name).
    """
    spark = docs.sparkSession
    # Each run of at least one item character is at most one word, so text length bounds the words.
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0))).first()[0]

    def windows(rows: DataFrame):
        return spark.sparkContext.broadcast(WindowSet([(r.item_id, r.text) for r in rows.select("item_id", "text").toLocalIterator()], width))

    if total <= max_words:
        return docs.withColumn(name, _scan(windows(items))(F.col("text")))
    sliced, slices = _sliced(items, width, max_words)
    row = fresh(docs, "row")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-rows")
    parts = []
    for k in range(slices):
        found = rows.select(F.col(row), _scan(windows(sliced.where(F.col("slice") == k)))(F.col("text")).alias("f")).select(row, "f.*")
        parts.append(materialise(found if k == 0 else found.where(F.size("runs") > 0), "decontam-hits"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.union(part)
    # One row of the first slice and at most one of each other one.
    hits = hits.groupBy(row).agg(F.max("n_words").alias("n_words"), F.collect_list("runs").alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = hits.select(row, F.struct("n_words", _merged()("runs").alias("runs"), "items").alias(name))
    return rows.join(merged, row).drop(row)


def hit_words(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + (r[1] - r[0]))


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that no window hits, columns unchanged.

    Null, empty and wordless texts stay; repeated rows stay or go together; an
    empty benchmark removes nothing.
    """
    name = fresh(docs, "found")
    return scan(docs, benchmark, name).where(F.size(f"{name}.runs") == 0).drop(name)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows, with the hit passages cut out of ``text``; other columns unchanged.

    Null, empty and wordless texts stay as they are; what is between passages
    stays, white space included.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, runs in zip(texts, spans):
            if text and len(runs):
                data, at = text.encode(), [m.span() for m in WORDS.finditer(text.encode().lower())]
                kept, last = [], 0
                for a, b in runs:
                    kept.append(data[last : at[a][0]])
                    last = at[b - 1][1]
                text = b"".join([*kept, data[last:]]).decode()
            out.append(text)
        return pd.Series(out, dtype="object")

    name = fresh(docs, "found")
    return scan(docs, benchmark, name).withColumn("text", cut("text", f"{name}.runs")).drop(name)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "_found")
    names = F.array_sort("_found.items")
    return found.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        hit_words(F.col("_found.runs")).alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_found.runs") > 0).alias("contaminated"),
    )


def brute_force(docs, items, width: int = WIDTH) -> list[tuple]:
    """The same from plain dictionaries, for tests."""
    windows: dict[tuple, set] = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item_id)
    out, sizes = [], {len(w) for w in windows}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if owner := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owner
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return out
