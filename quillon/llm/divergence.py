"""How the sources of a language differ in their words, from mergeable radix tries.

Each partition counts its terms in byte-wise radix tries, one for each language;
a leaf counts the documents that have the term and its occurrences by source.
Tries leave a partition as blocks of front-coded leaves in byte order. Bounds
that split a sample of the blocks' first terms evenly then deal the tries out by
prefix range, blocks that cross a bound are cut there, and each task merges what
it gets of a range into one trie, whose walk gives the terms in UTF-8 order.

Terms in at least ``LEAST`` documents of their language are kept. A second walk
over the kept terms, range by range, sums the divergence of each pair of sources
and holds the ten best terms of each source; what it sends on is bounded by the
sources, not by the terms.

All arithmetic is exact in 64 bits while a language has fewer than 9 * 10^15
occurrences of kept terms.
"""

from __future__ import annotations

import gc
import pickle
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import count
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialise, parts, table

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents of its language that a kept term is in, and terms listed for a source.
LEAST, BEST = 10, 10
SCALE_STEPS = 3  # of 1000 each: shares count in billionths

#: Occurrences that a partition pours into its tries together; leaves of its tries, and of a range, that are held at once; leaves of a block.
POUR, HELD, BLOCK = 4_000_000, 200_000, 1024
#: Blocks whose first terms are looked at for bounds, about.
SAMPLE = 20_000

LABEL, KIDS, LEAF = 0, 1, 2
DOCS = None  # the key of a leaf's documents; all others are sources


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix: what differs first is the highest bit in which the numbers do."""
    n = min(len(a), len(b))
    if a[:1] != b[:1]:
        return 0
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


class Trie:
    """A radix trie; a node is [label, children by first byte, counts or None]."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.leaves = 0

    def extend(self, leaves: Iterable[tuple[bytes, dict]]) -> None:
        """Merge (term, counts) in byte order; each term sets out from where the path of the one before it leaves its own."""
        path, last = [(0, self.root)], b""
        for term, counts in leaves:
            shared = common(last, term)
            while path[-1][0] > shared:
                path.pop()
            at, node = path[-1]
            while at < len(term):
                child = node[KIDS].get(term[at])
                if child is None:
                    child = node[KIDS][term[at]] = [term[at:], {}, None]
                    at = len(term)
                else:
                    label = child[LABEL]
                    n = len(label) if term.startswith(label, at) else common(label, term[at : at + len(label)])
                    if n < len(label):
                        upper = [label[:n], {label[n]: child}, None]
                        child[LABEL] = label[n:]
                        node[KIDS][term[at]] = child = upper
                    at += n
                node = child
                path.append((at, node))
            if node[LEAF] is None:
                node[LEAF] = counts
                self.leaves += 1
            else:
                own = node[LEAF]
                for key, n in counts.items():
                    own[key] = own.get(key, 0) + n
            last = term

    def walk(self) -> Iterator[tuple[bytes, dict]]:
        """(term, counts) in byte order, which is that of UTF-8."""
        stack = [(b"", self.root)]
        while stack:
            prefix, (label, kids, counts) = stack.pop()
            term = prefix + label
            if counts is not None:
                yield term, counts
            stack.extend((term, kids[b]) for b in sorted(kids, reverse=True))


def packed(leaves: list[tuple[bytes, dict]]) -> bytes:
    """A piece of a trie: each term without what it shares with the one before, and its counts."""
    shared, rest, last = [], [], b""
    for term, _ in leaves:
        n = common(last, term)
        shared.append(n)
        rest.append(term[n:])
        last = term
    return zlib.compress(pickle.dumps((shared, rest, [counts for _, counts in leaves]), 5), 1)


def unpacked(blob: bytes) -> Iterator[tuple[bytes, dict]]:
    term = b""
    for n, rest, counts in zip(*pickle.loads(zlib.decompress(blob))):
        term = term[:n] + rest
        yield term, counts


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


class Counts:
    """The tries of a partition, behind numbers of terms and their counts by document, which gather before they are poured into them."""

    def __init__(self):
        self.tries: dict[str, Trie] = defaultdict(Trie)
        self.numbers: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(count().__next__))
        self.waiting: dict[str, list[tuple]] = defaultdict(list)  # source and numbers of each document
        self.sources: dict[str, int] = {}
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        terms = TERM.findall(text.lower())  # bytes.lower() changes A-Z only
        if terms:
            numbers = np.fromiter(map(self.numbers[lang].__getitem__, terms), np.int64, len(terms))
            self.waiting[lang].append((self.sources.setdefault(source, len(self.sources)), numbers))
            self.size += len(terms)

    def pour(self) -> None:
        names = list(self.sources)
        for lang, waiting in self.waiting.items():
            terms = list(self.numbers[lang])
            # Occurrences by document and term, then by term and source.
            key, n = counted(np.repeat(np.arange(len(waiting)), [len(x[1]) for x in waiting]) * len(terms) + np.concatenate([x[1] for x in waiting]))
            document, own = np.divmod(key, len(terms))
            key = own * len(names) + np.array([x[0] for x in waiting])[document]
            order = np.argsort(key)
            key, documents = counted(key)
            own, source = np.divmod(key, len(names))
            sums = np.add.reduceat(n[order], np.cumsum(documents) - documents)
            leaves: list[dict] = [{DOCS: 0} for _ in terms]
            for i, s, occurrences, docs in zip(own.tolist(), source.tolist(), sums.tolist(), documents.tolist()):
                leaves[i][DOCS] += docs
                leaves[i][names[s]] = occurrences
            self.tries[lang].extend(sorted(zip(terms, leaves), key=itemgetter(0)))
        self.waiting.clear()
        self.numbers.clear()
        self.size = 0

    def drain(self) -> Iterator[tuple]:
        """(lang, first term, last term, leaves, blob) for each ``BLOCK`` leaves."""
        self.pour()
        for lang, trie in self.tries.items():
            held: list = []
            for leaf in trie.walk():
                held.append(leaf)
                if len(held) == BLOCK:
                    yield lang, held[0][0], held[-1][0], len(held), packed(held)
                    held = []
            if held:
                yield lang, held[0][0], held[-1][0], len(held), packed(held)
        self.tries.clear()


BLOCKS = "lang string, first binary, last binary, leaves int, blob binary"


def _batch(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _batches(rows: Iterable[tuple], schema: str, size: int) -> Iterator:
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


@contextmanager
def no_cycles():
    """Tries have none, and looking for them takes a third of the time that building a trie does."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _counted(batches: Iterator) -> Iterator:
    def rows():
        counts = Counts()
        for batch in batches:
            for k in range(batch.num_rows):
                lang, source, text = (batch.column(c)[k].as_py() for c in range(3))
                counts.add(lang, source, text)
                if counts.size > POUR:
                    counts.pour()
                    if sum(t.leaves for t in counts.tries.values()) > HELD:
                        yield from counts.drain()
        yield from counts.drain()

    with no_cycles():
        yield from _batches(rows(), BLOCKS, 16)


def _dealt(bounds: list[tuple[bytes, bytes]]):
    """Blocks by number of their prefix range, cut where a bound runs through them."""

    def deal(batches: Iterator) -> Iterator:
        def rows():
            for batch in batches:
                for k in range(batch.num_rows):
                    lang, first, last, _, blob = (batch.column(c)[k].as_py() for c in range(5))
                    own = lang.encode()
                    low, high = bisect_right(bounds, (own, first)), bisect_right(bounds, (own, last))
                    if low == high:
                        yield low, lang, blob
                    else:
                        leaves = list(unpacked(blob))
                        terms = [term for term, _ in leaves]
                        cuts = [0, *(bisect_left(terms, bounds[at][1]) for at in range(low, high)), len(leaves)]
                        for at, a, b in zip(range(low, high + 1), cuts, cuts[1:]):
                            if a < b:
                                yield at, lang, packed(leaves[a:b])

        yield from _batches(rows(), "at int, lang string, blob binary", 16)

    return deal


KEPT = "lang string, term binary, sources array<string>, counts array<long>"


def _merged(least: int):
    """The kept leaves of a range, in byte order within a language."""

    def merge(batches: Iterator) -> Iterator:
        def rows():
            tries: dict[str, Trie] = defaultdict(Trie)
            for batch in batches:
                for lang, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    tries[lang].extend(unpacked(blob))
            for lang in sorted(tries):
                for term, counts in tries[lang].walk():
                    if counts.pop(DOCS) >= least:
                        yield lang, term, list(counts), list(counts.values())

        with no_cycles():
            yield from _batches(rows(), KEPT, 2048)

    return merge


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, sources, counts) of terms in at least ``least`` rows of their language; ``docs`` has lang, source, and text as bytes."""
    spark = docs.sparkSession
    blocks = materialise(docs.mapInArrow(_counted, BLOCKS), "tries")
    n, leaves = blocks.agg(F.count("*"), F.coalesce(F.sum("leaves"), F.lit(0))).first()
    ranges = max(parts(spark), int(leaves // HELD) + 1)
    some = blocks.select("lang", "first") if n <= SAMPLE else blocks.select("lang", "first").sample(SAMPLE / n, 7)
    firsts = sorted((r.lang.encode(), bytes(r.first)) for r in some.toLocalIterator())  # about SAMPLE at most
    bounds = sorted({firsts[len(firsts) * k // ranges] for k in range(1, ranges)}) if firsts else []
    dealt = blocks.mapInArrow(_dealt(bounds), "at int, lang string, blob binary").repartitionById(len(bounds) + 1, "at")
    return materialise(dealt.select("lang", "blob").mapInArrow(_merged(least), KEPT), "terms")


def share(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 * counts / total), by long division; counts are at most ``total``."""
    value, rest = counts // total, counts % total
    for _ in range(SCALE_STEPS):
        value, rest = value * 1000 + rest * 1000 // total, rest * 1000 % total
    return value + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Language:
    """The sources of a language, with the occurrences of kept terms in each."""

    def __init__(self, totals: dict[str, int], terms: int):
        self.sources = sorted(totals)
        self.at = {s: i for i, s in enumerate(self.sources)}
        self.totals = [totals[s] + 2 * terms for s in self.sources]
        self.total = sum(totals.values()) + 2 * terms

    def shares(self, sources: list[list[str]], counts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences and shares of terms by source, and their shares in the language."""
        own = np.zeros((len(sources), len(self.sources)), np.int64)
        for row, names, values in zip(own, sources, counts):
            row[[self.at[s] for s in names]] = values
        p = np.stack([share(own[:, a] + 2, n) for a, n in enumerate(self.totals)], 1)
        return own, p, share(own.sum(1) + 2, self.total)


SUMS = "lang string, source string, part string, item string, value long"


def _compared(held, best: int):
    """Sums for pairs of sources, of which the first is the smaller, and the best terms of each source, of a partition's terms."""

    def compare(batches: Iterator) -> Iterator:
        def rows():
            sums: dict[str, np.ndarray] = {}
            tops: dict[tuple[str, str], list] = defaultdict(list)
            for batch in batches:
                langs = np.array(batch.column(0).to_pylist(), dtype=object)
                for lang in dict.fromkeys(langs):
                    at = np.flatnonzero(langs == lang)
                    language = held.value[lang]
                    terms, sources, counts = ([column[i] for i in at] for column in (batch.column(c).to_pylist() for c in (1, 2, 3)))
                    own, p, q = language.shares(sources, counts)
                    pairs = sums.setdefault(lang, np.zeros((len(language.sources),) * 2, np.int64))
                    for a, source in enumerate(language.sources):
                        pairs[a, a + 1 :] += divergence(p[:, a : a + 1], p[:, a + 1 :]).sum(0)
                        found = np.flatnonzero((own[:, a] > 0) & (p[:, a] > q))
                        if len(found):
                            values = divergence(p[found, a], q[found])
                            # All that tie with the last one that may be listed compete by their bytes.
                            bar = np.partition(values, -best)[-best] if len(values) > best else values.min()
                            better = tops[lang, source] + [(-int(values[i]), terms[found[i]]) for i in np.flatnonzero(values >= bar)]
                            tops[lang, source] = sorted(better)[:best]
            for lang, pairs in sums.items():
                names = held.value[lang].sources
                for a, b in zip(*np.triu_indices(len(names), 1)):
                    yield lang, names[a], "pair", names[b], int(pairs[a, b])
            for (lang, source), top in tops.items():
                for value, term in top:
                    yield lang, source, "term", term.decode(), -value

        yield from _batches(rows(), SUMS, 2048)

    return compare


def audit(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other one of its language, and the terms that set it apart from the language.

    Null texts, languages and sources are empty ones; repeated rows count each;
    a term may be as long as its text; extra columns are ignored. A language
    without kept terms has pairs of value 0, a source that is alone has no pairs,
    and an empty table no rows. The driver holds a number for each source of each
    language, of which the result has all ordered pairs.
    """
    spark = docs.sparkSession
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kept = kept_terms(plain, least)
    groups = plain.select("lang", "source").distinct()
    occurrences = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    terms = {r.lang: r.n for r in kept.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    totals: dict[str, dict] = defaultdict(dict)
    for r in groups.join(occurrences, ["lang", "source"], "left").collect():
        totals[r.lang][r.source] = r.n or 0
    held = spark.sparkContext.broadcast({lang: Language(own, terms.get(lang, 0)) for lang, own in totals.items()})

    found = kept.mapInArrow(_compared(held, best), SUMS)
    names = spark.createDataFrame([(lang, source) for lang, own in totals.items() for source in own], "lang string, source string")
    zeros = names.join(names.withColumnRenamed("source", "item"), "lang").where("source < item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    # A term lies in one range, so only pairs have values to add up.
    summed = found.unionByName(zeros).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).otherwise(F.array(F.struct("source", "item")))
    mirrored = summed.select("lang", "part", "value", F.explode(both).alias("x")).select("lang", "x.source", "part", "x.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = mirrored.withColumn("rank", rank)
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= best))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), w AS (SELECT k, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
full_c AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
ns AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM full_c GROUP BY lang, source),
p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000 * (f.n + 2)) // (ns.total + 2 * v.v) AS p FROM full_c f JOIN ns ON f.lang = ns.lang AND f.source = ns.source JOIN v ON v.lang = f.lang),
ln AS (SELECT lang, sum(total)::HUGEINT AS total FROM ns GROUP BY lang),
q AS (SELECT f.lang, f.term, 1 + (1000000000 * (sum(f.n)::HUGEINT + 2)) // (any_value(ln.total) + 2 * any_value(v.v)) AS q FROM full_c f JOIN ln ON ln.lang = f.lang JOIN v ON v.lang = f.lang GROUP BY f.lang, f.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
), u AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs UNION ALL SELECT lang, source, 'term', item, value::BIGINT FROM terms)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM u) WHERE part = 'pair' OR rank <= {BEST}
"""
