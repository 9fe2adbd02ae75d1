"""What filters do to each other: every order of five filters, from one pass over the texts.

Each document gets a mask of the filters that it fails. Four conditions are seen
in the text alone. The fifth, being a copy of a text with a smaller id, needs
texts to meet: each partition holds chains of texts by fingerprint (xxhash), so
only one row a text leaves it, with the smallest id found there. These rows are
routed by fingerprint and sorted by it, so that a task holds the chain of one
fingerprint at a time: texts are compared whole, the smallest id of each is kept
and all others come out as copies. However often a text is repeated, one row of
it leaves each partition (one for each ``CHAIN_BYTES`` of other texts there).

Masks are then counted by part: ``combineByKey`` merges vectors that count
masks, and each order of the filters is read off such a vector.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby, permutations
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import parts, table

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)

MIN_WORDS = 200
#: Percent of words that differ at least, and percent of code points that are A-Z at most.
MIN_DISTINCT, MAX_UPPER = 50, 2
SYMBOL = re.compile(rb"[#$%&*|]")
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUATION = bytes(range(0x80, 0xC0))

#: Bytes of different texts that a partition holds before it lets them go, and of text that a routed partition gets, about.
CHAIN_BYTES, ROUTED_BYTES = 32 << 20, 64 << 20

#: Rows of the result: one for each order and step.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failed(text: bytes) -> int:
    """Mask of the conditions A to D; bytes.split() splits at ASCII white space."""
    words = text.split()
    points = len(text.translate(None, CONTINUATION))
    upper = len(text) - len(text.translate(None, UPPER))
    tests = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT * len(words),
        100 * upper > MAX_UPPER * points,
        SYMBOL.search(text) is not None,
    )
    return sum(1 << i for i, fails in enumerate(tests) if fails)


class Chains:
    """Texts by fingerprint, each with its mask, its smallest id and how often each part has that id."""

    def __init__(self):
        self.links: dict[int, list[list]] = defaultdict(list)
        self.size = 0

    def put(self, key: int, text: bytes, mask: int, doc_id: int, sources: dict[str, int]) -> tuple | None:
        """File a text; if it is known, (id, mask, sources) of the larger of both ids."""
        for link in self.links[key]:
            if link[0] == text:
                if doc_id == link[2]:
                    for source, n in sources.items():
                        link[3][source] = link[3].get(source, 0) + n
                    return None
                if doc_id > link[2]:
                    return doc_id, mask | COPY, sources
                beaten = link[2], mask | COPY, link[3]
                link[2:] = doc_id, dict(sources)
                return beaten
        self.links[key].append([text, mask, doc_id, dict(sources)])
        self.size += len(text)
        return None

    def drain(self) -> Iterator[tuple]:
        for key, chain in self.links.items():
            for link in chain:
                yield key, *link
        self.links.clear()
        self.size = 0


def gathered(rows: Iterable) -> Iterator[tuple]:
    """(key, (text, mask, id, sources)) of a partition: texts of smallest id under their fingerprint, and what is settled, without text, under keys that spread."""
    from xxhash import xxh64_intdigest

    chains, nameless = Chains(), Counter()
    for doc_id, source, text in rows:
        text = bytes(text)
        key = xxh64_intdigest(text)
        known = next((link[1] for link in chains.links.get(key, ()) if link[0] == text), None)
        mask = failed(text) if known is None else known
        if doc_id is None:
            nameless[source, mask] += 1
        elif settled := chains.put(key, text, mask, doc_id, {source: 1}):
            yield xxh64_intdigest(str(settled[0])), (None, settled[1], settled[0], settled[2])
        if chains.size > CHAIN_BYTES:
            for key, *link in chains.drain():
                yield key, tuple(link)
    for key, *link in chains.drain():
        yield key, tuple(link)
    for (source, mask), n in nameless.items():
        yield xxh64_intdigest(source), (None, mask, None, {source: n})


def resolved(rows: Iterable) -> Iterator[tuple]:
    """(doc_id, source, mask, n) from rows sorted by key."""
    for key, group in groupby(rows, key=itemgetter(0)):
        chains = Chains()
        for _, (text, mask, doc_id, sources) in group:
            settled = (doc_id, mask, sources) if text is None else chains.put(key, text, mask, doc_id, sources)
            if settled:
                yield from ((settled[0], source, settled[1], n) for source, n in settled[2].items())
        for _, _, mask, doc_id, sources in chains.drain():
            yield from ((doc_id, source, mask, n) for source, n in sources.items())


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, source, mask, n): ``n`` rows of ``docs`` with this id and source fail the filters of ``mask``.

    Null texts and sources are empty ones. A row whose id is null is nobody's
    copy and has no copies. Rows that share an id and a text are no copies of
    each other, since neither id is smaller. Extra columns are ignored.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = parts(spark, int(size // ROUTED_BYTES) + 1)
    whole = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    routed = whole.rdd.mapPartitions(gathered).repartitionAndSortWithinPartitions(n, lambda key: key % n)
    return spark.createDataFrame(routed.mapPartitions(resolved), "doc_id long, source string, mask int, n long", verifySchema=False)


def weights() -> np.ndarray:
    """For each order and step, which masks are kept, removed, redundant and failing this filter only: 0 or 1, as [kind, row, mask]."""
    mask, rows = np.arange(MASKS), []
    for order in ORDERS:
        before = 0
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            fails, gone = mask & bit > 0, mask & before > 0
            rows.append((~fails & ~gone, fails & ~gone, fails & gone, mask == bit))
            before |= bit
    return np.array(rows, np.int64).transpose(1, 0, 2)


def table_of(part: str, counts: np.ndarray, kinds: np.ndarray) -> list[tuple]:
    """The rows of a part from its vectors of masks: of all rows, of good ones and of toxic ones."""
    kept, removed, redundant, unique = (k @ counts[0] for k in kinds)
    good, toxic = kinds[1] @ counts[1], kinds[1] @ counts[2]
    letters = "".join(ORDERS)
    shares = Counter()
    for letter, n in zip(letters, removed.tolist()):
        shares[letter] += n
    columns = (x.tolist() for x in (kept, removed, redundant, unique, good, toxic))
    n = len(FILTERS)
    return [(part, ORDERS[i // n], i % n + 1, *values, shares[letters[i]]) for i, values in enumerate(zip(*columns))]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each source, order of the filters and step, with the counts of ``SCHEMA``.

    A document is good (toxic) if any of its labels says so; null labels, and
    labels of null ids, say nothing. Repeated rows count each; an empty table has
    no parts; a very long text is measured like any other.
    """
    spark = docs.sparkSession
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    said = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic"))
    rows = masks(docs).join(said, "doc_id", "left").select("source", "mask", "n", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def add(vectors: np.ndarray, value: tuple) -> np.ndarray:
        mask, n, good, toxic = value
        vectors[:, mask] += (n, n * good, n * toxic)
        return vectors

    vectors = rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda v: add(np.zeros((3, MASKS), np.int64), v), add, np.add, parts(spark))
    kinds = weights()
    return spark.createDataFrame(vectors.flatMap(lambda kv: table_of(kv[0], kv[1], kinds)), SCHEMA, verifySchema=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copy FROM documents
), m AS (
  SELECT part, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN copy THEN 16 ELSE 0 END) AS mask,
         CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS good,
         CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS toxic FROM d
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || x.letter || y.letter || z.letter AS filter_order
  FROM f a, f b, f x, f y, f z WHERE a.bit + b.bit + x.bit + y.bit + z.bit = 31 AND a.bit | b.bit | x.bit | y.bit | z.bit = 31
), steps AS (
  SELECT filter_order, step, f.letter, f.bit, coalesce((SELECT sum(g.bit) FROM f g WHERE contains(left(filter_order, step - 1), g.letter)), 0)::INTEGER AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step) s, f WHERE f.letter = substr(filter_order, step, 1)
), r AS (
  SELECT part, filter_order, step, letter,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, steps GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
