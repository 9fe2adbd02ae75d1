"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the text gives each document the size and a 128-bit digest of
   its shingle set, and a MinHash signature. Documents with equal sets form a
   class; only one of each class goes on.
2. Signatures are cut into bands; representatives with an equal band share a
   bucket.
3. Rounds of comparisons. The first two rounds compare each member with one
   centre of its bucket, which joins large groups of copies with as many
   comparisons as they have members. The last round compares what still shares a
   bucket in different components. Nodes that chains of buckets hold together
   are compared as one cluster where that is fewer pairs than in its buckets one
   by one (a dense group shares many buckets), else by bucket, a pair in its
   first common band only. Clusters and buckets are cut into blocks; a pair of
   blocks is compared in place and returns only the links that join components,
   so fewer rows than it has members.
4. A comparison reads signatures in batches. After each batch the posterior
   probability that the similarity reaches the threshold, given the matches so
   far, is bounded below by ``MISS``, or the pair is pruned. Survivors are
   verified on the full shingle sets.

A pair in one bucket thus ends in one component, is pruned by the posterior, or
is refuted exactly; no bucket is capped. Rows of a bucket that holds more than
one in ``HOT`` of them are dealt out by salts wherever they meet its one row. Two documents at the threshold share no
bucket with probability (1 - s^ROWS)^BANDS: 4e-7 at 0.85, 5e-5 at 0.8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillon.llm.common import fresh, materialise, table
from quillon.llm.components import connected_components

BANDS, ROWS = 25, 5
HASHES = 128
BATCH = 32
#: Posterior probability of reaching the threshold below which a pair is pruned.
MISS = 1e-5
#: Nodes of a bucket in one block of the last round, and their shingles; right sides in one group of exact verification.
BLOCK, SHINGLES, GROUP = 512, 1_000_000, 64
#: By arithmetic fewer buckets than this have more than one in so many rows.
HOT = 1_000
SEED = 977


@lru_cache(maxsize=1)
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(SEED)
    a, b = (rnd.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    return a[:, None], b[:, None]


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of ``width`` words; of the whole sequence where it is shorter."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split() if text else []  # both touch ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out ^= h[k : k + len(out)]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    a, b = multipliers()
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(own), 512):
        least = np.minimum(least, ((own[i : i + 512] * a + b) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return least


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, digest, signature) for each row; the last two are null where there are no words."""

    @F.pandas_udf("n long, digest binary, signature binary")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for texts in batches:
            rows = []
            for text in texts:
                own = shingles(text, width)
                rows.append((len(own), xxh3_128_digest(own.tobytes()), signature(own).tobytes()) if len(own) else (0, None, None))
            yield pd.DataFrame(rows, columns=["n", "digest", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), sketched("text").alias("s")).select("doc_id", "s.*")


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(hashes read, fewest matches that go on) after each batch.

    With a uniform prior, m matches of n leave the similarity a Beta(m + 1,
    n - m + 1) posterior, whose upper tail at s is P(Binomial(n + 1, s) <= m).
    """
    s, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(s) + (n + 1 - m) * math.log(1 - s)) if s < 1 else float(m == n)
        out.append((n, m))
    return tuple(out)


def plausible(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which row pairs of two signature tables survive all batches."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int32)
    for n, least in least_matches(percent):
        matches = matches + (left[alive, n - BATCH : n] == right[alive, n - BATCH : n]).sum(axis=1)
        alive, matches = alive[matches >= least], matches[matches >= least]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def matrix(signatures) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint32).reshape(-1, HASHES)


def buckets(reps: DataFrame) -> DataFrame:
    """(bucket, node) of all bands."""

    @F.pandas_udf("array<long>")
    def bands(signatures: pd.Series) -> pd.Series:
        from xxhash import xxh3_64_intdigest

        step = 4 * ROWS
        return signatures.map(lambda s: [xxh3_64_intdigest(s[k * step : (k + 1) * step], seed=k) - (1 << 63) for k in range(BANDS)])

    return reps.select(F.explode(F.array_distinct(bands("signature"))).alias("bucket"), F.col("rep").alias("node"))


class Salts:
    """How many tasks share a key: one, but for keys with more than one in ``HOT`` of the rows."""

    def __init__(self, rows: DataFrame, *keys: str):
        self.keys = list(keys)
        least = max(rows.count() / HOT, 1.0)
        found = rows.groupBy(*keys).count().where(F.col("count") > least).select(*keys, F.ceil(F.col("count") / F.lit(least)).cast("int").alias("salts")).collect()  # fewer than HOT
        self.table = rows.sparkSession.createDataFrame(found, StructType([*(rows.schema[k] for k in keys), StructField("salts", IntegerType())]))

    def deal(self, rows: DataFrame) -> DataFrame:
        """Rows of (key, node, ...) with the salt of each."""
        return rows.join(F.broadcast(self.table), self.keys, "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")

    def repeat(self, one: DataFrame) -> DataFrame:
        """One row a key to one for each of its salts."""
        return one.join(F.broadcast(self.table), self.keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")

    def join(self, rows: DataFrame, one: DataFrame, how: str = "inner") -> DataFrame:
        return self.deal(rows).join(self.repeat(one), [*self.keys, "salt"], how).drop("salt")


def star_pairs(members: DataFrame, turn: int, salts: Salts) -> DataFrame:
    """Each member with its bucket's centre, which differs from turn to turn; only across components."""
    order = F.struct(F.when(F.lit(turn == 0), F.lit(0)).otherwise(F.xxhash64("node", F.lit(turn))), F.col("node"), F.col("component"))
    centre = members.groupBy("bucket").agg(F.min(order).alias("c")).select("bucket", F.col("c.node").alias("a"), F.col("c.component").alias("ca"))
    return salts.join(members, centre).where("component <> ca").select("a", F.col("node").alias("b")).distinct()


def survivors_of(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    @F.pandas_udf("boolean")
    def survives(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(plausible(matrix(left), matrix(right), percent))

    left, right = (reps.select(F.col("rep").alias(k), F.col("signature").alias(f"s{k}")) for k in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").where(survives("sa", "sb")).select("a", "b").distinct()


def similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Exactly: does the intersection reach its share of the union?"""
    small, large = sorted((len(left), len(right)))
    if 100 * small < percent * large:
        return False
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (small + large - shared)


def units(members: DataFrame, salts: Salts) -> DataFrame:
    """(unit, whole, node, component): clusters of nodes, or their buckets where these have fewer pairs."""
    centre = members.groupBy("bucket").agg(F.min("node").alias("a"))
    held = salts.join(members, centre).where("a <> node").select("a", F.col("node").alias("b")).distinct()
    clusters = connected_components(held).withColumnRenamed("component", "cluster")
    own = materialise(members.join(clusters, "node"), "clusters")
    buckets = own.groupBy("bucket").agg(F.first("cluster").alias("cluster"), F.count("*").alias("n")).groupBy("cluster").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("apart"))
    whole = clusters.groupBy("cluster").agg(F.count("*").cast("double").alias("m")).join(buckets, "cluster").where("m * m <= apart").select("cluster")
    hot = Salts(own, "cluster")
    together = hot.join(own.select("cluster", "node", "component").distinct(), whole, "left_semi").select(F.col("cluster").alias("unit"), F.lit(True).alias("whole"), "node", "component")
    return together.unionByName(hot.join(own, whole, "left_anti").select(F.col("bucket").alias("unit"), F.lit(False).alias("whole"), "node", "component"))


def unit_links(members: DataFrame, reps: DataFrame, texts: DataFrame, salts: Salts, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join components among all nodes that share a bucket, each pair of blocks of a unit in a group of its own."""
    keys = ["unit", "whole"]
    found = materialise(units(members, salts), "units")
    sizes = (
        found.join(reps.select(F.col("rep").alias("node"), "n"), "node").groupBy(*keys)
        .agg(F.ceil(F.greatest(F.count("*") / F.lit(float(BLOCK)), F.sum("n") / F.lit(float(SHINGLES)))).cast("int").alias("blocks"))
    )
    own = Salts(found, *keys).join(found, sizes).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A member of block i takes part in the groups (i, j) and (j, i) of every block j.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    rows = own.join(reps.select(F.col("rep").alias("node"), "signature"), "node").join(texts, "node").select(*keys, "node", "component", "block", "signature", "text", F.explode(pairs).alias("g"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sig, node, block, texts = matrix(rows["signature"]), rows["node"].to_numpy(), rows["block"].to_numpy(), rows["text"].tolist()
        label = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
        first, second = np.flatnonzero(block == rows["i"].iloc[0]), np.flatnonzero(block == rows["j"].iloc[0])
        bands = np.ascontiguousarray(sig[:, : BANDS * ROWS]).view(f"V{4 * ROWS}").reshape(len(sig), BANDS)
        bands = np.stack([np.unique(bands[:, k], return_inverse=True)[1].ravel() for k in range(BANDS)], axis=1).astype(np.int32)
        whole = bool(rows["whole"].iloc[0])
        here = int((bands == bands[0]).all(axis=0).argmax())  # in a bucket, the first band that all of them share
        sets, out = {}, []

        def set_of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles(texts[k], width)
            return sets[k]

        for x in first:
            others = second[(label[second] != label[x]) & ((block[second] != block[x]) | (second > x))]
            common = bands[others] == bands[x]
            others = others[common.any(axis=1) if whole else common.argmax(axis=1) == here]
            if len(others):
                for y in others[plausible(np.broadcast_to(sig[x], (len(others), HASHES)), sig[others], percent)]:
                    if label[y] != label[x] and similar(set_of(x), set_of(y), percent):
                        out.append((node[x], node[y]))
                        label[label == label[y]] = label[x]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    grouped = rows.select(*keys, "g.i", "g.j", "node", "component", "block", "signature", "text").groupBy(*keys, "i", "j")
    return grouped.applyInPandas(compare, "a long, b long")


def links_among(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold.

    Rows travel once for each pair they are the right side of. The right sides
    of one left side are dealt out in groups of about ``GROUP``, and the left
    side's text goes to each of these.
    """
    n = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(float(GROUP))).cast("int").alias("groups"))
    salted = pairs.join(n, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int"))
    sides = salted.select("a", "salt", F.col("b").alias("node"), F.lit(1).alias("side")).union(
        salted.select("a", "salt", F.col("a").alias("node"), F.lit(0).alias("side")).distinct()
    )
    rows = sides.join(texts, "node").repartition("a", "salt").sortWithinPartitions("a", "salt", "side")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, lefts = None, []
        for rows in batches:
            out = []
            for a, salt, node, side, text in zip(rows["a"], rows["salt"], rows["node"], rows["side"], rows["text"]):
                if group != (a, salt):
                    group, lefts = (a, salt), []
                own = shingles(text, width)
                if side == 0:
                    lefts.append(own)
                    continue
                if any(similar(left, own, percent) for left in lefts):
                    out.append((a, node))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.select("a", "salt", "node", "side", "text").mapInPandas(verify, "a long, b long")


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links: only the components that these join are looked at again."""
    ends = links
    for c in ("a", "b"):
        ends = ends.join(found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left")
    edges = materialise(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct(), "joined")
    if edges.isEmpty():
        return found
    more = materialise(connected_components(edges), "components")
    kept = found.join(more.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return materialise(kept.unionByName(more.join(found.select("node"), "node", "left_anti")), "components")


def components_of(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, component) for each row of documents whose ids are all different; component is null where the id is."""
    base = materialise(sketch(docs, width), "sketch")
    named = base.where("doc_id is not null and digest is not null")
    reps = materialise(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n").alias("n")), "reps")
    banded = materialise(buckets(reps), "bands")
    salts = Salts(banded, "bucket")
    shared = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")
    members = materialise(salts.join(banded, shared), "buckets")
    texts = materialise(docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(members.select("node").distinct(), "node", "left_semi"), "texts")

    found = None
    for turn in range(3):
        labelled = members.withColumn("component", F.col("node")) if found is None else members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # Buckets whose members are all in one component need no further look.
        mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
        left = salts.join(labelled, mixed)
        if turn < 2:
            near = materialise(survivors_of(star_pairs(left, turn, salts), reps, percent), "near")
            made = links_among(near, texts, width, percent)
        else:
            left = materialise(left, "mixed")
            if left.isEmpty():
                break
            made = unit_links(left, reps, texts, salts, width, percent)
        made = materialise(made, "links")
        found = materialise(connected_components(made), "components") if found is None else joined(found, made)

    classes = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    # Rows without a word or an id don't travel, so that they don't meet in one task.
    alone = base.where("doc_id is null or digest is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    return named.join(classes, "digest").select("doc_id", "n", "component").unionByName(alone)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and that column's name, which is new."""
    name = fresh(docs, "row")
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Null, empty and wordless texts have no shingles and link with nothing. Each
    row is judged by its own text, also where rows share a doc_id; a component's
    id is the smallest doc_id in it. A null doc_id links with nothing, has a null
    component_id and is kept. Extra columns are ignored.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    if ids.groupBy("doc_id").count().where("count > 1").limit(1).count():
        rows, name = numbered(docs.select("doc_id", "text"))
        own = rows.select(F.col(name), F.col("doc_id").cast("long").alias("own_id"))
        found = components_of(rows.where("doc_id is not null").select(F.col(name).alias("doc_id"), "text"), width, percent)
        found = own.join(found, own[name] == found["doc_id"], "left").drop("doc_id")
        sizes = sketch(rows.where("doc_id is null").select(F.col(name).alias("doc_id"), "text"), width).select(F.col("doc_id").alias(name), F.col("n").alias("own_n"))
        least = found.where("component is not null").groupBy("component").agg(F.min("own_id").alias("least"))
        found = found.join(sizes, name, "left").join(least, "component", "left").select(F.col("own_id").alias("doc_id"), F.coalesce("n", "own_n").alias("n"), F.col("least").alias("component"))
    else:
        found = components_of(docs, width, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id (nulls last); columns unchanged.

    Rows are told apart by a number of their own, so repeated rows and repeated
    or null ids are near-duplicates or not by their texts alone. Null, empty and
    wordless texts all stay.
    """
    rows, name = numbered(docs)
    found = components_of(rows.select(F.col(name).alias("doc_id"), "text"), width, percent).select(F.col("doc_id").alias(name), "component")
    grouped = found.join(found.where(F.col(name) != F.col("component")).select("component").distinct(), "component", "left_semi")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(name).alias("r"))
    firsts = grouped.join(rows.select(name, "doc_id"), name).groupBy("component").agg(F.min(order)["r"].alias("first"))
    gone = grouped.join(firsts, "component").where(F.col(name) != F.col("first")).select(name)
    return rows.join(gone, name, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
