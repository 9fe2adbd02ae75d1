"""Embedding near-duplicates through a pivot-permutation index.

A bounded sample gives reference points ("pivots"), thinned so that no two are
alike and a dense group has few of its own. Each vector is described by its
nearest pivots in order, ``PREFIX`` of them and more the more pivots there are,
and filed in the inverted list of each of them. Vectors of one list that share at least ``SHARED`` pivots are candidates,
which are verified by their cosine in double precision. A pair is counted in
the list of the smallest pivot it shares only.

Equal vectors are one class, of which one representative is indexed, with the
class's size. Long lists are cut into blocks and each pair of blocks is a group
of its own, so no list is gathered in one task and none is capped. A group
returns sums of links and a spanning forest of its links, both at most as many
rows as it has members.

The number of pivots grows with the square root of the number of vectors, up to
``MOST``, so that lists do too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialise, table
from quillon.llm.components import connected_components

COSINE = 0.9
PREFIX, SHARED = 8, 2
#: Pivots per square root of the number of vectors, and at most; the sample is three times as many vectors.
PIVOTS, MOST = 4, 16_384
#: Pivots that ``PREFIX`` is for; each doubling takes ``MORE`` further ones.
FEW, MORE = 256, 2
#: Pivots are taken below the first of these cosines; the next ones only where that leaves too few.
ALIKE = (0.5, 0.7, 0.85)
BLOCK = 1_024


def classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, digest, vector) for each row; the last two null for vectors that link with nothing.

    ``vector`` holds the values as they are, 32-bit where the column is of floats.
    """
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"

    @F.pandas_udf("size int, digest binary, vector binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for part in batches:
            rows = []
            for x in part:
                own = None if x is None else np.array(x, dtype=np.float64)  # null components become nan
                if own is None or not len(own) or not np.isfinite(own).all() or not own.any():
                    rows.append((0, None, None))
                else:
                    data = own.astype(kind).tobytes()
                    rows.append((len(own), xxh3_128_digest(data), data))
            yield pd.DataFrame(rows, columns=["size", "digest", "vector"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), packed("embedding").alias("p")).select("vec_id", "p.*", F.lit(kind).alias("kind"))


def unit(data, kind: str) -> np.ndarray:
    """Rows of unit length, in double precision; scaled by the largest component first, so that no square overflows."""
    x = np.frombuffer(b"".join(data), kind).astype(np.float64).reshape(len(data), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def thinned(sample: np.ndarray, wanted: int) -> np.ndarray:
    """At most ``wanted`` rows of the sample, in its order, no two more alike than allowed."""
    chosen, n, taken = np.zeros((wanted, sample.shape[1])), 0, np.zeros(len(sample), bool)
    for limit in ALIKE:
        for i in range(len(sample)):
            if n == wanted:
                break
            if not taken[i] and (not n or (chosen[:n] @ sample[i]).max() < limit):
                chosen[n], taken[i] = sample[i], True
                n += 1
        if 4 * n >= wanted:
            break
    return chosen[:n]


def prefix(pivots: int) -> int:
    """Nearest pivots that describe a vector: among more pivots, near vectors agree on fewer of the nearest few."""
    return PREFIX + max(0, round(MORE * np.log2(max(pivots, 1) / FEW)))


def pivots_of(reps: DataFrame, n: int, kind: str, most: int) -> np.ndarray:
    wanted = min(most, max(16, int(PIVOTS * n**0.5)))
    order = F.pmod(F.xxhash64("digest"), F.lit(1 << 30))
    share = min(1.0, 3 * wanted / n)
    picked = reps.where(order < share * (1 << 30)).select(order.alias("o"), "digest", "vector").orderBy("o", "digest").limit(4 * wanted).collect()
    return thinned(unit([r.vector for r in picked], kind), wanted) if picked else unit([reps.first().vector], kind)


def filed(reps: DataFrame, pivots: np.ndarray, kind: str) -> DataFrame:
    """``reps`` with ``prefix``: numbers of the nearest pivots, nearest first."""
    held, n = reps.sparkSession.sparkContext.broadcast(pivots), prefix(len(pivots))

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            if len(part):
                yield pd.Series(list(np.argsort(-(unit(list(part), kind) @ held.value.T), axis=1, kind="stable")[:, :n].astype(np.int32)))
            else:
                yield pd.Series([], dtype=object)

    return reps.withColumn("prefix", nearest("vector"))


def compare(rows: pd.DataFrame, kind: str, cosine: float, shared: int) -> pd.DataFrame:
    """Sums of links and a forest of links of one pair of blocks of one list."""
    rows = rows.sort_values("rep", kind="stable").reset_index(drop=True)
    pivot, i, j = (rows[c].iloc[0] for c in ("pivot", "i", "j"))
    x, top, weight = unit(list(rows["vector"]), kind), np.array(rows["prefix"].tolist()), rows["members"].to_numpy()
    block = rows["block"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    links = np.zeros(len(rows), np.int64)
    root = np.arange(len(rows))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    edges = []
    for k in range(0, len(left), 256):
        part = left[k : k + 256]
        both = np.zeros((len(part), len(right)), np.uint8)
        for a in range(top.shape[1]):
            for b in range(top.shape[1]):
                both += top[part, a][:, None] == top[right, b]
        near = (both >= min(shared, top.shape[1])) & (x[part] @ x[right].T >= cosine)
        p, q = np.nonzero(near)
        p, q = part[p], right[q]
        once = (p < q) | (block[p] != block[q])
        p, q = p[once], q[once]
        # Shared pivots below this list's own mean that the pair is counted elsewhere.
        low = np.where(top < pivot, top, -1)
        here = ~((low[p][:, :, None] == low[q][:, None, :]) & (low[p] >= 0)[:, :, None]).any(axis=(1, 2))
        p, q = p[here], q[here]
        np.add.at(links, p, weight[q])
        np.add.at(links, q, weight[p])
        for a, b in zip(p.tolist(), q.tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((a, b))
    ids = rows["rep"].tolist()
    found = [(None, None, rows["digest"].iloc[k], int(links[k])) for k in np.flatnonzero(links)] + [(ids[a], ids[b], None, None) for a, b in edges]
    return pd.DataFrame(found, columns=["a", "b", "digest", "links"]).astype({"a": "Int64", "b": "Int64", "links": "Int64"})


def linked(reps: DataFrame, n: int, kind: str, cosine: float, most: int = MOST) -> DataFrame:
    """(a, b) of a forest of links and (digest, links) of partial sums, for representatives of one size."""
    known = materialise(filed(reps, pivots_of(reps, n, kind, most), kind), "filed")
    rows = known.select("*", F.explode("prefix").alias("pivot"))
    blocks = rows.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(blocks), "pivot").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))  # a row for each pivot
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    rows = rows.select("pivot", "block", "rep", "members", "digest", "vector", "prefix", F.explode(pairs).alias("g")).select("*", "g.i", "g.j").drop("g")
    return rows.groupBy("pivot", "i", "j").applyInPandas(lambda x: compare(x, kind, cosine, SHARED), "a long, b long, digest binary, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, most: int = MOST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors of different sizes don't link. Repeated rows are
    vectors of their own that link with each other, and have one component. A
    null vec_id links with nothing, has a null component_id and is kept. Extra
    columns are ignored.
    """
    base = materialise(classes(vectors), "vectors")
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    usable = base.where("vec_id is not null and digest is not null")
    reps = materialise(usable.groupBy("digest", "size").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"), F.first("vector").alias("vector")), "classes")
    sizes = reps.groupBy("size").count().collect()  # one row for each number of dimensions
    found = None
    for r in sorted(sizes):
        part = linked(reps.where(F.col("size") == r["size"]), r["count"], kind, cosine, most)
        found = part if found is None else found.union(part)
    if found is None:
        found = reps.select(F.col("rep").alias("a"), F.col("rep").alias("b"), "digest", F.col("members").alias("links"))
    found = materialise(found, "links")
    sums = found.where("digest is not null").groupBy("digest").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("a is not null").select("a", "b")).withColumnRenamed("node", "rep")
    told = reps.join(comps, "rep", "left").join(sums, "digest", "left").select(
        "digest", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links")
    )
    # Vectors that link with nothing don't travel, so that they don't meet in one task.
    alone = base.where("vec_id is null or digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    own = usable.select("vec_id", "digest").join(told, "digest")
    return own.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept")).unionByName(alone)


def op3_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
