"""Names that imitate popular ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.functions.core import top_per

#: Affixes of combination names; edits; shortest names; downloads that clear a name.
AFFIXES = ["js", "lib", "core", "cli", "sdk", "api", "node", "official", "dev", "pro", "plus", "ng", "v2", "new", "real"]
EDITS, SHORTEST, SHORTEST_REST, CLEARED, RATIO = 2, 5, 5, 25_000, 0.1
#: Targets of more characters are found by pieces instead of deletions. A swap may touch two pieces, so that two edits spare one of five.
LONG, PIECES = 24, 5


def deletions(w):
    """A word and all that is left of it without one or two characters: about half the square of its length."""
    once = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    one = once(w)
    two = F.flatten(F.transform(F.filter(one, lambda x: F.length(x) > 0), once))
    return F.array_distinct(F.concat(F.array(w), one, two))


def piece(w, length, i, shift):
    """Piece ``i`` of those into which a word of ``length`` characters is cut, as it lies in ``w``, moved by ``shift``; with its number and ``length``."""
    start = lambda k: F.floor(k * length / PIECES).cast("int")
    return F.concat_ws(":", length.cast("string"), i.cast("string"), F.substring(w, start(i) + 1 + shift, start(i + 1) - start(i)))


def pieces(w):
    """All pieces of a word."""
    return F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: piece(w, F.length(w), i, F.lit(0)))


def probes(w):
    """What ``w`` may share with a long target within ``EDITS``: a number of rows that doesn't grow with its length."""
    near, width = F.sequence(F.lit(-EDITS), F.lit(EDITS)), 2 * EDITS + 1
    places = F.sequence(F.lit(0), F.lit(PIECES * width - 1))  # a piece and a shift in one number
    of_length = lambda n: F.transform(places, lambda j: piece(w, n, F.floor(j / width).cast("int"), j % width - EDITS))
    lengths = F.filter(F.transform(near, lambda d: F.length(w) + d), lambda n: n > LONG)
    return F.flatten(F.transform(lengths, of_length))


def neighbours(candidates: DataFrame, popular: DataFrame) -> DataFrame:
    """(name, target, distance, downloads) of popular names within two edits of a candidate's canonical form, itself excepted.

    Pairs meet in an equi-join instead of a comparison of all with all; the exact
    distance decides. Deleting up to two characters of both sides gives equal
    strings for all names within two edits; names of more than ``LONG``
    characters, which have too many of these, are cut into pieces instead, one of
    which two edits leave as it is, moved by two characters at most.
    """
    left = candidates.select("name").distinct().withColumn("a", N.canonical(F.col("name")))
    right = popular.select(F.col("name").alias("target"), F.col("downloads")).withColumn("b", N.canonical(F.col("target")))
    a, b, none = F.col("a"), F.col("b"), F.array().cast("array<string>")
    asked = F.concat(F.when(F.length(a) <= LONG + EDITS, deletions(a)).otherwise(none), F.when(F.length(a) > LONG - EDITS, probes(a)).otherwise(none))
    filed = F.when(F.length(b) <= LONG, deletions(b)).otherwise(pieces(b))
    near = (
        left.where(F.length("a") >= SHORTEST).withColumn("v", F.explode(F.array_distinct(asked)))
        .join(right.withColumn("v", F.explode(filed)), "v")
        .where("a <> b").where(F.levenshtein(a, b, 2 * EDITS) >= 0)  # a swap counts two there
        .select("name", "a", "target", "b", "downloads").distinct()
        .withColumn("distance", N.edit_distance(a, b, EDITS)).where(F.col("distance") <= EDITS)
    )
    same = left.join(right, left.a == right.b).withColumn("distance", F.lit(0))
    return same.unionByName(near).where("name <> target").select("name", "target", "distance", "downloads")


def nearest(candidates: DataFrame, popular: DataFrame, n: int = 5) -> DataFrame:
    return top_per(neighbours(candidates, popular), ["name"], n, F.asc("distance"), F.desc("downloads"), F.asc("target"))


def separators(candidates: DataFrame, popular: DataFrame) -> DataFrame:
    """(name, target) that differ in separators and case only; the most popular target."""
    right = popular.select(F.col("name").alias("target"), "downloads", N.stripped(F.col("name")).alias("key"))
    joined = candidates.select("name", N.stripped(F.col("name")).alias("key")).join(right, "key").where("name <> target")
    return joined.groupBy("name").agg(F.min_by("target", F.struct(-F.col("downloads"), F.col("target"))).alias("target"))


def combinations(candidates: DataFrame, popular: DataFrame) -> DataFrame:
    """(name, target, affix): a popular name with one of the affixes after or before it; affixes in order, endings first."""
    affixes = candidates.sparkSession.createDataFrame([(x, i) for i, x in enumerate(AFFIXES)], "affix string, rank int")
    rows = candidates.select("name", N.stripped(F.col("name")).alias("key")).crossJoin(F.broadcast(affixes))  # fifteen affixes
    rest = F.array(
        F.when(F.endswith("key", "affix"), F.struct(F.lit(0).alias("side"), F.expr("substring(key, 1, length(key) - length(affix))").alias("rest"))),
        F.when(F.startswith("key", F.col("affix")), F.struct(F.lit(1).alias("side"), F.expr("substring(key, length(affix) + 1)").alias("rest"))),
    )
    cut = rows.select("name", "affix", "rank", F.explode(F.array_compact(rest)).alias("c")).where(F.length("c.rest") >= SHORTEST_REST)
    right = popular.select(F.col("name").alias("target"), "downloads", N.stripped(F.col("name")).alias("rest"))
    joined = cut.select("name", "affix", "rank", "c.side", "c.rest").join(right, "rest").where("name <> target")
    best = F.min(F.struct("rank", "side", (-F.col("downloads")).alias("d"), "target", "affix"))
    return joined.groupBy("name").agg(best.alias("b")).select("name", "b.target", "b.affix")


def suppression(matches: DataFrame, popular: DataFrame, downloads: DataFrame) -> DataFrame:
    """Each match with the reason why it is nothing to report, or null. Unknown downloads clear nothing."""
    known = popular.select("name", F.lit(True).alias("is_popular"))
    rows = matches.join(known, "name", "left").join(downloads.select("name", F.col("downloads").alias("own")), "name", "left")
    reason = (
        F.when(F.col("is_popular"), "popular").when(F.col("own") >= CLEARED, "downloads").when(F.col("own") > RATIO * F.col("downloads"), "ratio")
    )
    return rows.select("name", "target", "distance", reason.alias("reason"))
