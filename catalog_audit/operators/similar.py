"""Names that nearly agree: an edit-distance join by segments and a Jaccard join by rare words, both verified.

Proposals for review; nothing is merged by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_audit.functions.names import content_tokens


def normalized(name):
    """Lower case, digits and signs read as space, single spaces."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}]+", " "))


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    """(name, uses): every normalised name once."""
    return df.select(normalized(F.col(column)).alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("uses"))


def within_edits(names: DataFrame, edits: int = 2) -> DataFrame:
    """(a, b, distance), a before b: pairs of distinct names at most ``edits`` insertions, deletions or changes apart.

    The shorter name of a pair is cut into ``edits`` + 1 segments, of which at least one survives all edits, at
    a place no more than ``edits`` away. So names meet under (length, segment number, segment text), a number of rows that does
    not depend on how many names there are; each candidate pair is verified once. Names too short to be cut
    meet under one key.
    """
    parts = edits + 1
    n, span = F.length("name"), lambda length: F.floor(length / parts)
    each = F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("i")
    # the last segment takes the rest of the division
    width = lambda length, i: F.when(i == edits, length - span(length) * edits).otherwise(span(length))
    cut = names.where(n >= parts).select("name", n.alias("length"), each)
    filed = cut.select(F.col("name").alias("short"), "length", "i", F.substring(F.col("name"), (span(F.col("length")) * F.col("i") + 1).cast("int"), width(F.col("length"), F.col("i")).cast("int")).alias("segment"))
    asked = names.select("name", F.explode(F.sequence(F.greatest(n - edits, F.lit(parts)), n)).alias("length")).where(F.col("length") <= n)
    asked = asked.select("name", "length", each).select("name", "length", "i", F.explode(F.sequence(F.lit(-edits), F.lit(edits))).alias("shift"))
    start = span(F.col("length")) * F.col("i") + 1 + F.col("shift")
    asked = asked.where(start >= 1).select("name", "length", "i", F.substring(F.col("name"), start.cast("int"), width(F.col("length"), F.col("i")).cast("int")).alias("segment")).distinct()
    met = asked.join(filed, ["length", "i", "segment"]).select("name", "short")
    small = names.where(n < parts).select(F.col("name").alias("short"))
    met = met.unionByName(small.join(names.where(n < parts + edits).select("name"), F.length("name") >= F.length("short")))
    pairs = met.where("name <> short").select(F.least("name", "short").alias("a"), F.greatest("name", "short").alias("b")).distinct()
    distance = F.levenshtein("a", "b", edits)
    return pairs.withColumn("distance", distance).where("distance >= 0")


def alike_words(names: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, shared, jaccard), a before b: pairs of names whose word sets have a Jaccard similarity of ``least`` or more.

    Words are ordered from rare to frequent; a pair that reaches ``least`` shares a word among the first
    n - ceil(least * n) + 1 of either set, so only those are filed, and a frequent word seldom is.
    """
    sets = names.select("name", F.array_distinct(content_tokens(F.col("name"))).alias("words")).where("size(words) > 0")
    rows = sets.select("name", F.size("words").alias("n"), F.explode("words").alias("word"))
    order = rows.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    # bounded by the words of one name
    ranked = rows.join(order, "word").groupBy("name", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "word"))).alias("ws"))
    first = F.slice("ws", F.lit(1), (F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).cast("int"))
    filed = ranked.select("name", "n", F.transform("ws", lambda w: w["word"]).alias("words"), F.explode(F.transform(first, lambda w: w["word"])).alias("key"))
    sides = [filed.select(F.struct(F.col("name"), "n", "words").alias(s), "key") for s in "xy"]
    met = sides[0].join(sides[1], "key").where("x.name < y.name AND least(x.n, y.n) >= {0} * greatest(x.n, y.n)".format(least)).select("x", "y").distinct()
    shared = F.size(F.array_intersect("x.words", "y.words"))
    found = met.select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), shared.alias("shared"), (shared / (F.col("x.n") + F.col("y.n") - shared)).alias("jaccard"))
    return found.where(F.col("jaccard") >= least)
