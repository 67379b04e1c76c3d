"""Exact duplicates through content-defined chunk recipes, in built-in functions only.

A text is normalised (each run of ``[\\x20\\x09-\\x0D]`` becomes one space) and cut where its content says so: after
the first punctuation-and-space at least ``MIN_CHUNK`` characters on, at the latest after ``MAX_CHUNK``. Each chunk has a
128-bit identifier; the identifiers of a text in order are its recipe. Equal texts have equal recipes, and texts are
compared by recipes alone, so a long document never moves whole.

Identifiers are verified, not trusted: every distinct chunk of the corpus is moved once (repeats are combined
map-side) and checked for an identifier that stands for two different chunks. If there is one, all identifiers are
drawn anew from the next seed and verified again, so two texts with equal recipes are equal.

Copies meet in an aggregate over recipes with map-side combining, so a group of any size costs one row per task.
Only recipes held twice or more are joined back, and a hot one is split by the adaptive skew join.

Edge cases: null counts as empty; all empty texts are equal to each other; a text without a space or punctuation is cut
every ``MAX_CHUNK`` characters; equal ids are kept apart only by their texts; an empty table gives an empty
result; other columns ride in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CHUNK = 256
MAX_CHUNK = 2048
_CUT = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:(?<=[.,;:!?。，]) |\z)|.{{{MIN_CHUNK},{MAX_CHUNK}}}|.+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks(norm: Column) -> Column:
    """The content-defined chunks of a normalised text, in order; they concatenate to the text."""
    return F.regexp_extract_all(norm, F.lit(_CUT), F.lit(0))


def identifiers(chunk: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * seed), chunk), F.xxhash64(F.lit(2 * seed + 1), chunk)


def chunk_table(docs: DataFrame, text: str = "text", seed: int = 0) -> DataFrame:
    """(a, b, chunk, uses): every distinct chunk with its identifier, moved once."""
    each = docs.select(F.explode(chunks(normalised(F.col(text)))).alias("chunk"))
    a, b = identifiers(F.col("chunk"), seed)
    return each.groupBy(a.alias("a"), b.alias("b"), "chunk").agg(F.count(F.lit(1)).alias("uses"))


def ambiguous(table: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk."""
    return table.groupBy("a", "b").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")


def verified_seed(docs: DataFrame, text: str = "text", seed: int = 0) -> int:
    """The first seed whose identifiers are unambiguous over every chunk of ``docs``."""
    while not ambiguous(chunk_table(docs, text, seed)).isEmpty():
        seed += 1
    return seed


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """(row, doc_id, text_sha256, a, b): per document the two halves of its verified chunk identifiers, in order."""
    seed = verified_seed(docs, text)
    norm = normalised(F.col(text))
    cut = docs.select(F.struct(*keep).alias("row"), F.col(doc_id).alias("doc_id"), F.sha2(norm, 256).alias("text_sha256"), chunks(norm).alias("cut"))
    return cut.select("row", "doc_id", "text_sha256", F.transform("cut", lambda c: identifiers(c, seed)[0]).alias("a"),
                      F.transform("cut", lambda c: identifiers(c, seed)[1]).alias("b"))


def mark_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256), one row per document.

    Of equal texts the smallest id stays. Where the same id repeats with the same text, every such row is kept.
    """
    made = recipes(docs, doc_id, text, keep)
    groups = (made.groupBy("a", "b").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .where("group_size > 1"))
    return (made.join(groups, ["a", "b"], "left")
            .select("row", "doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256")
            .withColumn("kept", F.col("keep_id").eqNullSafe(F.col("doc_id"))))


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with their columns unchanged.

    The (id, text digest) pairs that go are found first and then removed from the table, so texts are moved only where
    the planner finds those pairs too many to broadcast.
    """
    gone = (mark_duplicates(docs, doc_id, text, keep=(doc_id,)).where("not kept")
            .select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")).distinct())
    own = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("text_sha256"))
    return (own.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha256") == F.col("digest")), "left_anti")
            .select("row.*"))
