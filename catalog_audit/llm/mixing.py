"""Mixing sources to target weights by Poisson replication, in built-in functions only.

A source with share p of the documents and target weight w repeats each of its documents w / p times on average (times
``epochs``). The number of copies of a document is drawn from the Poisson distribution with that mean by inverting its
distribution function at a number hashed from the seed and the document, so every run and every retried task draws the
same. Copies are then dealt over all partitions in a hashed order: a global shuffle.

The distribution function of a source is built once, in the table of rates, up to the point where the tail is below
the spacing of the hashed numbers; a document only counts how many of its steps lie below its own number.

Targets: a mapping of source to weight, or, without one, ``share ** temperature`` for each source. Weights are
normalised over the sources present. Edge cases: a null source is a source of its own (``None`` in the mapping); a
source missing from a given mapping has weight 0 and no copies; a null id is hashed together with the text, so rows
without id draw by text; equal rows with equal ids draw the same number and each is copied; an empty table gives an
empty result; ``row`` holds the columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_audit.session import materialize

TEMPERATURE = 0.5
_STEPS = float(1 << 52)


def uniform(seed: int, *what: Column) -> Column:
    """A number in (0, 1) hashed from the seed and the given columns."""
    h = F.xxhash64(F.lit(seed), *what)
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / _STEPS


def poisson_steps(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution, far enough that what remains is below 2^-52.

    Terms are taken in logarithms, so no mean is too large; a mean of 0 gives the single step 1.
    """
    last = F.ceil(mean + 9.0 * F.sqrt(mean) + 30.0).cast("int")
    logs = F.aggregate(  # log(k!) for k = 0, 1, ... as a running sum
        F.sequence(F.lit(1), last), F.array(F.lit(0.0)),
        lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + F.ln(k.cast("double")))))
    terms = F.transform(logs, lambda f, k: F.exp(k * F.ln(mean) - mean - f))
    steps = F.aggregate(terms, F.array().cast("array<double>"),
                        lambda acc, t: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + t)))
    return F.when(mean > 0, steps).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, source: str = "source", weights: Mapping[str | None, float] | None = None,
          temperature: float = TEMPERATURE, epochs: float = 1.0) -> DataFrame:
    """(source, documents, share, weight, mean, steps): one row per source, from counts over all documents."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    if weights is None:
        raw = F.pow(F.col("documents").cast("double"), F.lit(temperature))
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(raw)
    weighed = counts.withColumn("raw", raw)
    documents, raw = (weighed.agg(F.sum(c).alias("n")).scalar() for c in ("documents", "raw"))
    known = weighed
    share, weight = F.col("documents") / documents, F.try_divide(F.col("raw"), raw)
    known = known.select("source", "documents", share.alias("share"), F.coalesce(weight, F.lit(0.0)).alias("weight"))
    return known.withColumn("mean", F.lit(float(epochs)) * F.col("weight") / F.col("share")).withColumn("steps", poisson_steps(F.col("mean")))


def replicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
              weights: Mapping[str | None, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0,
              seed: int = 17) -> DataFrame:
    """(row, copy, copies): each document as often as drawn (``copy`` counts from 0), dealt out in hashed order."""
    table = materialize(rates(docs, source, weights, temperature, epochs), "rates").select(F.col("source").alias("s"), "steps")
    key = F.when(F.col(doc_id).isNull(), F.xxhash64(F.col(text))).otherwise(F.col(doc_id).cast("long"))
    own = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), key.alias("key"))
    drawn = own.join(table, F.col("source").eqNullSafe(F.col("s")))
    number = uniform(seed, F.col("key"))
    copies = F.size(F.filter("steps", lambda p: p < number))
    many = drawn.select("row", "key", copies.alias("copies")).where("copies > 0")
    each = many.select("row", "key", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = each.withColumn("place", F.xxhash64(F.lit(seed + 1), "key", "copy"))
    return dealt.repartition("place").sortWithinPartitions("place").select("row", "copy", "copies")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The replicated, shuffled documents with their columns unchanged."""
    return replicate(docs, **options).select("row.*")
