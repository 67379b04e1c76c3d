"""Distributions: five-number summary, histogram, buckets.

Each starts from the histogram of values, so what is ordered or bucketed afterwards is
the set of distinct values, however many rows share one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_audit.operators.ordering import running


def int_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def five_number_stats(df: DataFrame, column: str) -> DataFrame:
    """n, min, p25, median, p75, max, mean with linear interpolation (one row).

    The quantiles are read off the running histogram by rank; n is 0 and the rest NULL
    when there is nothing to describe.
    """
    hist = int_histogram(df, column)
    cum = running(hist, [], [F.col("value")], {"upto": F.col("n")})
    total = F.col("total")
    cum = cum.withColumn("total", hist.agg(F.sum("n").alias("t")).scalar())

    def at(rank):  # the value holding 0-based position `rank`
        return F.min(F.when(F.col("upto") > rank, F.col("value"))).cast("double")

    out = [F.coalesce(F.max("total"), F.lit(0)).alias("n"), F.min("value").cast("double").alias("min")]
    for name, q in [("p25", 0.25), ("median", 0.5), ("p75", 0.75)]:
        pos = F.lit(q) * (total - 1)
        lo = F.floor(pos)
        low, high = at(lo), at(F.least(lo + 1, total - 1))
        out.append((low + (high - low) * F.max(pos - lo)).alias(name))
    out += [F.max("value").cast("double").alias("max"),
            F.try_divide(F.sum(F.col("value") * F.col("n")).cast("double"), F.max("total").cast("double")).alias("mean")]
    return cum.agg(*out)


def bucketize(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Counts per bucket; a value belongs to the first edge it does not exceed. Empty buckets stay."""
    spark = df.sparkSession
    labels = [f"≤ {edges[0]:g}"] + [f"{a:g}–{b:g}" for a, b in zip(edges, edges[1:])] + [f"> {edges[-1]:g}"]
    bucket = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        bucket = F.when(F.col(column) <= edges[i], i).otherwise(bucket)
    counted = df.filter(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame(list(enumerate(labels)), "bucket int, label string")
    return names.join(counted, "bucket", "left").select("bucket", "label", F.coalesce("n", F.lit(0)).alias("n"))
