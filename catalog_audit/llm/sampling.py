"""Bounded training samples, drawn by hash in one pass so that no group is gathered or ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_class(rows: DataFrame, label: str, total: int, *key: Column | str, seed: int = 11) -> DataFrame:
    """About ``total`` keys in all, shared evenly by the values of ``label``: a class with fewer is taken whole.

    Keys are taken when their hash falls below the class's share, so the draw is the same in every run and its
    expected size is ``total`` at any table size. Rows of one key are taken together: the caller keeps one of each.
    The shares, one number a class, are a scalar that the scan compares with; no row moves.
    """
    counts = rows.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_rows"))
    entries = F.collect_list(F.struct("_class", (F.lit(float(total)) / F.col("_rows")).alias("_share")))
    shares = counts.where("_class IS NOT NULL").agg(F.struct(F.map_from_entries(entries).alias("of"), F.count(F.lit(1)).alias("n")).alias("s"))
    number = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)).cast("double") / float(1 << 52)
    drawn = rows.withColumn("_s", shares.select("s").scalar())
    return drawn.where(number * F.col("_s.n") < F.try_element_at(F.col("_s.of"), F.col(label))).drop("_s")
