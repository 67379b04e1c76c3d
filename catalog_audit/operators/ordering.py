"""Row numbers and running totals without one task per group.

Rows are range-sorted on (group, order) and stored; each stored partition sums its own slice of each group, and
what the slices before it hold is added (one number per slice and group). Every task sees at most one range partition
whatever the largest group, and small tables take the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog_audit.session import materialize


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], measures: dict[str, Column]) -> DataFrame:
    """Add, per ``keys`` group in ``order``, the inclusive running sum of each measure.

    ``order`` must be a total order within the group. Measures must not be NULL.
    """
    named = df.withColumns({f"_m_{n}": c for n, c in measures.items()})
    stored = materialize(named.sort(*keys, *order).withColumn("_pos", F.monotonically_increasing_id()), "ordered")
    # the id holds the partition in its upper bits and the row in its lower 33
    stored = stored.withColumn("_slice", F.shiftright("_pos", 33))
    local = Window.partitionBy("_slice", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = stored.withColumns({n: F.sum(f"_m_{n}").over(local) for n in measures})
    sums = stored.groupBy("_slice", *keys).agg(*[F.sum(f"_m_{n}").alias(n) for n in measures])
    # one row per slice and group: no more rows of a group than stored partitions, summed in one linear pass
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_slice").alias("_oslice"), *[F.col(k).alias(f"_k_{k}") for k in keys],
                          *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).cast(sums.schema[n].dataType).alias(f"_o_{n}") for n in measures])
    cond = [F.col("_slice") == F.col("_oslice")] + [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = inside.join(offsets, cond)
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_o_{n}")).alias(n) for n in measures])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add a 1-based row number per group."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")})


def cover_counts(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """How many of the largest values reach each fraction of the group's total.

    Works on the histogram of values: equal values are interchangeable, so the rows
    ordered are the distinct values of a group, not its members. 0 when the total is 0.
    """
    df = df.select(*keys, F.col(value).alias("_v"))
    hist = df.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    hist = hist.filter("_v > 0").withColumn("_mass", F.col("_v") * F.col("_n"))
    cum = running(hist, keys, [F.col("_v").desc()], {"_cum": F.col("_mass")})
    totals = df.groupBy(*keys).agg(F.coalesce(F.sum("_v"), F.lit(0)).cast("bigint").alias("total"))
    named = totals.withColumnsRenamed({k: f"_t_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    joined = cum.join(named, same) if keys else cum.withColumn("total", totals.select("total").scalar())
    before, item = F.col("_cum") - F.col("_mass"), F.col("_v").cast("double")
    out = {}
    for name, fraction in fractions.items():
        # items of this value still needed: settle the division's rounding by comparing
        target = F.lit(fraction) * F.col("total")
        guess = F.floor((target - before) / item)
        least = (F.when(before + (guess - 1) * item >= target, guess - 1)
                 .when(before + guess * item >= target, guess).otherwise(guess + 1))
        needed = F.when(before < target, F.least(F.col("_n"), least)).otherwise(F.lit(0))
        out[name] = F.coalesce(F.sum(needed), F.lit(0)).cast("bigint")
    counted = joined.groupBy(*keys).agg(*[c.alias(n) for n, c in out.items()])
    if not keys:
        return counted.withColumn("total", totals.select("total").scalar())
    # a group without any positive value has no histogram row and covers with 0
    return named.join(counted, same, "left").select(
        *[F.col(f"_t_{k}").alias(k) for k in keys], "total",
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in fractions])
