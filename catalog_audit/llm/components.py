"""Connected components of an edge table, by alternating star contractions.

Each round links every vertex to the smallest neighbour of its neighbourhood. Edges are narrow rows; a vertex with very
many neighbours is one combinable minimum, and the join back on it is split by the adaptive skew join. Each round is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_audit.session import materialize_counted


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): every vertex of ``edges`` with the smallest vertex reachable. Loops and repeats are harmless."""
    pairs = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v <> u").distinct()
    now, seen = materialize_counted(pairs, "edges", mark=_checksum())
    while seen["rows"]:
        # large star: each vertex's larger neighbours move to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        # small star: smaller neighbours move to the smallest of them
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(small, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        following = moved.unionByName(small.select("v", F.col("m").alias("u"))).distinct()
        after, now_seen = materialize_counted(following, "edges", mark=_checksum())
        now = after
        if (now_seen["rows"], now_seen["mark"]) == (seen["rows"], seen["mark"]):
            break
        seen = now_seen
    ends = now.select(F.col("v").alias("id"), F.col("u").alias("root"))
    return ends.unionByName(ends.select(F.col("root").alias("id"), "root")).distinct()


def _checksum():
    return F.bit_xor(F.xxhash64("v", "u"))
