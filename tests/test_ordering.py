import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog_audit.operators import stats
from catalog_audit.operators.ordering import cover_counts, numbered, running


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, many of them tied."""
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.7 else f"g{rnd.randrange(6)}", f"id{i:05d}", rnd.choice([0, 0, 1, 2, 5, 5, 9])) for i in range(4000)]
    return spark.createDataFrame(data + [(None, "n1", 3), (None, "n2", 4)], "g string, id string, v bigint").repartition(7).cache()


@pytest.mark.parametrize("keys", [["g"], []])
def test_slices_agree_with_one_window(skewed, keys):
    order = [F.col("v").desc(), F.col("id")]
    one = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*order)
    assert rows(numbered(skewed, keys, order, "rn")) == rows(skewed.withColumn("rn", F.row_number().over(one).cast("bigint")))
    got = running(skewed, keys, order, {"cum": F.col("v"), "n": F.lit(1).cast("bigint")})
    upto = one.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    assert rows(got) == rows(skewed.withColumns({"cum": F.sum("v").over(upto), "n": F.count(F.lit(1)).over(upto)}))


def first_reaching(values, fraction):
    values, total = sorted(values, reverse=True), sum(values)
    seen = 0
    for n, v in enumerate(values, 1):
        seen += v
        if total > 0 and seen >= fraction * total:
            return n
    return 0


def test_cover_counts_against_brute_force(skewed):
    got = {r.g: (r.a, r.b) for r in cover_counts(skewed, ["g"], "v", {"a": 0.7, "b": 0.8}).collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.g, []).append(r.v)
    assert got == {g: (first_reaching(v, 0.7), first_reaching(v, 0.8)) for g, v in groups.items()}


def test_cover_counts_rounding_and_empty(frame):
    rnd = random.Random(9)
    for _ in range(6):
        vals = [rnd.randrange(0, 8) for _ in range(rnd.randrange(1, 40))]
        df = frame("v bigint", [(v,) for v in vals])
        fr = {"x": rnd.choice([0.1, 0.3, 0.7, 0.9])}
        r = cover_counts(df, [], "v", fr).first()
        assert (r.x, r.total) == (first_reaching(vals, fr["x"]), sum(vals))
    z = cover_counts(frame("g string, v bigint", [("a", 0), ("a", 0)]), ["g"], "v", {"x": 0.8}).first()
    assert (z.g, z.x) == ("a", 0)


def test_five_numbers(spark):
    rnd = random.Random(3)
    vals = [rnd.randrange(50) for _ in range(401)]
    r = stats.five_number_stats(spark.createDataFrame([(v,) for v in vals], "v bigint"), "v").first()
    assert r.n == 401 and (r.min, r.max) == (min(vals), max(vals))
    for name, q in [("p25", 25), ("median", 50), ("p75", 75)]:
        assert r[name] == pytest.approx(np.percentile(vals, q))
    assert r["mean"] == pytest.approx(np.mean(vals))


def test_five_numbers_edges(frame):
    one = stats.five_number_stats(frame("v bigint", [(7,)]), "v").first()
    assert (one.n, one.min, one.p25, one.median, one.max) == (1, 7, 7, 7, 7)
    none = stats.five_number_stats(frame("v bigint", [(None,)]), "v").first()
    assert none.n == 0 and none.median is None


def test_buckets_take_the_lower_edge(frame):
    got = rows(stats.bucketize(frame("v double", [(7.0,), (7.5,), (91.0,)]), "v", [7, 30, 90]), "label", "n")
    assert sorted(got) == sorted([("≤ 7", 1), ("7–30", 1), ("30–90", 0), ("> 90", 1)])
