"""Quality rules whose cutoffs adapt to each language and source.

Base counts come from the whole text and are stored once. Every (lang, source) group keeps, of each measure, how many texts
have none of it and a mergeable quantile sketch (KLL) of the others. A document fails when a measure lies beyond its group's upper
fence, ``q3 + reach * (q3 - q1)``. Most texts have no symbols or repeated lines at all, so that quartiles are equal and tell no scale:
there the fence is the natural break of the group's distribution, the cut that parts its values into the two classes of the
greatest variance between them, and at least half the break of all documents, so that a group without junk keeps what is usual
elsewhere. A fence of a share stays below 1 even where over a quarter of a group is junk: it lies at most halfway to 1 from the median,
or from q3 where a high share is usual. A group of fewer than ``LEAST`` texts is judged by the merged sketches of its language, or
else of all documents. No cutoff is fixed. Sketches are built map-side and merged, so a hot source costs no more than any other;
thresholds are then joined to the documents.

Edge cases: a null or empty text has no words and fails the base rule; null ``lang`` or ``source`` is a group of its
own; repeated rows are judged one by one; an empty table gives an empty result; extra columns pass through
``filter_quality`` untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_audit.llm.text import distinct, is_space, slices, small_batches, windows, words
from catalog_audit.session import materialize

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
WINDOW = 8
MIN_WORDS = 20
REACH = 3.0
LEAST = 30
SKETCH_K = 400
#: Quantiles read from a sketch.
POINTS = 200
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_STRUCT = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def counts_of(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of an Arrow column."""
    out = {c: np.zeros(len(column), np.int64) for c in COUNTS}
    for i, j, data, bounds in slices(column):
        w = words(data, bounds)
        n = j - i

        def per_text(flags: np.ndarray) -> np.ndarray:
            return np.diff(np.append(0, np.cumsum(flags))[bounds])

        solid = ~is_space(data)
        out["n_words"][i:j] = w.counts
        out["word_chars"][i:j] = per_text(solid & ((data & 0xC0) != 0x80))
        out["n_symbols"][i:j] = per_text(_SYMBOLS[data])
        out["n_upper"][i:j] = per_text((data >= 65) & (data <= 90))
        out["n_dup_lines"][i:j], out["n_lines"][i:j] = _lines(data, bounds, n)
        out["n_repeat_words"][i:j] = _repeats(w, n)
    return out


def _lines(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines that have a word: how many equal an earlier line of the text, and how many there are."""
    cut = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([bounds[:-1], cut + 1]))
    start = start[start < len(data)]
    if not len(start):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    end = np.append(start[1:], len(data))
    of = np.searchsorted(bounds, start, "right") - 1
    solid = np.append(0, np.cumsum(~is_space(data)))
    end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 10))
    some = (solid[end] - solid[start]) > 0
    start, end, of = start[some], end[some], of[some]
    total = np.bincount(of, minlength=n)[:n]
    h = _span_hash(data, start, end)
    _, owners, times = distinct(h, of)
    dup = np.bincount(owners, weights=times - 1, minlength=n)[:n].astype(np.int64)
    return dup, total


def _span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    from catalog_audit.llm.text import Words
    return Words(data, np.array([0, len(data)]), start, end, np.array([0, len(start)])).hashes()


def _repeats(w, n: int) -> np.ndarray:
    """Words inside a window of eight words that the text holds twice or more."""
    h, at = windows(w.hashes(), w.docs, WINDOW)
    if not len(h):
        return np.zeros(n, np.int64)
    owner = w.owner
    of = owner[at]
    order = np.lexsort((h, of))
    same = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(len(owner) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, np.minimum(at[twice] + WINDOW, len(owner)), -1)
    return np.bincount(owner, weights=np.cumsum(cover[:-1]) > 0, minlength=n)[:n].astype(np.int64)


@F.arrow_udf(_STRUCT)
def _count(texts: pa.Array) -> pa.Array:
    got = counts_of(texts)
    return pa.StructArray.from_arrays([pa.array(got[c]) for c in COUNTS], list(COUNTS))


def text_counts(text: Column) -> Column:
    """The counts of a text column as one struct."""
    return _count(text)


def _measures(c: Column) -> dict[str, Column]:
    n = F.greatest(c["n_words"], F.lit(1)).cast("double")
    return {
        "symbol_share": c["n_symbols"] / n,
        "dup_line_share": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
        "repeat_share": c["n_repeat_words"] / n,
        "upper_share": c["n_upper"] / F.greatest(c["word_chars"], F.lit(1)),
        "word_length": c["word_chars"] / n,
    }


def _summary(k: str) -> Column:
    """(q1, q2, q3, break) of one measure, from the number of texts without it and the ``POINTS`` quantiles of the others."""
    n, m, v = F.col("n").cast("double"), F.col(f"{k}_n").cast("double"), F.col(k)

    def quantile(at: float) -> Column:
        place = F.floor((at * n - (n - m)) / m * POINTS).cast("int")
        return F.when(at * n > n - m, F.element_at(v, F.greatest(F.lit(1), F.least(F.lit(POINTS), place + 1)))).otherwise(0.0)

    return F.struct(*[quantile(x / 4).alias(f"q{x}") for x in (1, 2, 3)], _break(v, n - m, m / POINTS, k != "word_length").alias("break"))


def _break(v: Column, zeros: Column, weight: Column, share: bool) -> Column:
    """The middle of the gap that parts ``zeros`` zeros and the rising values ``v``, of equal weight, into the two classes of
    greatest variance between them; null where all values are equal. Shares count as no more than 1.
    """
    one = (lambda x: F.least(x, F.lit(1.0))) if share else (lambda x: x)
    whole = F.aggregate(v, F.lit(0.0), lambda total, x: total + one(x)) * weight
    start = F.struct(zeros.alias("w"), F.lit(0.0).alias("s"), F.lit(0.0).alias("last"), F.lit(0.0).alias("best"), F.lit(None).cast("double").alias("cut"), whole.alias("all"))

    def step(a: Column, x: Column) -> Column:
        rest = zeros + weight * POINTS - a["w"]
        between = F.when((a["w"] > 0) & (one(x) > a["last"]), a["w"] * rest * F.pow(a["s"] / a["w"] - (a["all"] - a["s"]) / rest, F.lit(2.0))).otherwise(0.0)
        better = between > a["best"]
        return F.struct((a["w"] + weight).alias("w"), (a["s"] + one(x) * weight).alias("s"), one(x).alias("last"),
                        F.when(better, between).otherwise(a["best"]).alias("best"), F.when(better, (a["last"] + one(x)) / 2).otherwise(a["cut"]).alias("cut"), a["all"].alias("all"))

    return F.aggregate(v, start, step, lambda a: a["cut"])


def _fence(k: str, own: Column, language: Column, everything: Column, reach: float) -> Column:
    q1, q2, q3 = (own[f"q{i}"] for i in (1, 2, 3))
    far = q3 + reach * (q3 - q1)
    if k != "word_length":
        far = F.least(far, F.when(q2 < 0.5, (1 + q2) / 2).when(q3 < 1, (1 + q3) / 2))
    gap = F.greatest(F.coalesce(own["break"], language["break"], everything["break"]), everything["break"] / 2)
    return F.when(q3 > q1, far).otherwise(F.greatest(q3, gap))


def thresholds(counted: DataFrame, reach: float = REACH) -> DataFrame:
    """(lang, source, counts) -> one row per group: the upper fence of every measure, from KLL sketches of all documents."""
    m = _measures(F.col("counts"))
    some = F.col("counts")["n_words"] > 0
    groups = materialize(counted.groupBy("lang", "source").agg(
        F.count_if(some).alias("n"), *[F.count_if(some & (v > 0)).alias(f"{k}_n") for k, v in m.items()],
        *[F.kll_sketch_agg_double(F.when(some & (v > 0), v), F.lit(SKETCH_K)).alias(k) for k, v in m.items()]), "sketches")
    merged = [F.sum("n").alias("n"), *[F.sum(f"{k}_n").alias(f"{k}_n") for k in m], *[F.kll_merge_agg_double(k).alias(k) for k in m]]

    values = [F.when(F.col(f"{k}_n") > 0, F.kll_sketch_get_quantile_double(k, F.lit((np.arange(POINTS) + 0.5) / POINTS))).otherwise(
        F.array().cast("array<double>")).alias(k) for k in m]
    parts = F.struct(*[_summary(k).alias(k) for k in m])

    def summary(sketches: DataFrame, least: int, name: str, *keys: str) -> DataFrame:
        read = sketches.select(*keys, "n", *[f"{k}_n" for k in m], *values)
        return read.select(*keys, F.when(F.col("n") >= least, parts).alias(name))

    languages = summary(groups.groupBy(F.col("lang").alias("l")).agg(*merged), LEAST, "of_lang", "l")
    of_all = summary(groups.agg(*merged), 1, "of_all")
    told_all = of_all.first()["of_all"]  # one row of twenty numbers: a literal below
    everything = F.lit(None).cast(of_all.schema["of_all"].dataType) if told_all is None else F.struct(*[
        F.struct(*[F.lit(x).cast("double").alias(c) for c, x in told_all[k].asDict().items()]).alias(k) for k in m])
    told = summary(groups, LEAST, "own", "lang", "source").join(languages, F.col("lang").eqNullSafe(F.col("l")), "left")
    q = told.select("lang", "source", F.coalesce("own", "of_lang", everything).alias("q"), F.coalesce("of_lang", everything).alias("r"))
    return q.select("lang", "source", F.struct(*[_fence(k, F.col("q")[k], F.col("r")[k], everything[k], reach).alias(k) for k in m]).alias("fence"))


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", reach: float = REACH,
                  keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """(row, counts, base_failed, reason, kept) of every document; ``row`` holds its columns named in ``keep``.

    ``reason`` is ``base``, or the first measure beyond its fence, or null.
    """
    small_batches(docs)
    own = materialize(docs.select(F.struct(*keep).alias("row"), F.col(lang).alias("lang"), F.col(source).alias("source"), text_counts(F.col(text)).alias("counts")), "counts")
    cuts = materialize(thresholds(own.select("lang", "source", "counts"), reach), "fences").select(F.col("lang").alias("l"), F.col("source").alias("s"), "fence")
    c = F.col("counts")
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
    beyond = F.coalesce(*[F.when(v > F.col("fence")[k], F.lit(k)) for k, v in _measures(c).items()])
    joined = own.join(cuts, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    judged = joined.select("row", "counts", failed.alias("base_failed"), F.when(failed, F.lit("base")).otherwise(beyond).alias("reason"))
    return judged.withColumn("kept", F.col("reason").isNull())


def filter_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", reach: float = REACH) -> DataFrame:
    """The documents that pass, with their columns unchanged."""
    return judge_quality(docs, text, lang, source, reach).where("kept").select("row.*")
