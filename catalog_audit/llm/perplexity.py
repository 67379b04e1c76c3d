"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

*Model.* Trusted documents are labelled rows, and all of them are counted but those kept out for the thresholds. Their
bigrams, with marks for the start and end of a text, are counted in Spark and the model stays a table; discounts come from the counts of counts, lower-order probabilities from continuation counts. Each bigram's and word's share
of a text's log-probability is stored in one table by gram hash: a text's total is the sum over its words of
``log p(w) + log gamma(w)``, plus ``log p(w|u) - log gamma(u) - log p(w)`` for each bigram of the model, plus constants.

*Scores.* Whole texts of all documents are exploded into grams. A gram outside the model adds nothing beyond the
constant for unknown words; a bounded bit table of the model's grams tells most of these at the source. The values of the
``HEAD`` most frequent grams are looked up map-side, so no hot gram travels. The others are packed by hash shard and
joined there with the model's table, and sums return per document.

*Filter.* A quarter of the trusted ids never enters the model. Each language gets a mergeable quantile sketch of those
documents' log-perplexities (of all its documents, where it has none); a document is kept up to its language's upper
fence, ``q3 + REACH * (q3 - q1)``.

Edge cases: a text without words has no perplexity and is not kept; a null language is a group of its own; without trusted
text nothing can be scored, perplexities are null and documents with words are kept; equal ids are scored together;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_audit.llm.gram_shards import SCHEMA, lookup, packed, shard_count
from catalog_audit.llm.text import U64, Words, mix, slices, words
from catalog_audit.session import materialize

HEAD = 1 << 17
BITS = 1 << 26
REACH = 3.0
SKETCH_K = 200
ROWS = 4096
START, END = U64(0x51ED270B0B5E9A1D), U64(0x3C6EF372FE94F82B)


def marked_bigrams(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous, word, text) of every position of every text that has words, with START before and END after."""
    n = len(w.counts)
    some = w.counts > 0
    owner = w.owner
    first, last = w.docs[:-1][some], w.docs[1:][some] - 1
    before = np.empty(len(h), U64)
    before[1:] = h[:-1]
    before[first] = START
    return (np.concatenate([before, h[last]]), np.concatenate([h, np.full(len(last), END, U64)]),
            np.concatenate([owner, np.arange(n)[some]]))


def gram_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(mix(u + U64(1)) ^ v * U64(0xE7037ED1A0B428DB))


def count_bigrams(texts: DataFrame, text: str = "text") -> DataFrame:
    """(u, v, gram, n) over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in slices(batch.column(0), rows=ROWS):
                w = words(data, bounds)
                u, v, _ = marked_bigrams(w, w.hashes())
                g, at, n = np.unique(gram_hash(u, v), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u[at], v[at], g)] + [pa.array(n)], ["u", "v", "gram", "n"])

    return texts.select(F.col(text).alias("text")).mapInArrow(run, "u long, v long, gram long, n long").groupBy("u", "v", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame, column: str) -> DataFrame:
    """One row (d1, d2, d3): modified Kneser-Ney discounts from the counts of counts; within (0, count) on tiny tables."""
    n = [F.sum(F.when(F.col(column) == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    one = counts.agg(*n).withColumn("y", F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0)))

    def of(k: int):
        top = F.greatest(F.col(f"n{k}"), F.lit(1.0))
        return F.least(F.lit(k - 0.1), F.greatest(F.lit(0.1), k - (k + 1) * F.col("y") * F.col(f"n{k + 1}") / top)).alias(f"d{k}")

    return one.select(*[of(k) for k in (1, 2, 3)])


def _beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """The columns of a one-row frame on every row."""
    return df.withColumn("_one", one.select(F.struct("*").alias("x")).scalar()).select("*", "_one.*").drop("_one")


def _discount(count: str):
    return F.when(F.col(count) == 1, F.col("d1")).when(F.col(count) == 2, F.col("d2")).otherwise(F.col("d3"))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, float, float]:
    """(u, v, gram, n) -> ((gram, value, uses), log-probability of an unknown word, constant per text)."""
    words_in = counts.groupBy("v").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("uses"))
    totals = words_in.agg(F.sum("kinds").alias("all_kinds"), F.count(F.lit(1)).alias("vocabulary"))
    low = _beside(_beside(words_in, totals), discounts(words_in, "kinds"))
    spare = low.groupBy().agg((F.sum(_discount("kinds")) / F.max("all_kinds") / (F.max("vocabulary") + 1)).alias("unknown"))
    unigrams = _beside(low, spare).select("v", "uses", "unknown", ((F.col("kinds") - _discount("kinds")) / F.col("all_kinds") + F.col("unknown")).alias("p1"))
    high = _beside(counts, discounts(counts, "n"))
    contexts = high.groupBy("u").agg(F.sum("n").alias("total"), F.sum(_discount("n")).alias("spared")).withColumn("gamma", F.col("spared") / F.col("total"))
    unigrams = materialize(unigrams, "unigrams")
    bigrams = (high.withColumn("d", _discount("n")).join(contexts, "u").join(unigrams.select("v", "p1"), "v")
               .select("gram", (F.ln((F.col("n") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("p1")) - F.ln("gamma") - F.ln("p1")).alias("value"), F.col("n").alias("uses")))
    # a word's own gram is its hash; START is only a context, END only a word
    single = unigrams.join(contexts.select(F.col("u").alias("v"), "gamma"), "v", "left").select(
        F.col("v").alias("gram"), (F.ln("p1") - F.ln("unknown") + F.coalesce(F.ln("gamma"), F.lit(0.0))).alias("value"), "uses")
    start, end = (int(x.view(np.int64)) for x in (np.array(START), np.array(END)))
    first = contexts.where(F.col("u") == start).select(F.ln("gamma").alias("x")).first()
    last = unigrams.where(F.col("v") == end).select(F.ln("p1").alias("x"), F.ln("unknown").alias("y")).first()
    table = single.where(F.col("gram") != end).unionByName(bigrams)
    return table, last["y"], first["x"] + last["x"]


def kept_out(doc_id: Column) -> Column:
    """Trusted ids that set thresholds instead of training the model."""
    return F.pmod(F.xxhash64(F.lit(5), doc_id.cast("long")), F.lit(4)) == 0


def trusted_model(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, float, float] | None:
    """The model of all documents whose id is in ``trusted`` (doc_id) and not kept out; None if there are none with words."""
    # stored, so that the join knows their size and leaves the texts where they are while the ids are few
    usable = materialize(trusted.where(~kept_out(F.col("doc_id"))).select(F.col("doc_id").alias("key")).distinct(), "trusted-ids")
    counts = materialize(count_bigrams(docs.join(usable, docs[doc_id] == usable["key"], "left_semi"), text), "trusted-bigrams")
    if counts.isEmpty():
        return None
    table, unknown, constant = kneser_ney(counts)
    return materialize(table, "kneser-ney"), unknown, constant


def _bit_table(table: DataFrame) -> np.ndarray:
    """BITS bits, set where a gram of the model may be: a fixed 8 MB whatever the model's size."""
    at = F.pmod(F.col("gram"), F.lit(BITS)) + 1  # Spark's buckets count from one
    parts = table.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts.toLocalIterator():
        chunk = np.frombuffer(r["bits"], np.uint8)
        begin = (r["bucket"] - 1) * len(chunk)
        out[begin:begin + len(chunk)] = chunk
    return out


def text_scores(docs: DataFrame, model: tuple[DataFrame, float, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_perplexity) of every document."""
    spark = docs.sparkSession
    table, unknown, constant = model
    frequent = table.orderBy(F.col("uses").desc(), "gram").limit(HEAD).select("gram", "value").toPandas().sort_values("gram")
    sent = spark.sparkContext.broadcast((frequent["gram"].to_numpy(np.int64), frequent["value"].to_numpy(np.float64), _bit_table(table)))
    shards = shard_count(8 * table.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, values, bits = sent.value
        for batch in batches:
            for i, j, data, bounds in slices(batch.column(1), rows=ROWS):
                w = words(data, bounds)
                h = w.hashes()
                u, v, of = marked_bigrams(w, h)
                grams = np.concatenate([h, gram_hash(u, v)]).view(np.int64)
                owner = np.concatenate([w.owner, of])
                at = lookup(head, grams)
                known = np.bincount(owner[at >= 0], weights=values[at[at >= 0]], minlength=j - i)[:j - i]
                place = (grams & (BITS - 1))
                asked = np.flatnonzero((at < 0) & ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool))
                grams, owner = grams[asked], owner[asked]
                yield packed(batch.column(0).slice(i, j - i), w.counts, known, shards,
                             [("grams", pa.int64(), grams, owner, grams % shards)])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = own.mapInArrow(run, SCHEMA.format("grams array<long>"))
    each = dealt.select("doc_id", "n_words", "known", F.posexplode_outer("grams").alias("pos", "gram"))
    # narrow rows: a text's settled part travels once
    first = F.coalesce("pos", F.lit(0)) == 0
    narrow = each.select("doc_id", "gram", *[F.when(first, F.col(c)).alias(c) for c in ("n_words", "known")])
    # every gram that was sent has its one value in the table, or none where the bit was another gram's
    joined = narrow.join(table.select("gram", "value"), "gram", "left")
    sums = joined.groupBy("doc_id").agg(
        F.sum("n_words").alias("n_words"), (F.sum("known") + F.sum(F.coalesce("value", F.lit(0.0)))).alias("known"))
    per_word = -(F.col("known") + F.col("n_words") * unknown + constant) / (F.col("n_words") + 1)
    return sums.select("doc_id", "n_words", F.when(F.col("n_words") > 0, per_word).alias("log_perplexity"))


def fences(scored: DataFrame, reach: float = REACH) -> DataFrame:
    """(lang, log_perplexity, held) -> (lang, fence): the upper fence of each language, from KLL sketches of its documents."""
    held = F.when(F.col("held"), F.col("log_perplexity"))
    sketches = scored.groupBy("lang").agg(*[
        x for name, v in (("held", held), ("all", F.col("log_perplexity")))
        for x in (F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias(f"s_{name}"), F.count(v).alias(f"n_{name}"))])

    def fence(name: str) -> Column:
        low, high = (F.kll_sketch_get_quantile_double(F.col(f"s_{name}"), F.lit(q)) for q in (0.25, 0.75))
        return F.when(F.col(f"n_{name}") > 0, high + reach * (high - low))

    return sketches.select("lang", F.coalesce(fence("held"), fence("all")).alias("fence"))


def judge_perplexity(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                     reach: float = REACH) -> DataFrame:
    """(doc_id, lang, n_words, log_perplexity, fence, kept) of every document."""
    model = trusted_model(docs, trusted, doc_id, text)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"))
    if model is None:
        size = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")
        return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), size.alias("n_words"),
                           F.lit(None).cast("double").alias("log_perplexity"), F.lit(None).cast("double").alias("fence"), (size > 0).alias("kept"))
    scored = text_scores(docs, model, doc_id, text).withColumnRenamed("doc_id", "id")
    held = trusted.where(kept_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("h")).distinct()
    judged = materialize(own.join(scored, F.col("doc_id").eqNullSafe(F.col("id")), "left").join(held, F.col("doc_id") == F.col("h"), "left")
                         .withColumn("held", F.col("h").isNotNull()).drop("id", "h"), "perplexities")
    cuts = materialize(fences(judged, reach), "perplexity-fences").withColumnRenamed("lang", "l")
    return (judged.join(cuts, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l", "held")
            .withColumn("kept", F.coalesce(F.col("log_perplexity") <= F.col("fence"), F.lit(False))))
