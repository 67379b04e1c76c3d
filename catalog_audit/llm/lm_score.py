"""Language-model scores by stupid backoff, computed relationally.

Counts come from the whole corpus. A word w after u scores c(u w) / c(u), whatever their frequency; the first word of a
text scores c(w) / N. A document's score is the sum of the logarithms. The scored corpus is the counted one, so every pair
is seen and nothing backs off, unless a caller limits the model by ``VOCABULARY``: then a pair outside the
most frequent words scores ``ALPHA`` times c(w) / N.

Exploded n-grams are dealt by hash to shards; a shard counts its grams and joins the counts to the n-grams in place, so
one exchange serves both the count table and the join. What is frequent never travels: the counts of the ``FREQUENT``
most frequent words, and of all pairs of the ``HEAD`` most frequent ones, are exact tables of bounded size, read map-side. They
and the 32-bit codes of pairs of frequent words are shortcuts that change no score. Any other pair holds less than 1 / HEAD of all
tokens and any other word less than 1 / FREQUENT, so no shard has a hot key. A word's count joins with the weight
the text's sum gives it: 1 where the word stands without its pair, -1 where it begins one, and 0 where these cancel or
the text ends.

Edge cases: a text without words scores 0 over 0 words and has a null mean; equal ids are scored together as one
document; a null id is a document of its own kind (all such rows together); ties in frequency are broken by hash, the
same way in each run; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog_audit.llm.gram_shards import SCHEMA, lookup, packed, shard_count
from catalog_audit.llm.text import U64, Words, mix, slices, words
from catalog_audit.session import materialize_counted

#: The model's vocabulary: None for every word, or how many of the most frequent words may form pairs.
VOCABULARY: int | None = None
FREQUENT = 65_535
HEAD = 256
ALPHA = 0.4
ROWS = 4096
#: The lists of infrequent words, and the weight of their counts in a text's sum.
WEIGHTS = {"added": 1, "counted": 0, "taken": -1}


def _each(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    for i, j, data, bounds in slices(batch.column(column), rows=ROWS):
        w = words(data, bounds)
        yield i, j, w, w.hashes()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the count of every word, by 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, h in _each(batch, 0):
                word, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(run, "word long, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Frequent:
    """The most frequent words: sorted hashes, counts, and each word's rank by count."""

    def __init__(self, word: np.ndarray, n: np.ndarray):
        order = np.argsort(word.view(U64))
        self.word, self.n = word.view(U64)[order], n[order]
        self.rank = order  # rows come by falling count


def _ranks(w: Words, h: np.ndarray, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether it begins its text, rank of the previous word, rank) of every word; -1 where there is none."""
    at = lookup(frequent.word, h)
    rank = np.full(len(h), -1, np.int64)
    rank[at >= 0] = frequent.rank[at[at >= 0]]
    first = np.zeros(len(h), bool)
    first[w.docs[:-1][w.counts > 0]] = True
    before = np.full(len(h), -1, np.int64)
    before[1:] = rank[:-1]
    before[first] = -1
    return first, before, rank


def _pair_hashes(h: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words at ``second`` and before."""
    return mix(mix(h[second - 1] + U64(0xA0761D6478BD642F)) ^ h[second] * U64(0xE7037ED1A0B428DB))


def head_counts(docs: DataFrame, sent: Broadcast, text: str = "text") -> np.ndarray:
    """HEAD x HEAD: exact counts of all pairs of the most frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        total = np.zeros(HEAD * HEAD, np.int64)
        for batch in batches:
            for _, _, w, h in _each(batch, 0):
                _, u, v = _ranks(w, h, frequent)
                top = (u >= 0) & (v >= 0) & (u < HEAD) & (v < HEAD)
                total += np.bincount(u[top] * HEAD + v[top], minlength=HEAD * HEAD)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(HEAD * HEAD, np.int64)
    out[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _dealt(docs: DataFrame, sent: Broadcast, total: int, shards: int, doc_id: str, text: str) -> DataFrame:
    """Tokens that need a count from a shard (pairs by the ranks of frequent words or by hash; words by weight), and each text's settled part."""
    cap = VOCABULARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, head = sent.value
        log_n = np.zeros(len(frequent.n))
        log_n[frequent.rank] = np.log(frequent.n.astype(np.float64))
        for batch in batches:
            for i, j, w, h in _each(batch, 1):
                owner = w.owner
                first, u, v = _ranks(w, h, frequent)
                paired = ~first if cap is None else (u >= 0) & (v >= 0) & (u < cap) & (v < cap)
                value = np.where(paired, 0.0, -np.log(max(total, 1)))
                value[~paired & ~first] += np.log(ALPHA)
                weight = (~paired).astype(np.int8)
                weight[:-1] -= paired[1:]
                known = v >= 0
                value[known] += weight[known] * log_n[v[known]]
                near = paired & (np.minimum(u, v) >= 0) & (np.maximum(u, v) < 1 << 16)
                top = near & (u < HEAD) & (v < HEAD)
                value[top] += np.log(head[u[top] * HEAD + v[top]])
                near, far = np.flatnonzero(near & ~top), np.flatnonzero(paired & ~near)
                settled = np.bincount(owner, weights=value, minlength=j - i)[:j - i]
                codes = (u[near] << 16 | v[near]).astype(np.uint32)
                streams = [("near", pa.int32(), codes.view(np.int32), owner[near], (mix(codes.astype(U64)) % U64(shards)).astype(np.int64))]
                hashes = [("far", owner[far], _pair_hashes(h, far))]
                hashes += [(name, owner[some], h[some]) for name, some in ((name, np.flatnonzero(~known & (weight == x))) for name, x in WEIGHTS.items())]
                streams += [(name, pa.int64(), x.view(np.int64), of, (x % U64(shards)).astype(np.int64)) for name, of, x in hashes]
                yield packed(batch.column(0).slice(i, j - i), w.counts, settled, shards, streams)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, SCHEMA.format("near array<int>, far array<long>, " + ", ".join(f"{name} array<long>" for name in WEIGHTS)))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every document, against the counts of all of ``docs``."""
    sc = docs.sparkSession.sparkContext
    counts, seen = materialize_counted(word_counts(docs, text), "word-counts", tokens=F.sum("n"))
    most = counts.orderBy(F.col("n").desc(), "word").limit(max(FREQUENT, VOCABULARY or 0)).toPandas()
    frequent = Frequent(most["word"].to_numpy(np.int64), most["n"].to_numpy(np.int64))
    head = head_counts(docs, sc.broadcast(frequent), text)
    shards = shard_count(seen["tokens"])
    dealt = _dealt(docs, sc.broadcast((frequent, head)), seen["tokens"], shards, doc_id, text).repartitionById(shards, "shard")
    def grams(name: str, order: int, weight: int) -> Column:
        return F.transform(name, lambda g: F.struct(F.lit(order).cast("byte").alias("order"), F.lit(weight).cast("byte").alias("weight"), g.cast("long").alias("gram")))

    gram = F.concat(grams("near", 2, 1), grams("far", 3, 1), *[grams(name, 1, x) for name, x in WEIGHTS.items()])
    each = dealt.select("doc_id", "shard", "n_words", "known", F.posexplode_outer(gram).alias("pos", "g"))
    # narrow rows: what is sorted is little more than the gram. A text without grams in a shard stands alone under its id
    narrow = each.select("doc_id", "shard", F.coalesce("g.gram", "doc_id").alias("gram"), *[F.coalesce(f"g.{c}", F.lit(0).cast("byte")).alias(c) for c in ("order", "weight")],
                         *[F.when(F.coalesce("pos", F.lit(0)) == 0, F.col(c)).alias(c) for c in ("n_words", "known")])
    counted = narrow.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("gram", "order", "shard")))
    scored = counted.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), (
        F.sum("known") + F.sum(F.when(F.col("weight") != 0, F.col("weight") * F.ln("n")).otherwise(0.0))).alias("log_score"))
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
