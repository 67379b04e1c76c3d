"""Alignment of two tokenizers over the same bytes, with an identity map as its fast path.

A byte-level vocabulary (A) and a piece vocabulary (B) both spell a space and the text. Byte offsets where a token of
each ends cut the tokens into groups; the two tokens that end a group are linked. How often each pair of ids is linked in the
whole corpus rates the links of every document.

* *Identity map.* An array gives for each A id the B id of the same bytes. A group of one token each whose ids the array
  relates is counted in a vector of A's length per task; two tokens of equal bytes that end together also start together,
  so such a pair never comes from another group and its vector entry is its whole count.
* *Irregular groups.* Only their pairs of ids are shuffled, summed per task first. The ``HEAD`` most frequent pairs are sent
  to the tasks as a bounded table; documents meet the other, rarer pairs in a join, so no key of it is hot.

Neither vocabulary joins bytes across a single space between two other characters (checked when it is loaded), so a text
is encoded unit by unit between such spaces. Units are remembered up to a bound, and memory follows the unit.

Edge cases: null and empty texts, and texts that a vocabulary does not spell back (U+2581 stands for a space in B), have no
tokens: zeros and an empty digest; special-token strings are plain text; equal ids and repeated rows are rated apart, each
counting; an empty table gives an empty result; other columns ride in ``row``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_audit.llm.gram_shards import lookup
from catalog_audit.llm.text import small_batches
from catalog_audit.session import materialize

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Most frequent irregular pairs that are sent to the tasks, a shortcut that changes no result.
HEAD = 1 << 16
#: Units remembered per worker, and the longest unit remembered.
UNITS = 400_000
UNIT_CHARS = 48
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Two tokenizers and the groups of a text's tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a) as f:
            model = json.load(f)["model"]
        byte = _byte_alphabet()
        spelling = {i: bytes(byte[c] for c in entry) for entry, i in model["vocab"].items() if all(c in byte for c in entry)}
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        if any(x is None or y is None or x >= y for x, y in zip(merged, merged[1:])):
            raise ValueError("ids do not follow the merges: the ranks of the entries are not their order of merging")
        # entries that no merge makes are names of special tokens
        made = {i for i in spelling if len(spelling[i]) == 1} | set(merged)
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={spelling[i]: i for i in made}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a: list[bytes] = [spelling[i] if i in made else b"" for i in range(max(made) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space after another character: texts cannot be cut at spaces")
        self.bytes_b = [bytes((int(m[1], 16),)) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        named = {}
        for i, p in enumerate(self.bytes_b):
            if not self.b.is_control(i) and not self.b.is_unknown(i):
                named[p] = i  # a piece comes after the single byte of the same spelling
        self.same = np.array([named.get(p, -1) if p else -1 for p in self.bytes_a], np.int64)
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.len_a, self.len_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        ids = [[str(i) for i in range(len(v))] for v in (self.bytes_a, self.bytes_b)]
        self.names = [i + mark for own, marks in zip(ids, (",|", ",;\n")) for mark in marks for i in own]

    def _groups(self, units: list[str]) -> list[tuple]:
        """Of each unit (tokens of A, of B, digest text, linked pairs as a * 2**32 + b); an empty tuple if B does not spell it back."""
        b = self.b.encode(units, num_threads=1)
        bad = [b"".join([self.bytes_b[i] for i in y]) != (" " + u).encode() for u, y in zip(units, b)]  # A always spells its bytes
        if any(bad):
            good = iter(self._groups([u for u, x in zip(units, bad) if not x]))
            return [() if x else next(good) for x in bad]
        if not units:
            return []
        a = [self.a.encode_ordinary(" " + u) for u in units]
        n_a, n_b = (np.array([len(x) for x in v]) for v in (a, b))
        left, right = (np.array([i for x in v for i in x], np.int64) for v in (a, b))
        # byte offsets over all units at once: those where tokens of both end are the ends of groups
        _, at_a, at_b = np.intersect1d(np.cumsum(self.len_a[left]), np.cumsum(self.len_b[right]), assume_unique=True, return_indices=True)
        links = ((left[at_a] << 32) + right[at_b]).tolist()
        # each token's name with what follows it, in the order of groups, A before B
        size_a, size_b = len(self.bytes_a), len(self.bytes_b)
        mark_a, mark_b = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        mark_a[at_a], mark_b[at_b] = 1, 1
        mark_b[np.cumsum(n_b) - 1] = 2
        order = np.empty(len(left) + len(right), np.int64)
        of_a, of_b = np.searchsorted(at_a, np.arange(len(left))), np.searchsorted(at_b, np.arange(len(right)))
        order[np.arange(len(left)) + np.append(0, at_b + 1)[of_a]] = left + mark_a * size_a
        order[np.arange(len(right)) + at_a[of_b] + 1] = right + mark_b * size_b + 2 * size_a
        texts = "".join([self.names[i] for i in order.tolist()]).split("\n")
        bound = np.append(0, np.searchsorted(at_a, np.cumsum(n_a))).tolist()
        return list(zip(n_a.tolist(), n_b.tolist(), texts, [tuple(links[i:j]) for i, j in zip(bound[:-1], bound[1:])]))

    def units(self, texts: list[list[str]]) -> list[list[tuple]]:
        """The groups of every unit of every text; an empty tuple where B does not spell a unit back."""
        if len(self.known) > UNITS // 2:  # what was not met since the last change is forgotten
            self.known, self.older = {}, self.known
        known, older, fresh = self.known, self.older, {}
        out = [list(map(known.get, units)) for units in texts]
        late = []
        for units, found in zip(texts, out):
            if None in found:
                for i, g in enumerate(found):
                    if g is None:
                        u = units[i]
                        found[i] = g = known.get(u, older.get(u))
                        if g is None:
                            fresh[u] = None
                            late.append((found, i, u))
                        elif u not in known:
                            known[u] = g
        fresh = dict(zip(fresh, self._groups(list(fresh))))
        for found, i, u in late:
            found[i] = fresh[u]
        known |= {u: g for u, g in fresh.items() if len(u) <= UNIT_CHARS}
        return out


_loaded: dict[tuple, Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _loaded:
        _loaded[a, b] = Aligner(public_tokenizers.path(a), public_tokenizers.path(b))
    return _loaded[a, b]


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    bounds = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), kind))


def grouped(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """(uid, row, n_a, n_b, n_groups, n_links, groups_sha256) and each text's distinct links with their number: ``same`` by A id, ``odd`` by pair."""
    small_batches(docs)
    schema = ("uid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "same array<int>, same_n array<int>, odd array<long>, odd_n array<int>")
    asked = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"), F.struct(*keep).alias("row"))
    types = dict(asked.dtypes)
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a, b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = 0
            while n < len(texts):
                first, size = n, 0
                while n < len(texts) and (n == first or size < 1 << 19):
                    size += len(texts[n] or "")
                    n += 1
                part = [t or "" for t in texts[first:n]]
                counts, digests, same, odd = [], [], [], []
                for t, units in zip(part, both.units([_BETWEEN.split(t) if t else [] for t in part])):
                    if not t or () in units:
                        counts.append((0, 0, 0, 0))
                        digests.append("")
                        same.append((none, none))
                        odd.append((none, none))
                        continue
                    links = np.array([x for u in units for x in u[3]], np.int64)
                    pairs, times = np.unique(links, return_counts=True)
                    left = pairs >> 32
                    alike = both.same[left] == (pairs & 0xFFFFFFFF)
                    same.append((left[alike], times[alike]))
                    odd.append((pairs[~alike], times[~alike]))
                    counts.append((sum(u[0] for u in units), sum(u[1] for u in units), len(links), len(links)))
                    digests.append(hashlib.sha256(";".join([u[2] for u in units]).encode()).hexdigest())
                columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n - first), batch.column(2).slice(first, n - first), *columns, pa.array(digests, pa.string()),
                    _lists([s for s, _ in same], pa.int32()), _lists([c for _, c in same], pa.int32()),
                    _lists([o for o, _ in odd], pa.int64()), _lists([c for _, c in odd], pa.int32())],
                    ["uid", "row", *[x.split()[0] for x in schema.split(", ")[1:]]])

    head, tail = schema.split(", ", 1)
    return asked.mapInArrow(run, f"{head}, row {types['row']}, {tail}")


def identity_counts(links: DataFrame, size: int) -> DataFrame:
    """(a, n): links of the identity map in the whole corpus, counted in one vector per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["a", "n"])

    return links.select("same", "same_n").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n): links of irregular groups in the whole corpus."""
    each = links.select(F.explode(F.arrays_zip(F.col("odd").alias("pair"), F.col("odd_n").alias("n"))).alias("x"))
    return each.groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.n").alias("n"))


def align(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """Per row of ``docs``: (row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    spark = docs.sparkSession
    both = aligner(a, b)
    to_b = both.same
    links = materialize(grouped(docs, text, keep, a, b), "token-groups")
    # what is collected here is bounded by the two vocabularies and by HEAD
    same = np.zeros(len(both.bytes_a), np.int64)
    best = np.zeros(len(both.bytes_b), np.int64)
    for r in identity_counts(links, len(same)).toLocalIterator():
        same[r["a"]] = r["n"]
    at = np.flatnonzero(same)
    np.maximum.at(best, to_b[at], same[at])
    pairs = materialize(pair_counts(links), "token-pairs")
    for r in pairs.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("n")).toLocalIterator():
        best[r["b"]] = max(best[r["b"]], r["n"])
    frequent = pairs.orderBy(F.desc("n"), "pair").limit(HEAD).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast((same, to_b, best, frequent["pair"].to_numpy(), frequent["n"].to_numpy()))
    types = dict(links.dtypes)
    passed = ["uid", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    ddl = ", ".join(f"{c} {types[c]}" for c in passed) + ", n_best long, count_sum long, odd array<long>, odd_n array<int>"

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, to_b, best, names, times = sent.value
        for batch in batches:
            rows = batch.num_rows
            known = np.zeros((2, rows), np.int64)

            def add(of, n, count, top, known=known):
                np.add.at(known[0], of, n * (count == top))
                np.add.at(known[1], of, n * count)

            ids, n, of = _flat(batch, "same", "same_n")
            add(of, n, same[ids], best[to_b[ids]])
            odd, n, of = _flat(batch, "odd", "odd_n")
            at = lookup(names, odd)
            hit = at >= 0
            add(of[hit], n[hit], times[at[hit]], best[odd[hit] & 0xFFFFFFFF])
            bounds = np.append(0, np.cumsum(np.bincount(of[~hit], minlength=rows)[:rows])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in passed], pa.array(known[0]), pa.array(known[1]),
                 pa.ListArray.from_arrays(pa.array(bounds), pa.array(odd[~hit])), pa.ListArray.from_arrays(pa.array(bounds), pa.array(n[~hit].astype(np.int32)))],
                [*passed, "n_best", "count_sum", "odd", "odd_n"])

    rated = materialize(links.mapInArrow(rate, ddl), "token-rates")
    top = spark.createDataFrame(pa.table({"b": np.flatnonzero(best), "top": best[np.flatnonzero(best)]}))
    rare = pairs.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("is_best"))
    left = rated.select("uid", F.explode(F.arrays_zip(F.col("odd").alias("pair"), F.col("odd_n").alias("times"))).alias("x")).select("uid", "x.*")
    more = left.join(rare, "pair").groupBy("uid").agg(F.sum(F.col("times") * F.col("is_best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    whole = rated.join(more, "uid", "left")
    plus = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return whole.select("row", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")


def _flat(batch: pa.RecordBatch, values: str, times: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, their numbers and owning rows of two list columns."""
    lists = batch.column(values)
    of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    return lists.flatten().to_numpy(), batch.column(times).flatten().to_numpy().astype(np.int64), of
