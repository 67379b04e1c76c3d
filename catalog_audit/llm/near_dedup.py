"""Near duplicates: a chosen-path similarity join on word-shingle sets.

1. *Sketch.* Each text becomes its set of k-word shingles (64-bit hashes) and ``COORDINATES`` minwise tokens of the set.
   Texts with the same set (same size, same two 64-bit sums over it) collapse to one.
2. *Chosen paths.* ``TREES`` independent trees start with all texts at the root. At each level the path so far selects
   ``BRANCHES`` of the minwise coordinates; a text goes down one branch for each, named by its own token there. Two texts
   of similarity s stay together in a branch with probability s, so with two branches a pair at 0.8 survives any depth
   in one tree with probability 0.94 and in at least one of three with 0.9997. Nodes of one text end; nodes of at
   most ``SMALL`` texts are compared exhaustively; larger ones branch again. The depth follows the logarithm of the number
   of texts, which parts unlike texts; a node still large at the last level holds texts that agreed on every
   selected token, and its members become candidates of one another by a star, not by pairs.
3. *Candidates.* In small nodes the sketches' agreement decides: at or above the threshold less ``SLACK`` (over four
   standard errors) the texts are joined into a candidate class. Only a spanning forest per node is emitted.
4. *Verification.* A text lies in one candidate class, so its words move once. Inside a class all links are
   confirmed on full sets: an inverted list over shingles gives each text's exact intersections with all others. Classes
   beyond ``BLOCK_SHINGLES`` are cut into blocks; pivots present in every block tie the dense part together, and
   the texts still outside the main part are then matched against every block, exactly.
5. *Classes* are the connected components of confirmed links and of equal sets.

Edge cases: a text without words has an empty set and is alone; one with fewer than k words has its whole sequence as
its one shingle; equal ids are one vertex; rows with a null id are never linked and stay; an empty table gives an empty
result; other columns ride in ``row``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_audit.llm.components import components
from catalog_audit.llm.text import U64, distinct, mix, shingles, slices, small_batches, words
from catalog_audit.session import materialize, materialize_counted

COORDINATES = 128
TREES = 3
BRANCHES = 2
SMALL = 64
SHRINK = 10  # a level parts unlike texts (similarity up to a tenth) by at least this factor
SLACK = 0.15
BLOCK_SHINGLES = 4_000_000
BLOCK_TEXTS = 2048
PIVOTS = 16
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def sketch(docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(id, n_shingles, set_a, set_b, tokens, bits): set size, two sums that name the set, its minwise tokens, their low bytes."""
    schema = "id long, n_shingles long, set_a long, set_b long, tokens binary, bits binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, bounds in slices(batch.column(1)):
                h, of, _ = distinct(*shingles(words(data, bounds, lower=True), k))
                n = j - i
                size = np.bincount(of, minlength=n)[:n]
                some = np.flatnonzero(size)
                first = np.searchsorted(of, some)
                a, b = np.zeros(n, U64), np.zeros(n, U64)
                tokens = np.zeros((n, COORDINATES), np.uint32)
                if len(h):
                    a[some] = np.add.reduceat(mix(h), first)
                    b[some] = np.add.reduceat(mix(h ^ U64(0xA0761D6478BD642F)), first)
                    for c in range(COORDINATES):
                        seen = (h * (_SEEDS[c] | U64(1)) + _SEEDS[COORDINATES + c]) >> U64(32)
                        tokens[some, c] = np.minimum.reduceat(seen.astype(np.uint32), first)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, n), pa.array(size.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                    pa.array([t.tobytes() if s else None for t, s in zip(tokens, size)], pa.binary()),
                    pa.array([t.tobytes() if s else None for t, s in zip(tokens.astype(np.uint8), size)], pa.binary())],
                    ["id", "n_shingles", "set_a", "set_b", "tokens", "bits"])

    small_batches(docs)
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _branch(tokens: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The child nodes of (text, node) rows: one per selected coordinate."""
    out = np.empty((len(nodes), BRANCHES), U64)
    for b in range(BRANCHES):
        pick = mix(nodes + U64((b + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = (pick % U64(COORDINATES)).astype(np.int64)
        out[:, b] = mix(pick ^ mix(tokens[np.arange(len(nodes)), at].astype(U64) + U64(1)))
    return out


def _descend(frame: DataFrame, levels: int = 1) -> DataFrame:
    """(id, tokens, nodes) -> (id, node): every text one or more branchings further down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            lists = batch.column(2)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            nodes = lists.flatten().to_numpy().view(U64)
            for _ in range(levels):
                children = _branch(tokens[rows], nodes)
                rows, nodes = np.repeat(rows, BRANCHES), children.reshape(-1)
            ids = batch.column(0).to_numpy()[rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(nodes.view(np.int64))], ["id", "node"])

    return frame.select("id", "tokens", "nodes").mapInArrow(run, "id long, node long")


def _agreeing(members: DataFrame, cut: float) -> DataFrame:
    """(members: array of (id, bits) of a small node) -> spanning edges between texts whose sketches agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            lists = batch.column(0)
            off = lists.offsets.to_numpy()
            flat = lists.flatten()
            ids = flat.field("id").to_numpy()
            bits = np.frombuffer(b"".join(flat.field("bits").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            off = off - off[0]
            for i, j in zip(off[:-1], off[1:]):
                own = bits[i:j]
                alike = (own[:, None, :] == own[None, :, :]).sum(2) >= cut * COORDINATES
                if alike.sum() == j - i:
                    continue
                open_ = np.ones(j - i, bool)
                for first in range(j - i):  # breadth first from each text not yet reached
                    front = [first] if open_[first] else []
                    open_[first] = False
                    while front:
                        x = front.pop()
                        hit = np.flatnonzero(alike[x] & open_)
                        open_[hit] = False
                        front += hit.tolist()
                        left += [ids[i + x]] * len(hit)
                        right += ids[i + hit].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return members.mapInArrow(run, "a long, b long").distinct()


def candidate_edges(sets: DataFrame, texts: int, threshold: float) -> DataFrame:
    """Edges that tie together all candidate partners (not all pairs) among distinct sets."""
    cut = threshold - SLACK
    roots = mix(np.arange(1, TREES + 1, dtype=U64)).view(np.int64).tolist()
    alive = sets.select("id", "tokens", F.array(*[F.lit(r) for r in roots]).alias("nodes"))
    edges = None
    depth, step = 0, 2
    deepest = max(3, 1 + math.ceil(math.log(max(texts, SMALL) / SMALL) / math.log(SHRINK)))
    while True:
        rows = materialize(_descend(alive, step), "paths")
        depth, step = depth + step, 1
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")).where("size > 1")
        sized, seen = materialize_counted(rows.join(sizes, "node"), "nodes", large=F.sum((F.col("size") > SMALL).cast("long")))
        small = (sized.where(F.col("size") <= SMALL).join(sets.select("id", "bits"), "id")
                 .groupBy("node").agg(F.collect_list(F.struct("id", "bits")).alias("members")).select("members"))
        found = _agreeing(small, cut)
        large = sized.where(F.col("size") > SMALL)
        last = not seen["large"] or depth >= deepest
        if last:
            found = found.unionByName(large.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct())
        found = materialize(found, "candidates")
        edges = found if edges is None else edges.unionByName(found)
        if last:
            return edges.distinct()
        alive = large.groupBy("id").agg(F.collect_list("node").alias("nodes")).join(sets.select("id", "tokens"), "id")


def _confirm(blocks: DataFrame, k: int, share: int) -> DataFrame:
    """(key, id, side, root, text) in order of key -> confirmed edges (a spanning forest per key).

    side 0: matched with all of the key; side 1: matched with side 2 only, where roots differ.
    """

    def links(ids: list, sides: list, roots: list, texts: list) -> tuple[list, list]:
        column = pa.array(texts, pa.large_string())
        hs, ofs = [], []
        for i, _, data, bounds in slices(column):
            h, of, _ = distinct(*shingles(words(data, bounds, lower=True), k))
            hs.append(h)
            ofs.append(of + i)
        h, of = np.concatenate(hs), np.concatenate(ofs)
        n = len(ids)
        size = np.bincount(of, minlength=n)
        order = np.argsort(h, kind="stable")
        names, first, times = np.unique(h[order], return_index=True, return_counts=True)
        owners = of[order]
        at = np.searchsorted(names, h)
        bounds = np.searchsorted(of, np.arange(n + 1))
        side, root = np.array(sides), np.array(roots, dtype=np.int64)
        label = np.arange(n)
        left, right = [], []
        for d in range(n):
            if side[d] == 2:
                continue
            mine = at[bounds[d]:bounds[d + 1]]
            lengths = times[mine]
            starts = np.repeat(first[mine] - np.append(0, np.cumsum(lengths)[:-1]), lengths)
            shared = np.bincount(owners[starts + np.arange(lengths.sum())], minlength=n)
            near = 100 * shared >= share * (size[d] + size - shared)
            near &= (shared > 0) & (label != label[d])
            near &= (side == 2) & (root != root[d]) if side[d] == 1 else True
            for e in np.flatnonzero(near):
                if label[e] != label[d]:
                    left.append(ids[d])
                    right.append(ids[e])
                    label[label == label[e]] = label[d]
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        key = None

        def done():
            got = links(*held) if len(held[0]) > 1 else ([], [])
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["a", "b"])

        for batch in batches:
            for this, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if this != key and held[0]:
                    yield done()
                key = this
                for x, v in zip(held, row):
                    x.append(v)
        if held[0]:
            yield done()

    dealt = blocks.repartition("key").sortWithinPartitions("key", "id")
    return dealt.select("key", "id", "side", "root", "text").mapInArrow(run, "a long, b long")


def _cut(members: DataFrame, width: Column) -> DataFrame:
    return members.withColumn("block", F.pmod(F.xxhash64("id"), width).cast("long"))


def confirmed_edges(texts: DataFrame, classes: DataFrame, sizes: DataFrame, k: int, share: int) -> DataFrame:
    """Confirmed links of every candidate class: (id, text), (id, root), (id, n_shingles) -> (a, b)."""
    sized = classes.join(sizes, "id")
    totals = sized.groupBy("root").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_shingles").alias("total"))
    width = F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("total") / BLOCK_SHINGLES))
    placed = materialize(sized.select("id", "root").join(totals.select("root", width.alias("width")), "root"), "classes")
    words_of = materialize(placed.join(texts, "id"), "class-texts")
    whole = words_of.where("width = 1").select(F.col("root").alias("key"), "id", F.lit(0).alias("side"), F.col("root"), "text")
    found = _confirm(whole, k, share)
    big = words_of.where("width > 1")
    if big.isEmpty():
        return found
    # blocks with shared pivots
    drawn = [F.min(F.struct(F.xxhash64(F.lit(i), F.col("id")).alias("h"), "id")).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = (big.groupBy("root").agg(*drawn)
              .select("root", F.explode(F.array_distinct(F.array(*[F.col(f"p{i}.id") for i in range(PIVOTS)]))).alias("id")))
    own = _cut(big, F.col("width")).select(F.xxhash64("root", "block").alias("key"), "id", F.lit(0).alias("side"), "root", "text")
    spread = (big.join(pivots, ["root", "id"]).select("id", "root", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("block"))
              .select(F.xxhash64("root", "block").alias("key"), "id", F.lit(0).alias("side"), "root", "text"))
    inside = materialize(_confirm(own.unionByName(spread).dropDuplicates(["key", "id"]), k, share), "inside")
    # what is still outside a class's main part meets every block
    parts = components(inside)
    labelled = placed.where("width > 1").join(parts.withColumnRenamed("root", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    main = (labelled.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main")))
    labelled = materialize(labelled.join(main, "root"), "labelled")
    rest = labelled.where("part <> main")
    chunks = rest.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(1, BLOCK_TEXTS // 8))).cast("long").alias("chunks"))
    both = labelled.join(chunks, "root").join(big.select("id", "text"), "id")
    chunk, block = F.pmod(F.xxhash64(F.lit(7), F.col("id")), F.col("chunks")), F.pmod(F.xxhash64("id"), F.col("width").cast("long"))
    asked = both.where("part <> main").select("id", F.col("part").alias("root"), "text", F.col("root").alias("class"), chunk.alias("c"),
                                              F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") - 1)).alias("b"), F.lit(1).alias("side"))
    held = both.select("id", F.col("part").alias("root"), "text", F.col("root").alias("class"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), block.alias("b"), F.lit(2).alias("side"))
    across = asked.unionByName(held).select(F.xxhash64("class", "c", "b").alias("key"), "id", "side", "root", "text")
    return found.unionByName(inside).unionByName(_confirm(across, k, share))


def near_components(docs: DataFrame, k: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row; ``component_id`` is the smallest id reachable over links."""
    drawn = materialize(sketch(docs, k, doc_id, text), "sketches")
    linkable = drawn.where("n_shingles > 0 AND id IS NOT NULL")
    sets, seen = materialize_counted(linkable.groupBy("n_shingles", "set_a", "set_b").agg(F.min("id").alias("id"), F.any_value("tokens").alias("tokens"), F.any_value("bits").alias("bits")), "sets")
    same = linkable.join(sets.select("n_shingles", "set_a", "set_b", F.col("id").alias("a")), ["n_shingles", "set_a", "set_b"])
    same = same.where("id <> a").select("a", F.col("id").alias("b"))
    classes = components(candidate_edges(sets, seen["rows"], threshold))
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    links = confirmed_edges(texts, classes, sets.select("id", "n_shingles"), k, round(100 * threshold))
    parts = components(links.unionByName(same))
    return drawn.join(parts, "id", "left").select("id", "n_shingles", F.coalesce("root", "id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id; columns unchanged, rows with a null id stay."""
    gone = near_components(docs, k, threshold, doc_id, text).where("component_id <> id").select(F.col("id").alias("gone")).distinct()
    own = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"))
    return own.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
