"""N-gram Jaccard join by signature trees.

1. *Parts.* A text is its set of distinct k-word shingles. Two sets linked at the threshold differ in few members, and in no
   more than a bound that follows from their sizes. Every size class cuts the space of shingle hashes into one part more than
   that bound, so linked sets agree on at least one whole part. A set sends one key per part of its own size class and of
   the next one; sets that share a key are tied by a star. No linked pair is lost, and the classes that arise are the roots
   of the trees.
2. *Signature trees.* Inside a class the sets are ordered by size and least member and packed into leaves, the leaves into
   nodes. A set's signature is a bitmap of its members; a node holds the OR of the bitmaps below it, the range of sizes, and the
   largest number of members that share a bit with another one of their set.
3. *Dual traversal.* Pairs of nodes are opened from the root. Two sets below a pair share at most as many members as
   the two bitmaps have common bits, and those that may hide behind one bit; where that, or the sizes, cannot reach the
   threshold, the whole pair of nodes is dropped. So is a pair whose sets all hang together already. Pairs of sets
   left in a pair of leaves are bounded by their own bitmaps in the same way, then counted exactly on full sets.
4. Classes beyond ``BLOCK_SETS`` or ``BLOCK_SHINGLES`` are cut by size, then by hash, into blocks, trees of their own that also hold
   pivots of the class, which tie dense groups together. Blocks whose sizes can meet are then traversed against each other on
   narrow signatures, for sets not yet tied; pairs that stay possible are confirmed on full sets.

Components of the links are what is returned, so no more links are found than they need.

Edge cases: a text without words has an empty set and is alone; one with fewer than k words has its whole sequence as its one
shingle; equal sets are one vertex of the trees; equal ids are one vertex; rows with a null id are never linked; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_audit.llm.components import components
from catalog_audit.llm.text import U64, distinct, mix, shingles, slices, small_batches, words
from catalog_audit.session import materialize, tune

LEAF = 16
FANOUT = 4
BITS_PER_MEMBER = 4
MOST_BITS = 1 << 17
#: One tree: its hashes, and its signatures even beside the longest set, stay within a few hundred megabytes.
BLOCK_SETS = 8192
BLOCK_SHINGLES = 4_000_000
PIVOTS = 16


def size_classes(most: int, share: int) -> np.ndarray:
    """First sizes of the classes up to beyond ``most``: a set and its linked partner lie in the same class or in adjacent ones."""
    firsts = [1, 2]
    while firsts[-1] <= most:
        firsts.append(max(firsts[-1] + 1, (firsts[-1] - 1) * 100 // share + 1))
    firsts.append(max(firsts[-1] + 1, (firsts[-1] - 1) * 100 // share + 1))
    return np.array(firsts)


def part_counts(firsts: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts, spare) of each class. Linked sets below the next class differ in at most ``parts - 1 - spare`` members, so they
    agree on more than ``spare`` parts; a set with no more empty parts than that needs no keys for them."""
    differing = 2 * (firsts[1:] - 1) * (100 - share) // (100 + share)
    spare = np.where(differing > 0, 1 + differing // 64, 0)
    return differing + 1 + spare, spare


def part_keys(h: np.ndarray, of: np.ndarray, size: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) of every part of every set: a hash of class, part and the members that fall into it."""
    firsts = size_classes(int(size.max(initial=1)), share)
    parts, spare = part_counts(firsts, share)
    own = np.searchsorted(firsts, size, "right") - 1
    spread = mix(h ^ U64(0x8EBC6AF09C88C6E3)) >> U64(32)
    keys, owners = [], []
    for step in (0, 1):
        group = np.where(size > 0, own + step, 0)
        count = np.where(size > 0, parts[group], 0)
        first = np.append(0, np.cumsum(count))
        where = first[:-1][of] + (spread * count[of].astype(U64) >> U64(32)).astype(np.int64)
        sums = np.zeros(first[-1], U64)
        np.add.at(sums, where, mix(h + U64(0xD1B54A32D192ED03)))
        empty = np.bincount(where, minlength=first[-1]) == 0
        owner = np.repeat(np.arange(len(size)), count)
        part = np.arange(first[-1]) - first[:-1][owner]
        many = np.bincount(owner[empty], minlength=len(size)) > spare[group]
        sent = ~empty | many[owner]
        keys.append(mix(sums ^ mix((group[owner].astype(U64) << U64(32)) + part.astype(U64) + U64(1)))[sent])
        owners.append(owner[sent])
    return np.concatenate(keys), np.concatenate(owners)


def vertices(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text, mark); a repeated id is told apart by the hash of its text."""
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))


def sets_of(docs: DataFrame, k: int, share: int, doc_id: str, text: str) -> DataFrame:
    """(id, mark, n_shingles, set_a, set_b, keys): a hash of the text, size, two sums that name the set, its part keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, bounds in slices(batch.column(1)):
                h, of, _ = distinct(*shingles(words(data, bounds, lower=True), k))
                n = j - i
                size = np.bincount(of, minlength=n)[:n]
                some = np.flatnonzero(size)
                names = np.zeros((2, n), U64)
                if len(h):
                    first = np.searchsorted(of, some)
                    names[0, some] = np.add.reduceat(mix(h), first)
                    names[1, some] = np.add.reduceat(mix(h ^ U64(0xA0761D6478BD642F)), first)
                keys, owner = part_keys(h, of, size, share)
                order = np.argsort(owner, kind="stable")
                bounds_of = np.append(0, np.cumsum(np.bincount(owner, minlength=n)[:n])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds_of), pa.array(keys[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, n), batch.column(2).slice(i, n), pa.array(size.astype(np.int64)), *[pa.array(x.view(np.int64)) for x in names], lists],
                    ["id", "mark", "n_shingles", "set_a", "set_b", "keys"])

    small_batches(docs)
    return vertices(docs, doc_id, text).mapInArrow(run, "id long, mark long, n_shingles long, set_a long, set_b long, keys array<long>")


def candidate_classes(sets: DataFrame) -> DataFrame:
    """(id, root): sets that share a part, directly or through others."""
    rows = sets.select("id", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.max("id").alias("most"), F.min("id").alias("least")).where("least < most").select("key", "least")
    return components(rows.join(shared, "key").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct())


def _bitmaps(h: np.ndarray, of: np.ndarray, n: int, bits: int) -> np.ndarray:
    """One row of ``bits`` bits per set; widths are powers of two, so a map folds to a narrower one."""
    maps = np.zeros((n, bits // 8), np.uint8)
    at = (mix(h ^ U64(0x2545F4914F6CDD1D)) % U64(bits)).astype(np.int64)
    np.bitwise_or.at(maps.reshape(-1), of * (bits // 8) + (at & (bits // 8 - 1)), (1 << (at // (bits // 8))).astype(np.uint8))
    return maps


class Tree:
    """Signature tree over sets given as sorted members ``h`` of each ``of``, in any order."""

    def __init__(self, h: np.ndarray, of: np.ndarray, n: int, bits: int):
        bounds = np.searchsorted(of, np.arange(n + 1))
        self.sets = [h[bounds[i]:bounds[i + 1]] for i in range(n)]
        least = np.array([s[0] if len(s) else U64(0) for s in self.sets], U64)
        self._build(np.diff(bounds), _bitmaps(h, of, n, bits), np.lexsort((least, np.diff(bounds))))

    @classmethod
    def of_signatures(cls, size: np.ndarray, maps: np.ndarray) -> Tree:
        """A tree over signatures alone."""
        tree = cls.__new__(cls)
        tree.sets = None
        tree._build(size, maps, np.argsort(size, kind="stable"))
        return tree

    def _build(self, size: np.ndarray, maps: np.ndarray, order: np.ndarray) -> None:
        self.order = order
        maps = np.ascontiguousarray(maps[order])
        pad = -maps.shape[1] % 8
        self.maps = (np.pad(maps, ((0, 0), (0, pad))) if pad else maps).view(np.uint64)
        self.size = size[order].astype(np.int64)
        self.hidden = self.size - np.bitwise_count(self.maps).sum(1).astype(np.int64)
        n, width = len(order), LEAF
        self.levels = []
        maps, low, high, hidden = self.maps, self.size, self.size, self.hidden
        step = LEAF
        while True:
            cut = np.arange(0, len(maps), step)
            maps = np.bitwise_or.reduceat(maps, cut, axis=0)
            low, high, hidden = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(hidden, cut)
            self.levels.append((maps, low, high, hidden, width))
            if len(maps) == 1:
                break
            step, width = FANOUT, width * FANOUT


def needed(x, y, share: int):
    """Least common members of linked sets of sizes x and y."""
    return -(-share * (x + y) // (100 + share))


def traverse(left: Tree, right: Tree, share: int, label_left: np.ndarray, label_right: np.ndarray, meet) -> None:
    """Call ``meet(i, j)`` for the pairs of sets (positions in tree order) that may be linked; labels are read as they change.

    ``right`` may be ``left``; then each pair is met once.
    """
    same = left is right
    top = max(len(left.levels), len(right.levels)) - 1
    stack = [(min(top, len(left.levels) - 1), 0, min(top, len(right.levels) - 1), 0)]
    while stack:
        a, p, b, q = stack.pop()
        maps_p, low_p, high_p, hidden_p, width_p = left.levels[a]
        maps_q, low_q, high_q, hidden_q, width_q = right.levels[b]
        if 100 * high_p[p] < share * low_q[q] or 100 * high_q[q] < share * low_p[p]:
            continue
        own, other = slice(p * width_p, (p + 1) * width_p), slice(q * width_q, (q + 1) * width_q)
        first = label_left[own][0]
        if (label_left[own] == first).all() and (label_right[other] == first).all():
            continue
        common = int(np.bitwise_count(maps_p[p] & maps_q[q]).sum())
        if min(common + min(hidden_p[p], hidden_q[q]), high_p[p], high_q[q]) < needed(low_p[p], low_q[q], share):
            continue
        if a or b:
            down_p = [(a, p)] if a < b or not a else [(a - 1, c) for c in range(p * FANOUT, min((p + 1) * FANOUT, len(left.levels[a - 1][0])))]
            down_q = [(b, q)] if b < a or not b else [(b - 1, c) for c in range(q * FANOUT, min((q + 1) * FANOUT, len(right.levels[b - 1][0])))]
            pairs = [(*x, *y) for x in down_p for y in down_q if not same or x[1] <= y[1]]
            pairs.sort(key=lambda x: abs(x[1] - x[3]), reverse=True)  # nodes near each other are opened first
            stack += pairs
            continue
        x, y = left.maps[own], right.maps[other]
        shared = np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(2).astype(np.int64)
        size_x, size_y = left.size[own][:, None], right.size[other][None, :]
        most = np.minimum(shared + np.minimum(left.hidden[own][:, None], right.hidden[other][None, :]), np.minimum(size_x, size_y))
        for i, j in np.argwhere(most >= needed(size_x, size_y, share)):
            i, j = i + own.start, j + other.start
            if (not same or i < j) and label_left[i] != label_right[j]:
                meet(i, j)


def joined(x: np.ndarray, y: np.ndarray, share: int) -> bool:
    """Whether two sets of sorted members are linked, counted exactly."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[at] == x).sum())
    return 100 * common >= share * (len(x) + len(y) - common)


def width_of(size: int) -> int:
    """Bits of a signature: a power of two of at least ``BITS_PER_MEMBER`` times the size, within bounds."""
    return min(MOST_BITS, max(256, 1 << int(size * BITS_PER_MEMBER - 1).bit_length()))


def _members(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    hs, ofs = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for i, _, data, bounds in slices(texts):
        h, of, _ = distinct(*shingles(words(data, bounds, lower=True), k))
        hs.append(h)
        ofs.append(of + i)
    return np.concatenate(hs), np.concatenate(ofs)


def _stars(ids: np.ndarray, tree: Tree, share: int) -> tuple[np.ndarray, np.ndarray]:
    """What the links of one tree hold together, as a star from the least id of each part: later rounds over the edges stay few."""
    label = np.arange(len(ids))

    def meet(i: int, j: int) -> None:
        if joined(tree.sets[tree.order[i]], tree.sets[tree.order[j]], share):
            label[label == label[j]] = label[i]

    traverse(tree, tree, share, label, label, meet)
    own = ids[tree.order]
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, own)
    moved = own != least[label]
    return least[label][moved], own[moved]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one key of the first column after the other."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if held and keys[i] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = keys[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def tree_links(blocks: DataFrame, k: int, share: int) -> DataFrame:
    """(key, id, mark, text) -> (a, b): edges that connect what is linked inside each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            ids = rows.column(1).to_numpy()
            left = right = np.zeros(0, np.int64)
            if len(ids) > 1:
                h, of = _members(rows.column(2).combine_chunks(), k)
                most = int(np.bincount(of, minlength=1).max())
                left, right = _stars(ids, Tree(h, of, len(ids), width_of(most)), share)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    dealt = blocks.repartition("key").sortWithinPartitions("key", "id", "mark")
    return dealt.select("key", "id", "text").mapInArrow(run, "a long, b long")


def signatures(texts: DataFrame, k: int) -> DataFrame:
    """``texts`` with ``map``, its signature, in place of ``text``; the width follows the size of the set."""
    types = dict(texts.dtypes)
    passed = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for i, j, data, bounds in slices(batch.column("text")):
                h, of, _ = distinct(*shingles(words(data, bounds, lower=True), k))
                edge = np.searchsorted(of, np.arange(j - i + 1))
                for d in range(j - i):
                    members = h[edge[d]:edge[d + 1]]
                    maps.append(_bitmaps(members, np.zeros(len(members), np.int64), 1, width_of(len(members))).tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], pa.array(maps, pa.binary())], [*passed, "map"])

    return texts.select(*passed, "text").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in passed) + ", map binary")


def _alike(maps: list[bytes]) -> np.ndarray:
    """Signatures folded to the least width among them: a bit of the narrow map is the OR of those that fall on it."""
    least = min(map(len, maps))
    out = np.empty((len(maps), least), np.uint8)
    for i, m in enumerate(maps):
        out[i] = np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, least), axis=0)
    return out


def possible_pairs(sides: DataFrame, share: int) -> DataFrame:
    """(key, side, id, part, n_shingles, map, mark) -> (a, mark_a, b, mark_b): pairs of side 0 and side 1 of a key that hang together in no part and may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            side, ids, part, size, marks = (rows.column(c).to_numpy() for c in (1, 2, 3, 4, 6))
            maps = _alike(rows.column(5).to_pylist())
            at = [np.flatnonzero(side == s) for s in (0, 1)]
            left, right = [], []
            if len(at[0]) and len(at[1]):
                x, y = (Tree.of_signatures(size[p], maps[p]) for p in at)
                own, other = at[0][x.order], at[1][y.order]

                def meet(i, j, own=own, other=other, left=left, right=right):
                    left.append(own[i])
                    right.append(other[j])

                traverse(x, y, share, part[own], part[other], meet)
            columns = [x[np.array(at, np.int64)] for at in (left, right) for x in (ids, marks)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "mark_a", "b", "mark_b"])

    dealt = sides.repartition("key").sortWithinPartitions("key", "side", "id", "mark")
    return dealt.select("key", "side", "id", "part", "n_shingles", "map", "mark").mapInArrow(run, "a long, mark_a long, b long, mark_b long")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, share: int) -> DataFrame:
    """The pairs that are linked, counted on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _members(batch.column(2), k), _members(batch.column(3), k)
            n = batch.num_rows
            bx, by = (np.searchsorted(v[1], np.arange(n + 1)) for v in (x, y))
            good = [joined(x[0][bx[i]:bx[i + 1]], y[0][by[i]:by[i + 1]], share) for i in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, two = (texts.select(F.col("id").alias(c), F.col("mark").alias(f"mark_{c}"), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(one, ["a", "mark_a"]).join(two, ["b", "mark_b"]).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def large_class_links(big: DataFrame, k: int, share: int) -> DataFrame:
    """Links of classes cut into blocks by size, then by hash: (root, id, mark, n_shingles, text) -> (a, b)."""
    band = F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(100.0 / share))).cast("long")
    big = big.withColumn("band", band)
    widths = big.groupBy("root", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    widths = materialize(widths, "block-widths")
    cut = big.join(widths, ["root", "band"]).withColumn("block", F.pmod(F.xxhash64("id", "mark"), F.col("blocks")))
    cut = materialize(cut, "blocks")
    drawn = [F.min(F.struct(F.xxhash64(F.lit(i), F.col("id"), F.col("mark")).alias("h"), "id", "mark")).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = (cut.groupBy("root", "band").agg(*drawn).select("root", F.explode(F.array_distinct(F.array(*[F.struct(f"p{i}.id", f"p{i}.mark") for i in range(PIVOTS)]))).alias("p"))
              .select("root", "p.*").join(cut.select("root", "id", "mark", "text", F.col("band").alias("at")), ["root", "id", "mark"]))
    near = pivots.join(widths, "root").where("abs(band - at) <= 1")
    key = F.xxhash64("root", "band", "block").alias("key")
    spread = near.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(key, "id", "mark", "text")
    own = cut.select(key, "id", "mark", "text").unionByName(spread).dropDuplicates(["key", "id", "mark"])
    inside = materialize(tree_links(own, k, share), "block-links")
    parts = components(inside).select("id", F.col("root").alias("part"))
    narrow = signatures(cut.select("root", "band", "block", "id", "mark", "n_shingles", "text"), k)
    narrow = materialize(narrow.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")), "signatures")
    main = narrow.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    narrow = narrow.join(main, "root").withColumn("place", F.struct("band", "block"))
    # sets outside the main part meet every other block whose sizes they can meet
    ranges = narrow.groupBy("root", "place").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    rest = narrow.where("part <> main").groupBy("root", "place").agg(F.min("n_shingles").alias("rest_low"), F.max("n_shingles").alias("rest_high"))
    met = (rest.withColumnRenamed("place", "from").join(ranges.withColumnRenamed("place", "to"), "root")
           .where(f"from <> to AND 100 * high >= {share} * rest_low AND 100 * rest_high >= {share} * low").select("root", "from", "to"))
    met = materialize(met, "block-pairs")
    key = F.xxhash64("root", "from", "to").alias("key")
    asked = narrow.where("part <> main").withColumnRenamed("place", "from").join(met, ["root", "from"]).withColumn("side", F.lit(0))
    held = narrow.withColumnRenamed("place", "to").join(met, ["root", "to"]).withColumn("side", F.lit(1))
    columns = [key, "side", "id", "part", "n_shingles", "map", "mark"]
    pairs = possible_pairs(asked.select(*columns).unionByName(held.select(*columns)), share)
    names = ["a", "mark_a", "b", "mark_b"]
    pairs = materialize(pairs.select(*names).distinct(), "possible-pairs")
    return inside.unionByName(confirmed(pairs, cut.select("id", "mark", "text"), k, share))


def jaccard_components(docs: DataFrame, k: int = 3, threshold: float = 0.9, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row; ``component_id`` is the smallest id reachable over links."""
    tune(docs.sparkSession)
    share = round(100 * threshold)
    drawn = materialize(sets_of(docs, k, share, doc_id, text), "shingle-sets")
    linkable = drawn.where("n_shingles > 0 AND id IS NOT NULL")
    name = ["n_shingles", "set_a", "set_b"]
    firsts = linkable.groupBy(*name).agg(F.min(F.struct("id", "mark")).alias("first"), F.any_value("keys").alias("keys"))
    firsts = materialize(firsts.select("first.*", *name, "keys"), "distinct-sets")
    same = linkable.join(firsts.select(F.col("id").alias("a"), *name), name).where("id <> a").select("a", F.col("id").alias("b"))
    sized = candidate_classes(firsts).join(firsts.select("id", "mark", "n_shingles"), "id")
    totals = sized.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n_shingles").alias("total"))
    placed = sized.join(totals, "root").withColumn("large", F.expr(f"sets > {BLOCK_SETS} OR total > {BLOCK_SHINGLES}")).select("root", "id", "mark", "n_shingles", "large")
    held = materialize(placed.join(vertices(docs, doc_id, text), ["id", "mark"]).dropDuplicates(["id", "mark"]), "class-texts")
    links = tree_links(held.where("NOT large").select(F.col("root").alias("key"), "id", "mark", "text"), k, share)
    big = held.where("large").drop("large")
    if not big.isEmpty():
        links = links.unionByName(large_class_links(big, k, share))
    parts = components(links.unionByName(same))
    return drawn.join(parts, "id", "left").select("id", "n_shingles", F.coalesce("root", "id").alias("component_id"))
