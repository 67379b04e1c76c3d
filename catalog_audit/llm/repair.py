"""Conversation structure repair by a Viterbi search whose survivors coalesce.

A conversation's rows, in order, are edited so that their roles read: an optional system turn, then user and assistant in
turn. A state of the search is what the repaired conversation ends with so far (nothing, system, user, assistant); each
row is kept, given another role, or deleted, and empty turns may be inserted anywhere.

Survivors live in a backpointer tree with reference counts: a branch that no survivor refers to is freed, a node left with
one child is merged with it, and as soon as all survivors descend from one node the edits up to it are final and are
emitted, together with the rows they edit. So what is held is the part that is still open, never the
conversation. Equal costs are told apart by the complete edit strings: both branches are walked up to their last common
node and compared below it. A survivor that another can replace at lower cost by one insertion and one deletion can
never win and is dropped, which makes survivors meet early.

Rows are partitioned by conversation and sorted by turn once; repeats are found by a window inside that partitioning. A
conversation is one ordered stream through one task, since the digest of its repaired rows runs over them in
order, but it is streamed from a sort that spills, with bounded memory.

Edge cases: a null role or text counts as one space and a null turn comes first and is left out of gaps; a null id is one
conversation of its own; rows of equal turn are ordered by role, then text; an empty role has no initial and is never
legal; a conversation without rows gives zeros, an empty audit and the digest of nothing; repeated rows are duplicates;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_audit.llm.text import small_batches

WHITE = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


@dataclass(frozen=True)
class Costs:
    """Price of each edit; ``truncated`` is added for a truncated row that is not deleted."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class _Node:
    """A run of edits below ``parent``; ``refs`` counts its children and the survivors that end in it."""

    __slots__ = ("letters", "parent", "refs")

    def __init__(self, parent: _Node | None, letters: bytearray):
        self.parent, self.letters, self.refs = parent, letters, 0
        if parent is not None:
            parent.refs += 1


class Viterbi:
    """Least-cost edits of one conversation: ``step`` for each row, ``finish`` at its end; both return the edits now final."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        self.root = _Node(None, bytearray())
        self.root.refs = 1
        self.alive: dict[int, tuple[int, _Node]] = {START: (0, self.root)}

    def _branch(self, node: _Node) -> list[_Node]:
        """The nodes from below the root down to ``node``; nodes with one reference are merged with their child on the way."""
        way = []
        while node is not self.root:
            above = node.parent
            while above is not self.root and above.refs == 1:
                above.letters += node.letters
                node.letters, node.parent, above = above.letters, above.parent, above.parent
            way.append(node)
            node = above
        way.reverse()
        return way

    def _before(self, a: tuple[_Node, bytes], b: tuple[_Node, bytes]) -> bool:
        """Whether the edit string of ``a`` (a node, then letters) is less than that of ``b``: the open suffixes are compared whole."""
        left, right = self._branch(a[0]), self._branch(b[0])
        k = 0
        while k < min(len(left), len(right)) and left[k] is right[k]:
            k += 1
        return b"".join([*[bytes(n.letters) for n in left[k:]], a[1]]) < b"".join([*[bytes(n.letters) for n in right[k:]], b[1]])

    def _offer(self, best: dict, state: int, cost: int, node: _Node, letters: bytes) -> None:
        held = best.get(state)
        if held is None or cost < held[0] or cost == held[0] and self._before((node, letters), held[1:]):
            best[state] = (cost, node, letters)

    def _inserted(self, best: dict) -> None:
        """Add what insertions reach: a user turn after anything else, an assistant turn after a user."""
        for _ in range(2):
            for state, (cost, node, letters) in list(best.items()):
                self._offer(best, ASSISTANT if state == USER else USER, cost + self.costs.insert, node, letters + b"I")

    def step(self, initial: str, must_delete: bool, truncated: bool) -> bytes:
        c = self.costs
        ready = {q: (cost, node, b"") for q, (cost, node) in self.alive.items()}
        self._inserted(ready)
        best: dict[int, tuple[int, _Node, bytes]] = {}
        stay = c.truncated * truncated
        for q, (cost, node, letters) in ready.items():
            self._offer(best, q, cost + c.delete, node, letters + b"D")
            if must_delete:
                continue
            following = ASSISTANT if q == USER else USER
            self._offer(best, following, cost + c.rerole + stay, node, letters + b"R")
            if initial == "s" and q == START:
                self._offer(best, SYSTEM, cost + c.keep + stay, node, letters + b"K")
            elif initial == ("a" if q == USER else "u"):
                self._offer(best, following, cost + c.keep + stay, node, letters + b"K")
        return self._settle(best)

    def finish(self) -> tuple[int, bytes]:
        best = {q: (cost, node, b"") for q, (cost, node) in self.alive.items()}
        self._inserted(best)
        ends = {q: best[q] for q in (START, ASSISTANT) if q in best}
        one: dict[int, tuple[int, _Node, bytes]] = {}
        for cost, node, letters in ends.values():
            self._offer(one, START, cost, node, letters)
        cost, node, letters = one[START]
        return cost, b"".join(bytes(n.letters) for n in self._branch(node)) + letters

    def _settle(self, best: dict) -> bytes:
        bound = min((best[q][0] for q in (USER, ASSISTANT) if q in best), default=None)
        if bound is not None:
            bound += self.costs.insert + self.costs.delete
            best = {q: v for q, v in best.items() if v[0] <= bound}
        old = self.alive
        self.alive = {}
        for q, (cost, node, letters) in best.items():
            self.alive[q] = (cost, self._grow(node, letters))
        for _, node in old.values():
            self._release(node)
        return self._emit()

    def _grow(self, node: _Node, letters: bytes) -> _Node:
        made = _Node(node, bytearray(letters))
        made.refs = 1
        return made

    def _release(self, node: _Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs:
                return
            node = node.parent

    def _emit(self) -> bytes:
        """Edits above the node from which all survivors descend."""
        out = bytearray()
        some = next(iter(self.alive.values()))[1]
        while self.root.refs == 1 and some is not self.root:
            way = self._branch(some)
            first = way[0]
            out += first.letters
            self.root = first
            first.parent, first.letters = None, bytearray()
        return bytes(out)


class _Conversation:
    """Counts, search and repaired rows of one conversation, row by row."""

    def __init__(self, costs: Costs):
        self.search = Viterbi(costs)
        self.open: deque = deque()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.first = self.last = None
        self.turns = 0
        self.before: str | None = None
        self.state = START

    def add(self, turn: int | None, role: str, text: str, repeated: bool, end: str) -> bytes:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        initial = role[:1]
        if self.before is not None:
            self.counts["illegal"] += (self.before, initial) not in _LEGAL
        self.before = initial
        fault = "blank" if not end else "duplicate" if repeated else "truncated" if end not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        self.open.append((turn, role, text))
        return self.search.step(initial, fault in ("blank", "duplicate"), fault == "truncated")

    @property
    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0

    def apply(self, edits: bytes) -> Iterator[tuple[str, int | None, str | None, str | None]]:
        """(edit, turn, role, text) of settled edits; role and text are null for a deleted row."""
        for edit in edits.decode():
            turn, role, text = (None, "", "") if edit == "I" else self.open.popleft()
            if edit == "D":
                yield edit, turn, None, None
                continue
            if edit in "IR":
                role = "assistant" if self.state == USER else "user"
            self.state = {"s": SYSTEM, "u": USER}.get(role[:1], ASSISTANT)
            yield edit, turn, role, text


def _stream(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[tuple]:
    """("edit", id, (edit, turn, role, text)) as they settle and ("end", id, conversation, cost) for sorted rows."""
    now, key = None, object()

    def close():
        cost, edits = now.search.finish()
        for e in now.apply(edits):
            yield "edit", key, e
        yield "end", key, now, cost

    for batch in batches:
        for conv, turn, times, role, text, repeated, end in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or conv != key:
                if now is not None:
                    yield from close()
                now, key = _Conversation(costs), conv
            for i in range(times):
                for e in now.apply(now.add(turn, role, text, repeated or i > 0, end)):
                    yield "edit", key, e
    if now is not None:
        yield from close()


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, times, role, text), ``times`` adjacent copies each, dealt by conversation, in order, with their faults."""
    small_batches(rows)
    own = Window.partitionBy("conv_id", F.xxhash64("role", "text"), "role", "text", F.col("times") > 0).orderBy(F.col("turn").asc_nulls_first())
    end = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    dealt = rows.repartition("conv_id").withColumn("repeated", F.row_number().over(own) > 1).withColumn("end", end)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return dealt.sortWithinPartitions(*order).select("conv_id", "turn", "times", "role", "text", "repeated", "end")


def as_rows(turns: DataFrame) -> DataFrame:
    """Any table of turns as the rows that the repair takes."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.lit(1).alias("times"), blank("role"), blank("text"))


def damage(turns: DataFrame) -> DataFrame:
    """Rows with reproducible faults planted by a checksum of ``conv_id:turn``: 0 drops a row (``times`` 0), 1 empties its text,
    2 removes its sentence ends, 3 repeats it, 4 makes it a user turn."""
    rows = as_rows(turns)
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    return rows.select("conv_id", "turn", F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"), F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(kind.isin(0, 1), "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"))


def repair_turns(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per edit in order: (conv_id, place, edit, turn, role, text). A deleted row has no role and text, an inserted one no turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        place = 0
        for what, key, value, *_ in _stream(batches, costs):
            if what == "end":
                place = 0
            else:
                held.append((key, place, *value))
                place += 1
            if len(held) >= 1000:
                yield _batch(held, turns_schema)
                held = []
        yield _batch(held, turns_schema)

    turns_schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return _ordered(rows).mapInArrow(run, "conv_id long, place long, edit string, turn long, role string, text string")


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*held) if held else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def repair_digests(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation: its faults, the least cost, the edits and the digest of the repaired rows."""
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        audit, digest, some = bytearray(), hashlib.sha256(), False
        for what, key, value, *cost in _stream(batches, costs):
            if what == "edit":
                edit, _, role, text = value
                audit += edit.encode()
                if role is not None:
                    digest.update(f"\n{role}:{text}".encode() if some else f"{role}:{text}".encode())
                    some = True
                continue
            held.append((key, value.gaps, *value.counts.values(), cost[0], audit.decode(), digest.hexdigest()))
            audit, digest, some = bytearray(), hashlib.sha256(), False
            if len(held) >= 1000:
                yield _batch(held, schema)
                held = []
        yield _batch(held, schema)

    ddl = "conv_id long, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string"
    return _ordered(rows).mapInArrow(run, ddl)
