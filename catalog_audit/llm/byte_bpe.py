"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

The merges of a ranks file are compiled on demand into a deterministic transducer over bytes. Its state is the input
since the last settled cut, together with the token before that cut. Reading a byte finds the one token that ends the
encoding of the longer prefix: the longest vocabulary entry ending there that forms a stable pair with the token before
it (a pair is stable when merging its bytes alone gives the pair back). Cuts that no later token can reach are settled:
when all open cuts share a past, the tokens of that past are emitted, so output lags input by a bounded
look-ahead. States and transitions are made when first met and dropped together when too many are held, so memory is
bounded; pieces already encoded are remembered in two generations, of which the older is dropped.

Decoding joins the tokens' bytes and passes them through an incremental UTF-8 machine that carries at most three
bytes between chunks and turns malformed sequences into U+FFFD.

Edge cases: null counts as empty and gives no ids; special-token strings are ordinary text; a piece that is itself
an entry is that entry; a text of one endless piece costs time in proportion to its length; an id outside the vocabulary
is an error; rows are independent, so repeats, order and other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: States with their transitions, and remembered pieces, held per Python worker before a fresh start.
MAX_TRANSITIONS = 800_000
MAX_PIECES = 450_000
START = 7  # first bytes of a piece that are followed in one step once they are known
BLOCK = 4096  # ids decoded at a time
RANKS = "byte_bpe_50k.tiktoken"
_WIDE_SPACE = re.compile(r" \s").search
_MARKS = ",.;:!?"  # each one piece of its own before a space or the end


class Transducer:
    """Bytes of one piece in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], share: int = 1):
        self.ranks, self.share = ranks, share
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        # entries that their own merges do not reach never occur in an encoding
        # (those that come down to two parts are reached: the last merge is the entry itself)
        self.halves = {t: tuple(h) for t in ranks if len(t) > 1 and len(h := self._merged(t)) == 2}
        self.entries = {t for t in ranks if len(t) == 1 or t in self.halves}
        self.prefixes = {t[:n] for t in self.entries for n in range(1, len(t))}
        self.bytes = [bytes((b,)) for b in range(256)]
        self.none = max(ranks.values(), default=0) + 2
        self.any = b""  # stands for a token before the cut that no later pair can touch
        self._restart()

    def _restart(self) -> None:
        first = (None, b"")
        self.ids: dict[tuple, int] = {first: 0}
        self.states: list[tuple] = [first]
        self.tails: list[tuple] = [((0,), 0)]  # per state the lengths of the tokens that end in its past, and where an entry may have begun
        self.shapes: dict[tuple, tuple] = {}
        self.ends: list[tuple[int, ...] | None] = [()]  # what a piece that ends in the state still emits
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.starts: dict[bytes, tuple[int, list[int]]] = {}  # where the first bytes of a piece lead, and what they emit
        self.pairs.clear()

    def _merged(self, word: bytes) -> list[bytes]:
        """The merges of one entry, down to two parts: the lowest rank first, then the leftmost."""
        parts = [word[i:i + 1] for i in range(len(word))]
        ranks = self.ranks
        while len(parts) > 2:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stable(self, left: bytes, right: bytes) -> bool:
        """Whether no merge crosses the cut between two entries before both are complete.

        The merges of both sides are undone at the cut, the later one first. The two parts that then touch
        would have merged instead if their union ranks below the merges undone so far.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        ranks, halves, a, b = self.ranks, self.halves, left, right
        bound = self.none  # the cut's own merge must come before this rank to win (ties: the left one wins)
        while True:
            joint = ranks.get(a + b)
            if joint is not None and joint < bound:
                known = False
                break
            ra = ranks[a] if len(a) > 1 else -1
            rb = ranks[b] if len(b) > 1 else -1
            if ra < 0 and rb < 0:
                known = True
                break
            if ra > rb:
                bound, a = ra, halves[a][1]
            else:
                bound, b = rb + 1, halves[b][0]
        self.pairs[(left, right)] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, past = self.states[state]
        lengths, since = self.tails[state]
        text = past + self.bytes[byte]
        n = len(text)
        entries, prefixes = self.entries, self.prefixes
        # what ends here, or begins an entry here, began one a byte ago (``since`` on) or begins now
        for at in range(since, n):
            token = text[at:]
            if token in entries:
                left = before if at == 0 else text[at - lengths[at]:at]
                if left is None or self._stable(left, token):
                    break
        lengths += (n - at,)
        # a later token can start no earlier than the longest suffix that begins some entry
        first = n
        for at in range(since, n):
            if text[at:] in prefixes:
                first = at
                break
        settled = n
        for cut in range(n - 1, first - 1, -1):
            while cut != settled:  # the last cut that both pasts share
                if cut > settled:
                    cut -= lengths[cut]
                else:
                    settled -= lengths[settled]
        if settled == 0:
            out, key = (), (before, text)
        else:
            out = self._back(text, lengths, settled)
            key = (text[settled - lengths[settled]:settled] if first == settled else None, text[settled:])
            lengths = (0, *[k if k < i else i for i, k in enumerate(lengths[settled + 1:], 1)])
            if key[0] is None:
                key = (self.any, key[1])
        known = self.ids.get(key)
        if known is None:
            known = self.ids[key] = len(self.states)
            self.states.append(key)
            tail = (lengths, first - settled)
            self.tails.append(self.shapes.setdefault(tail, tail))  # few shapes, many states
            self.ends.append(None)
        move = self.moves[state << 8 | byte] = (known, out)
        return move

    def _back(self, text: bytes, lengths: tuple[int, ...], end: int) -> tuple[int, ...]:
        out = []
        while end > 0:
            out.append(self.ranks[text[end - lengths[end]:end]])
            end -= lengths[end]
        return tuple(reversed(out))

    def _follow(self, state: int, some: bytes, out: list[int]) -> tuple[int, list[int]]:
        moves = self.moves
        for byte in some:
            move = moves.get(state << 8 | byte) or self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        return state, out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.moves) + len(self.starts) > MAX_TRANSITIONS // self.share:
            self._restart()
        # outputs of one prefix are the same for every piece that begins with it
        head = piece[:START]
        start = self.starts.get(head)
        if start is None:
            start = self.starts[head] = self._follow(0, head, [])
        state, out = self._follow(start[0], piece[START:], start[1].copy())
        end = self.ends[state]
        if end is None:
            text, lengths = self.states[state][1], self.tails[state][0]
            end = self.ends[state] = self._back(text, lengths, len(text))
        out += end
        return out


class Utf8Machine:
    """Incremental UTF-8: text of all complete characters so far; an unfinished one (three bytes at most) is carried."""

    def __init__(self):
        self.tail = b""

    def feed(self, data: bytes) -> str:
        data = self.tail + data
        cut = len(data)
        for back in range(1, min(4, len(data) + 1)):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                need = 2 if lead >= 0xC2 and lead < 0xE0 else 3 if lead >= 0xE0 and lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
                if need > back:
                    cut = len(data) - back
                break
        self.tail = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.tail = self.tail, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """A ranks file with its transducer and the memory of pieces; each holds one ``share``-th of its usual entries."""

    def __init__(self, content: bytes, pattern: str, share: int = 1):
        import regex
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        self.transducer, self.share = Transducer(ranks, share), share
        self.entries = dict((r, t) for t, r in ranks.items())
        self.pieces = regex.compile(pattern).findall
        self.plain = pattern == public_tokenizers.PATTERN
        self.known: dict[str, bytes] = {}
        # runs met since the last change of generation, and those met in the one before
        self.known_runs: dict[str, bytes] = {}
        self.older_runs: dict[str, bytes] = {}
        self._marks = {m: self._packed(m) for m in _MARKS}
        # up to here Python and the pattern call the same characters letters
        letter = regex.compile(r"\p{L}").match
        self.beyond = next((c for c in map(chr, range(0x3000)) if c.isalpha() != bool(letter(c))), "\u3000")

    def _packed(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _is_word(self, run: str) -> bool:
        return run.isalpha() and (run.isascii() or max(run) < self.beyond)

    def _run(self, run: str) -> bytes:
        """A space and a run of non-spaces; letters alone are one piece, and a mark after them is another."""
        known = self.known_runs
        packed = known.get(run)
        if packed is not None:
            return packed
        packed = self.older_runs.get(run)
        if packed is not None:
            known[run] = packed
            return packed
        if self._is_word(run):
            packed = self._packed(" " + run)
        elif run[-1:] in self._marks and self._is_word(run[:-1]):
            return self._run(run[:-1]) + self._marks[run[-1]]
        else:
            packed = self._pieces(" " + run)
        if len(packed) <= 256:
            known[run] = packed
        return packed

    def _pieces(self, text: str) -> bytes:
        known, out = self.known, []
        if len(known) > MAX_PIECES // self.share:
            known.clear()
        for piece in self.pieces(text):
            packed = known.get(piece)
            if packed is None:
                packed = self._packed(piece)
                if len(packed) <= 256:
                    known[piece] = packed
            out.append(packed)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        Under the usual pattern a piece always begins at a space that stands before a non-space, so the runs between such
        spaces are independent and may be remembered whole; other patterns and odd spacing take the general way.
        """
        if not self.plain or text.endswith(" ") or _WIDE_SPACE(text):
            return self._pieces(text)
        known = self.known_runs
        if len(known) > MAX_PIECES // self.share // 2:
            self.older_runs, self.known_runs = known, {}
            known = self.known_runs
        first, *runs = text.split(" ")
        out = list(map(known.get, runs))
        if None in out:
            out = [self._run(run) if packed is None else packed for run, packed in zip(runs, out)]
        return self._pieces(first) + b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_stream(self, ids: Iterable[int], block: int = 1) -> Iterator[str]:
        """Text as the ids arrive, ``block`` at a time."""
        machine = Utf8Machine()
        for some in batched(ids, block):
            yield machine.feed(b"".join(map(self.entries.__getitem__, some)))
        yield machine.close()

    def decoded(self, ids: bytes) -> bytes:
        """The streamed text in UTF-8."""
        return b"".join(t.encode() for t in self.decode_stream(np.frombuffer(ids, "<u4").tolist(), BLOCK))


_codecs: dict[str, Codec] = {}


def _codec(content: bytes, pattern: str, share: int = 1) -> Codec:
    key = hashlib.sha256(content + f"{share} {pattern}".encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(content, pattern, share)
    return _codecs[key]


class ByteBpe:
    """Column functions of one ranks file. The file is read once and sent to the workers (under 1 MB for 50,000 entries).

    A worker that also holds what other stages left there remembers one ``share``-th of what it otherwise would.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, pattern: str = public_tokenizers.PATTERN, share: int = 1):
        with open(path or public_tokenizers.path(RANKS), "rb") as f:
            content = spark.sparkContext.broadcast(f.read())

        @F.arrow_udf("struct<ids: binary, decoded: binary>")
        def both(texts: pa.Array) -> pa.Array:
            codec = _codec(content.value, pattern, share)
            ids = [codec.encode(t or "") for t in texts.to_pylist()]
            return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(codec.decoded, ids), pa.binary())], ["ids", "decoded"])

        @F.arrow_udf("binary")
        def encode(texts: pa.Array) -> pa.Array:
            codec = _codec(content.value, pattern, share)
            return pa.array([codec.encode(t or "") for t in texts.to_pylist()], pa.binary())

        @F.arrow_udf("string")
        def decode(ids: pa.Array) -> pa.Array:
            codec = _codec(content.value, pattern, share)
            return pa.array(["".join(codec.decode_stream(np.frombuffer(x or b"", "<u4").tolist())) for x in ids.to_pylist()], pa.string())

        self._both, self._encode, self._decode = both, encode, decode

    def encode(self, text: Column) -> Column:
        """Packed ids (little-endian unsigned 32-bit) of a text column."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """Text of packed ids."""
        return self._decode(ids)

    def round_trip(self, text: Column) -> Column:
        """(ids, decoded): packed ids and the UTF-8 of the text that streams from them."""
        return self._both(text)
