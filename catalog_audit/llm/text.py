"""Words of whole texts, taken from Arrow columns with numpy.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Texts are worked on in slices of a few
megabytes, so memory follows the slice (or the longest single text), never the partition.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from tempfile import mkdtemp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors when the launcher did not (once per application)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    sc = spark.sparkContext
    if root in known or (sc.master.startswith("local[") and os.getcwd() == root) or getattr(sc, "_llm_shipped", False):
        return spark
    path = os.path.join(mkdtemp(prefix="llm-"), "catalog_audit_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(os.path.join(root, "catalog_audit")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._llm_shipped = True
    return spark


def small_batches(df: DataFrame) -> SparkSession:
    """Send texts to the workers a thousand at a time: a batch, its copies and its results are held together there."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    small_batches(df)
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of consecutive texts: ``docs[i]:docs[i+1]`` are those of text i."""

    data: np.ndarray   # the bytes
    bounds: np.ndarray  # byte bounds of the texts
    start: np.ndarray  # byte bounds of each word
    end: np.ndarray
    docs: np.ndarray   # word bounds of each text

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.docs)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over its bytes, mixed with its length."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, U64)
        sums = np.zeros(n + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * _power(_BASE, n), out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * _power(_INVERSE, n)[self.start]
        return mix(h ^ (self.end - self.start).astype(U64) * U64(0xD6E8FEB86659FD93))


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, bounds) of consecutive texts of about ``limit`` bytes, ``rows`` at most; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, values = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n, i + rows)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> Words:
    """The words of the texts in one slice; ``lower`` folds A-Z only."""
    if lower:
        data = data + (((data >= 65) & (data <= 90)) * 32).astype(np.uint8)
    n = len(data)
    solid = ~is_space(data)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    start = np.flatnonzero(solid & (~before | first[:n]))
    end = np.flatnonzero(solid & (~after | first[1:])) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds))


def windows(h: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every k-word window that lies inside one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for j in range(1, k):
        out = mix(out + U64(j * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) ^ h[j:j + n] * U64(0xE7037ED1A0B428DB)
    out = mix(out + U64(k))
    owner = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
    at = np.flatnonzero(owner[:n] == owner[k - 1:])
    return out[at], at


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all k-word shingles; a text of fewer words gives its whole sequence as one."""
    h = w.hashes()
    out, at = windows(h, w.docs, k)
    owner = w.owner
    of = owner[at]
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.empty(len(short), U64)
        for i, d in enumerate(short):
            part = h[w.docs[d]:w.docs[d + 1]]
            extra[i] = windows(part, np.array([0, len(part)]), len(part))[0][0] ^ U64(0x5851F42D4C957F2D)
        out, of = np.concatenate([out, extra]), np.concatenate([of, short])
    return out, of


def distinct(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text) pairs ordered by text, then hash, and how often each occurs."""
    if not len(h):
        return h, of, np.zeros(0, np.int64)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return h[at], of[at], np.diff(np.append(at, len(h)))
