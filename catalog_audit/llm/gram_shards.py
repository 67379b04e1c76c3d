"""Exploded n-grams on their way to count tables, packed by hash shard.

One row per gram would cost more in row headers than in grams. A document therefore sends one row to each shard, holding
the grams that hash there; the row is exploded on the other side of the exchange, next to the shard's counts. A
gram's shard depends on its hash alone, and the number of shards follows the number of tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

TOKENS_PER_SHARD = 4_000_000
LEAST_SHARDS = 32
SCHEMA = "shard int, doc_id long, n_words long, known double, {}"


def shard_count(tokens: int) -> int:
    return max(LEAST_SHARDS, -(-tokens // TOKENS_PER_SHARD))


def packed(ids: pa.Array, n_words: np.ndarray, known: np.ndarray, shards: int,
           streams: list[tuple[str, pa.DataType, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows (shard, doc_id, n_words, known, one list per stream).

    A stream is (name, type, values, owning text, shard). Each text has a row for shard 0 that carries ``n_words``
    and ``known``, its part of the result that needed no exchange.
    """
    n = len(n_words)
    base = np.arange(n, dtype=np.int64) * shards
    cells = np.unique(np.concatenate([base, *[of * shards + shard for _, _, _, of, shard in streams]]))
    text, shard = cells // shards, (cells % shards).astype(np.int32)
    lists, names = [], []
    for name, kind, values, of, where in streams:
        key = of * shards + where
        order = np.argsort(key, kind="stable")
        bounds = np.append(np.searchsorted(key[order], cells), len(order)).astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values[order], kind)))
        names.append(name)
    first = shard == 0
    return pa.RecordBatch.from_arrays(
        [pa.array(shard), ids.take(pa.array(text)), pa.array(np.where(first, n_words[text], 0).astype(np.int64)),
         pa.array(np.where(first, known[text], 0.0)), *lists], ["shard", "doc_id", "n_words", "known", *names])


def lookup(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of ``wanted`` in ``sorted_keys``, -1 where absent."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, at, -1)
