"""Reproducible shuffle into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.llm.common import mixed, numbered

ROUNDS = 4


class Feistel:
    """Permutation of 0..n-1: balanced Feistel rounds on an even number of bits, walked until below n.

    The domain is under 4n, so a walk takes less than four steps on average; it always ends, because
    the start lies on the same cycle and is below n.
    """

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        steps = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.keys = mixed(steps + np.uint64(seed % (1 << 64)))

    def _pass(self, x: np.ndarray, keys) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for key in keys:
            left, right = right, left ^ (mixed(right + key) & mask)
        return (left << bits) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(x.astype(np.uint64))
        todo = np.flatnonzero(out >= np.uint64(self.n))
        while len(todo):
            out[todo] = step(out[todo])
            todo = todo[out[todo] >= np.uint64(self.n)]
        return out.astype(np.int64)

    def position(self, row: np.ndarray) -> np.ndarray:
        """Place in the shuffle of each row number."""
        return self._walk(np.asarray(row), lambda x: self._pass(x, self.keys))

    def row(self, position: np.ndarray) -> np.ndarray:
        """Row number at each place of the shuffle."""
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)

        def swapped(x):
            return ((x & mask) << bits) | (x >> bits)

        return self._walk(np.asarray(position), lambda x: swapped(self._pass(swapped(x), self.keys[::-1])))


def place(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of one global row number, without touching data."""
    at = int(Feistel(n, seed).position(np.array([row]))[0])
    return at % shards, at // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """Global row number found at a slot of a shard."""
    return int(Feistel(n, seed).row(np.array([slot * shards + shard]))[0])


def shard_rows(df: DataFrame, shards: int, *order: str, seed: int = 0) -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot``; shard counts differ by one at most.

    Rows are numbered in the given order, nulls first. Position p of the shuffle goes to shard
    ``p % shards`` at slot ``p // shards``. Rows that agree in all order columns share a set of places
    in no fixed order; an empty frame stays empty. Columns of these three names are replaced.
    """
    rows, n = numbered(df.drop("row_number", "shard", "slot"), *order)
    feistel = Feistel(n, seed)

    @F.pandas_udf("long")
    def position(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(feistel.position(batch.to_numpy()))

    placed = rows.withColumn("_p", position("row_number"))
    return placed.withColumns({"shard": (F.col("_p") % shards).cast("int"), "slot": F.floor(F.col("_p") / shards)}).drop("_p")
