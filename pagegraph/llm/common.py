"""Helpers the operators share: global numbering, running sums, connected components, word keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.session import checkpointed

#: low bits of ``monotonically_increasing_id`` that count rows inside a partition
_ROW_BITS = 33


#: bytes of rows that reach a Python worker at once
ARROW_BYTES = 4 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same frame, for a session whose Arrow batches hold ``ARROW_BYTES`` at most.

    The usual bound on the rows of a batch lets long texts fill a worker; this one bounds bytes. A
    smaller bound of the session stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(name, "64m").lower().rstrip("b")
    number, unit = int(held.rstrip("kmgtp")), 1 << (10 * (" kmgtp".find(held[-1:]) if held[-1:].isalpha() else 0))
    if number <= 0 or number * unit > ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return df


def ordered(df: DataFrame, *order: str | Column) -> DataFrame:
    """Globally sorted frame in the shared checkpoint folder; equal keys may span partitions."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*cols, "_tie").sortWithinPartitions(*cols, "_tie")
    return checkpointed(ranged.drop("_tie"))


def _offsets(df: DataFrame, totals: list) -> DataFrame:
    """``totals``: one (partition, amount) row per partition of a sorted frame."""
    before, rows = 0, []
    for part, amount in sorted((r[0], r[1]) for r in totals):
        rows.append((part, before))
        before += amount
    return F.broadcast(df.sparkSession.createDataFrame(rows or [(0, 0)], "_part long, _before long"))


def numbered(df: DataFrame, *order: str | Column, name: str = "row_number") -> tuple[DataFrame, int]:
    """Dense global row numbers from 0 in the given order, and their count.

    Rows are range-partitioned and sorted; a number is the rows of earlier partitions plus the place
    in the own one. Only one count per partition reaches the driver.
    """
    placed = ordered(df, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    totals = placed.groupBy("_part").count().collect()
    place = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    out = placed.join(_offsets(df, totals), "_part").withColumn(name, F.col("_before") + place)
    return out.drop("_at", "_part", "_before"), sum(r[1] for r in totals)


def running_sum(df: DataFrame, value: str, *order: str | Column, name: str = "before") -> DataFrame:
    """Sum of ``value`` (long, not null) over all rows that come earlier in the global order.

    Sums inside a partition are carried from batch to batch; one total per partition reaches the driver.
    """
    placed = ordered(df, *order).withColumn("_part", F.spark_partition_id().cast("long"))
    totals = placed.groupBy("_part").agg(F.sum(value)).collect()
    joined = placed.join(_offsets(df, totals), "_part")
    schema = joined.drop("_part", "_before").withColumn(name, F.lit(0).cast("long")).schema
    names = schema.names

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            start = batch.column(batch.schema.get_field_index("_before")).to_numpy(zero_copy_only=False)
            ends = total + np.cumsum(own)
            cols = {n: batch.column(batch.schema.get_field_index(n)) for n in names if n != name}
            cols[name] = pa.array(start + ends - own, pa.int64())
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return joined.mapInArrow(carry, schema)


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each id by undirected edges ``(a long, b long)``: ``id, component``.

    Alternates large-star and small-star steps; every step is a partial minimum per id and a join that
    adaptive execution can split. Lineage is cut in the shared checkpoint folder after each round.
    """
    pairs = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct()
        pairs = checkpointed(small)
        seen = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if seen == mark:
            break
        mark = seen
    roots = pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


class Forest:
    """Union-find over 0..n-1 with the smaller index as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class WordKeys(dict):
    """64-bit key of a word, kept for words met before; emptied when it grows past ``most``."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        key = self[word] = xxhash.xxh3_64_intdigest(word)
        return key

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator on unsigned 64-bit values (fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_keys(words: np.ndarray, n: int) -> np.ndarray:
    """Key of every run of ``n`` consecutive word keys."""
    last = len(words) - n + 1
    if last <= 0:
        return np.zeros(0, np.uint64)
    key = np.zeros(last, np.uint64)
    for i in range(n):
        key = mixed(key + np.uint64(0x9E3779B97F4A7C15)) + words[i : i + last]
    return mixed(key)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``lower`` turns A-Z into a-z and nothing else."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def text_key(text: Column) -> Column:
    """Key that tells rows of one document id apart."""
    return F.xxhash64(text)


def order_id(column: Column) -> Column:
    """Ids as long with null last."""
    return F.coalesce(column.cast("long"), F.lit((1 << 63) - 1))
