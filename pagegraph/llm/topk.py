"""Exact top-k by inner product with sequential reads of sorted lists only (no random access)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: vectors of a candidate block, and queries that visit it together
BLOCK, QUERIES = 4096, 1024
#: part of each list read after each round
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 1.0)
#: a query stops early once at most this many candidates per wanted place can qualify
SLACK = 8


def usable(vector: Column) -> Column:
    """True for vectors without null and non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def scaled(vector: Column, factor: int = 256) -> Column:
    """Components as floor(factor * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long"))


def ranked(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, equal ones by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search_block(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """Top k of one block for every query: (query place, candidate place, exact score) triples.

    Each component has one list of the block's values in sorted order. A query reads a list from the
    end that its own component favours, one run of all lists a round. What was read is summed; the value
    at the reading place bounds unread ones from above, the far end of the list from below. Reading ends
    for a query when no more than k * SLACK candidates have an upper bound that reaches the k-th lower
    bound; those candidates' scores are then resolved exactly. After the last run bounds are scores.
    """
    count, width = values.shape
    top = float(np.abs(values).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(width, 1)
    kind = np.float32 if top < 2**23 else np.float64
    slack = 0.0 if top < 2**52 else top * 1e-12
    whole = np.int64 if top < 2**62 else object
    order = np.argsort(values, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(count)[:, None] + np.zeros((1, width), int), axis=0)
    lists = np.take_along_axis(values, order, axis=0).astype(kind)
    numbers = values.astype(kind)
    up, down = np.maximum(queries, 0).T.astype(kind), np.minimum(queries, 0).T.astype(kind)
    seen = np.zeros((count, len(queries)), kind)
    live = np.arange(len(queries))
    out, done = [], 0
    for part in DEPTHS:
        depth = max(done, min(count, int(np.ceil(part * count))))
        if depth == done and depth < count:
            continue
        plus, minus = up[:, live], down[:, live]
        run = (place >= count - depth) & (place < count - done)
        seen += np.where(run, numbers, 0) @ plus
        run = (place < depth) & (place >= done)
        seen += np.where(run, numbers, 0) @ minus
        if depth < count:
            unread_up, unread_down = (place < count - depth).astype(kind), (place >= depth).astype(kind)
            upper = seen + unread_up @ (plus * lists[count - depth][:, None]) + unread_down @ (minus * lists[depth - 1][:, None])
            lower = seen + unread_up @ (plus * lists[0][:, None]) + unread_down @ (minus * lists[-1][:, None])
        else:
            upper = lower = seen
        own = ids[:, None] == query_ids[live][None, :]
        lower, upper = np.where(own, -np.inf, lower), np.where(own, -np.inf, upper)
        wanted = min(k, count)
        floor = np.partition(lower, count - wanted, axis=0)[count - wanted]
        floor = np.where(np.isneginf(floor), np.finfo(kind).min, floor) - kind(slack)
        able = upper >= floor[None, :]
        stop = (able.sum(axis=0) <= k * SLACK) | (depth == count)
        for at in np.flatnonzero(stop):
            q, rows = live[at], np.flatnonzero(able[:, at])
            exact = values[rows].astype(whole) @ queries[q].astype(whole)
            for best in ranked(exact, ids[rows], k):
                out.append((q, rows[best], int(exact[best])))
        live, seen, done = live[~stop], seen[:, ~stop], depth
        if not len(live):
            break
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, group: int = QUERIES) -> DataFrame:
    """The k candidates of greatest inner product for every query: ``query_id, rank, vec_id, score``.

    Both frames have ``vec_id long`` and ``v array<long>`` (no nulls inside). A query is never its own
    candidate; equal scores go to the smaller id; with fewer candidates all are returned. Vectors of
    different lengths are not compared. Rows that repeat an id count once, with the smallest vector in
    array order; null ids take no part. Empty frames give an empty result. Candidates are dealt into
    blocks by a hash of their id; every group of queries visits every block, so a task holds one block
    and one group whatever the size of the tables, and passes on k rows per query.
    """

    def single(df):
        rows = df.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("v").alias("v"))
        return rows.withColumn("dim", F.size("v"))

    cand, query = single(candidates), single(queries)
    blocks = cand.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks"))
    groups = query.groupBy("dim").agg(F.ceil(F.count("*") / group).alias("groups"))
    sizes = blocks.join(groups, "dim")
    cand = cand.join(sizes, "dim").select(
        "dim", "vec_id", "v", F.expr("pmod(xxhash64(vec_id), blocks)").alias("c"), F.explode(F.expr("sequence(0, groups - 1)")).alias("q")
    )
    query = query.join(sizes, "dim").select(
        "dim", "vec_id", "v", F.expr("pmod(xxhash64(vec_id, 1), groups)").alias("q"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("c")
    )

    def matrix(table):
        ids = table.column("vec_id").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy()
        return ids, flat.reshape(len(ids), -1)

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, values = matrix(left)
        own, wanted = matrix(right)
        found = search_block(ids, values, own, wanted, k)
        cols = [own[[f[0] for f in found]], ids[[f[1] for f in found]], [f[2] for f in found]] if found else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], schema=schema)

    keys = ["dim", "c", "q"]
    near = cand.groupBy(*keys).cogroup(query.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranks = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranks.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
