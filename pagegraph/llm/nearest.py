"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched with a beam."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: distinct vectors of a shard; queries that visit a shard together
SHARD, QUERIES = 8192, 4096
#: out-edges kept by pruning, and room for edges that others add before a node is pruned again
DEGREE, ROOM = 32, 48
#: how much nearer than the node an edge's end must be to make another edge needless
RELAX = 1.2
#: nodes a search holds, when building and when asked; nodes a step expands
BUILD_BEAM, BEAM, WIDTH = 64, 128, 4
#: nodes a search starts from: the middle of the shard and others spread over it
STARTS = 32
#: nodes inserted together, nearest candidates pruning looks at, queries that step together
TOGETHER, CANDIDATES, LOCKSTEP = 256, 112, 256

INDEX = "dim int, shard int, place int, v array<double>, ids array<long>, edges array<int>"


def usable(vector: Column) -> Column:
    """True for vectors that are not null, empty or zero and hold no null and no non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unlike_before(rows: np.ndarray, ids: np.ndarray, seen: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """Mask of the ids (one line per row) not seen by their row yet, equal ones of a line once; -1 is none."""
    fresh = (ids >= 0) & ~seen[rows[:, None], ids]
    slot = np.broadcast_to(np.arange(ids.shape[1], dtype=stamp.dtype), ids.shape)
    stamp[rows[:, None], ids] = slot
    return fresh & (stamp[rows[:, None], ids] == slot)


class ProximityGraph:
    """Out-edges of the points of one shard, built by insertion in batches."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, room: int = ROOM, relax: float = RELAX):
        self.points = np.ascontiguousarray(points, np.float64)
        self.squares = np.einsum("nd,nd->n", self.points, self.points)
        self.degree, self.room, self.relax = degree, max(room, degree), relax
        self.edges = np.full((len(points), self.room), -1, np.int32)
        self.fill = np.zeros(len(points), np.int64)
        self.starts = np.arange(min(STARTS, len(points)))

    def _far(self, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Squared distance, up to the query's own square, of a line of ids to each query.

        In double precision: near copies of one vector differ in digits that single precision loses.
        """
        return self.squares[ids] - 2 * np.einsum("nkd,nd->nk", self.points[ids], queries)

    def search(self, queries: np.ndarray, beam: int, visited: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Places of the nearest points met by a greedy search with ``beam`` held, -1 where there are fewer.

        A search starts from several points: from one only, a dense group around it whose edges all stay
        inside would fill the beam.
        All queries go in lockstep. A step expands the ``WIDTH`` nearest held points not yet expanded; a
        query ends once all it holds are expanded. With ``visited`` the expanded ones come along.
        """
        count, n = len(queries), len(self.points)
        queries = np.ascontiguousarray(queries, np.float64)
        held = np.full((count, beam), -1, np.int32)
        far = np.full((count, beam), np.inf)
        done = np.ones((count, beam), bool)
        seen = np.zeros((count, n + 1), bool)
        stamp = np.zeros((count, n + 1), np.int16)
        first = len(self.starts)
        held[:, :first], done[:, :first] = self.starts, False
        far[:, :first] = self._far(np.repeat(self.starts[None], count, axis=0), queries)
        seen[:, self.starts] = True
        trail = []
        live = np.arange(count)
        width = min(WIDTH, beam)
        while len(live):
            open_far = np.where(done[live], np.inf, far[live])
            pick = np.argpartition(open_far, width - 1, axis=1)[:, :width]
            real = np.take_along_axis(open_far, pick, axis=1) < np.inf
            some = real.any(axis=1)
            live, pick, real = live[some], pick[some], real[some]
            if not len(live):
                break
            nodes = np.where(real, held[live[:, None], pick], -1)
            done[live[:, None], pick] = True
            if visited:
                step = np.full((count, width), -1, np.int32)
                step[live] = nodes
                trail.append(step)
            ids = np.where(real[:, :, None], self.edges[nodes], -1).reshape(len(live), -1)
            fresh = _unlike_before(live, ids, seen, stamp)
            seen[live[:, None], np.where(fresh, ids, n)] = True
            # lines are closed up, so that distances are worked out for new points only
            most = max(1, int(fresh.sum(axis=1).max()))
            first = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
            ids, fresh = np.take_along_axis(ids, first, axis=1), np.take_along_axis(fresh, first, axis=1)
            new = np.where(fresh, self._far(np.where(fresh, ids, 0), queries[live]), np.inf)
            both = np.concatenate([far[live], new], axis=1)
            best = np.argpartition(both, beam - 1, axis=1)[:, :beam]
            far[live] = np.take_along_axis(both, best, axis=1)
            held[live] = np.take_along_axis(np.concatenate([held[live], ids], axis=1), best, axis=1)
            closed = np.concatenate([done[live], ~fresh], axis=1)
            done[live] = np.take_along_axis(closed, best, axis=1)
        held[np.isinf(far)] = -1
        return held, np.concatenate(trail, axis=1) if trail else None

    def prune(self, nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Diverse out-edges of each node among its candidates: ``degree`` places at most, -1 behind them.

        The nearest candidate is kept; every other that lies nearer to it, by the factor ``relax``, than
        to the node is left out; then the nearest of what remains, and so on.
        """
        own = self.points[nodes]
        ids = np.where(ids == nodes[:, None], -1, ids)
        ordered = np.sort(ids, axis=1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        there = ordered >= 0
        far = np.where(there, self._far(np.where(there, ordered, 0), own) + np.einsum("nd,nd->n", own, own)[:, None], np.inf)
        cut = min(CANDIDATES, ids.shape[1])
        near = np.argsort(far, axis=1, kind="stable")[:, :cut]
        ids, far = np.take_along_axis(ordered, near, axis=1), np.take_along_axis(far, near, axis=1)
        places = np.maximum(ids, 0)
        others = self.points[places]
        between = self.squares[places][:, :, None] + self.squares[places][:, None, :] - 2 * others @ others.transpose(0, 2, 1)
        able = np.isfinite(far)
        out = np.full((len(nodes), self.degree), -1, np.int32)
        lines = np.arange(len(nodes))
        for k in range(self.degree):
            some = able.any(axis=1)
            if not some.any():
                break
            pick = able.argmax(axis=1)
            out[some, k] = ids[some, pick[some]]
            able &= ~(some[:, None] & (self.relax**2 * between[lines, pick] <= far))
            able[lines, pick] = False
        return out

    def insert(self, nodes: np.ndarray) -> None:
        """Search for the nodes, prune what was found, and add the edges back."""
        found, trail = self.search(self.points[nodes], BUILD_BEAM, visited=True)
        held = self.edges[nodes]
        edges = self.prune(nodes, np.concatenate([found, trail, held], axis=1))
        self.edges[nodes] = -1
        self.edges[nodes, : self.degree] = edges
        self.fill[nodes] = (edges >= 0).sum(axis=1)
        source = np.repeat(nodes.astype(np.int32), edges.shape[1])
        target = edges.ravel()
        there = target >= 0
        self._add(source[there], target[there])

    def _add(self, source: np.ndarray, target: np.ndarray) -> None:
        """Edges from ``target`` back to ``source``; nodes without room for all of theirs are pruned."""
        known = (self.edges[target] == source[:, None]).any(axis=1)
        source, target = source[~known], target[~known]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, first, counts = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, counts)
        fits = np.repeat(self.fill[heads] + counts <= self.room, counts)
        self.edges[target[fits], self.fill[target[fits]] + rank[fits]] = source[fits]
        tight = self.fill[heads] + counts > self.room
        self.fill[heads[~tight]] += counts[~tight]
        for at in range(0, int(tight.sum()), TOGETHER):
            some = np.flatnonzero(tight)[at : at + TOGETHER]
            more = np.full((len(some), int(counts[some].max())), -1, np.int32)
            for line, k in enumerate(some.tolist()):
                more[line, : counts[k]] = source[first[k] : first[k] + counts[k]]
            nodes = heads[some]
            edges = self.prune(nodes, np.concatenate([self.edges[nodes], more], axis=1))
            self.edges[nodes] = -1
            self.edges[nodes, : self.degree] = edges
            self.fill[nodes] = (edges >= 0).sum(axis=1)

    def build(self) -> ProximityGraph:
        """Insert all points in their order, in batches that double; the first ones once more at the end."""
        n, at = len(self.points), 1
        whole, order = self.starts, np.arange(n)
        while at < n:
            size = min(TOGETHER, at, n - at)
            self.starts = whole[whole < at]
            self.insert(order[at : at + size])
            at += size
        self.starts = whole
        for again in range(0, min(n, 4 * TOGETHER), TOGETHER):
            self.insert(order[again : again + TOGETHER])
        return self


def _points(values: pa.ChunkedArray) -> np.ndarray:
    column = values.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def largest(points: np.ndarray) -> float:
    """Greatest size of a component; divided by it, squares neither overflow nor vanish."""
    return max(float(np.abs(points).max(initial=0)), 5e-324)


def distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; large and small components are scaled before squaring."""
    apart = points - query
    most = np.abs(apart).max(initial=0)
    if 0 < most < 1e-140 or most > 1e140:
        return np.sqrt(((apart / most) ** 2).sum(axis=1)) * most
    return np.sqrt((apart * apart).sum(axis=1))


def _distinct(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """``vec_id, v, dim`` of the vectors that take part: one row per id, negative zeros as zeros."""
    value = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.where(usable(F.col(vector)) & F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("vec_id"), value.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def build_index(
    vectors: DataFrame,
    ident: str = "vec_id",
    vector: str = "embedding",
    keep: int = 11,
    shard: int = SHARD,
    degree: int = DEGREE,
    relax: float = RELAX,
) -> DataFrame:
    """A graph over all vectors: one row per distinct vector, ``dim, shard, place, v, ids, edges``.

    Rows with a null id and vectors that are null, empty, zero or hold null or non-finite components are
    not indexed; an id on several rows counts once, with its smallest vector in array order. Equal
    vectors are one node that names its ``keep`` smallest ids: more of them are in no result of
    ``keep - 1`` neighbours. Vectors of one length are dealt by hash into shards of about ``shard``
    nodes; a shard is one task, so memory is bounded whatever the table, and every vector is in a graph.
    ``edges`` are places in the same shard; its first ``STARTS`` places are where a search starts.
    """
    rows = _distinct(vectors, ident, vector)
    first = Window.partitionBy("dim", "v").orderBy("vec_id")
    few = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= keep)
    nodes = few.groupBy("dim", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = nodes.join(sizes, "dim").select("dim", F.expr("cast(pmod(xxhash64(v), shards) as int)").alias("shard"), "v", "ids")

    def graph(table: pa.Table) -> pa.Table:
        # the order of insertion follows the smallest id, mixed, so that runs give the same graph; the
        # vector nearest to the middle comes first
        head = np.array([c[0].as_py() for c in table["ids"]], np.int64)
        table = table.take(np.argsort(head * np.int64(-7046029254386353131), kind="stable"))
        given = _points(table["v"])
        points = given / largest(given)
        order = np.arange(len(points))
        middle = int(distances(points, points.mean(axis=0)).argmin())
        order[: middle + 1] = np.roll(order[: middle + 1], 1)
        found = ProximityGraph(points[order], degree, max(ROOM, degree), relax).build()
        edges = pa.array([line[line >= 0] for line in found.edges], pa.list_(pa.int32()))
        table = table.take(order)
        cols = [table["dim"], table["shard"], pa.array(np.arange(len(order), dtype=np.int32))]
        cols += [table["v"].cast(pa.list_(pa.float64())), table["ids"].cast(pa.list_(pa.int64())), edges]
        return pa.table(cols, names=["dim", "shard", "place", "v", "ids", "edges"])

    # a task per shard, about: building costs far more than the shard's bytes suggest
    shards = sizes.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]
    return dealt.repartition(max(1, shards), "dim", "shard").groupBy("dim", "shard").applyInArrow(graph, INDEX)


def search_index(
    index: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding", beam: int = BEAM, group: int = QUERIES
) -> DataFrame:
    """The nearest indexed vectors found for every query: ``query_id, rank, vec_id, score``.

    ``score`` is the Euclidean distance in double precision, ties go to the smaller id, a query is not
    its own neighbour; with fewer than ``k`` others all are returned. Every query visits every shard
    of its vector length; a task holds a shard and ``group`` queries and passes on k rows a query. The
    index must keep more than ``k`` ids of equal vectors. Queries that take no part give no rows.
    """
    held = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    asked = _distinct(queries, ident, vector)
    sizes = asked.groupBy("dim").agg(F.ceil(F.count("*") / group).cast("int").alias("groups")).join(held, "dim")
    nodes = index.join(sizes.select("dim", "groups"), "dim").withColumn("q", F.explode(F.expr("sequence(0, groups - 1)")))
    # new column instances: both sides may come from the same table
    visits = asked.join(sizes, "dim").select(
        F.col("dim").alias("own_dim"), F.expr("cast(pmod(xxhash64(vec_id), groups) as int)").alias("own_q"),
        F.explode(F.expr("sequence(0, shards - 1)")).alias("own_shard"), F.col("vec_id").alias("query_id"), F.col("v").alias("query"),
    )
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left = left.sort_by("place")
        given = _points(left["v"])
        scale = largest(given)
        found = ProximityGraph(given / scale)
        edges = left["edges"].combine_chunks()
        lengths = np.asarray(edges.value_lengths())
        found.edges = np.full((len(given), max(1, int(lengths.max()))), -1, np.int32)
        found.edges[np.arange(found.edges.shape[1])[None, :] < lengths[:, None]] = np.asarray(edges.flatten())
        ids = left["ids"].to_pylist()
        own = right["query_id"].to_numpy()
        wanted = _points(right["query"])
        rows: list[tuple[int, int, float]] = []
        for at in range(0, len(own), LOCKSTEP):
            # squares of queries far outside the shard's range would overflow
            asked = np.clip(wanted[at : at + LOCKSTEP] / scale, -1e15, 1e15)
            near, _ = found.search(asked, beam)
            for q, line in zip(range(at, at + len(near)), near, strict=True):
                places = line[line >= 0]
                apart = distances(given[places], wanted[q])
                best = sorted((float(d), i) for d, p in zip(apart, places.tolist(), strict=True) for i in ids[p] if i != own[q])[:k]
                rows += [(int(own[q]), i, d) for d, i in best]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    left = nodes.groupBy("dim", "shard", "q")
    near = left.cogroup(visits.groupBy("own_dim", "own_shard", "own_q")).applyInArrow(visit, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranks = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranks.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
