"""Prefix trie of conversations; subtree totals by time-forward processing in reverse level order."""

from __future__ import annotations

import hashlib
import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.llm.common import mixed, ordered
from pagegraph.session import checkpointed

#: members up to which a subtree lies in one shard
LIGHT = 4096
#: copies of the rows that many others join, dealt over as many tasks
SALTS = 16
#: messages a queue holds in memory; those of a spilled run read at once
QUEUE, RUN_READ = 100_000, 4096
#: ids of a piece of a node's list of ends
PIECE = 8192

#: a node: its depth and the 128-bit key of its path
KEY = ["depth", "ka", "kb"]
TURNS = ["conv_id", "ord", "a", "b", "words"]
PATHS = "conv_id bigint, depth bigint, ka bigint, kb bigint, pa bigint, pb bigint, a bigint, b bigint, words bigint, last boolean"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, ord, a, b, words`` per row with an id: place in its conversation, two hashes of the turn.

    Places count from 1 by turn, null first; equal turns by the hashes of role and text. Null roles and
    texts are empty. Texts are read once and go no further.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
    )
    placed = ordered(rows.withColumn("ord", F.lit(0).cast("long")), "conv_id", F.col("turn").asc_nulls_first(), "a", "b")
    along = along_conversations(placed.select(*TURNS))
    return checkpointed(along.select("conv_id", F.col("depth").alias("ord"), "a", "b", "words"))


def _running(batch: pa.RecordBatch, state: tuple) -> tuple:
    """Conversation, place, path keys and the keys before them of the rows of a batch, and the next state.

    ``state``: the conversation of the row before the batch, its rows and keys so far.
    """
    conv, a, b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2, 3))
    heads = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    owner = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(conv))))
    goes_on = state[0] == conv[0]
    place = np.arange(len(conv)) - heads[owner] + 1 + np.where((owner == 0) & goes_on, state[1], 0)
    keys, before = [], []
    for k, hashes in enumerate((a, b)):
        own = mixed(hashes.view(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sums = np.cumsum(own, dtype=np.uint64)
        start = (sums - own)[heads]
        start[:1] -= np.array([state[2][k] if goes_on else 0], np.uint64)
        keys.append(sums - start[owner])
        before.append(keys[-1] - own)
    return conv, place, keys, before, (int(conv[-1]), int(place[-1]), [int(k[-1]) for k in keys])


def _carried(numbered: DataFrame) -> dict[int, tuple]:
    """Per partition: the state it starts with, and the first conversation of the next partition.

    Two passes bring a row per partition each to the driver: its first and last conversation with the
    rows it has of the last; then, where a conversation spans partitions, the keys of these rows.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rows, last, part = None, 0, None, None
        for batch in batches:
            if batch.num_rows:
                conv = batch.column(0).to_numpy(zero_copy_only=False)
                if first is None:
                    first, part = int(conv[0]), batch.column(5)[0].as_py()
                if last != int(conv[-1]):
                    rows, last = 0, int(conv[-1])
                rows += int((conv == last).sum())
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, first, last, rows)], names=["part", "first", "last", "rows"])

    told = sorted(tuple(r) for r in numbered.mapInArrow(ends, "part long, first long, last long, rows long").collect())
    places, held = {}, (None, 0)
    for part, first, last, rows in told:
        earlier = held[1] if held[0] == first else 0
        places[part] = (first, earlier, [0, 0])
        held = (last, rows + (earlier if first == last else 0))
    if any(earlier for _, earlier, _ in places.values()):
        shared = numbered.sparkSession.sparkContext.broadcast(places)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, part = None, None
            for batch in batches:
                if batch.num_rows:
                    if part is None:
                        part = batch.column(5)[0].as_py()
                        state = shared.value[part]
                    *_, state = _running(batch, state)
            if part is not None:
                keys = np.array(state[2], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (part, *keys)], names=["part", "a", "b"])

        so_far = {r[0]: np.array(r[1:], np.int64).view(np.uint64) for r in numbered.mapInArrow(sums, "part long, a long, b long").collect()}
        held, key = None, np.zeros(2, np.uint64)
        for part, first, last, _ in told:
            key = key if held == first else np.zeros(2, np.uint64)
            places[part] = (*places[part][:2], [int(k) for k in key])
            key = so_far[part] + key if first == last else so_far[part]
            held = last
    following = [*(t[1] for t in told[1:]), None]
    return {t[0]: (places[t[0]], after) for t, after in zip(told, following, strict=False)}


def along_conversations(rows: DataFrame) -> DataFrame:
    """Places and path keys along the conversations of a frame that is sorted over all its partitions.

    Takes the columns of ``TURNS``, gives those of ``PATHS``. A path key is the sum, modulo 2**64, of a
    hash of every turn mixed with its place. A conversation may span any number of partitions.
    """
    numbered = rows.withColumn("part", F.spark_partition_id().cast("long"))
    shared = rows.sparkSession.sparkContext.broadcast(_carried(numbered))
    names = [f.split()[0] for f in PATHS.split(", ")]

    def given(batch: pa.RecordBatch, conv, place, keys, before, following) -> pa.RecordBatch:
        last = np.append(conv[1:] != conv[:-1], following != int(conv[-1]))
        sums = [pa.array(k.view(np.int64)) for k in (*keys, *before)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), *sums, *(batch.column(i) for i in (2, 3, 4)), pa.array(last)], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch is given out when the conversation that follows it is known
        state, after, waiting = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                state, after = shared.value[batch.column(5)[0].as_py()]
            *found, state = _running(batch, state)
            if waiting is not None:
                yield given(*waiting, int(found[0][0]))
            waiting = (batch, *found)
        if waiting is not None:
            yield given(*waiting, after)

    return numbered.mapInArrow(walk, PATHS)


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Turns of the rebuilt conversations, to be put in order by ``conv_id, part, ord``.

    Conversation c takes the first h turns of the conversation at its multiple of ``every`` below, and
    its own after its first h; h is crc32 of c modulo ``heads``.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = turns.where(F.col("ord") > h).withColumn("part", F.lit(1))
    convs = turns.where("ord = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    first = turns.where((F.col("ord") < heads) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "ord", "a", "b", "words")
    taken = convs.join(first, "base").where("ord <= h").withColumn("part", F.lit(0))
    return own.select("part", *TURNS).union(taken.select("part", *TURNS))


class SpillingQueue:
    """Least-first queue of (key, key, key, value, value) messages; what memory cannot hold lies in sorted runs.

    Runs are nameless files in the scratch folder Spark gives its executors. No other task reads them: a
    task that is tried again fills a queue of its own.
    """

    KIND = np.dtype([("depth", np.int64), ("ka", np.int64), ("kb", np.int64), ("leaves", np.int64), ("saved", np.int64)])

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.runs = most, [], []

    def push(self, message: tuple[int, int, int, int, int]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        file = tempfile.TemporaryFile(dir=folder if folder and os.path.isdir(folder) else None)
        file.write(np.array(sorted(self.heap), self.KIND).tobytes())
        file.seek(0)
        self.heap = []
        heapq.heappush(self.runs, self._next(file, len(self.runs)))

    def _next(self, file, number, rows=iter(())):
        """Head of a run, its number to break ties, and what follows."""
        row = next(rows, None)
        if row is None:
            rows = iter(np.frombuffer(file.read(RUN_READ * self.KIND.itemsize), self.KIND).tolist())
            row = next(rows, None)
            if row is None:
                file.close()
                return None
        return row, number, rows, file

    def take(self, key: tuple[int, int, int]) -> tuple[int, int]:
        """Sums of the messages to ``key``, which leave the queue; none may be for a lesser key."""
        leaves = saved = 0
        while self.heap and self.heap[0][:3] == key:
            _, _, _, n, s = heapq.heappop(self.heap)
            leaves, saved = leaves + n, saved + s
        while self.runs and self.runs[0][0][:3] == key:
            (*_, n, s), number, rows, file = heapq.heappop(self.runs)
            leaves, saved = leaves + n, saved + s
            following = self._next(file, number, rows)
            if following is not None:
                heapq.heappush(self.runs, following)
        return leaves, saved


TOTALS = "depth bigint, ka bigint, kb bigint, pa bigint, pb bigint, n_leaves bigint, saved bigint, root boolean"


def time_forward(batches: Iterator[pa.RecordBatch], most: int = QUEUE) -> Iterator[pa.RecordBatch]:
    """Subtree totals of nodes that come in reverse level order, deepest first.

    Columns: ``depth, ka, kb, pa, pb, leaves, saved, root``. A node adds what its children sent it to its
    own and sends the sum on to its parent; roots of a shard send nothing, their parents are elsewhere.
    """
    queue = SpillingQueue(most)
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        leaves, saved = cols[5], cols[6]
        for i, (depth, ka, kb, pa_, pb, n, s, root) in enumerate(zip(*cols, strict=True)):
            more, kept = queue.take((-depth, ka, kb))
            leaves[i], saved[i] = n + more, s + kept
            if not root:
                queue.push((1 - depth, pa_, pb, leaves[i], saved[i]))
        arrays = [*(batch.column(i) for i in range(5)), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64()), batch.column(7)]
        yield pa.RecordBatch.from_arrays(arrays, names=["depth", "ka", "kb", "pa", "pb", "n_leaves", "saved", "root"])


def salted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)))


def copied(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def subtree_totals(nodes: DataFrame, paths: DataFrame, light: int = LIGHT) -> DataFrame:
    """``depth, ka, kb, n_leaves, saved`` of every node with two members or more.

    ``nodes`` has ``depth, ka, kb, pa, pb, conv_id, n_convs, leaves, saved``: what a node itself counts,
    nodes of one member below it included. A node of more than ``light`` members is heavy; a light one
    whose parent is heavy is a shard root, and shards are dealt over partitions by it. Every shard is
    gone through in reverse level order; then the heavy nodes are, with the totals of the shard roots
    added to their parents. Of a level at most one node in ``light`` members is heavy.
    """
    heavy = (F.col("depth") == 0) | (F.col("n_convs") > light)
    marked = nodes.withColumn("heavy", heavy)
    lowest = marked.where("heavy").agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    # the first light depth on every path that has heavy turns, and the path's key there
    keys = copied(marked.where("heavy and depth > 0").select(*KEY))
    upper = salted(paths.where(F.col("depth") <= lowest).select("conv_id", *KEY), "conv_id")
    above = upper.join(keys, [*KEY, "salt"]).groupBy("conv_id").agg((F.max("depth") + 1).alias("from"))
    some = marked.where("not heavy").join(above, "conv_id", "left").withColumn("from", F.coalesce("from", F.lit(1).cast("long")))
    anchors = paths.where(F.col("depth") <= lowest + 1).select(F.col("conv_id"), F.col("depth").alias("from"), F.col("ka").alias("ra"), F.col("kb").alias("rb"))
    some = some.join(anchors, ["conv_id", "from"])
    some = some.withColumn("root", F.col("depth") == F.col("from"))
    fields = ["depth", "ka", "kb", "pa", "pb", "leaves", "saved", "root"]
    dealt = some.repartition("from", "ra", "rb")
    order = [F.desc("depth"), F.asc("ka"), F.asc("kb")]
    shards = checkpointed(dealt.sortWithinPartitions(*order).select(*fields).mapInArrow(time_forward, TOTALS))
    sent = shards.where("root").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb"))
    sent = sent.agg(F.sum("n_leaves").alias("more"), F.sum("saved").alias("kept"))
    top = marked.where("heavy").join(sent, KEY, "left")
    top = top.select(
        *("depth", "ka", "kb", "pa", "pb"),
        (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("kept", F.lit(0))).alias("saved"),
        (F.col("depth") == 0).alias("root"),
    )
    done = top.repartition(1).sortWithinPartitions(*order).mapInArrow(time_forward, TOTALS)
    return shards.union(done).select(*KEY, "n_leaves", "saved")


def end_digests(ends: DataFrame) -> DataFrame:
    """``depth, ka, kb, ends_sha256``: of each node's ids in ascending order, joined by commas.

    A digest runs over its text from front to back, so a node's last step is one task; ids are sorted
    and joined to pieces in all tasks before, and the pieces are fed to it one by one.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, number = None, [], 0

        def piece():
            cols = [pa.array([x], pa.int64()) for x in (*held, ids[0])] + [pa.array([",".join(map(str, ids))])]
            return pa.RecordBatch.from_arrays(cols, names=[*KEY, "first", "ids"])

        for batch in batches:
            for *key, conv in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if ids and (key != held or len(ids) >= PIECE):
                    yield piece()
                    ids = []
                held = key
                ids.append(conv)
        if ids:
            yield piece()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None

        def done():
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in held), pa.array([digest.hexdigest()])], names=[*KEY, "ends_sha256"])

        for batch in batches:
            for *key, _, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key != held:
                    if held is not None:
                        yield done()
                    held, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
        if held is not None:
            yield done()

    pieces = ordered(ends.select(*KEY, "conv_id"), *KEY, "conv_id").mapInArrow(joined, "depth long, ka long, kb long, first long, ids string")
    pieces = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return pieces.mapInArrow(digests, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, every: int = 20, heads: int = 4, light: int = LIGHT) -> DataFrame:
    """A row per node of the trie of rebuilt conversations.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``. Input
    columns: ``conv_id, turn, role, text``; others are not read. Rows with a null ``conv_id`` belong to
    no conversation; null turns come first, null roles and texts are empty, turns of equal number go by
    the hashes of role and text, equal rows are turns one after the other. Without conversations there
    is no node. Turns are known by two 64-bit hashes of role and text, paths by two 64-bit sums of them
    mixed with their places; texts of any length take part whole and do not travel.

    Nodes are aggregates over path rows with map-side combine, so a turn that all conversations share
    gathers in no task. Nodes of one member have one leaf and save nothing; the others' totals come from
    ``subtree_totals``.
    """
    turns = turn_rows(conversations)
    rows = ordered(rebuilt(turns, every, heads), "conv_id", "part", "ord").select(*TURNS)
    paths = checkpointed(along_conversations(rows).drop("a", "b"))
    convs = turns.where("ord = 1").select("conv_id")
    nothing = F.lit(0).cast("long")
    turnless = convs.join(paths.where("last").select("conv_id"), "conv_id", "left_anti")
    here = [nothing.alias(c) for c in KEY]
    ends = turnless.select(*here, "conv_id").union(paths.where("last").select(*KEY, "conv_id"))

    below = paths.groupBy(*KEY, "pa", "pb").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*here, none.alias("pa"), none.alias("pb"), "conv_id", "n_convs", nothing.alias("words"))
    nodes = checkpointed(below.unionByName(root))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb"))
    children = children.agg(F.count("*").alias("n_children"), F.sum(F.when(F.col("n_convs") == 1, 1).otherwise(0)).alias("single"))
    counted = nodes.join(children, KEY, "left").fillna(0, ["n_children", "single"])
    counted = checkpointed(counted)
    shared = (F.col("n_convs") > 1) | (F.col("depth") == 0)
    own = F.when(F.col("n_children") == 0, 1).otherwise(F.col("single")).cast("long")
    saved = ((F.col("n_convs") - 1) * F.col("words")).cast("long")
    some = counted.where(shared).select(*KEY, "pa", "pb", "conv_id", "n_convs", own.alias("leaves"), saved.alias("saved"))
    totals = subtree_totals(checkpointed(some), paths, light)

    # parents with several members are looked up; a node whose parent is not among them has its only member
    parents = counted.where(shared & (F.col("n_children") > 0))
    parents = copied(parents.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent")))
    told = salted(counted, "ka", "kb").join(parents, ["depth", "pa", "pb", "salt"], "left")
    told = told.join(totals, KEY, "left").join(end_digests(ends), KEY, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return told.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.col("n_children").cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved", nothing).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )
