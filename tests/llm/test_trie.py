"""Prefix trie against a plain one, time-forward processing, spilling, edge cases."""

import hashlib
import math
import random
import zlib

import brute
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from pagegraph.llm import trie
from pagegraph.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows, every=20, heads=4):
    """rows: (conv_id, turn, role, text); equal turns of a conversation must be equal rows."""
    convs = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((r or "", x or ""))
    members, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        path = tuple(convs.get(c - int(math.fmod(c, every)), [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out, totals = [], {}
    for path in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in children.get(path, [])]
        words = len(brute.word_list(path[-1][1])) if path else 0
        leaves = sum(b[0] for b in below) or 1
        saved = sum(b[1] for b in below) + (len(members[path]) - 1) * words
        totals[path] = leaves, saved
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        parent = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), parent, len(members[path]), len(below), leaves, saved, digest))
    return sorted(out, key=str)


def test_query(spark, tables, rows):
    assert rows(QUERIES["op13_trie"](spark, SF)) == plain_trie(tables("conversations", "conv_id", "turn", "role", "text"))


def random_turns(seed, convs=150, words=4, longest=9):
    """Few different turns, so that many prefixes are shared."""
    rng = random.Random(seed)
    return [(c, t, rng.choice("ab"), "x " * rng.randint(0, words)) for c in range(convs) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("light", [1, 3, 20, 10**6])
def test_shards_and_their_roots(spark, rows, light):
    data = random_turns(1)
    found = trie.prefix_trie(spark.createDataFrame(data, TURNS), light=light)
    assert rows(found) == plain_trie(data)


def test_conversations_over_many_partitions(spark, rows):
    """Conversations of hundreds of turns, equal but for their end, cut by every partition border."""
    rng = random.Random(2)
    shared = [("r", "turn %d" % rng.randint(0, 5)) for _ in range(400)]
    data = [(c, t, *x) for c in (7, 8, 9, 10) for t, x in enumerate([*shared[: 400 - c], ("r", "end %d" % (c % 3))])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows(trie.prefix_trie(spark.createDataFrame(data, TURNS).repartition(9), light=2)) == plain_trie(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_copies_by_the_thousand(spark, rows, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 64)
    data = [(c, t, "u", "same %d" % t) for c in range(2000) for t in range(3)] + [(5000 + c, 0, "u", "same 0") for c in range(100)]
    assert rows(trie.prefix_trie(spark.createDataFrame(data, TURNS), light=50)) == plain_trie(data)


@pytest.mark.parametrize("most", [1, 2, 5, 1000])
def test_queue_spills_and_merges(most):
    rng = random.Random(most)
    messages = sorted((-rng.randint(0, 5), rng.randint(-3, 3), rng.randint(-2, 2), rng.randint(0, 9), rng.randint(0, 9)) for _ in range(500))
    waiting, queue = messages[:], trie.SpillingQueue(most)
    rng.shuffle(waiting)
    for m in waiting:
        queue.push(m)
    for key in sorted({m[:3] for m in messages}):
        assert queue.take(key) == tuple(sum(m[i] for m in messages if m[:3] == key) for i in (3, 4))
    assert queue.take((1, 0, 0)) == (0, 0)


@pytest.mark.parametrize("most", [1, 1000])
def test_time_forward(most):
    """A chain of three below a root with a second child, in batches of one row."""
    nodes = [(3, 9, 0, 7, 0, 1, 5, False), (2, 7, 0, 4, 0, 0, 2, False), (1, 4, 0, 0, 0, 0, 1, False), (1, 5, 0, 0, 0, 2, 8, False), (0, 0, 0, 0, 0, 1, 0, True)]
    names = ["depth", "ka", "kb", "pa", "pb", "leaves", "saved", "root"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, n, strict=True))]) for n in nodes]
    found = [tuple(r.values()) for b in trie.time_forward(iter(batches), most) for r in b.select(["depth", "n_leaves", "saved"]).to_pylist()]
    assert found == [(3, 1, 5), (2, 1, 7), (1, 1, 8), (1, 2, 8), (0, 4, 16)]


def test_edges(spark, rows):
    data = [(1, None, None, None), (1, 0, "a", "x y"), (1, 0, "a", "x y"), (21, 5, "", ""), (-5, 1, "a", "b"), (-40, 1, "q", "w e"), (-47, 2, "q", "w e")]
    data += [(None, 1, "a", "no id"), (40, 1, "a", "long " * 100_000), (45, 1, "a", "long " * 100_000), (3, 1, "a", "z"), (5, 1, "a", "z")]
    df = spark.createDataFrame(data, TURNS).withColumn("depth", F.lit("clash")).withColumn("a", F.lit("clash")).withColumn("ord", F.lit(9))
    assert rows(trie.prefix_trie(df)) == plain_trie(data)
    assert rows(trie.prefix_trie(df.where("false"))) == []
    # turnless: their first turns are replaced by those of a conversation that is not there
    lone = [(c, 0, "a", "gone") for c in range(1, 8)]
    found = rows(trie.prefix_trie(spark.createDataFrame(lone, TURNS)))
    assert found == plain_trie(lone) and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in found)
