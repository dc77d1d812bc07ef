"""Top-k search and near-duplicate vectors against brute force, and their edge cases."""

import random

import brute
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from pagegraph.llm import neardup, topk
from pagegraph.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"


def test_topk_query(spark, tables, rows):
    expected = brute.topk(tables("embeddings", "vec_id", "embedding"))
    assert sorted(rows(QUERIES["op1_topk"](spark, SF))) == expected


def test_neardup_query(spark, tables, rows):
    expected = brute.vector_links(tables("embeddings", "vec_id", "embedding", "label"))
    assert sorted(rows(QUERIES["op4_neardup"](spark, SF))) == expected


@pytest.mark.parametrize("kind", ["plain", "ties", "large", "skewed"])
def test_reading_stops_with_the_exact_best(kind):
    rng = np.random.default_rng(3)
    values = rng.integers(-100, 100, (300, 7))
    if kind == "ties":
        values = rng.integers(-1, 2, (300, 3))
    if kind == "large":
        values = values * 10**7
    if kind == "skewed":
        values[:, 1:] //= 50
    ids = rng.permutation(300) + 1000
    queries, own = values[:20].copy(), ids[:20]
    found = topk.search_block(ids, values, own, queries, 5)
    for q in range(20):
        scores = values @ queries[q]
        best = sorted((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != own[q])[:5]
        assert sorted((-s, int(ids[c])) for p, c, s in found if p == q) == best


def test_reading_stops_early_on_separated_lists():
    """A list whose head dominates is not read to its end."""
    values = np.zeros((2000, 2), int)
    values[:5, 0] = 10**6
    values[5:, 0] = np.arange(1995) % 7
    assert {int(c) for _, c, _ in topk.search_block(np.arange(2000), values, np.array([-1]), np.array([[3, 1]]), 5)} == set(range(5))


def test_topk_edges(spark, rows):
    data = [(50, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], None), (2, [1.0, 0.0], None), (3, [float("nan"), 1.0], 1), (4, None, 1)]
    data += [(100, [0.5, None], 1), (150, [1.0, 2.0, 3.0], 1), (None, [9.0, 9.0], 1), (5, [], 1)]
    df = spark.createDataFrame(data, VECTORS).withColumn("score", F.lit("x")).withColumn("rank", F.lit("y"))
    df = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.scaled(F.col("embedding")).alias("v"), "score", "rank")
    found = rows(topk.top_k(df, df.where("vec_id % 50 = 0"), 5))
    assert found == [(50, 1, 1, 65536), (50, 2, 2, 65536)]
    assert rows(topk.top_k(df.where("false"), df.where("false"), 5)) == []


def test_neardup_random(spark, rows):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(30)]
    data = []
    for i in range(240):
        v = [x + rng.gauss(0, 0.12) for x in base[i % 30]]
        data.append((i, v if i % 4 else base[i % 30], i % 2))
    got = neardup.link_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"))
    assert sorted(rows(got)) == brute.vector_links(data)


def test_neardup_many_tiles(spark, rows, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)
    rng = random.Random(6)
    data = [(i, [rng.gauss(0, 1) for _ in range(3)], 0) for i in range(150)]
    got = neardup.link_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"))
    assert sorted(rows(got)) == brute.vector_links(data)


def test_neardup_edges(spark, rows):
    data = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1)]
    data += [(7, [1.0, 0.0], None), (8, [float("inf"), 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0], 1), (10, [], 1)]
    df = spark.createDataFrame(data, VECTORS).withColumn("n_links", F.lit("clash"))
    alone = [(i, 0, i, True) for i in (10, 3, 4, 5, 6, 7, 8, 9)]
    assert rows(neardup.link_vectors(df)) == sorted([(1, 1, 1, True), (2, 1, 1, False), *alone], key=str)
    assert rows(neardup.link_vectors(df.where("false"))) == []
