"""Nearest neighbours: recall against brute force, exact scores, graph properties and edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegraph.llm import nearest
from pagegraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def brute_force(rows, query_id, query, k):
    ids = np.array([i for i, _ in rows])
    apart = np.sqrt(((np.array([v for _, v in rows], float) - np.array(query, float)) ** 2).sum(axis=1))
    order = [j for j in np.lexsort((ids, apart)).tolist() if ids[j] != query_id]
    return [(float(apart[j]), int(ids[j])) for j in order[:k]]


def recall(found, rows, asked, k):
    """Share of the k true neighbours found; checks ranks, order and scores on the way."""
    vectors = dict(rows)
    hits = total = 0
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    for i, v in asked:
        got = sorted(by_query.get(i, []))
        true = brute_force(rows, i, v, k)
        assert [g[0] for g in got] == list(range(1, len(true) + 1))
        assert [g[1:] for g in got] == sorted(g[1:] for g in got)
        for _, score, j in got:
            assert j != i and math.isclose(score, math.dist(vectors[j], v), rel_tol=1e-12, abs_tol=1e-15)
        hits += len({j for _, j in true} & {g[2] for g in got})
        total += len(true)
    return hits / total


def test_query_recall(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(SF + "/embeddings.parquet").collect()]
    found = QUERIES["op12_nearest"](spark, SF).collect()
    assert recall(found, rows, [r for r in rows if r[0] % 100 == 0], 10) >= 0.95


def test_recall_over_many_shards_and_query_groups(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(SF + "/embeddings.parquet").collect()]
    df = spark.read.parquet(SF + "/embeddings.parquet")
    index = nearest.build_index(df, keep=6, shard=300).cache()
    assert index.count() == len(rows) and index.agg(F.max("shard")).first()[0] >= 5
    asked = [r for r in rows if r[0] % 40 == 0]
    found = nearest.search_index(index, df.where("vec_id % 40 = 0"), 5, group=16).collect()
    assert recall(found, rows, asked, 5) >= 0.95
    # no edge leaves its shard, none is double or leads back to its own node
    sizes = {r[0]: r[1] for r in index.groupBy("shard").count().collect()}
    for r in index.collect():
        assert len(set(r.edges)) == len(r.edges) and r.place not in r.edges and all(0 <= e < sizes[r.shard] for e in r.edges)


def test_runs_agree(spark):
    df = spark.read.parquet(SF + "/embeddings.parquet").where("vec_id < 700")
    one = sorted(map(tuple, nearest.build_index(df, shard=200).select("shard", "place", "edges").collect()))
    two = sorted(map(tuple, nearest.build_index(df.repartition(7), shard=200).select("shard", "place", "edges").collect()))
    assert one == two


def test_near_copies_in_thousands():
    """A third of the points around one vector: neighbours of the others and of the group are still found."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    points = np.concatenate([base + 1e-5 * rng.normal(size=(1000, 16)), rng.normal(size=(2000, 16))])[rng.permutation(3000)]
    graph = nearest.ProximityGraph(points).build()
    asked = points[::30]
    held, _ = graph.search(asked, nearest.BEAM)
    hits = 0
    for q, line in zip(asked, held, strict=True):
        hits += len(set(line.tolist()) & set(np.argsort(((points - q) ** 2).sum(axis=1))[:10].tolist()))
    assert hits / (10 * len(asked)) >= 0.9


def test_pruning_keeps_diverse_edges():
    # on a line: of points on one side only the nearest is kept, however many there are
    points = np.array([[0.0], [1.0], [1.1], [1.2], [-2.0], [-2.1]])
    graph = nearest.ProximityGraph(points, degree=4)
    kept = graph.prune(np.array([0]), np.array([[1, 2, 3, 4, 5, -1, 0, 1]]))[0]
    assert kept[kept >= 0].tolist() == [1, 4]


@pytest.mark.parametrize("scale", [1.0, 1e200, 1e-200])
def test_scores_of_extreme_vectors(spark, scale):
    rng = random.Random(3)
    rows = [(i, [scale * rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.search_index(nearest.build_index(df, keep=4), df.where("vec_id < 5"), 3).collect()
    for i in range(5):
        true = sorted((math.dist(rows[i][1], v), j) for j, v in rows if j != i)[:3]
        got = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == i)
        assert [g[1] for g in got] == [j for _, j in true]
        assert all(math.isclose(g[2], d, rel_tol=1e-9) for g, (d, _) in zip(got, true, strict=True))


def test_edges(spark, rows):
    data = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, -0.0], 1), (3, [0.0, 1.0], 1)]
    data += [(4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [float("inf"), 1.0], 1), (8, [], 1), (None, [1.0, 0.0], 1)]
    data += [(200, [1.0, 1.0, 1.0], 1), (300, None, 1), (400, [0.0, 0.0], 1), (9, [2.0, 0.0], 1), (9, [3.0, 0.0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x")).withColumn("v", F.lit(1))
    asked = df.where("vec_id % 100 = 0")
    found = rows(nearest.search_index(nearest.build_index(df, keep=4), asked, 3))
    assert found == [(100, 1, 1, 0.0), (100, 2, 2, 0.0), (100, 3, 9, 1.0)]
    # equal vectors: the smallest ids are named, whatever their number
    many = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.lit(2.0)).alias("embedding"))
    found = rows(nearest.search_index(nearest.build_index(many, keep=3), many.where("vec_id in (0, 4900)"), 2))
    assert found == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (4900, 1, 0, 0.0), (4900, 2, 1, 0.0)]
    empty = df.where("false")
    assert rows(nearest.search_index(nearest.build_index(empty), asked, 3)) == []
    assert rows(nearest.search_index(nearest.build_index(df), empty, 3)) == []
