"""Chains, rings and closures take rounds in proportion to the logarithm of their length."""

import random

import pytest
from pyspark.sql import functions as F

from pagegraph.operators import chains, changes, links, pattern
from pagegraph.operators.pattern import Graph, plus, star
from pagegraph.operators.triples import GRAPH_COLUMNS


def plain_ends(steps):
    out = {}
    for node in steps:
        seen, cur = [], node
        while cur in steps and cur not in seen:
            seen.append(cur)
            cur = steps[cur]
        out[node] = (cur, seen[-1] if cur in seen else cur)
    return out


def counted(monkeypatch, module):
    calls, real = [], module.checkpointed

    def count(df):
        calls.append(1)
        return real(df)

    monkeypatch.setattr(module, "checkpointed", count)
    return calls


def step_frame(spark, steps):
    return spark.createDataFrame([("w", a, b) for a, b in steps.items()], "key string, node long, next long")


@pytest.mark.parametrize("seed", range(3))
def test_ends_of_random_functions(spark, seed):
    rng = random.Random(seed)
    steps = {a: b for a in rng.sample(range(80), 60) if (b := rng.randrange(80)) != a}
    got = chains.chain_ends(step_frame(spark, steps)).collect()
    assert {r.node: (r.end, r.last) for r in got} == plain_ends(steps) and len(got) == len(steps)


def test_long_chain_in_few_rounds(spark, monkeypatch):
    calls = counted(monkeypatch, chains)
    names = spark.range(5000).select(F.lit("w").alias("wiki"), F.format_string("t%05d", "id").alias("source"), F.format_string("t%05d", F.col("id") + 1).alias("target"))
    titles = names.select("wiki", F.col("source").alias("title"))
    got = links.resolve_aliases(titles, names)
    assert got.where("final_title <> 't05000'").count() == 0 and got.count() == 5000
    # the frame it starts from, and one per round
    assert len(calls) <= 1 + 14


def test_ring_with_tails(spark):
    steps = {i: i + 1 for i in range(1000)} | {1000: 700} | {2000 + i: i for i in range(0, 1000, 100)} | {5000: 5001}
    got = {r.node: (r.end, r.last) for r in chains.chain_ends(step_frame(spark, steps)).collect()}
    assert got == plain_ends(steps)


def test_aliases_stop_where_a_title_repeats(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("s", "s"), ("m", "n"), ("m", "o"), ("n", "z")]
    aliases = spark.createDataFrame([("w", *p) for p in pairs], "wiki string, source string, target string")
    titles = spark.createDataFrame([("w", t) for t in ("a", "c", "x", "s", "m", "n", "q")] + [("v", "a")], "wiki string, title string")
    got = {(r.wiki, r.title): r.final_title for r in links.resolve_aliases(titles, aliases).collect()}
    assert got == {("w", "a"): "a", ("w", "c"): "c", ("w", "x"): "a", ("w", "s"): "s", ("w", "m"): "o", ("w", "n"): "z", ("w", "q"): "q", ("v", "a"): "a"}


def test_redirect_ring_of_hundreds(spark):
    page = spark.range(300).select(F.lit("w").alias("wiki"), F.lit(0).alias("page_namespace"), F.format_string("P%d", "id").alias("page_title"), F.col("id").alias("page_id"))
    redirect = spark.range(300).select(F.lit("w").alias("wiki"), F.col("id").alias("rd_from"), F.lit(0).alias("rd_namespace"), F.format_string("P%d", (F.col("id") + 1) % 300).alias("rd_title"))
    starts = page.select("wiki", F.lit(0).alias("ns_id"), F.col("page_title").alias("db_title"))
    got = {r.db_title: r.page_id for r in changes.chase_redirects(starts, page, redirect).collect()}
    assert got == {"P%d" % i: (i - 1) % 300 for i in range(300)}


def edge_graph(spark, edges):
    rows = [tuple({"s": a, "p": "p", "o": b, "o_kind": "iri", "dataset_id": "1"}.get(c) for c in GRAPH_COLUMNS) for a, b in edges]
    return Graph(spark.createDataFrame(rows, ", ".join(c + " string" for c in GRAPH_COLUMNS)))


@pytest.mark.parametrize("ring", [False, True])
def test_closure_of_ten_thousand_steps(spark, monkeypatch, ring):
    calls = counted(monkeypatch, pattern)
    n = 10_000
    rows = spark.range(n).select(
        *[{"s": F.format_string("n%d", "id"), "p": F.lit("p"), "o": F.format_string("n%d", (F.col("id") + 1) % (n if ring else n + 1)),
           "o_kind": F.lit("iri"), "dataset_id": F.lit("1")}.get(c, F.lit(None).cast("string")).alias(c) for c in GRAPH_COLUMNS]
    )
    assert Graph(rows).path("n0", plus("p"), "?x").df.count() == n
    assert len(calls) <= 40


@pytest.mark.parametrize("seed", range(2))
def test_closures_of_random_graphs(spark, monkeypatch, seed):
    monkeypatch.setattr(pattern, "PLAIN", 1)
    rng = random.Random(seed)
    chain = [("c%d" % i, "c%d" % (i + 1)) for i in range(30)]
    edges = chain + [("n%d" % rng.randrange(14), "n%d" % rng.randrange(14)) for _ in range(18)] + [("n0", "c0"), ("c30", "c30")]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)

    def reached(a):
        seen, todo = set(), list(near.get(a, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near.get(x, ())
        return seen

    g = edge_graph(spark, edges)
    nodes = {x for e in edges for x in e}
    got = {tuple(r) for r in g.path("?x", plus("p"), "?y").values("x", "y").collect()}
    assert got == {(a, b) for a in nodes for b in reached(a)}
    got = {tuple(r) for r in g.path("n0", star("p"), "?y").values("y").collect()}
    assert got == {(b,) for b in reached("n0") | {"n0"}}
