import json

import pytest
from pyspark.sql import functions as F

from pagegraph.functions import terms
from pagegraph.functions.fixed import XSD_INTEGER
from pagegraph.operators import catalog, pattern as g, sinks
from pagegraph.operators.pattern import Graph, Lit, Solutions
from pagegraph.operators.triples import GRAPH_COLUMNS

SCHEMA = ", ".join(c + " string" for c in GRAPH_COLUMNS)


def graph(spark, edges, literals=()):
    rows = [("1", s, p, "iri", o, None, None) for s, p, o in edges]
    rows += [("1", s, p, "literal", v, dt, lang) for s, p, v, dt, lang in literals]
    return Graph(spark.createDataFrame(rows, SCHEMA))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_patterns(spark):
    gr = graph(spark, [("a", "p", "b"), ("b", "p", "c"), ("a", "q", "a")], [("b", "n", "x\"\n", None, None), ("c", "n", "1", XSD_INTEGER, None), ("c", "l", "moi", None, "fi")])
    assert rows(gr.match("?x", "q", "?x").values()) == [("a",)]
    assert rows(gr.match("?s", "n", Lit("1", XSD_INTEGER)).values()) == [("c",)]
    assert rows(gr.match("?s", "n", Lit("1")).values()) == []
    assert rows(gr.match("?s", "?p", "c").values()) == [("b", "p")]
    joined = gr.match("?x", "p", "?y").join(gr.match("?y", "n", "?v"))
    assert rows(joined.values("x", "v")) == [("a", 'x"\n'), ("b", "1")]
    both = gr.match("?x", "p", "?y", address=True).optional(gr.match("?y", "l", "?l"))
    assert sorted(map(str, rows(both.values("x", "l")))) == ["('a', None)", "('b', 'moi')"]
    assert rows(gr.match("?x", "zz", "?y").ask()) == [(False,)]
    lines = {r.line for r in sinks.ntriples(gr.df).collect()}
    assert '<b> <n> "x\\"\\n" .' in lines and '<c> <l> "moi"@fi .' in lines
    assert '<c> <n> "1"^^<{}> .'.format(XSD_INTEGER) in lines
    bindings = {r.binding for r in sinks.json_bindings(gr.match("?s", "l", "?l")).collect()}
    assert bindings == {'{"s":{"type":"uri","value":"c"},"l":{"type":"literal","value":"moi","xml:lang":"fi"}}'}


def test_minus_and_compatible_join_against_brute_force(spark):
    """All combinations of bound and unbound values of two shared variables."""
    some = [None, "1", "2"]
    left = [(str(i), a, b) for i, (a, b) in enumerate((a, b) for a in some for b in some)]
    right = [(str(i), a, b) for i, (a, b) in enumerate((a, b) for a in some for b in some if (a, b) != (None, None))]

    def solutions(data, key):
        df = spark.createDataFrame(data, "{} string, a string, b string".format(key)).where("true")
        wrap = lambda c: F.when(F.col(c).isNotNull(), terms.literal(F.col(c))).alias(c)
        return Solutions(df.select(key, wrap("a"), wrap("b")), certain={key}, maybe={"a", "b"}, addresses={key})

    def compatible(x, y):
        return all(p is None or q is None or p == q for p, q in zip(x[1:], y[1:]))

    def overlap(x, y):
        return any(p is not None and q is not None for p, q in zip(x[1:], y[1:]))

    kept = [x[0] for x in left if not any(compatible(x, y) and overlap(x, y) for y in right)]
    got = solutions(left, "l").minus(solutions(right, "r")).values("l")
    assert rows(got) == sorted((k,) for k in kept)
    with pytest.raises(ValueError):
        solutions(left, "l").join(solutions(right, "r"))
    tied_left = [(x[0], x[1], x[2], "k") for x in left]
    tied_right = [(y[0], y[1], y[2], "k") for y in right]

    def tied(data, key):
        df = spark.createDataFrame(data, "{} string, a string, b string, k string".format(key))
        wrap = lambda c: F.when(F.col(c).isNotNull(), terms.literal(F.col(c))).alias(c)
        return Solutions(df.select(key, "k", wrap("a"), wrap("b")), certain={key, "k"}, maybe={"a", "b"}, addresses={key, "k"})

    expected = sorted(
        (x[0], y[0], x[1] or y[1] or "", x[2] or y[2] or "") for x in left for y in right if compatible(x, y)
    )
    joined = tied(tied_left, "l").join(tied(tied_right, "r")).values("l", "r", "a", "b").na.fill("")
    assert rows(joined) == expected


def test_paths_with_cycle(spark):
    edges = [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("c", "p", "d"), ("x", "q", "a")]
    gr = graph(spark, edges)
    step = {}
    for s, p, o in edges:
        if p == "p":
            step.setdefault(s, set()).add(o)

    def reach(s):
        seen, todo = set(), list(step.get(s, ()))
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += step.get(n, ())
        return seen

    expected = sorted((s, o) for s in step for o in reach(s))
    assert rows(gr.path("?a", g.plus("p"), "?b").values("a", "b")) == expected
    nodes = {n for s, _, o in edges for n in (s, o)}
    assert rows(gr.path("?a", g.star("p"), "?b").values("a", "b")) == sorted(set(expected) | {(n, n) for n in nodes})
    assert rows(gr.path("x", g.seq("q", g.plus("p")), "?b").values()) == [("a",), ("b",), ("c",), ("d",)]
    assert rows(gr.path("zz", g.star("p"), "?b").values()) == [("zz",)]
    assert rows(gr.path("?a", g.inv("q"), "x").values()) == [("a",)]


def test_group_of_nothing_counts_zero(spark):
    gr = graph(spark, [("a", "p", "b")])
    s = gr.match("?x", "none", "?y")
    out = s.group([], n=g.count(), t=g.total(terms.number(s.term("y"))), m=g.mean(terms.number(s.term("y"))))
    assert rows(out) == [(0, 0.0, 0.0)]


def test_value_equality(evaluate):
    call = lambda a, b: terms.value_equal(terms.literal(a, XSD_INTEGER), terms.literal(b, terms.fixed.XSD_DOUBLE))
    assert evaluate(call, [("1", "1.0"), ("1", "2.0")], "a string, b string") == [True, False]


def test_write_replaces_only_its_datasets(spark, tmp_path):
    path = str(tmp_path / "graph")
    first = spark.createDataFrame([("1", "a", "http://x/p", "iri", "b", None, None)] * 3 + [("2", "c", "http://x/p", "literal", "5", XSD_INTEGER, None)], SCHEMA)
    sinks.write_graph(first, path)
    sinks.write_graph(spark.createDataFrame([("1", "new", "http://x/p", "iri", "b", None, None)], SCHEMA), path)
    back = sinks.read_graph(spark, path)
    assert rows(back.select("dataset_id", "s", "p", "o")) == [("1", "new", "http://x/p", "b"), ("2", "c", "http://x/p", "5")]
    plan = back.where(F.col("p") == "http://x/p")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p), EqualTo(p" in plan
    sinks.write_ntriples(back, str(tmp_path / "nt"))
    assert spark.read.text(str(tmp_path / "nt")).count() == 2
    sinks.write_json_result(Graph(back).match("?s", "http://x/p", "?o"), str(tmp_path / "json"))
    head = spark.read.text(str(tmp_path / "json" / "head")).collect()[0][0]
    assert json.loads(head) == {"head": {"vars": ["s", "o"]}}


def test_rewrite_leaves_nothing_of_the_last_version(spark, tmp_path):
    path = str(tmp_path / "graph")
    row = lambda d, p, s: (d, s, p, "iri", "b", None, None)
    sinks.write_graph(spark.createDataFrame([row("1", "old", "a"), row("1", "keep", "a"), row("a/b", "keep", "c")], SCHEMA), path)
    sinks.write_graph(spark.createDataFrame([row("1", "keep", "n")], SCHEMA), path)
    read = lambda: rows(sinks.read_graph(spark, path).select("dataset_id", "s", "p"))
    assert read() == [("1", "n", "keep"), ("a/b", "c", "keep")]
    sinks.write_graph(spark.createDataFrame([], SCHEMA), path, datasets=["1", "none"])
    assert read() == [("a/b", "c", "keep")]
    sinks.write_graph(spark.createDataFrame([row("2", "p", "x")], SCHEMA), path)
    lines = [(d, 1, "https://x/", None, t, []) for d, t in (("a/b", "2026-03-01T00:00:00Z"), ("2", "2026-04-01T00:00:00Z"))]
    catalog.append_catalog(spark.createDataFrame(lines, catalog.CATALOG_SCHEMA), str(tmp_path / "catalog"))
    assert sinks.drop_expired(path, str(tmp_path / "catalog"), "2026-04-01T12:00:00Z", spark) == ["a/b"]
    assert read() == [("2", "x", "p")]
    assert [r.dataset_id for r in catalog.read_catalog(spark, str(tmp_path / "catalog")).collect()] == ["2"]


def test_terms_keep_their_kind(spark):
    five = [("s1", "n", "5", XSD_INTEGER, None), ("s2", "n", "5", None, None), ("s3", "n", "5", None, "en")]
    gr = graph(spark, [("s4", "n", "5")], five)
    s = gr.match("?s", "n", "?v")
    assert [r[-1] for r in rows(s.group(["v"], n=g.count()))] == [1, 1, 1, 1]
    assert rows(gr.match("?s", "n", Lit("5", terms.fixed.XSD_STRING)).values()) == [("s2",)]
    assert [r.s for r in s.order_terms("v").values("s").collect()] == ["s4", "s1", "s2", "s3"]
    assert [r.s for r in s.order_terms("v", descending=["v"]).values("s").collect()] == ["s3", "s2", "s1", "s4"]


def test_optional_parts_in_a_chain(spark):
    gr = graph(spark, [("x", "e", "y"), ("x", "t", "k"), ("z", "t", "k")], [("y", "l", "label", None, None)])
    s = gr.match("?x", "t", "k").optional(gr.match("?x", "e", "?y")).optional(gr.match("?y", "l", "?z"))
    assert sorted(map(str, rows(s.values("x", "y", "z")))) == ["('x', 'y', 'label')", "('z', None, None)"]


def test_exact_integers_and_offsets(evaluate):
    typed = lambda kind: lambda a, b: terms.value_equal(terms.literal(a, kind), terms.literal(b, kind))
    whole = [("9007199254740993", "9007199254740992"), ("12345678901234567890", "12345678901234567890")]
    assert evaluate(typed(XSD_INTEGER), whole, "a string, b string") == [False, True]
    times = [("2026-04-01T12:00:00+02:00", "2026-04-01T10:00:00Z"), ("2026-04-01T12:00:00.5Z", "2026-04-01T12:00:00Z"), ("2026-04-01T12:00:00", "2026-04-01T12:00:00Z")]
    assert evaluate(typed(terms.fixed.XSD_DATE_TIME), times, "a string, b string") == [True, False, True]


def test_signature_ignores_order_and_sees_change(spark):
    data = [("1", "s{}".format(i), "p", "iri", "o", None, None) for i in range(50)]
    sign = lambda d: rows(sinks.graph_signature(spark.createDataFrame(d, SCHEMA)))
    assert sign(data) == sign(data[::-1])
    assert sign(data) != sign(data[:-1] + [("1", "s49", "p", "iri", "changed", None, None)])


def test_catalog(spark):
    line = lambda d, t, p: (d, 3, "https://x/", p, t, [])
    lines = [
        line("a", "2026-04-01T11:31:00+00:00", {"w": ["1", "2"], "l": ["5"]}),
        line("b", "2026-04-01T11:29:59Z", {"l": ["5"], "w": ["1", "2"]}),
        line("c", "2026-04-01T11:59:00", {"w": ["2", "1"], "l": ["5"]}),
        line("d", "2026-03-31T11:00:00Z", None),
        line("e", "broken", None),
    ]
    df = spark.createDataFrame(lines, catalog.CATALOG_SCHEMA)
    wanted = F.create_map(F.lit("l"), F.array(F.lit("5")), F.lit("w"), F.array(F.lit("1"), F.lit("2")))
    assert [r.dataset_id for r in catalog.fresh(df, "2026-04-01T12:00:00Z", wanted).collect()] == ["a"]
    assert [r.dataset_id for r in catalog.expired(df, "2026-04-01T12:00:00Z").collect()] == ["d"]
    keep = spark.createDataFrame([("d",)], "dataset_id string")
    assert catalog.expired(df, "2026-04-01T12:00:00Z", keep).count() == 0
    newer = df.unionByName(spark.createDataFrame([line("a", "2026-04-02T00:00:00Z", None)], catalog.CATALOG_SCHEMA))
    assert {r.loaded_at for r in catalog.current(newer).where("dataset_id = 'a'").collect()} == {"2026-04-02T00:00:00Z"}


def test_bucketed_graph_joins_stars_without_shuffle(spark, tmp_path):
    data = [("1", "s{}".format(i), p, "literal", str(i), None, None) for i in range(40) for p in ("p", "q")]
    sinks.save_graph_table(spark.createDataFrame(data, SCHEMA), "bucketed_graph", buckets=4, path=str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gr = Graph(spark.table("bucketed_graph"))
        joined = gr.match("?s", "p", "?a").join(gr.match("?s", "q", "?b"))
        plan = joined.df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert joined.df.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucketed_graph")
