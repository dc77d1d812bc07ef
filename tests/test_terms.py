"""Aggregates over terms, functions on terms, and optional parts with unbound shared variables."""

import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pagegraph.functions import fixed, terms
from pagegraph.operators import pattern as g
from pagegraph.operators.pattern import Solutions

INT, DEC, DBL = fixed.XSD_INTEGER, fixed.XSD + "decimal", fixed.XSD_DOUBLE
TERM = "struct<kind:string,value:string,datatype:string,lang:string>"


def lit(value, datatype=None, lang=None):
    return ("literal", value, datatype, lang)


def aggregated(spark, values, *functions):
    df = spark.createDataFrame([(v,) for v in values], "t " + TERM)
    row = df.agg(*[f(F.col("t")).alias("x%d" % i) for i, f in enumerate(functions)]).first()
    return [None if r is None else (r.value, r.datatype) for r in row]


@pytest.mark.parametrize(
    "values, total, mean",
    [
        ([], ("0", INT), ("0", INT)),
        ([lit("1", INT), lit("2", INT)], ("3", INT), ("1.5", DEC)),
        ([lit("7", INT)] * 2, ("14", INT), ("7", DEC)),
        ([lit("1", INT), lit("0.25", DEC)], ("1.25", DEC), ("0.625", DEC)),
        ([lit("-1.50", DEC)], ("-1.5", DEC), ("-1.5", DEC)),
        ([lit("1", INT), lit("0.25", DEC), lit("1.5", DBL)], ("2.75", DBL), ("0.9166666666666666", DBL)),
        ([lit("9" * 37, INT), lit("1", INT)], ("1" + "0" * 37, INT), None),
        ([lit("9" * 38, INT), lit("1", INT)], None, None),
        ([lit("1", INT), lit("x")], None, None),
        ([lit("1", INT), ("iri", "1", None, None)], None, None),
        ([lit("1", INT), None], None, None),
        ([lit("one", INT)], None, None),
        ([lit("1e2", DBL)], ("100.0", DBL), ("100.0", DBL)),
    ],
)
def test_sums_promote_and_absorb(spark, values, total, mean):
    got = aggregated(spark, values, g.total_term, g.mean_term)
    assert got[0] == total
    if len(values) < 2 or len(values[0][1]) < 20:
        assert got[1] == mean


def test_least_and_greatest_follow_term_order(spark):
    values = [lit("b"), lit("10", INT), lit("9.5", DBL), ("iri", "z", None, None), lit("a", None, "en"), None]
    assert aggregated(spark, values, g.least_term, g.greatest_term) == [("z", None), ("b", None)]
    assert aggregated(spark, values[:3], g.least_term, g.greatest_term) == [("9.5", DBL), ("b", None)]
    assert aggregated(spark, [None], g.least_term, g.greatest_term, g.sample_term) == [None, None, None]
    assert aggregated(spark, values, g.sample_term) == [("z", None)]


def test_partial_sums_merge(spark):
    rng = random.Random(1)
    values = [lit(str(rng.randint(-50, 50)), INT) if rng.random() < 0.5 else lit("%.2f" % rng.uniform(-9, 9), DEC) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "t " + TERM).repartition(7)
    got = df.agg(g.total_term(F.col("t")).alias("x")).first().x
    assert Decimal(got.value) == sum(Decimal(v[1]) for v in values) and got.datatype == DEC


def value(spark, column, *cells):
    df = spark.createDataFrame([tuple(cells)], ", ".join("c%d %s" % (i, TERM) for i in range(len(cells))))
    got = df.select(column(*[F.col("c%d" % i) for i in range(len(cells))]).alias("x")).first().x
    return got if got is None or isinstance(got, str) else tuple(got)


def test_functions_on_terms(spark):
    en, de, plain, iri = lit("a", None, "en"), lit("b", None, "de"), lit("x"), ("iri", "urn:x", None, None)
    at = lambda text: lit(text, fixed.XSD_DATE_TIME)
    assert value(spark, terms.concat, en, en) == lit("aa", None, "en")
    assert value(spark, terms.concat, en, de) == lit("ab") and value(spark, terms.concat, en, plain) == lit("ax")
    assert value(spark, terms.concat, en, iri) is None and value(spark, terms.concat, en, None) is None
    assert value(spark, lambda a, b: terms.if_(terms.is_iri(a), a, b), iri, plain) == iri
    assert value(spark, lambda a, b: terms.if_(terms.number(a) > 1, a, b), plain, iri) is None
    assert value(spark, terms.coalesce, None, plain) == plain
    assert value(spark, terms.to_iri, lit("http://x/y")) == ("iri", "http://x/y", None, None) and value(spark, terms.to_iri, iri) == iri
    assert value(spark, terms.to_iri, lit("a b")) is None and value(spark, terms.to_iri, en) is None
    assert value(spark, lambda t: terms.strdt(t, INT), lit("5")) == lit("5", INT) and value(spark, lambda t: terms.strdt(t, INT), en) is None
    assert value(spark, lambda t: terms.strlang(t, "FI"), plain) == lit("x", None, "fi") and value(spark, lambda t: terms.strlang(t, "fi"), lit("5", INT)) is None
    zones = {"Z": ("Z", "PT0S"), "+05:30": ("+05:30", "PT5H30M"), "-08:00": ("-08:00", "-PT8H"), "+00:00": ("+00:00", "PT0S"), "": ("", None)}
    for text, (zone, duration) in zones.items():
        assert value(spark, terms.tz, at("2026-04-01T00:00:00" + text)) == lit(zone)
        expected = None if duration is None else lit(duration, fixed.XSD + "dayTimeDuration")
        assert value(spark, terms.timezone, at("2026-04-01T00:00:00" + text)) == expected
    assert value(spark, terms.tz, plain) is None and value(spark, terms.timezone, plain) is None


def test_optional_with_unbound_on_both_sides_against_brute_force(spark):
    """All combinations of bound and unbound values of two shared variables, repeated rows included."""
    some = [None, "1", "2"]
    pairs = list(itertools.product(some, some))
    left = [("l%d" % (i % 9), a, b) for i, (a, b) in enumerate(pairs + pairs[:4])]
    right = [("r%d" % i, a, b) for i, (a, b) in enumerate(pairs[1:] + pairs[4:6])]

    def solutions(data, key):
        df = spark.createDataFrame(data, "{} string, a string, b string".format(key)).where("true")
        wrap = lambda c: F.when(F.col(c).isNotNull(), terms.literal(F.col(c))).alias(c)
        return Solutions(df.select(key, wrap("a"), wrap("b")), certain={key}, maybe={"a", "b"}, addresses={key})

    def joined(keep):
        out = []
        for x in left:
            found = []
            for y in right:
                shared = [(p, q) for p, q in zip(x[1:], y[1:]) if p is not None and q is not None]
                if shared and all(p == q for p, q in shared) and keep(y):
                    found.append((x[0], *(p if p is not None else q for p, q in zip(x[1:], y[1:])), y[0]))
            out += found or [(*x, None)]
        return sorted(map(str, out))

    got = solutions(left, "x").optional(solutions(right, "y"))
    assert sorted(str(tuple(r)) for r in got.values("x", "a", "b", "y").collect()) == joined(lambda y: True)
    got = solutions(left, "x").optional(solutions(right, "y"), condition=lambda s: F.col("y") > "r4")
    assert sorted(str(tuple(r)) for r in got.values("x", "a", "b", "y").collect()) == joined(lambda y: y[0] > "r4")
    chained = got.optional(solutions([("q1", "1", None), ("q2", None, "2")], "z"))
    assert chained.maybe == {"a", "b", "y", "z"} and chained.df.count() >= len(left)
