"""Fill-in-middle against its contract restated, exact round trips and edge cases."""

import hashlib
import random
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from pagegraph.llm import infill
from pagegraph.llm.queries import QUERIES


def restate(ident, text, rate=100, suffix_first=50, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text, re.S)
    h = hashlib.sha256(("7:" + ("" if ident is None else str(ident))).encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return n, "spm", len(prefix), len(middle), "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return n, "psm", len(prefix), len(middle), "<P>" + prefix + "<S>" + suffix + "<M>" + middle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark, tables, rows):
    expected = []
    for i, t in tables("documents", "doc_id", "text"):
        *head, output = restate(i, t)
        expected.append((i, *head, sha(output), sha(t or "")))
    assert sorted(rows(QUERIES["op11_infill"](spark, SF))) == sorted(expected)
    assert {e[2] for e in expected} >= {"psm", "spm"}


@pytest.mark.parametrize("unit", ["line", "char"])
@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_borders_in_every_block_size(unit, block):
    rng = random.Random(block)
    for _ in range(60):
        text = "".join(rng.choice("ab\né漢🙂\n\r") for _ in range(rng.randint(0, 70)))
        units = re.findall(r"[^\n]*\n|[^\n]+" if unit == "line" else r".", text, re.S)
        index = infill.UnitIndex(text.encode(), unit, block)
        assert index.units == len(units) and index.chars == len(text)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert index.border(k) == (len(head.encode()), len(head))


def test_descent_finds_the_block():
    import numpy as np

    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 8, 13, 100):
        counts = rng.integers(0, 4, (size, 2))
        tree = infill.Fenwick(counts)
        ends = np.cumsum(counts[:, 0])
        assert tree.total() == tuple(counts.sum(axis=0))
        for k in range(1, int(ends[-1]) + 1):
            b = int(np.searchsorted(ends, k))
            assert tree.descend(k) == (b, int(ends[b] - counts[b, 0]), int(counts[:b, 1].sum()))


def test_edges(spark):
    data = [(1, None), (2, ""), (3, "\n"), (4, "\n\n\nx"), (5, "a <S> b\nc"), (6, "one line"), (None, "a\nb\nc\n"), (7, "é\n漢🙂\r\n" * 200_000)]
    data += [(8, "<\nP\n>S>\n<"), (8, "<\nP\n>S>\n<"), (8, "other\ntext\n"), (9, "x" * 3_000_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("id", F.lit("clash"))
    found = infill.fill_in_middle(docs).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    expected = sorted(((i, *restate(i, t), t or "") for i, t in data), key=str)
    assert sorted((tuple(r) for r in found), key=str) == expected
    assert infill.fill_in_middle(docs.where("false")).count() == 0


@pytest.mark.parametrize("rate, suffix_first", [(0, 50), (60, 100), (100, 0)])
def test_rates_and_characters(spark, rate, suffix_first):
    data = [(i, "añ\nb漢 %d" % i) for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = infill.fill_in_middle(docs, unit="char", rate=rate, suffix_first=suffix_first)
    back = found.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    expected = sorted((i, *restate(i, t, rate, suffix_first, r"."), t) for i, t in data)
    assert sorted(tuple(r) for r in back) == expected
