"""Shingle groups and passage removal against brute force, and their edge cases."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from pagegraph.llm import jaccard, substring
from pagegraph.llm.queries import QUERIES


@pytest.fixture(scope="module")
def near():
    """Texts with copies, near copies of one base, shared passages and short ones."""
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(40, 160))] for _ in range(12)]
    rows = []
    for i in range(260):
        words = list(bases[i % 12 if i % 3 else 0])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words = words[: rng.randint(1, len(words))]
        text = " ".join(words).replace(" ", "\n" if i % 2 else "  ")
        if rng.random() < 0.3:
            text += " " + passage
        rows.append((i, text.upper() if i % 7 == 0 else text))
    return rows + [(1000 + i, t) for i, t in enumerate([None, "", " ", "one two", "one two", "ONE two", "one two three four", "a b c d e"])]


GROUPS = ["id", "n_shingles", "component_id"]


def shingle_links(rows, n=5, near=4, of=5):
    """rows: (id, text) -> (id, links to other rows, smallest id of an equal set), every pair compared."""
    sets = [brute.shingles(t, n) for _, t in rows]
    out = []
    for x, (i, _) in enumerate(rows):
        links, first = 0, i
        for y, (j, _) in enumerate(rows):
            if x != y and i is not None and j is not None and sets[x] and of * len(sets[x] & sets[y]) >= near * len(sets[x] | sets[y]):
                links += 1
                first = min(first, j) if sets[x] == sets[y] else first
        out.append((i, links, first))
    return sorted(out, key=str)


def test_groups_query(spark, tables, rows):
    docs = tables("documents", "doc_id", "text")
    found = QUERIES["op7_jaccard"](spark, SF)
    assert sorted(rows(found, "doc_id", "n_shingles", "component_id")) == brute.shingle_classes(docs)
    assert rows(found, "doc_id", "n_links", "class_id") == shingle_links(docs)


@pytest.mark.parametrize("limit", [1_000_000, 900])
def test_groups(spark, rows, near, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "JOIN_GRAMS", limit)
    df = spark.createDataFrame(near, "doc_id long, text string")
    found = jaccard.similar_groups(df).cache()
    assert sorted(rows(found, *GROUPS)) == brute.shingle_classes(near)
    assert rows(found, "id", "n_links", "class_id") == shingle_links(near)


@pytest.mark.parametrize("gram, part, whole", [(3, 1, 2), (5, 19, 20)])
def test_other_thresholds(spark, rows, near, gram, part, whole):
    df = spark.createDataFrame(near, "doc_id long, text string")
    assert rows(jaccard.similar_groups(df, gram=gram, near=part, of=whole), "id", "n_links", "class_id") == shingle_links(near, gram, part, whole)


def test_pairs_of_classes(spark, rows, near):
    pairs, members = jaccard.linked_pairs(spark.createDataFrame(near, "doc_id long, text string"))
    group = {i: c for i, _, c in brute.shingle_classes(near)}
    of_class = dict(rows(members))
    assert of_class == {i: c for i, _, c in shingle_links(near)}
    roots = brute.roots(group, [tuple(p) for p in pairs.collect()])
    assert {i: roots[of_class[i]] for i in group} == group


def test_groups_edges(spark, rows):
    text = " ".join("w%d" % i for i in range(30))
    data = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, ""), (5, "x " * 50), (6, "X\tx " * 9), (7, text.replace("w7", "v"))]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("n", F.lit(0))
    got = rows(jaccard.similar_groups(df), *GROUPS)
    assert got == sorted([(1, 26, 1), (1, 26, 1), (2, 26, 1), (None, 26, None), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 5), (7, 26, 7)], key=str)
    assert rows(jaccard.similar_groups(df), "id", "n_links", "class_id") == shingle_links(data)
    assert rows(jaccard.similar_groups(df.where("false"))) == []


def test_tree_join_equals_pairs():
    rng = random.Random(2)
    for _ in range(40):
        base = sorted(rng.sample(range(1000), 80))
        sets = []
        for _ in range(rng.randint(2, 25)):
            gone = set(rng.sample(base, rng.randint(0, 14)))
            sets.append(np.array(sorted({*base} - gone | set(rng.sample(range(1000, 1100), rng.randint(0, 9)))), np.int64))
        sizes = np.array([len(s) + rng.randint(0, 3) for s in sets])
        like, weights = jaccard.Similarity(), np.array([rng.randint(1, 4) for _ in sets])
        pairs = {
            (x, y) for x in range(len(sets)) for y in range(x) if like.linked(len(np.intersect1d(sets[x], sets[y])), sizes[x], sizes[y])
        }

        def counts(links):
            out = [0] * len(sets)
            for x, y in links:
                out[x] += weights[y]
                out[y] += weights[x]
            return out

        expected = brute.roots(range(len(sets)), pairs)
        forest, links = jaccard.join_sets(sets, sizes, weights, like)
        assert brute.roots(range(len(sets)), forest) == expected and links.tolist() == counts(pairs)
        half = len(sets) // 2
        across = {(x, y) for x, y in pairs if x >= half > y}
        met, a, b = jaccard.meet_sets(sets[half:], sizes[half:], weights[half:], sets[:half], sizes[:half], weights[:half], like)
        met = [(v + half, y) for v, y in met]
        assert [*b.tolist(), *a.tolist()] == counts(across)
        assert set(met) <= across
        assert brute.roots(range(len(sets)), met) == brute.roots(range(len(sets)), across)


def test_substring_query(spark, tables, rows):
    expected = brute.substring_dedup(tables("documents", "doc_id", "text"))
    assert sorted(rows(QUERIES["op9_substring"](spark, SF))) == expected


@pytest.mark.parametrize("size", [8 << 20, 500])
def test_substring(spark, rows, near, monkeypatch, size):
    monkeypatch.setattr(substring, "BATCH_BYTES", size)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 4096)
    data = [(i, t) for i, t in near] + [(2000, "r s t " * 40), (2001, "u " * 19), (2002, "u " * 21)]
    cut = substring.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"))
    got = rows(cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)))
    assert sorted(got) == brute.substring_dedup(data)


def test_substring_edges(spark, rows):
    text = " ".join("w%d" % i for i in range(25))
    data = [(3, text), (3, text), (None, text), (9, None), (10, ""), (3, "z " + text)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("id", F.lit("x"))
    got = rows(substring.remove_repeats(df), "doc_id", "n_words", "n_removed")
    assert got == sorted([(3, 25, 0), (3, 25, 0), (None, 25, 25), (9, 0, 0), (10, 0, 0), (3, 26, 25)], key=str)
    assert rows(substring.remove_repeats(df.where("false"))) == []


def test_windows_with_one_key_and_two_texts_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring, "window_keys", lambda data, lows, highs: np.full(len(lows), 5, np.uint64))
    docs = [(1, 0, [b"a"] * 20), (2, 0, [b"b"] * 20), (3, 0, [b"a"] * 19 + [b"b"]), (4, 0, [b"b"] * 20)]
    packed = [row for d in docs for row in substring._pack([d], 20, 1, substring.WordKeys())]
    found = substring._repeats(pa.Table.from_pylist(packed, schema=substring._arrow(substring._PACKED)), 20)
    assert found.to_pylist() == [{"id": 4, "text_key": 0, "span_from": 0, "span_to": 20}]


def test_windows_of_a_frequent_minimiser_are_split(spark, rows, monkeypatch):
    monkeypatch.setattr(substring, "BATCH_BYTES", 500)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 1 << 30)
    rng = random.Random(3)
    # words around one phrase differ, so that one minimiser gets a run of each text; some texts are copies
    data = [(i, " ".join(["v%d" % rng.randrange(10**6) for _ in range(19)] + ["a b c"] + ["v%d" % rng.randrange(10**6) for _ in range(19)])) for i in range(80)]
    data += [(100 + i, data[i][1]) for i in range(0, 80, 3)]
    words = substring.WordKeys()

    def key(start):
        return substring.gram_keys(words.of([start.encode(), b"b", b"c"]), 3)[0]

    start = min(("p%d" % k for k in range(3000)), key=key)
    phrase = key(start)
    data = [(i, t.replace(" a b c ", " %s b c " % start)) for i, t in data]
    least = [substring.super_kmers(words.of(substring.words_of(t)), 20)[2] for _, t in data]
    assert sum(phrase in x for x in least) > 10
    df = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(substring, "HEAVY", 40)
    heavy, more = substring.heavy_minimisers(df.select("text"), 20)
    assert phrase in heavy and more > 1
    packed = substring._pack([(i, 0, substring.words_of(t)) for i, t in data], 20, 1, words, heavy, more)
    assert len({row["bucket"] for row in packed}) > 2
    got = rows(substring.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)))
    assert sorted(got) == brute.substring_dedup(data)


def test_other_text_of_a_copied_id_keeps_its_links(spark):
    x, y = (["%s%d" % (c, i) for i in range(60)] for c in "xy")
    data = [(1, " ".join(x)), (2, " ".join(x)), (2, " ".join(y)), (3, " ".join(y[:59]))]
    groups = jaccard.similar_groups(spark.createDataFrame(data, "doc_id long, text string"))
    assert {(r.id, r.component_id) for r in groups.collect()} == {(1, 1), (2, 1), (3, 1)}
