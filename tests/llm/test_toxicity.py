"""Toxicity: the search against all cosines, accuracy on held-out labels, edge cases."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegraph.llm import toxicity
from pagegraph.llm.queries import QUERIES

SF, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.001"


def random_texts(rng, count, words=60, longest=12):
    return [" ".join("w%d" % w for w in (words * rng.random(rng.integers(0, longest)) ** 2).astype(int)) for _ in range(count)]


def plain_cosines(example_texts, labels, all_texts, queries, by_label):
    """TF-IDF cosines of the queries and the examples, from the texts alone."""
    counts = [Counter(re.findall(r"\w+", t.lower())) for t in all_texts]
    held = Counter(w for c in counts for w in c)
    examples = [Counter(re.findall(r"\w+", t.lower())) for t in example_texts]
    n, known = len(examples), {w for c in examples for w in c}
    ones = sum(labels)

    def factor(word):
        idf = math.log((1 + len(all_texts)) / (1 + held[word])) + 1
        if not by_label:
            return idf
        a = sum(word in c for c, y in zip(examples, labels, strict=True) if y)
        b = sum(word in c for c, y in zip(examples, labels, strict=True) if not y)
        bottom = (a + b) * (n - a - b) * ones * (n - ones)
        return idf * max(toxicity.FLOOR, abs(a * (n - ones - b) - b * (ones - a)) / math.sqrt(bottom) if bottom else 0)

    factors = {w: factor(w) for w in known}
    other = (math.log(1 + len(all_texts)) + 1) * (toxicity.FLOOR if by_label else 1)

    def unit(c):
        v = {w: (1 + math.log(k)) * factors.get(w, other) for w, k in c.items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / length for w, x in v.items()}

    vectors = [unit(c) for c in examples]
    return [[sum(x * v.get(w, 0) for w, x in unit(Counter(re.findall(r"\w+", q.lower()))).items()) for v in vectors] for q in queries]


@pytest.mark.parametrize("by_label", [True, False])
@pytest.mark.parametrize("count", [1, 40, 700])
def test_search_equals_brute_force_from_texts(count, by_label, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    monkeypatch.setattr(toxicity, "VISIT", 3)
    rng = np.random.default_rng(count)
    texts = random_texts(rng, count)
    labels = [int(y) for y in rng.random(count) < 0.3]
    queries = random_texts(rng, 25) + ["", "strange words", texts[0], "w0 " * 50]
    rows = [(i + 7, y, *toxicity.terms_of(t)) for i, (t, y) in enumerate(zip(texts, labels, strict=True))]
    terms = np.unique(np.concatenate([r[2] for r in rows]))
    held = np.array([sum(t in r[2] for r in rows) for t in terms], int)
    model = toxicity._indexed(rows, terms, held, count, {0: 900, 1: 100}, by_label)
    search = toxicity.BlockMaxIndex(model)
    expected = plain_cosines(texts, labels, texts, queries, by_label)
    place = {i: k for k, i in enumerate(model["ids"].tolist())}
    found = search.nearest([search.vector(*toxicity.terms_of(q)) for q in queries], 16)
    for (near, cosine), cosines in zip(found, expected, strict=True):
        true = sorted((-c, place[i + 7]) for i, c in enumerate(cosines) if c > 1e-15)[:16]
        assert np.allclose(cosine, [-c for c, _ in true], atol=1e-12)
        assert all(abs(cosines[int(model["ids"][p]) - 7] - c) < 1e-12 for p, c in zip(near, cosine, strict=True))
    if count == 700:
        assert search.visited < 0.9 * len(queries) * search.blocks


def test_keys_are_those_of_the_words(monkeypatch):
    """Equal words have equal keys wherever they stand, also in texts read piece by piece."""
    rng = np.random.default_rng(5)
    letters = list("abcÀσΣİßé9_²字\U00020000 \t\n.-'\u0301\ud800\x00")
    texts = ["".join(rng.choice(letters, n)) for n in (0, 1, 2, 50, 3000)] + ["a" * 500, " ", None, "x y"]
    for piece in (1, 7, 1 << 16):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        keys = {}
        for text in texts:
            words, found = re.findall(r"\w+", (text or "").lower()), toxicity.keys_in(text).tolist()
            assert len(words) == len(found)
            assert all(keys.setdefault(w, k) == k for w, k in zip(words, found, strict=True))
            terms, counts = toxicity.terms_of(text)
            assert Counter(dict(zip(terms.tolist(), counts.tolist(), strict=True))) == Counter(found)
        assert len(set(keys.values())) == len(keys) > 300


@pytest.mark.parametrize("postings", [1, 300, 1 << 17])
def test_search_of_texts_in_groups(postings, monkeypatch):
    """Texts searched together find what each finds alone, however many are taken at once."""
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    monkeypatch.setattr(toxicity, "POSTINGS", postings)
    rng = np.random.default_rng(11)
    texts = random_texts(rng, 300, words=400, longest=30)
    rows = [(i, i % 3 == 0, *toxicity.terms_of(t)) for i, t in enumerate(texts)]
    terms = np.unique(np.concatenate([r[2] for r in rows]))
    search = toxicity.BlockMaxIndex(toxicity._indexed(rows, terms, np.ones(len(terms), int), 300, {0: 200, 1: 100}, True))
    vectors = [search.vector(*toxicity.terms_of(t)) for t in ["", *texts[:40], "strange words"]]
    for (near, cosine), alone in zip(search.nearest(vectors, 9), vectors, strict=True):
        own, exact = search.nearest([alone], 9)[0]
        assert np.allclose(cosine, exact, atol=1e-12) and len(near) == len(own) <= 9
        assert np.allclose(cosine[near != own], exact[near != own], atol=1e-12)


def test_query_neighbours_from_texts(spark, tables):
    """Evidence of the query on the small tables is the brute-force neighbourhood."""
    texts = dict(tables("documents", "doc_id", "text"))
    labels = {i: y for i, y in tables("labels", "doc_id", "toxic") if y is not None and i in texts and zlib.crc32(str(i).encode()) % 5}
    examples = sorted(labels)
    found = {r.doc_id: r.evidence for r in QUERIES["op6_toxicity"](spark, SMALL).collect()}
    some = sorted(texts)[::9]
    cosines = plain_cosines([texts[i] or "" for i in examples], [labels[i] for i in examples], [t or "" for t in texts.values()], [texts[i] or "" for i in some], True)
    for i, row in zip(some, cosines, strict=True):
        near = {e.doc_id: e.cosine for e in found[i]}
        assert np.allclose(sorted(near.values()), sorted(c for c in row if c > 1e-15)[-16:], atol=1e-9)
        assert all(abs(row[examples.index(j)] - c) < 1e-9 for j, c in near.items())


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(SF + "/labels.parquet").collect()}
    found = QUERIES["op6_toxicity"](spark, SF).collect()
    assert len(found) == spark.read.parquet(SF + "/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [(labels[r.doc_id], r.score) for r in found if r.held_out and labels.get(r.doc_id) is not None]
    ones, zeros = [s for y, s in held if y == 1], [s for y, s in held if y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
    assert wins / (len(ones) * len(zeros)) > 0.95
    near = [e for r in found for e in r.evidence]
    assert near and all(labels[e.doc_id] == e.label and 0 < e.cosine < 1.0001 for e in near)


def test_scores_do_not_use_other_columns(spark):
    docs = spark.read.parquet(SMALL + "/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(SMALL + "/labels.parquet"))
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 10**6})
    a = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    b = {r.doc_id - 10**6: r.score for r in toxicity.score_texts(moved, model).collect()}
    assert a == b


@pytest.mark.parametrize("labelled", [True, False])
def test_edges(spark, labelled):
    bad, good = "you awful idiot person", "what a lovely calm day"
    data = [(i, bad if i % 2 else good) for i in range(40)] + [(40, None), (41, ""), (42, "idiot " * 20000), (None, bad), (1, bad)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = [(i, i % 2) for i in range(40)] + [(1, 1), (50, None), (None, 1), (51, 7)]
    labels = spark.createDataFrame(marks if labelled else [], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    found = toxicity.score_texts(docs, toxicity.fit(docs, labels)).collect()
    assert len(found) == len(data)
    score = {(r.doc_id, r.text): r.score for r in found}
    if labelled:
        assert score[None, bad] > 0.5 > score[0, good] and score[42, "idiot " * 20000] > 0.5
        assert score[40, None] == score[41, ""]
    else:
        assert set(score.values()) == {0.0}
    assert toxicity.score_texts(docs.where("false"), toxicity.fit(docs, labels)).count() == 0


def test_driver_holds_examples_packed(spark):
    """Sixteen bytes and more for every word of every example once went through the driver's Python."""
    rng = np.random.default_rng(5)
    data = [(i, " ".join("w%d" % w for w in rng.integers(0, 6000, 4000))) for i in range(500)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    docs = docs.unionByName(docs.where("doc_id < 20").withColumn("text", F.concat("text", F.lit(" once more")))).localCheckpoint()
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).localCheckpoint()
    tracemalloc.start()
    try:
        model = toxicity.fit(docs, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    built = model["index"].value
    postings = int(toxicity._unpacked(built["held"]).sum())
    assert postings > 700_000 and most < 12 * postings, (postings, most)
    texts = sorted((r.doc_id, r.text) for r in docs.where(toxicity.trained(F.col("doc_id"))).collect())
    rows = [(i, int(i % 3 == 0), *toxicity.terms_of(t)) for i, t in texts]
    terms = np.unique(np.concatenate([r[2] for r in rows]))
    held = np.bincount(np.concatenate([np.searchsorted(terms, r[2]) for r in rows]))
    assert (built["terms"] == terms).all() and (toxicity._unpacked(built["held"]) == held).all()
    # every posting stands in its term's list, at its example's place, with its count
    spots = {}
    for spot, (ident, label) in enumerate(zip(built["ids"].tolist(), built["labels"].tolist(), strict=True)):
        spots.setdefault((ident, label), []).append(spot)
    place, tf = toxicity._unpacked(built["place"]), toxicity._unpacked(built["tf"])
    lists = np.repeat(np.arange(len(terms)), held)
    found = sorted(zip(terms[lists].tolist(), [(int(built["ids"][p]), int(built["labels"][p])) for p in place], tf.tolist(), strict=True))
    assert found == sorted((k, (i, y), n) for i, y, keys, counts in rows for k, n in zip(keys.tolist(), counts.tolist(), strict=True))
    assert all(len(s) == (2 if i < 20 else 1) for (i, _), s in spots.items())
    assert (np.diff(place.astype(int))[np.diff(lists) == 0] > 0).all()
