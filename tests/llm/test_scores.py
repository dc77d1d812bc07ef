"""Language-model scores against a plain restatement."""

import math
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from pagegraph.llm import ppm
from pagegraph.llm.queries import QUERIES


def plain_ppm(train, texts, order):
    """Byte by byte: longest context first, method D escapes, exclusion of bytes already ruled out."""
    counts = defaultdict(Counter)
    for words in train:
        data = bytes([ppm.END]) * order + b" ".join(words) + bytes([ppm.END])
        for p in range(order, len(data)):
            for k in range(order + 1):
                counts[data[p - k : p]][data[p]] += 1
    out = []
    for words in texts:
        data, score = bytes([ppm.END]) * order + b" ".join(words) + bytes([ppm.END]), 0.0
        for p in range(order, len(data)):
            gone, found = set(), False
            for k in range(order, -1, -1):
                seen = {b: n for b, n in counts[data[p - k : p]].items() if b not in gone}
                if not seen:
                    continue
                bottom = 2 * sum(seen.values())
                if data[p] in seen:
                    score += math.log10((2 * seen[data[p]] - 1) / bottom)
                    found = True
                    break
                score += math.log10(len(seen) / bottom)
                gone |= set(seen)
            if not found:
                score -= math.log10(256 - len(gone))
        out.append(score)
    return out


def test_scores_query(spark, tables):
    docs = tables("documents", "doc_id", "text")
    found = sorted(QUERIES["op10_ppm"](spark, SF).collect())
    for r, e in zip(found, brute.unigram(docs), strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:5]
        assert r.base_score == pytest.approx(e[5])
        assert r.score < 0


def test_model_equals_plain_ppm(spark):
    texts = ["the cat sat", "the dog sat on the mat", "", None, "a\n\tb é", "THE END"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = ppm.fit(df)
    train = [ppm.words_of(t, True) for t in texts]
    probe = train + [ppm.words_of(t, True) for t in ("unseen zebra", "the the the", "ÿ", "the dot")]
    assert list(ppm.code_lengths(model, probe)) == pytest.approx(plain_ppm(train, probe, ppm.ORDER), rel=1e-5)


def test_model_is_a_distribution_and_keeps_its_bound(spark, tables):
    df = spark.read.parquet(SF + "/documents.parquet")
    model = ppm.expanded(ppm.fit(df, contexts=500))
    assert 1 < len(model["child"]) <= 500
    used = int((model["column"] < model["log10"].shape[1] - 1).sum())
    mass = (10.0 ** model["log10"][:, :used].astype(float)).sum(axis=1) + (256 - used) * 10.0 ** model["log10"][:, used].astype(float)
    assert np.allclose(mass, 1, atol=1e-4)


def test_longer_contexts_help_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", ppm.held_out(F.col("doc_id")))
    probe = [ppm.words_of(r.text, True) for r in docs.where("held").collect()]
    scores = [ppm.code_lengths(ppm.fit(docs.where("not held"), order=k), probe).sum() for k in (1, 3, 5)]
    assert scores == sorted(scores)


def test_scores_edges(spark, rows, monkeypatch):
    monkeypatch.setattr(ppm, "BATCH_BYTES", 50)
    data = [(3, "A a b"), (3, "A a b"), (None, None), (20, ""), (21, " \n"), (22, "long " * 5000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("score", F.lit("y"))
    got = ppm.score_texts(df)
    assert {r.id: r.n_tokens for r in got.collect()} == {3: 4, None: 1, 20: 1, 21: 1, 22: 5001}
    assert ppm.score_texts(df.where("false")).count() == 0
    only = ppm.score_texts(df.where("doc_id = 3")).collect()
    assert [round(r.base_score, 6) for r in only] == [round(e[5], 6) for e in brute.unigram([(3, "A a b"), (3, "A a b")])]


def test_scores_use_every_context(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 3 = 0 and n_chars < 4000").withColumn("held", ppm.held_out(F.col("doc_id")))
    texts = {r.doc_id: (r.held, ppm.words_of(r.text, True)) for r in docs.collect()}
    train = [w for h, w in texts.values() if not h]
    ids = sorted(i for i, (h, _) in texts.items() if h)[:20] + sorted(i for i, (h, _) in texts.items() if not h)[:20]
    got = {r.id: r.score for r in ppm.score_texts(docs).collect()}
    assert [got[i] for i in ids] == pytest.approx(plain_ppm(train, [texts[i][1] for i in ids], ppm.ORDER), rel=1e-5)


@pytest.mark.parametrize("count", [0, 1, 70_000, 1 << 17])
def test_values_of_grams(count):
    """Every gram of a batch gets its own value back in its own place, in batches longer than a run."""
    rng = np.random.default_rng(count)
    grams = np.append(rng.integers(0, 1 << 12, count) ** 4, [(1 << 48) - 1, 0, (1 << 48) - 1])
    names = ppm._distinct(grams)
    assert names.tolist() == sorted(set(grams.tolist()))
    value = rng.random(len(names))
    known = dict(zip(names.tolist(), value.tolist(), strict=True))
    assert ppm.values_at(grams, names, value).tolist() == [known[g] for g in grams.tolist()]
    assert len(ppm._distinct(grams[:0])) == len(ppm.values_at(grams[:0], names, value)) == 0


def test_scores_without_training_rows(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(100)], "doc_id long, text string").where(ppm.held_out(F.col("doc_id")))
    assert {round(r.score, 4) for r in ppm.score_texts(df).collect()} == {round(-4 * math.log10(256), 4)}
