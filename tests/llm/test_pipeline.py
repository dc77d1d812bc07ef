"""The pipeline against its stages restated plainly, and each stage's edge cases."""

import brute
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagegraph.llm import mixing
from pagegraph.llm.queries import QUERIES, vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "mixing", "bpe_tokens"]


def test_pipeline_equals_its_stages_restated(spark, tables):
    docs = {r[0]: r for r in tables("documents", "doc_id", "text", "source")}
    toxic = {r.doc_id for r in QUERIES["op6_toxicity"](spark, SF).collect() if r.predicted == 1}
    kept = [(i, t) for i, t, _ in docs.values() if i not in toxic]
    heads = {i for i, _, c in brute.shingle_classes(kept) if i == c}
    kept = sorted((i, t) for i, t in kept if i in heads)
    first, left = {}, []
    for i, t in kept:
        words = brute.word_list(t)
        gone = set()
        for s in range(len(words) - 19):
            if first.setdefault(tuple(words[s : s + 20]), (i, s)) != (i, s):
                gone |= set(range(s, s + 20))
        if not words or len(gone) < len(words):
            left.append((i, " ".join(w for k, w in enumerate(words) if k not in gone) if gone else t, docs[i][2]))
    frame = spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in left], DOCS)
    library = Tokenizer.from_file(vocabulary_path())
    expected = sorted(
        (r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids)) for r in mixing.mixed_documents(frame).collect()
    )
    found = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in found.collect()) == expected
    assert found.where("not decodes_back").count() == 0


@pytest.fixture(scope="module")
def odd(spark):
    text = " ".join("w%d" % i for i in range(40))
    data = [(1, text), (1, text), (2, text), (3, None), (4, ""), (5, "short text"), (None, "no id here"), (None, "no id here"), (6, "x " * 3000)]
    df = spark.createDataFrame([(i, t, "en", None if i == 5 else "s", 7) for i, t in data], DOCS)
    return df.withColumn("score", F.lit("clash"))


def test_stages_keep_columns_and_clean_documents(spark, odd):
    for name in ("toxicity", "ngram_jaccard", "substring_dedup", "mixing"):
        out = STAGES[name](spark, odd, SF)
        assert out.columns == odd.columns, name
        out.count()
        assert STAGES[name](spark, odd.where("false"), SF).count() == 0
    once = STAGES["ngram_jaccard"](spark, odd, SF).collect()
    assert sorted(str(r.doc_id) for r in once) == sorted(["1", "3", "4", "5", "6", "None", "None"])
    cut = {r.doc_id: r for r in STAGES["substring_dedup"](spark, odd, SF).collect()}
    assert 2 not in cut and cut[1].n_chars == 7 and cut[3].text is None and cut[4].text == ""
    assert cut[6].text == "x" and cut[6].n_chars == 1
    assert STAGES["bpe_tokens"](spark, odd, SF).where("decodes_back").count() == odd.count()
