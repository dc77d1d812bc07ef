"""From raw documents to token ids: the training-data pipeline, one stage after another.

Stages take and give the columns of ``documents`` (the last gives token ids). Null and empty texts are
clean documents: they pass all filters and leave where words are mixed, since they have none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagegraph.llm import bpe, jaccard, mixing, substring, toxicity
from pagegraph.llm.queries import table, vocabulary_path
from pagegraph.session import ensure_checkpoint_dir

#: no SQL: a learned score and a tokenizer are among the stages
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted to be toxic. The labels come from the table ``labels``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model).where("predicted = 0").select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Rows that share an id are one document: of several with words one stays. Rows without an id are in
    no group and stay.
    """
    groups = jaccard.similar_groups(docs).where("id is not null").groupBy("id")
    groups = groups.agg(F.min("component_id").alias("head"), F.max("n_shingles").alias("n"), F.count("*").alias("rows"))
    marks = groups.where("id <> head or (rows > 1 and n > 0)").select(F.col("id").alias("_id"), F.col("head").alias("_head"))
    joined = docs.join(marks, F.col("doc_id") == F.col("_id"), "left").where("_id is null or _id = _head")
    own = F.xxhash64("text")
    turn = F.row_number().over(Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), own)).orderBy(own))
    return joined.withColumn("_turn", turn).where("_id is null or _turn = 1").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that appear earlier; texts without such passages stay as they are.

    A document all of whose words appear earlier goes.
    """
    cut = substring.remove_repeats(docs).where("n_words = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    out = cut.withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
    chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them: once per pass, the last of a source cut at its target."""
    return mixing.mixed_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    back = bpe.round_trip(docs, vocabulary_path())
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return back.select("doc_id", "lang", "source", "n_tokens", "token_ids", same.alias("decodes_back"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("bpe_tokens", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to shared storage and read again by the next."""
    folder = "{}/pipeline-{}".format(ensure_checkpoint_dir(spark), uuid.uuid4().hex)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = "{}/{}".format(folder, name)
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
