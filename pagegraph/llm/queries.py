"""The registered query of every operator: whole tables, production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.llm import bpe, infill, jaccard, mixing, neardup, nearest, ppm, sharding, substring, topk, toxicity, trie, warc
from pagegraph.llm.oracles import ORACLES  # noqa: F401  the SQL beside the queries
from pagegraph.session import ensure_checkpoint_dir

#: name of the vocabulary file of ``op3`` and of the pipeline
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    """Place of the public vocabulary file, as installed beside the tokenizer libraries."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet("{}/{}.parquet".format(sf_dir, name))


def scratch(spark: SparkSession, kind: str) -> str:
    """New folder in the session's shared checkpoint storage."""
    return "{}/{}-{}".format(ensure_checkpoint_dir(spark), kind, uuid.uuid4().hex)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every query vector, no random access."""
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    rows = rows.select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feistel shuffle of all documents into 16 shards."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = sharding.shard_rows(rows, 16, "doc_id", "size", "text_crc32")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.round_trip(docs, vocabulary_path())
    return back.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of equally labelled vectors with cosine of at least 0.93."""
    return neardup.link_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes."""
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document from its nearest labelled examples."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = ~toxicity.trained(F.col("doc_id"))
    return toxicity.score_texts(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "evidence")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose five-word shingles overlap by 80 of 100 or more."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    folder = scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.archived_payloads(warc.read_archive(spark, folder))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left when passages of 20 words or more that appeared before are taken out."""
    cut = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and byte-model score of every document."""
    return ppm.score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for infilling, and rebuilt from that."""
    cut = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    back = infill.restored(F.col("output"), F.col("form"))
    digests = [F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (back, "restored_sha256"))]
    return cut.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every query vector, from a written graph index of all vectors."""
    vectors, folder = table(spark, sf_dir, "embeddings"), scratch(spark, "graph")
    nearest.build_index(vectors, keep=11).write.parquet(folder)
    return nearest.search_index(spark.read.parquet(folder), vectors.where("vec_id % 100 = 0"), 10)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations with the totals of its subtrees."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_sharding": op2_sharding,
    "op3_bpe": op3_bpe,
    "op4_neardup": op4_neardup,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard": op7_jaccard,
    "op8_warc": op8_warc,
    "op9_substring": op9_substring,
    "op10_ppm": op10_ppm,
    "op11_infill": op11_infill,
    "op12_nearest": op12_nearest,
    "op13_trie": op13_trie,
}
