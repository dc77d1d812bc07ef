"""Landed API responses: event lists, member lists and page lookups.

Responses land as JSON text (plain or gzip), one response per line, together with the wiki they
came from and their place in the continuation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.functions.text import integer, page_title, qid, user_name
from pagegraph.functions.times import numeric_time, xsd_datetime

LIST_NAMES = ["logevents", "usercontribs", "categorymembers"]


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(wiki, seq, response) from JSON lines; ``.gz`` files are read by the codec."""
    return spark.read.schema("wiki string, seq bigint, response string").json(path)


def feed_rows(responses: DataFrame, list_name: str) -> DataFrame:
    """One row per listed entry, in continuation order (seq, position)."""
    doc = F.try_parse_json(F.col("response"))
    entries = F.try_variant_get(doc, "$.query." + list_name, "array<variant>")
    exploded = responses.select("wiki", "seq", F.posexplode_outer(entries).alias("position", "entry"))
    text = lambda name: F.try_variant_get("entry", "$." + name, "string")
    stamp = text("timestamp")
    return exploded.where(F.startswith(F.schema_of_variant("entry"), F.lit("OBJECT"))).select(
        "wiki",
        "seq",
        F.col("position").cast("bigint").alias("position"),
        integer(text("pageid")).alias("page_id"),
        integer(F.coalesce(text("ns"), F.lit("0"))).alias("namespace"),
        page_title(text("title")).alias("title"),
        user_name(text("user")).alias("user_name"),
        text("sortkeyprefix").alias("sort_key"),
        stamp.alias("timestamp"),
        numeric_time(stamp).alias("time_key"),
    )


def creation_rows(responses: DataFrame) -> DataFrame:
    return feed_rows(responses, "logevents").where(F.col("page_id").isNotNull() & F.col("namespace").isNotNull())


def contribution_rows(responses: DataFrame) -> DataFrame:
    rows = feed_rows(responses, "usercontribs")
    return rows.where(F.col("page_id").isNotNull() & F.col("namespace").isNotNull() & F.col("time_key").isNotNull())


def member_rows(responses: DataFrame) -> DataFrame:
    return feed_rows(responses, "categorymembers").where(F.col("title") != "")


def page_length(value: Column) -> Column:
    """Whole, non-negative page length or null."""
    number = integer(value)
    return F.when(number >= 0, number)


def page_lookup_rows(responses: DataFrame) -> DataFrame:
    """Enrichment row per page of a lookup response; the last entry of a title wins."""
    doc = F.try_parse_json(F.col("response"))
    pages = F.try_variant_get(doc, "$.query.pages", "array<variant>")
    rows = responses.select("wiki", "seq", F.posexplode_outer(pages).alias("position", "page"))
    text = lambda path: F.try_variant_get("page", path, "string")
    lookup = rows.select(
        "wiki",
        page_title(text("$.title")).alias("title"),
        F.struct("seq", "position").alias("_place"),
        F.struct(
            qid(text("$.pageprops.wikibase_item")).alias("qid"),
            page_length(text("$.length")).alias("page_len"),
            xsd_datetime(text("$.revisions[0].timestamp")).alias("rev_timestamp"),
        ).alias("_row"),
    ).where(F.col("title") != "")
    return lookup.groupBy("wiki", "title").agg(F.max_by("_row", "_place").alias("_row")).select("wiki", "title", "_row.*")


def alias_rows(responses: DataFrame) -> DataFrame:
    """(wiki, source, target) of the title aliases; a redirect overrides a normalization."""
    doc = F.try_parse_json(F.col("response"))
    parts = []
    for rank, name in enumerate(["normalized", "redirects"]):
        entries = F.try_variant_get(doc, "$.query." + name, "array<variant>")
        rows = responses.select("wiki", "seq", F.posexplode(entries).alias("position", "entry"))
        parts.append(
            rows.select(
                "wiki",
                page_title(F.try_variant_get("entry", "$.from", "string")).alias("source"),
                page_title(F.try_variant_get("entry", "$.to", "string")).alias("target"),
                F.struct("seq", F.lit(rank).alias("kind"), "position").alias("_place"),
            )
        )
    both = parts[0].unionByName(parts[1]).where((F.col("source") != "") & (F.col("target") != ""))
    return both.groupBy("wiki", "source").agg(F.max_by("target", "_place").alias("target"))
