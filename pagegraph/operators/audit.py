"""Data-quality audits and comparisons of datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import fixed
from pagegraph.functions.text import casefold, user_name
from pagegraph.functions.wiki import url_host


def user_name_matches(
    users: DataFrame, wikis: Sequence[str], actor: DataFrame, recentchanges: DataFrame, floor: str
) -> DataFrame:
    """Per wiki and listed user: spellings in the actor table, hits and latest time in the changes.

    Changes are counted per actor before names come in, so a busy actor is one line. ``wikis``
    are the selected names of the request; every listed user is reported for each of them.
    """
    names = users.select(user_name(F.col("user_name")).alias("user_name")).where(F.col("user_name").isNotNull()).distinct()
    listed = names.withColumn("_key", casefold(F.col("user_name")))
    spellings = names.select(F.col("user_name").alias("actor_name"))
    actors = actor.join(spellings, "actor_name", "left_semi").withColumn("_key", casefold(user_name(F.col("actor_name"))))
    activity = (
        recentchanges.where(F.col("rc_timestamp") >= floor)
        .groupBy("wiki", F.col("rc_actor").alias("actor_id"))
        .agg(F.count(F.lit(1)).alias("_hits"), F.max("rc_timestamp").alias("_latest"))
    )
    seen = (
        actors.join(activity, ["wiki", "actor_id"], "left")
        .groupBy("wiki", "_key")
        .agg(
            F.array_sort(F.collect_set("actor_name")).alias("actor_values"),
            F.array_sort(F.collect_set(F.when(F.col("_hits") > 0, F.col("actor_name")))).alias("change_values"),
            F.coalesce(F.sum("_hits"), F.lit(0)).alias("hits"),
            F.max("_latest").alias("latest"),
        )
    )
    every = listed.withColumn("wiki", F.explode(F.array(*[F.lit(w) for w in wikis])))
    report = every.join(seen, ["wiki", "_key"], "left")
    hits = F.coalesce(F.col("hits"), F.lit(0))
    match = F.col("actor_values").isNotNull() | (hits > 0)
    return report.select(
        "wiki",
        "user_name",
        "actor_values",
        "change_values",
        hits.alias("hits"),
        "latest",
        F.when(match, F.lit("match")).otherwise(F.lit("not_found")).alias("status"),
    )


def enrichment_coverage(links: DataFrame, allowed_missing: Sequence[str] = ()) -> DataFrame:
    """Totals over distinct links (uri, qid, page_len, rev_timestamp)."""
    one = _distinct_links(links)
    length, stamp = F.col("page_len").isNotNull(), F.col("rev_timestamp").isNotNull()
    some = lambda test: F.count(F.when(test, 1))
    return one.agg(
        F.count(F.lit(1)).alias("links_total"),
        some(F.col("qid").isNotNull()).alias("links_with_qid"),
        some(length).alias("links_with_page_len"),
        some(stamp).alias("links_with_rev_timestamp"),
        some(length & stamp).alias("links_with_both"),
        some(~(length & stamp) & F.col("uri").isin(*allowed_missing)).alias("allowed_missing"),
    )


def missing_by_host(links: DataFrame, top: int | None = None, allowed_missing: Sequence[str] = ()) -> DataFrame:
    """Hosts by links that lack a length or a time, most first, ties by host; all of them unless ``top`` is given."""
    gaps = _distinct_links(links).where(
        (F.col("page_len").isNull() | F.col("rev_timestamp").isNull()) & ~F.col("uri").isin(*allowed_missing)
    )
    host = F.coalesce(url_host(F.col("uri")), F.lit("unknown")).alias("host")
    ranked = gaps.groupBy(host).agg(F.count(F.lit(1)).alias("missing")).orderBy(F.desc("missing"), F.asc("host"))
    return ranked if top is None else ranked.limit(top)


def missing_reason(page_len: Column, rev_timestamp: Column, enriched: Column) -> Column:
    reasons = F.array(
        F.when(~enriched, F.lit("no_enrichment_payload")),
        F.when(page_len.isNull(), F.lit("missing_page_len")),
        F.when(rev_timestamp.isNull(), F.lit("missing_rev_timestamp")),
    )
    return F.array_join(reasons, ",")


def _distinct_links(links: DataFrame) -> DataFrame:
    return links.groupBy("uri").agg(
        F.max("qid").alias("qid"), F.max("page_len").alias("page_len"), F.max("rev_timestamp").alias("rev_timestamp")
    )


def sample_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("wiki_domain", "namespace").agg(F.count(F.lit(1)).alias("records"))


def dataset_diff(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], length: str = "page_len") -> DataFrame:
    """(key, status): only_left, only_right, equal, tolerated or mismatch.

    A mismatch is tolerated where the right side is a very short page, which is what a redirect
    looks like.
    """
    a = left.select(key, F.struct(*columns).alias("_a"))
    b = right.select(key, F.struct(*columns).alias("_b"))
    short = F.coalesce((F.col("_b")[length] >= 0) & (F.col("_b")[length] < fixed.REDIRECT_PAGE_LENGTH), F.lit(False))
    status = (
        F.when(F.col("_b").isNull(), F.lit("only_left"))
        .when(F.col("_a").isNull(), F.lit("only_right"))
        .when(F.col("_a") == F.col("_b"), F.lit("equal"))
        .when(short, F.lit("tolerated"))
        .otherwise(F.lit("mismatch"))
    )
    return a.join(b, key, "full").select(key, status.alias("status"))


def uri_parity(records: DataFrame, articles: DataFrame) -> DataFrame:
    """Compare record addresses with a reference graph's articles (qid, site_url, article).

    The expected address is looked up by equality; the alternative shown otherwise is the
    smallest one, so no list of addresses is gathered.
    """
    keyed = articles.select(
        F.col("qid").alias("wikidata_id"), "site_url", F.col("article").alias("page_url"), F.lit(True).alias("_hit")
    ).distinct()
    first = articles.groupBy(F.col("qid").alias("wikidata_id"), "site_url").agg(F.min("article").alias("_first"))
    joined = records.join(keyed, ["wikidata_id", "site_url", "page_url"], "left").join(
        first, ["wikidata_id", "site_url"], "left"
    )
    matched = F.coalesce(F.col("_hit"), F.lit(False))
    shown = F.when(matched, F.col("page_url")).otherwise(F.coalesce(F.col("_first"), F.lit("(missing)")))
    return joined.select(*records.columns, shown.alias("reference_uri"), matched.alias("matched"))
