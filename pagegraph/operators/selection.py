"""Selection of wikis by short tokens, host names and wildcards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import fixed
from pagegraph.functions.wiki import canonical_token, clean_host, host_valid, token_domain, wiki_token


def supported(wiki_group: Column, domain: Column) -> Column:
    return wiki_group.isin(*fixed.SUPPORTED_GROUPS) | domain.isin(*fixed.SUPPORTED_SPECIAL_DOMAINS)


def domain_suffixes(domain: Column) -> Column:
    """``.b.c`` and ``.c`` of ``a.b.c``: what a wildcard can match."""
    labels = F.split(domain, r"\.")
    return F.transform(
        F.when(F.size(labels) > 1, F.sequence(F.lit(2), F.size(labels))),
        lambda i: F.concat(F.lit("."), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )


def select_wikis(requests: DataFrame, wikis: DataFrame, column: str = "token") -> DataFrame:
    """(request, domain, status) with status selected, unsupported, unknown or invalid.

    A wildcard selects the supported wikis below it; it is matched by equality on the domain's
    own suffixes, so no pairwise comparison of requests and wikis takes place.
    """
    asked = requests.select(
        F.explode(F.split(F.col(column), ",")).alias("_part")
    ).select(clean_host(F.col("_part")).alias("request")).where(F.col("request") != "").distinct()
    dim = wikis.select(
        "domain", "wiki_group", canonical_token(F.col("domain"), F.col("wiki_group"), F.col("lang_code")).alias("_token")
    )
    ok = supported(F.col("wiki_group"), F.col("domain"))
    wild = F.startswith(F.col("request"), F.lit("*."))
    suffix = F.substring(F.col("request"), F.lit(2), F.length("request"))
    stars = asked.where(wild).select("request", suffix.alias("_suffix"), host_valid(F.substring(F.col("request"), F.lit(3), F.length("request"))).alias("_valid"))
    below = dim.where(ok).select("domain", F.explode(domain_suffixes(F.col("domain"))).alias("_suffix"))
    by_star = stars.join(below, "_suffix", "left").select(
        "request",
        "domain",
        F.when(~F.col("_valid"), F.lit("invalid"))
        .when(F.col("domain").isNull(), F.lit("unknown"))
        .otherwise(F.lit("selected"))
        .alias("status"),
    )
    named = asked.where(~wild).withColumn("_token", wiki_token(F.col("request")))
    named = named.withColumn("_domain", F.when(F.col("_token").isNotNull(), token_domain(F.col("_token"))))
    by_domain = dim.select(F.col("domain").alias("_domain"), F.col("wiki_group").alias("_g1"), F.lit(1).alias("_hit"))
    by_token = dim.groupBy("_token").agg(F.min_by(F.struct("domain", "wiki_group"), "domain").alias("_by_token"))
    found = named.join(by_domain, "_domain", "left").join(by_token, "_token", "left")
    domain = F.when(F.col("_hit") == 1, F.col("_domain")).otherwise(F.col("_by_token.domain"))
    group = F.when(F.col("_hit") == 1, F.col("_g1")).otherwise(F.col("_by_token.wiki_group"))
    status = (
        F.when(F.col("_token").isNull(), F.lit("invalid"))
        .when(domain.isNull(), F.lit("unknown"))
        .when(supported(group, domain), F.lit("selected"))
        .otherwise(F.lit("unsupported"))
    )
    by_name = found.select("request", F.coalesce(domain, F.col("_domain")).alias("domain"), status.alias("status"))
    return by_star.unionByName(by_name)


def selected_domains(selection: DataFrame) -> DataFrame:
    return selection.where(F.col("status") == "selected").select("domain").distinct()
