"""Pile payloads: a wiki and a list of page titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions.text import page_title, strip
from pagegraph.sources import large

_PILE = "struct<wiki:string,pages:array<string>>"


def pile_titles(pages: Column, limit: int | None = None) -> Column:
    """Clean titles of one pile, blanks dropped, first of equals kept, in order, up to the limit."""
    titles = F.array_distinct(F.filter(F.transform(pages, page_title), lambda t: t != ""))
    return titles if limit is None else F.slice(titles, 1, limit)


def read_piles(
    payloads: DataFrame, keys: list[str], json_column: str, limit: int | None = None, whole: int | None = large.WHOLE, size: int = large.RANGE
) -> DataFrame:
    """(keys, wiki, position, title); a payload without wiki or pages gives no rows.

    Everything happens inside the payload's row, so no shuffle is needed. Payloads of more than ``whole``
    bytes are cut in ranges of ``size`` bytes by as many tasks.
    """
    small, long = large.halves(payloads, json_column, whole)
    pile = F.from_json(F.col(json_column), _PILE)
    wiki = F.lower(strip(pile["wiki"]))
    found = (
        small.select(*keys, wiki.alias("wiki"), pile_titles(pile["pages"], limit).alias("_titles"))
        .where(F.coalesce(F.col("wiki") != "", F.lit(False)))
        .select(*keys, "wiki", F.posexplode_outer("_titles").alias("position", "title"))
        .where(F.col("position").isNotNull())
    )
    return found if long is None else found.union(_large_piles(long, keys, json_column, limit, size))


def _large_piles(payloads: DataFrame, keys: list[str], json_column: str, limit: int | None, size: int) -> DataFrame:
    """Titles of piles that are cut: the first place of each, numbered in blocks."""
    cut = large.shred(payloads, keys, json_column, size)
    top = large.root_members(cut).where("child is null")
    pile = F.from_json(F.col("text"), _PILE)
    wikis = top.select("doc", F.lower(strip(pile["wiki"])).alias("wiki")).where("wiki <> ''")
    one = F.get(F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>"), 0)
    lists = cut.containers.where((F.col("kind") == "[") & (F.col("names") == F.array(F.lit("pages"))))
    titles = large.whole_elements(cut, lists).select("doc", "at", page_title(one).alias("title"))
    few = top.select("doc", F.posexplode(pile["pages"]).alias("at", "title")).select("doc", F.col("at").cast("long"), page_title(F.col("title")).alias("title"))
    firsts = titles.union(few).where("title <> ''").groupBy("doc", "title").agg(F.min("at").alias("at"))
    rows = large.numbered_rows(firsts, "doc", "at")
    if limit is not None:
        rows = rows.where(F.col("position") < limit)
    rows = large.spread_join(rows, wikis, ["doc"], "position")
    return large.restore_keys(rows, cut, "position", "wiki", F.col("position").cast("int").alias("position"), "title")


def broken_piles(payloads: DataFrame, keys: list[str], json_column: str) -> DataFrame:
    pile = F.from_json(F.col(json_column), _PILE)
    missing = (F.coalesce(strip(pile["wiki"]), F.lit("")) == "") | pile["pages"].isNull()
    return payloads.where(missing).select(*keys, json_column)
