"""Schema profile of a graph while it is built, and of fixed-schema records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import fixed
from pagegraph.functions.text import strip
from pagegraph.operators.triples import SITELINK_FIELDS, Vocabulary, field_name

# --- fixed values: type names of a profile, in their own order ---
KINDS = ["iri", "xsd:boolean", "xsd:dateTime", "xsd:double", "xsd:integer", "xsd:string"]
# --- fixed values: keys a link contributes to its row ---
LINK_KEYS = ["gil_link", "gil_link_page_len", "gil_link_rev_timestamp", "gil_link_wikidata_id", "gil_link_wikidata_entity"]
# --- fixed values: declared field order of the sitelink sources ---
PAGE_FIELDS = [
    "created_timestamp",
    "current_timestamp",
    "lang_code",
    "namespace",
    "page_id",
    "page_title",
    "page_label",
    "site_url",
    "wiki_domain",
    "wiki_dbname",
    "wiki_group",
    "wikidata_entity",
    "wikidata_id",
]
MEMBER_FIELDS = [
    "lang_code",
    "page_label",
    "page_title",
    "site_url",
    "wiki_group",
    "wiki_project",
    "wikidata_entity",
    "wikidata_id",
]
MEMBER_OPTIONAL = ["site_url", "wikidata_entity", "wikidata_id"]


def profile(rows: DataFrame, vocab: Vocabulary, link_rows: DataFrame | None = None) -> DataFrame:
    """One line per (dataset, field): rows present, primary and observed types, cardinality.

    ``rows`` has dataset_id, position and ``fields``, whose entries already tell whether the row
    emitted the key before. So the only shuffle carries one partial line per task and field.
    ``link_rows`` (dataset_id, position, key, kind) adds what a row's links emit; they are counted
    per row first. Counts are of emissions, before equal triples merge.
    """
    own = rows.select("dataset_id", "position", F.explode_outer("fields").alias("_f")).where(F.col("_f.value").isNotNull())
    own = own.select("dataset_id", "position", "_f.key", "_f.kind", "_f.repeated", "_f.same_kind")
    lines = own if link_rows is None else own.where(~F.col("key").isin(*LINK_KEYS))
    marks = [F.count(F.when((F.col("kind") == k) & ~F.col("same_kind"), 1)).alias("_" + k) for k in KINDS]
    counts = lines.groupBy("dataset_id", "key").agg(
        F.count(F.when(~F.col("repeated"), 1)).alias("present_in_rows"),
        F.max(F.col("repeated").cast("int")).alias("_many"),
        *marks,
    )
    if link_rows is not None:
        shared = own.where(F.col("key").isin(*LINK_KEYS)).select("dataset_id", "position", "key", "kind")
        per_row = (
            shared.unionByName(link_rows.select("dataset_id", "position", "key", "kind"))
            .groupBy("dataset_id", "position", "key")
            .agg(F.count(F.lit(1)).alias("n"), *[F.max((F.col("kind") == k).cast("int")).alias("_" + k) for k in KINDS])
        )
        linked = per_row.groupBy("dataset_id", "key").agg(
            F.count(F.lit(1)).alias("present_in_rows"),
            F.max((F.col("n") > 1).cast("int")).alias("_many"),
            *[F.sum("_" + k).alias("_" + k) for k in KINDS],
        )
        counts = counts.unionByName(linked)
    ranked = F.array(*[F.struct(F.col("_" + k).alias("rows"), F.lit(k).alias("kind")) for k in KINDS])
    seen = F.filter(ranked, lambda x: x["rows"] > 0)
    return counts.select(
        "dataset_id",
        F.col("key").alias("source_key"),
        F.concat(F.lit(vocab.ontology), field_name(F.col("key"))).alias("predicate"),
        "present_in_rows",
        F.array_max(seen)["kind"].alias("primary_type"),
        F.transform(seen, lambda x: x["kind"]).alias("observed_types"),
        F.when(F.col("_many") == 1, F.lit("M")).otherwise(F.lit("1")).alias("row_side_cardinality"),
    )


_STANDARD = {c: p for c, p, _ in SITELINK_FIELDS if p} | {"wiki_group": fixed.WIKI_GROUP}
_TYPES = {c: k for c, _, k in SITELINK_FIELDS} | {"wiki_group": "xsd:string"}


def fixed_profile(
    records: DataFrame, vocab: Vocabulary, order: Sequence[str] = tuple(PAGE_FIELDS), optional: Sequence[str] | None = None
) -> DataFrame:
    """Profile of records whose fields and types are declared; one aggregation, no unpivot of rows.

    Without ``optional`` a field counts where it is neither null nor blank. With it, the optional
    fields count where they are set and every other one counts all rows. Fields nowhere present
    are left out.
    """
    present = [c for c in order if c in records.columns or (optional is not None and c not in optional)]

    def hits(column: str) -> Column:
        if optional is not None and column not in optional:
            return F.count(F.lit(1))
        filled = F.col(column).isNotNull()
        if optional is None:
            filled = filled & (strip(F.col(column).cast("string")) != "")
        return F.count(F.when(filled, 1))

    counts = records.groupBy("dataset_id").agg(*[hits(c).alias(c) for c in present])
    lines = F.array(
        *[
            F.struct(
                F.lit(order.index(c)).cast("bigint").alias("field_order"),
                F.lit(c).alias("source_key"),
                F.lit(_STANDARD.get(c, vocab.ontology + c)).alias("predicate"),
                F.col(c).alias("present_in_rows"),
                F.lit(_TYPES[c]).alias("primary_type"),
                F.array(F.lit(_TYPES[c])).alias("observed_types"),
                F.lit("1").alias("row_side_cardinality"),
            )
            for c in present
        ]
    )
    return (
        counts.select("dataset_id", F.explode(lines).alias("_l"))
        .select("dataset_id", "_l.*")
        .where(F.col("present_in_rows") > 0)
    )
