"""Catalog of built datasets: what is loaded, whether it is fresh, what has expired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import fixed
from pagegraph.functions.text import strip
from pagegraph.functions.times import xsd_datetime
from pagegraph.streaming import versions

CATALOG_SCHEMA = (
    "dataset_id string, records bigint, source_url string, source_params map<string,array<string>>, "
    "loaded_at string, fields array<struct<source_key:string,predicate:string,present_in_rows:bigint,"
    "primary_type:string,observed_types:array<string>,row_side_cardinality:string>>"
)


def catalog_rows(rows: DataFrame, profile: DataFrame, source_url: Column, params: Column, loaded_at: str) -> DataFrame:
    """One line per dataset with its record count and profile.

    A profile has one line per field name, so the collected list is as long as the schema.
    """
    counts = rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("records"))
    line = F.struct(
        "source_key", "predicate", "present_in_rows", "primary_type", "observed_types", "row_side_cardinality"
    )
    fields = profile.groupBy("dataset_id").agg(F.sort_array(F.collect_list(line)).alias("fields"))
    return counts.join(fields, "dataset_id", "left").select(
        "dataset_id",
        "records",
        source_url.alias("source_url"),
        params.cast("map<string,array<string>>").alias("source_params"),
        F.lit(loaded_at).alias("loaded_at"),
        F.coalesce("fields", F.array()).alias("fields"),
    )


def append_catalog(lines: DataFrame, path: str) -> None:
    """Add lines as a folder of their own, which counts once it is whole."""
    versions.add(lines, path)


def read_catalog(spark, path: str) -> DataFrame:
    return versions.read(spark, path, CATALOG_SCHEMA)


def current(catalog: DataFrame) -> DataFrame:
    """Newest line per dataset."""
    rest = [c for c in catalog.columns if c != "dataset_id"]
    newest = F.max_by(F.struct(*rest), xsd_datetime(F.col("loaded_at"))).alias("_l")
    return catalog.groupBy("dataset_id").agg(newest).select("dataset_id", "_l.*")


def _age_seconds(loaded_at: Column, as_of: str) -> Column:
    """Whole seconds between a load time and ``as_of``, both UTC text."""
    moment = lambda text: F.unix_seconds(F.to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))
    return moment(F.lit(as_of)) - moment(xsd_datetime(loaded_at))


def usable() -> Column:
    return (
        F.coalesce(F.col("records") >= 0, F.lit(False))
        & (F.coalesce(strip(F.col("source_url")), F.lit("")) != "")
        & (F.coalesce(strip(F.col("loaded_at")), F.lit("")) != "")
    )


def same_params(params: Column, wanted: Column) -> Column:
    """Maps are compared by their sorted entries; an absent map counts as empty."""
    entries = lambda m: F.coalesce(F.array_sort(F.map_entries(m)), F.array())
    return F.to_json(entries(params)) == F.to_json(entries(wanted))


def fresh(catalog: DataFrame, as_of: str, wanted: Column, minutes: int = fixed.CATALOG_FRESH_MINUTES) -> DataFrame:
    """Usable lines not older than ``minutes`` whose parameters equal the wanted ones."""
    young = _age_seconds(F.col("loaded_at"), as_of) <= minutes * 60
    return catalog.where(usable() & young & same_params(F.col("source_params"), wanted))


def expired(catalog: DataFrame, as_of: str, keep: DataFrame | None = None, days: int = fixed.CATALOG_RETENTION_DAYS) -> DataFrame:
    """Datasets older than ``days``, without those to keep."""
    old = catalog.where(_age_seconds(F.col("loaded_at"), as_of) > days * 86400)
    return old if keep is None else old.join(keep.select("dataset_id").distinct(), "dataset_id", "left_anti")
