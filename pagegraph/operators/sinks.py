"""Writers and order-independent summaries of graphs and query results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions.terms import json_term, ntriples_term
from pagegraph.operators.catalog import current, expired, read_catalog
from pagegraph.operators.pattern import Solutions, address_term, object_term
from pagegraph.operators.triples import GRAPH_COLUMNS, graph_set
from pagegraph.streaming import versions


def write_graph(triples: DataFrame, path: str, datasets: Sequence[str] = ()) -> None:
    """Replace the datasets present in ``triples``, empty the other ones named, leave the rest alone.

    A dataset is one folder, so nothing of its last version stays. Equal triples merge in the only
    shuffle, whose partitions hold a share of every predicate; adaptive execution joins small ones.
    Files are sorted by predicate and subject, so the statistics of their row groups lead a pattern to
    its predicate.
    """
    spark = triples.sparkSession
    laid = graph_set(triples).sortWithinPartitions("dataset_id", "p", "s")
    (
        laid.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_id")
        .parquet(path)
    )
    if datasets:
        filled = triples.where(F.col("dataset_id").isin(*datasets)).select("dataset_id").distinct()
        drop_datasets(spark, path, set(datasets) - {r[0] for r in filled.collect()})


def drop_datasets(spark, path: str, datasets: Iterable[str]) -> None:
    """Delete the folders of the named datasets, in whatever file system the graph is kept."""
    jvm = spark.sparkContext._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for name in sorted(datasets):
        folder = jvm.org.apache.hadoop.fs.Path("{}/dataset_id={}".format(path, escape(name)))
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_expired(graph_path: str, catalog_path: str, as_of: str, spark, keep: DataFrame | None = None) -> list[str]:
    """Drop the graphs of expired datasets and their catalog lines; gives the dropped ids.

    A catalog line is a dataset, so the list is as long as the list of datasets kept. The new catalog is
    written beside the old one and takes its place together with the list of graphs to drop; then the
    graphs go, then the list. After a stop in between the next call drops what is left on the list,
    unless the catalog has the dataset again: its graph was replaced whole then.
    """
    catalog = read_catalog(spark, catalog_path)
    known = current(catalog)
    old = [r.dataset_id for r in expired(known, as_of, keep).select("dataset_id").collect()]
    listed = set(versions.manifest(spark, catalog_path).get("dropping", []))
    again = {r[0] for r in known.where(F.col("dataset_id").isin(*listed)).select("dataset_id").collect()} if listed else set()
    gone = sorted({*old, *(listed - again)})
    if old:
        left = catalog.join(spark.createDataFrame([(g,) for g in old], "dataset_id string"), "dataset_id", "left_anti")
        versions.replace(left, catalog_path, dropping=gone)
    if gone or listed:
        drop_datasets(spark, graph_path, gone)
        versions.commit(spark, catalog_path, lambda now: now | {"dropping": []})
        versions.clean(spark, catalog_path)
    return gone


def save_graph_table(triples: DataFrame, table: str, buckets: int = 200, path: str | None = None) -> None:
    """Graph as a table bucketed and sorted by subject: star patterns then join without a shuffle."""
    writer = (
        graph_set(triples).repartition(buckets, "s").write.mode("overwrite").bucketBy(buckets, "s").sortBy("s", "p")
    )
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_graph(spark, path: str) -> DataFrame:
    """Graph columns as text, whatever types the folder names look like."""
    schema = ", ".join(c + " string" for c in ["s", "p", "o_kind", "o", "o_dt", "o_lang", "dataset_id"])
    return spark.read.schema(schema).parquet(path).select(*GRAPH_COLUMNS)


def ntriples_line() -> Column:
    """One N-Triples line per triple; plain strings are written without a datatype."""
    return F.concat_ws(
        " ",
        ntriples_term(address_term(F.col("s"))),
        F.concat(F.lit("<"), F.col("p"), F.lit(">")),
        ntriples_term(object_term()),
        F.lit("."),
    )


def ntriples(graph: DataFrame) -> DataFrame:
    return graph.select(ntriples_line().alias("line"))


def write_ntriples(graph: DataFrame, path: str, compression: str = "none") -> None:
    ntriples(graph).write.mode("overwrite").option("compression", compression).text(path)


def json_bindings(solutions: Solutions) -> DataFrame:
    """One JSON object of bindings per solution; unbound variables are absent."""
    bound = F.struct(*[json_term(solutions.term(v)).alias(v) for v in solutions.variables])
    return solutions.df.select(F.to_json(bound, {"ignoreNullFields": "true"}).alias("binding"))


def write_json_result(solutions: Solutions, path: str) -> None:
    """Folder with a ``head`` line of variable names and the bindings, one object per line."""
    spark = solutions.df.sparkSession
    head = '{"head":{"vars":[%s]}}' % ",".join('"{}"'.format(v) for v in solutions.variables)
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(path + "/head")
    json_bindings(solutions).write.mode("overwrite").text(path + "/bindings")


def snapshot_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Right-trimmed, non-blank lines in order (a range-partitioned sort)."""
    clean = F.regexp_replace(F.col(column), r"(?U)\s+$", "").alias(column)
    return lines.select(clean).where(F.col(column) != "").orderBy(column)


def snapshot_stats(lines: DataFrame, column: str = "line") -> DataFrame:
    """Line and byte counts of the canonical text (one line feed per line)."""
    clean = F.regexp_replace(F.col(column), r"(?U)\s+$", "").alias("_l")
    kept = lines.select(clean).where(F.col("_l") != "")
    return kept.agg(
        F.count(F.lit(1)).alias("triple_count"),
        F.coalesce(F.sum(F.octet_length("_l") + 1), F.lit(0)).cast("bigint").alias("byte_count"),
    )


_MODULUS = 1 << 60


def _digest(salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), ntriples_line())), 1, 15), 16, 10).cast("bigint")


def graph_signature(graph: DataFrame) -> DataFrame:
    """Per dataset: triple count, XOR and two modular sums of 60-bit digests.

    Order does not matter and the aggregates merge, so every task sends one line per dataset.
    """
    a, b = _digest("a"), _digest("b")
    total = lambda d: (F.sum(d.cast("decimal(38,0)")) % F.lit(_MODULUS)).cast("bigint")
    return graph.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("triple_count"), F.bit_xor(a).alias("xor_digest"), total(a).alias("sum_a"), total(b).alias("sum_b")
    )


def predicate_counts(graph: DataFrame) -> DataFrame:
    return graph.groupBy("dataset_id", "p").agg(F.count(F.lit(1)).alias("triples"))
