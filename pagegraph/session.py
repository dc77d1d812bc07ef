"""Session, checkpoint folder and bounded-fan-out helpers shared by all jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: rows of a table one task works on at most, where a row may become a dozen triples
TASK_ROWS = 50_000


def build_session(app: str = "pagegraph", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster session
    without it is an error, because a machine-local folder would not survive an executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="pagegraph-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_tasks(table: DataFrame) -> int:
    """Tasks for costly work per row of a table: one per core at least, of ``TASK_ROWS`` rows at most.

    A split of a well-compressed file holds millions of rows, and what a task keeps of them (their
    triples, to merge equal ones) grows with their number.
    """
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS))


def spread(table: DataFrame) -> DataFrame:
    """Deal a table read from files over enough tasks for costly work per row.

    A table that already has as many splits is returned unchanged.
    """
    wanted = row_tasks(table)
    return table if table.rdd.getNumPartitions() >= wanted else table.repartition(wanted)
