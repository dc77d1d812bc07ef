"""Tables of folders whose readers see whole versions: a manifest names the folders that count.

A table is a folder of folders. ``_manifest/<n>`` holds the n-th list of them; the greatest complete one
is the table. Folders are written first and named afterwards, and go only when no manifest names them,
so a stop between any two steps leaves the table as it was or as it should be. Without a manifest all
folders count.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_MANIFEST = "_manifest"


def _at(spark: SparkSession, *parts: str):
    """A path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, *parts: str) -> list[str]:
    path, files = _at(spark, *parts)
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def _read(spark: SparkSession, path: str, number: int) -> dict | None:
    """A manifest; null where it is none."""
    place, files = _at(spark, path, _MANIFEST, str(number))
    stream = files.open(place)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def manifest(spark: SparkSession, path: str) -> dict:
    """``number``, ``folders`` and whatever else the last commit noted; number 0 without a manifest."""
    for number in sorted((int(n) for n in _names(spark, path, _MANIFEST) if n.isdigit()), reverse=True):
        held = _read(spark, path, number)
        if held is not None:
            return held | {"number": number}
    return {"number": 0, "folders": sorted(n for n in _names(spark, path) if n[0] not in "._")}


def commit(spark: SparkSession, path: str, change) -> dict:
    """Make ``change(manifest)`` the next manifest; tried again if another writer was faster.

    A manifest is written under another name and takes its number by a rename that fails where the
    number is taken, so no reader sees half of one and no writer loses another's change.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    hadoop = jvm.org.apache.hadoop.fs
    no_options = gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    while True:
        taken = max([0, *(int(n) for n in _names(spark, path, _MANIFEST) if n.isdigit())])
        new = change(dict(manifest(spark, path))) | {"number": taken + 1}
        draft, files = _at(spark, path, _MANIFEST, "_" + uuid.uuid4().hex)
        out = files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(new).encode()))
        finally:
            out.close()
        place, _ = _at(spark, path, _MANIFEST, str(taken + 1))
        try:
            hadoop.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, place, no_options)
            return new
        except Py4JJavaError as error:
            files.delete(draft, False)
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise


def read(spark: SparkSession, path: str, schema: str | None = None, folders: list[str] | None = None) -> DataFrame:
    """Rows of the folders that count, or of those given; the part of a name behind ``=`` is a column."""
    folders = manifest(spark, path)["folders"] if folders is None else folders
    reader = spark.read if schema is None else spark.read.schema(schema)
    if all("=" in f for f in folders):
        reader = reader.option("basePath", path)
    if schema is not None and not folders:
        return spark.createDataFrame([], schema)
    return reader.parquet(*("{}/{}".format(path, f) for f in folders))


def add(df: DataFrame, path: str) -> None:
    """Append the rows as a folder of their own."""
    folder = "v-" + uuid.uuid4().hex
    commit(df.sparkSession, path, lambda now: now)
    df.write.parquet("{}/{}".format(path, folder))
    commit(df.sparkSession, path, lambda now: now | {"folders": [*now["folders"], folder]})


def delete(spark: SparkSession, path: str, folder: str) -> None:
    place, files = _at(spark, path, folder)
    files.delete(place, True)


def clean(spark: SparkSession, path: str) -> None:
    """Delete folders that the last manifest does not name, and older manifests.

    Run it where no writer is between writing a folder and naming it.
    """
    now = manifest(spark, path)
    for name in _names(spark, path):
        if name[0] not in "._" and name not in now["folders"]:
            delete(spark, path, name)
    for name in _names(spark, path, _MANIFEST):
        if name.isdigit() and int(name) < now["number"]:
            delete(spark, path, "{}/{}".format(_MANIFEST, name))


def replace(df: DataFrame, path: str, **notes) -> None:
    """Put ``df``, which may read the table, in place of all rows, and note ``notes`` with it.

    Rows that another writer adds meanwhile stay.
    """
    spark = df.sparkSession
    old, folder = manifest(spark, path)["folders"], "v-" + uuid.uuid4().hex
    commit(spark, path, lambda now: now)
    df.write.parquet("{}/{}".format(path, folder))
    commit(spark, path, lambda now: now | {"folders": [folder, *(f for f in now["folders"] if f not in old)]} | notes)
