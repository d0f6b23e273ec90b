"""Table folders, completion markers, and single-document sinks; all by Hadoop's file systems."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Incomplete(FileNotFoundError):
    """An input that isn't there or wasn't finished."""


class Empty(ValueError):
    """A result without rows where some must be."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def changed(spark: SparkSession, folder: str) -> int:
    """When a table in ``folder`` last changed, in milliseconds."""
    fs, p = _fs(spark, folder)
    return max((x.getModificationTime() for x in fs.listStatus(p)), default=0)


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether any file has a path like ``pattern``."""
    fs, p = _fs(spark, pattern)
    return bool(fs.globStatus(p))


def raw_path(spark: SparkSession, path: str, required: bool = True) -> str | None:
    """The path of an input file; None if it is optional and absent."""
    if exists(spark, path):
        return path
    if required:
        raise Incomplete(path)
    return None


def table_path(spark: SparkSession, path: str) -> str:
    """Where a table lies: a finished folder of parts beside it goes first, else the path itself."""
    parts = f"{path}.parts"
    return parts if exists(spark, f"{parts}/_SUCCESS") else path


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written under another name and renamed, so that readers never see half of it."""
    fs, p = _fs(spark, path)
    _, temporary = _fs(spark, f"{path}.tmp")
    stream = fs.create(temporary, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(p, False)
    fs.rename(temporary, p)


def read_json(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, path):
        return None
    fs, p = _fs(spark, path)  # Spark's readers pass over names that begin with an underscore
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    _write_text(spark, path, json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def write_document(df: DataFrame, path: str) -> dict:
    """A one-row table as a JSON document."""
    row = df.first()
    document = row.asDict(recursive=True) if row else {}
    write_json(df.sparkSession, path, document)
    return document


def marker(path: str) -> str:
    return f"{path}/_stage.json"


def is_complete(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_SUCCESS") and exists(spark, marker(path))


def require_complete(spark: SparkSession, path: str) -> str:
    """The path, if what wrote it came to its end."""
    if not is_complete(spark, path):
        raise Incomplete(path)
    return path


def write_table(df: DataFrame, path: str, compression: str = "snappy", rows_per_file: int = 0, allow_empty: bool = True, check: Callable[[int], dict] | None = None, **facts) -> int:
    """Writes a Parquet table, counts its rows on the way, checks them against what can be read, and marks it complete.

    The committer makes files visible at the end only; the marker comes last. ``check`` gets the number of rows and gives
    more facts for the marker, or raises an error, by which the table stays incomplete.
    """
    spark = df.sparkSession
    seen = Observation()
    if exists(spark, marker(path)):  # what is written over is not complete any more
        fs, old = _fs(spark, marker(path))
        fs.delete(old, False)
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", compression)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    rows = seen.get["rows"]
    there = spark.read.parquet(path).count()
    if there != rows:
        raise Incomplete(f"{path} has {there} rows of {rows}")
    if not rows and not allow_empty:
        raise Empty(path)
    write_json(spark, marker(path), {"rows": rows, "status": "complete", **facts, **(check(rows) if check else {})})
    return rows


def adopt(spark: SparkSession, path: str, min_rows: int = 1) -> int:
    """Marks a table that is there already as complete, unless it has too few rows."""
    rows = spark.read.parquet(path).count()
    if rows < max(min_rows, 1):
        raise Empty(f"{path} has {rows} rows; {min_rows} at least are wanted")
    write_json(spark, f"{path}/_SUCCESS", {})
    write_json(spark, marker(path), {"rows": rows, "status": "complete", "adopted": True})
    return rows


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False, **options) -> DataFrame:
    """The table at ``path``, built if it isn't complete; a limited one is built anew."""
    done = read_json(spark, marker(path)) if is_complete(spark, path) else None
    if force or done is None or done.get("limited"):
        write_table(build(), path, **options)
    return spark.read.parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file and rows of each part of a table."""
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return spark.read.parquet(path).groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """A small result as one CSV file with a header."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def verified(spark: SparkSession, files: str, manifest: DataFrame) -> DataFrame:
    """file and status (OK, BAD, NO ENTRY) of files against a manifest of file and sha1; it only reports."""
    found = spark.read.format("binaryFile").load(files).select(F.substring_index("path", "/", -1).alias("file"), F.sha1("content").alias("found"))
    status = F.when(F.col("sha1").isNull(), "NO ENTRY").when(F.lower("sha1") == F.col("found"), "OK").otherwise("BAD")
    return found.join(manifest, "file", "left").select("file", status.alias("status"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file and sha1 from lines of a digest and a name."""
    parts = F.split(F.trim("value"), r"\s+\*?", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(parts[1].alias("file"), parts[0].alias("sha1"))
