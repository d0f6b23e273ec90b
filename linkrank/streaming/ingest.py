"""Dumps that arrive in several files: each file is parsed once, whatever run sees it first.

The checkpoint remembers which files are done, so an interrupted conversion goes on with the next file, and a rerun
over a finished folder does nothing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import sqldump


def ingest_new(spark: SparkSession, folder: str, table: str, columns: list[str], target: str, checkpoint: str, strict: bool = False) -> int:
    """Appends the rows of new dump files in ``folder`` to ``target``; the number of batches that ran.

    ``columns`` is the order of the dump's columns (``sqldump.create_columns`` reads it from a first file).
    """
    text = spark.readStream.option("lineSep", "\n").text(folder).select(F.make_valid_utf8("value").alias("value"))
    rows = sqldump.selected(sqldump.tuples(sqldump.insert_payloads(text, table)), columns, sqldump.DUMPS[table].schema, strict)
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] > 0 for p in query.recentProgress)
