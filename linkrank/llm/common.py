"""Helpers that several operators share: shared-folder tables and gapless ranking without hot tasks."""

from __future__ import annotations

import ctypes
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import delete, scratch

#: Prefix of working columns, so that a caller's extra columns never clash with them.
P = "__lr_"

#: Most rows of a per-group plan (sources, shards) that may be held on the driver and broadcast.
MAX_GROUPS = 100_000

#: Most rows that one bucket of a ranking gets on average.
BUCKET_ROWS = 4096

#: Most keys that count as hot, and the rows that one has at least.
HOT, HOT_ROWS = 100_000, 1000

#: Most rows of an Arrow batch of texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Lets Python workers get BATCH_ROWS texts at once and not ten thousand, on this session, as some texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


#: Large objects that a Python worker keeps from batch to batch, such as a tokenizer's tables.
resident: dict = {}


def released() -> None:
    """Lets go of what other stages left in ``resident``; batches of stages that keep nothing begin with this."""
    if resident:
        resident.clear()
        trimmed(None)


def trimmed(result):
    """``result``, after a Python worker gave free memory back.

    Workers stay between stages and share the executor's memory with the JVM, so batches end with this.
    """
    resident.clear()
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    return result


def stored(df: DataFrame, *order: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts lineage and outlives executors.

    With ``order`` the table is range-partitioned and sorted by those columns, so that filters on them prune
    row groups. The folder goes when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def discarded(df: DataFrame) -> None:
    """Deletes a table that ``stored`` gave, as nothing will read it again."""
    delete(df.sparkSession, df._stored_at)


def spread(rows: DataFrame, keyed: DataFrame, same: Column, n: str, most: int) -> DataFrame:
    """``rows`` joined on ``same`` with ``keyed``, which has one row of each key and in ``n`` how many of ``rows`` have it.

    ``rows`` are ``most`` at most, so at most HOT keys have over a HOT-th of that: these are broadcast, and what is
    shuffled has no hot key. ``n`` is not among the result's columns.
    """
    least = max(HOT_ROWS, most // HOT)
    hot = F.broadcast(keyed.where(F.col(n) > least).drop(n))
    return rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(keyed.where(F.col(n) <= least).drop(n), same))


def group_counts(df: DataFrame, group: str) -> dict:
    """Rows per value of ``group``; the number of values is checked against MAX_GROUPS."""
    rows = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"{group} has over {MAX_GROUPS} values; it can't be planned on the driver")
    return {r[group]: r["n"] for r in rows}


def buckets_for(rows: int) -> int:
    return max(1, math.isqrt(max(rows - 1, 0)) + 1, math.ceil(rows / BUCKET_ROWS))


def ranked(df: DataFrame, group: str, counts: dict, keys: list[str], out: str, by: Column | None = None) -> DataFrame:
    """Adds ``out``: 0, 1, 2 ... within each value of ``group``, without any task that holds a whole group.

    Rows go to hash buckets of ``keys``; the order is by bucket, then by ``keys``. With ``by``, a digest in lower-case
    hex digits, buckets are its ranges, so that the order is that of the digests, then of ``keys``. Counts per bucket
    give each bucket its offset, so the only window over rows is within one bucket. ``group`` must not be null and
    ``counts`` must hold its row counts.
    """
    spark = df.sparkSession
    g, b = f"{P}group", f"{P}bucket"
    sizes = spark.createDataFrame([(k, buckets_for(n)) for k, n in counts.items()] or [], f"{g} {dict(df.dtypes)[group]}, {P}n int")
    first = F.xxhash64(*keys) if by is None else by
    # of a digest, the first 32 bits scaled to the number of buckets
    bucket = F.pmod(first, F.col(f"{P}n")) if by is None else F.shiftright(F.conv(F.substring(by, 1, 8), 16, 10).cast("long") * F.col(f"{P}n"), 32)
    rows = df.join(F.broadcast(sizes), F.col(group) == F.col(g)).withColumn(b, bucket.cast("int")).drop(f"{P}n")
    # the same hash gives the order, so that neighbours in a source are not neighbours in the ranking
    offsets = rows.groupBy(g, b).agg(F.count(F.lit(1)).alias(f"{P}c"))
    before = Window.partitionBy(g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(F.col(g).alias(f"{P}g2"), F.col(b).alias(f"{P}b2"), F.coalesce(F.sum(f"{P}c").over(before), F.lit(0)).alias(f"{P}o"))
    inside = Window.partitionBy(g, b).orderBy(first, *keys)
    rows = rows.withColumn(f"{P}r", F.row_number().over(inside) - 1)
    joined = rows.join(offsets, (F.col(g) == F.col(f"{P}g2")) & (F.col(b) == F.col(f"{P}b2")))
    return joined.withColumn(out, (F.col(f"{P}o") + F.col(f"{P}r")).cast("long")).drop(g, b, f"{P}r", f"{P}g2", f"{P}b2", f"{P}o")
