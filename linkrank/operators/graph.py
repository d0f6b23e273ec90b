"""The link graph: nodes, edges, degrees and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """One row for each key, the first in ``order``. The whole row is the aggregate, so one shuffle with partial results does."""
    rest = [c for c in df.columns if c != key]
    place = F.struct(*order, *(c for c in rest if c not in order))
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), place).alias("row")).select(key, "row.*").select(*df.columns)


def clean_pages(page: DataFrame, min_page_len: int = 100) -> DataFrame:
    """page_id, title and page_len of articles: namespace 0, no redirect, longer than ``min_page_len`` bytes; ids are unique."""
    kept = page.where((F.col("page_namespace") == 0) & (F.col("page_is_redirect") == 0) & (F.col("page_len") > min_page_len))
    return first_by(kept.select("page_id", F.col("page_title").alias("title"), "page_len"), "page_id", "title", "page_len")


def edges(pagelinks: DataFrame, linktarget: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct source_page_id, target_page_id between clean pages, without self-links. Redirects are not followed.

    Links are narrowed to clean targets and sources before the distinct; filters reach the scans.
    """
    targets = linktarget.where("lt_namespace = 0").join(pages.select(F.col("title").alias("lt_title"), F.col("page_id").alias("target_page_id")), "lt_title").select("lt_id", "target_page_id")
    links = pagelinks.where("pl_from_namespace = 0").select("pl_from", F.col("pl_target_id").alias("lt_id"))
    sources = pages.select(F.col("page_id").alias("pl_from"))
    out = links.join(targets, "lt_id").join(sources, "pl_from", "left_semi")
    return out.select(F.col("pl_from").alias("source_page_id"), "target_page_id").where("source_page_id <> target_page_id").distinct()


def degrees(pages: DataFrame, links: DataFrame) -> DataFrame:
    """page_id, in_degree, out_degree of every node, 0 where it has no edges.

    Both directions are counted by one aggregation, whose partial results take in pages with a million links.
    """
    ends = links.select(F.explode(F.array(F.struct(F.col("source_page_id").alias("page_id"), F.lit(1).alias("o")), F.struct(F.col("target_page_id").alias("page_id"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    counted = ends.groupBy("page_id").agg(F.sum(1 - F.col("o")).alias("in_degree"), F.sum("o").alias("out_degree"))
    both = pages.select("page_id").join(counted, "page_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select("page_id", zero("in_degree"), zero("out_degree"))


def graph_stats(node_degrees: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts, means, medians and maxima; number_of_edges counts every edge row."""
    dangling = F.col("out_degree") == 0
    out = [F.count(F.lit(1)).alias("number_of_nodes")]
    for c in ("in_degree", "out_degree"):
        out += [F.avg(c).alias(f"mean_{c}"), F.median(c).alias(f"median_{c}"), F.max(c).alias(f"max_{c}")]
    out += [
        F.count_if(dangling).alias("dangling_nodes"),
        (100 * F.avg(dangling.cast("int"))).alias("percent_dangling"),
        F.count_if(dangling & (F.col("in_degree") == 0)).alias("isolated_nodes"),
    ]
    return node_degrees.agg(*out).crossJoin(links.agg(F.count(F.lit(1)).alias("number_of_edges")))  # one row and one row


STATISTICS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles by linear interpolation between the values at two ranks.

    Equal values are counted first, then numbered by ranges, so no task holds all values, however many there are.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sum(counted, "v", "n", "last")
    total = ranked.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(shares)
    places = [q * (total - 1) for q in shares]
    wanted = sorted({int(p) for p in places} | {min(int(p) + 1, total - 1) for p in places})
    hit = F.filter(F.array(*map(F.lit, wanted)), lambda w: (w < F.col("last")) & (w >= F.col("last") - F.col("n")))
    at = {w: float(r["v"]) for r in ranked.withColumn("w", hit).where(F.size("w") > 0).select("v", "w").collect() for w in r["w"]}
    return [(1 - (p - int(p))) * at[int(p)] + (p - int(p)) * at[min(int(p) + 1, total - 1)] for p in places]


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """statistic and one column for each of ``columns``: exact quartiles by linear interpolation, sample deviation."""
    made = []
    for c in columns:
        middle = [F.lit(x) for x in quantiles(df, c, (0.25, 0.5, 0.75))]
        made.append(F.array(*(x.cast("double") for x in (F.count(c), F.avg(c), F.stddev_samp(c), F.min(c), *middle, F.max(c)))).alias(c))
    names = F.array(*map(F.lit, STATISTICS)).alias("statistic")
    return df.agg(*made).select(F.explode(F.arrays_zip(names, *columns)).alias("z")).select("z.statistic", *(f"z.{c}" for c in columns))


def running_sum(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows up to this one in ``order``, which must name each row uniquely.

    As in ``global_rank``, each range adds up its own rows, and ranges are shifted by the sums of those before.
    """
    from ..session import checkpointed

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id())
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = checkpointed(ranged.withColumn("__sum", F.sum(value).over(inside)))
    sums = summed.groupBy("__part").agg(F.sum(value).alias("__own"))  # as many rows as partitions
    before = F.sum("__own").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shift = sums.select("__part", F.coalesce(before, F.lit(0)).alias("__shift"))
    return summed.join(F.broadcast(shift), "__part").withColumn(out, F.col("__shift") + F.col("__sum")).drop("__part", "__sum", "__shift")


def global_rank(df: DataFrame, *order: Column, out: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds ``out``: 1, 2, 3 ... over all rows in ``order``, which must name each row uniquely.

    Rows are range-partitioned, numbered within their partition, and shifted by the sizes of the partitions before;
    no window holds all rows. The ranges are drawn from a sample, so the rows are checkpointed under their numbers
    before the sizes are counted.
    """
    from ..session import checkpointed

    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    inside = Window.partitionBy("__part").orderBy(*order)
    numbered = checkpointed(ranged.withColumn("__place", F.row_number().over(inside)))
    sizes = numbered.groupBy("__part").agg(F.max("__place").alias("__size"))  # as many rows as partitions
    shift = sizes.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    joined = numbered.join(F.broadcast(shift), "__part")
    return joined.withColumn(out, (F.col("__shift") + F.col("__place")).cast("long")).drop("__part", "__place", "__shift")
