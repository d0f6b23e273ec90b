"""Cohorts of pages: by rank, at random, by category."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("page_id", "title", "group_name", "pagerank", "rank", "percentile", "word_count")


def named(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("group_name", F.lit(name)).select(*COLUMNS)


def sample(df: DataFrame, k: int, seed: int, key: str = "page_id") -> DataFrame:
    """k rows without replacement: those with the least MD5 of seed and key. Neither order nor partitions matter."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(k)


def base_pages(ranking: DataFrame, articles: DataFrame) -> DataFrame:
    """Ranked pages that have text."""
    return ranking.join(articles.select("page_id", "word_count"), "page_id").select("page_id", "title", "pagerank", "rank", "percentile", "word_count")


def top_pages(base: DataFrame, k: int) -> DataFrame:
    return named(base.orderBy("rank").limit(k), "top_pagerank")


def bottom_pages(base: DataFrame, k: int) -> DataFrame:
    return named(base.orderBy(F.desc("rank")).limit(k), "bottom_pagerank")


def median_pages(base: DataFrame, k: int, seed: int, low: float = 0.45, high: float = 0.55) -> DataFrame:
    return named(sample(base.where(F.col("percentile").between(low, high)), k, seed), "median_pagerank")


def random_pages(base: DataFrame, k: int, seed: int) -> DataFrame:
    return named(sample(base, k, seed), "random")


def category_members(categorylinks: DataFrame, linktarget: DataFrame, categories: Mapping[str, str]) -> DataFrame:
    """Distinct page_id and group_name of the pages in each category. The map of categories is a parameter, so it is broadcast."""
    wanted = categorylinks.sparkSession.createDataFrame(list(categories.items()), "group_name string, lt_title string")
    targets = linktarget.where("lt_namespace = 14").join(F.broadcast(wanted), "lt_title").select("lt_id", "group_name")
    return categorylinks.join(targets, F.col("cl_target_id") == F.col("lt_id")).select(F.col("cl_from").alias("page_id"), "group_name").distinct()


def category_pages(base: DataFrame, members: DataFrame, k: int, seed: int) -> DataFrame:
    """At most k pages of each category, by sample order."""
    rows = base.join(members, "page_id")
    order = F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("page_id").cast("string")).cast("binary")).alias("h"), F.col("page_id"))
    # the optimiser keeps k rows of each group in every task before it shuffles
    place = F.row_number().over(Window.partitionBy("group_name").orderBy(order))
    picked = rows.withColumn("__n", place).where(F.col("__n") <= k)
    return picked.select(*COLUMNS)


def experiment_groups(ranking: DataFrame, articles: DataFrame, k: int, seed: int, categorylinks: DataFrame | None = None, linktarget: DataFrame | None = None, categories: Mapping[str, str] | None = None, low: float = 0.45, high: float = 0.55) -> DataFrame:
    """All cohorts; a page may be in several."""
    base = base_pages(ranking, articles)
    groups = [top_pages(base, k), median_pages(base, k, seed, low, high), bottom_pages(base, k), random_pages(base, k, seed)]
    if categorylinks is not None and linktarget is not None and categories:
        groups.append(category_pages(base, category_members(categorylinks, linktarget, categories), k, seed))
    return reduce(DataFrame.unionByName, groups)


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group_name").agg(F.count(F.lit(1)).alias("n_rows"))
