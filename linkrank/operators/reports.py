"""Result tables and the data of figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The questions, their metrics and how to read them.
QUESTIONS = (
    ("Top PageRank diversity vs random", "mean_similarity_difference_top_minus_random", "Negative values mean top PageRank pages are more diverse than random pages."),
    ("Top vs bottom PageRank similarity", "mean_similarity_difference_top_minus_bottom", "Negative values mean top PageRank pages are less similar than bottom PageRank pages."),
    ("MinHash validation", "mean_absolute_error_minhash_vs_exact", "Lower values mean MinHash closely approximates exact Jaccard on selected pairs."),
)


def minhash_error(pairs: DataFrame) -> DataFrame:
    """One row: the mean absolute difference of jaccard_minhash and jaccard_exact."""
    return pairs.agg(F.avg(F.abs(F.col("jaccard_minhash") - F.col("jaccard_exact"))).alias("mean_absolute_error"))


def research_questions(summary: DataFrame, pairs: DataFrame) -> DataFrame:
    """question, metric, value (null if a group is missing), interpretation."""
    mean = lambda g: F.max(F.when(F.col("group_name") == g, F.col("mean_similarity")))
    top = summary.agg((mean("top_pagerank") - mean("random")).alias("a"), (mean("top_pagerank") - mean("bottom_pagerank")).alias("b"))
    values = top.crossJoin(minhash_error(pairs))  # one row and one row
    rows = F.array(*(F.struct(F.lit(q).alias("question"), F.lit(m).alias("metric"), F.col(v).alias("value"), F.lit(i).alias("interpretation")) for (q, m, i), v in zip(QUESTIONS, ("a", "b", "mean_absolute_error"))))
    return values.select(F.inline(rows))


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """bin (from 0), lower edge and count of equal-width bins between the least and the greatest value; the last is closed."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = F.col("hi") - F.col("lo")
    at = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("lo")) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    rows = df.select(column).where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends))  # ends is one row
    counted = rows.groupBy(at.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.col("lo") + F.col("bin") * width / bins).alias("lower"), "n")


def top_bar(ranking: DataFrame, k: int = 20) -> DataFrame:
    """The k best pages, in the order in which a bar chart shows them."""
    return ranking.orderBy("rank").limit(k).select("page_id", "title", "pagerank", "rank").orderBy("pagerank", F.desc("rank"))


def mean_bar(summary: DataFrame) -> DataFrame:
    return summary.select("group_name", "mean_similarity")


def box(pairs: DataFrame, column: str = "jaccard_exact") -> DataFrame:
    """Quartiles and whiskers (the furthest values within 1.5 times the quartile distance) for each group."""
    q = lambda x: F.percentile(column, F.lit(x))
    quartiles = pairs.groupBy("group_name").agg(q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = lambda c: F.when((c >= F.col("q1") - reach) & (c <= F.col("q3") + reach), c)
    # groups are few: their quartiles are one row each
    rows = pairs.select("group_name", column).join(quartiles, "group_name")
    return rows.groupBy("group_name", "q1", "median", "q3").agg(F.min(inside(F.col(column))).alias("whisker_low"), F.max(inside(F.col(column))).alias("whisker_high"))


def percentile_line(bins: DataFrame) -> DataFrame:
    return bins.select("bin_idx", "percentile_bin", "mean_similarity")


def scatter(pairs: DataFrame) -> DataFrame:
    return pairs.select("group_name", "jaccard_exact", "jaccard_minhash")


def binned_scatter(points: DataFrame, bins: int = 100) -> DataFrame:
    """The points by cells of a grid, with their number n: ``bins`` squared rows a group at most, whatever that of pairs."""
    cell = lambda c: ((F.floor(F.least(F.col(c) * bins, F.lit(bins - 1))) + 0.5) / bins).alias(c)
    return points.groupBy("group_name", cell("jaccard_exact"), cell("jaccard_minhash")).agg(F.count(F.lit(1)).alias("n"))
