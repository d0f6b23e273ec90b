"""PageRank by power iteration with the dangling mass spread evenly."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, forgotten, static_plans
from .graph import degrees, global_rank


#: Edges of a partition, about. Fewer and larger partitions add up more of a target's sums before they are shuffled.
PART_EDGES = 1 << 21


@dataclass
class Ranking:
    """page_id and pagerank; how many iterations ran, and the last L1 change."""

    ranks: DataFrame
    iterations: int
    final_error: float


def inner_edges(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    ids = pages.select("page_id")
    out = links.join(ids.withColumnRenamed("page_id", "source_page_id"), "source_page_id", "left_semi")
    return out.join(ids.withColumnRenamed("page_id", "target_page_id"), "target_page_id", "left_semi").select("source_page_id", "target_page_id")


def pagerank(pages: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-8, max_iterations: int = 100) -> Ranking:
    """Iterates until the L1 change is under ``tolerance``, or for ``max_iterations`` steps.

    Nodes and edges are partitioned by (source) page once, and a source's targets lie in one row, so a step reads eight
    bytes of an edge and joins as many rows as nodes. It joins them where they lie, adds up by target in each
    task, and shuffles these partial sums to the nodes: one exchange, which hot targets don't skew. The new vector goes
    to the shared folder, so no step is computed twice and a lost executor costs one step; the one before it is deleted.
    One action gives the change and the next step's dangling mass.
    """
    if max_iterations < 1:
        raise ValueError("one iteration at least")
    spark = pages.sparkSession
    inner = inner_edges(pages, links)
    found = checkpointed(degrees(pages, inner).select("page_id", "out_degree"))
    n, edges = found.agg(F.count(F.lit(1)), F.sum("out_degree")).first()
    if not n:
        return Ranking(found.select("page_id", F.lit(0.0).alias("pagerank")), 0, 0.0)
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(edges / PART_EDGES))
    with static_plans(spark, parts):
        nodes = checkpointed(found.repartition(parts, "page_id").sortWithinPartitions("page_id"))
        # sorted, as the ranks are, so that no step sorts them again
        packed = inner.repartition(parts, "source_page_id").groupBy("source_page_id").agg(F.collect_list("target_page_id").alias("targets"))
        packed = checkpointed(packed.sortWithinPartitions("source_page_id"))
        ranks = nodes.select("page_id", "out_degree", F.lit(1.0 / n).alias("pagerank"))
        dangling, last = nodes.where("out_degree = 0").count() / n, None
        for step in range(1, max_iterations + 1):
            old = ranks.select(F.col("page_id").alias("source_page_id"), F.col("pagerank").alias("r"))
            sent = packed.join(old, "source_page_id").select(F.explode("targets").alias("page_id"), (F.col("r") / F.size("targets")).alias("part"))
            sent = sent.groupBy("page_id").agg(F.sum("part").alias("sent"))
            base = (1.0 - damping) / n + damping * dangling / n
            value = F.lit(base) + F.lit(damping) * F.coalesce("sent", F.lit(0.0))
            new = ranks.join(sent, "page_id", "left").select("page_id", "out_degree", value.alias("pagerank"), F.col("pagerank").alias("before"))
            new = checkpointed(new)
            change = F.sum(F.abs(F.col("pagerank") - F.col("before"))).alias("change")
            loose = F.sum(F.when(F.col("out_degree") == 0, F.col("pagerank")).otherwise(0.0)).alias("dangling")
            seen = new.agg(change, loose).first()
            dangling = seen["dangling"]
            ranks = new.drop("before")
            if last is not None:
                forgotten(last)
            last = new
            if seen["change"] < tolerance:
                break
    return Ranking(ranks.select("page_id", "pagerank"), step, float(seen["change"]))


def ranked_pages(ranks: DataFrame, pages: DataFrame, node_degrees: DataFrame, digits: int | None = None) -> DataFrame:
    """page_id, title, pagerank, rank, percentile, in_degree, out_degree; best first, ties by page_id.

    ``digits`` rounds the values before they are ranked, so that sums in another order rank alike.
    """
    value = F.round("pagerank", digits) if digits is not None else F.col("pagerank")
    rows = ranks.select("page_id", value.alias("pagerank")).join(pages.select("page_id", "title"), "page_id").join(node_degrees, "page_id")
    out = global_rank(rows, F.desc("pagerank"), F.asc("page_id"))
    n = out.count()
    return out.select("page_id", "title", "pagerank", "rank", (1.0 - (F.col("rank") - 1) / F.lit(max(n - 1, 1))).alias("percentile"), "in_degree", "out_degree")


def top(ranking: DataFrame, k: int = 100) -> DataFrame:
    return ranking.orderBy("rank").limit(k)


def run_stats(result: Ranking, seconds: float) -> dict:
    return {"iterations": result.iterations, "final_error": result.final_error, "runtime_seconds": seconds}
