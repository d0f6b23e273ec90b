"""Connected components of a link table, by alternating large-star and small-star steps; of a small one in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, discarded, released, spread, stored

#: Most links that one task works on.
SMALL = 1 << 19


def _star(both: DataFrame, most: int) -> DataFrame:
    """(u, v, m): each pair with the least of u and its neighbours. ``both``: u, v, of ``most`` rows at most. A node with
    very many neighbours doesn't go to one task."""
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias(f"{P}n")).select(F.col("u").alias(f"{P}u"), F.least("u", "m").alias("m"), f"{P}n")
    return spread(both, least, F.col("u") == F.col(f"{P}u"), f"{P}n", most).drop(f"{P}u")


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and each one's least connected node."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(places[: len(u)].tolist(), places[len(u) :].tolist()):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    released()
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, roots = united(*(np.concatenate(x) for x in zip(*held)))
        for at in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (nodes, roots)], ["node", "root"])


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """node and root (its component's least node) of every linked node. ``links``: a, b of type long, not null.

    Up to ``small`` links go to one task. With more, each round rewires links to smaller nodes and keeps components as
    they are; the number of rounds grows with the logarithm of the longest chain. It ends when a round changes nothing,
    as every link then points to a root.
    """
    edges, before = stored(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u > v").distinct()), None
    most = 2 * edges.count()  # no step adds links
    if most <= 2 * small:
        return edges.coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _star(large, most)
        small_star = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        last, edges = edges, stored(small_star.where("u > v").distinct())
        discarded(last)
        # equal links have equal sums; a sum of hashes doesn't overflow as a decimal
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
