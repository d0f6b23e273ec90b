"""Sharding: minimax contiguous partition of atomic groups (operator 10).

Rows with equal texts are one atomic group. Groups are ordered by the SHA-256 of their text and weigh the sum of
their rows' sizes. A binary search finds the smallest capacity at which a greedy pass needs no more shards than
asked for; the greedy cuts at that capacity are the shards. The driver holds sums of digest ranges only and reads
single groups just where a cut falls.

Edge cases: a null text counts as empty (size 1); an empty table gives an empty result; repeated rows stay rows of
one group; a group larger than an equal share sets the capacity; of equally good cuts the greedy ones count; slots go by the
SHA-256 of id and text's digest, so a shard's rows are shuffled in the same way each time; texts of any length count whole; shards may be empty when there are few
groups; only texts and ids are read, so other columns may have any names.
"""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, group_counts, ranked, stored

#: Hex digits of the digest that name a range on each level: at most 16**4 sums reach the driver at once.
DIGITS = 4

#: Most single groups that are read to the driver at once.
READ_GROUPS = 50_000


class _Ranges:
    """Sums over the ordered groups; ranges open on demand, down to single groups."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.nodes: dict[str, tuple[list[str], list[int], list[int]]] = {}
        top = self._sums("")
        self.total, self.largest = top[2][-1], top[4]
        self.nodes[""] = top[:3]

    def _sums(self, prefix: str):
        part = self.groups.where(F.col("digest").startswith(prefix)) if prefix else self.groups
        rows = part.groupBy(F.substring("digest", 1, len(prefix) + DIGITS).alias("k")).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.max("w").alias("m")).collect()
        rows.sort()
        return [r["k"] for r in rows], [r["n"] for r in rows], [0, *itertools.accumulate(r["w"] for r in rows)], None, max((r["m"] for r in rows), default=0)

    def _open(self, prefix: str) -> None:
        """Loads what lies below a range, and its neighbours' groups while they are few."""
        parent = prefix[:-DIGITS]
        keys, counts, _ = self.nodes[parent]
        at = bisect.bisect_left(keys, prefix)
        if counts[at] > READ_GROUPS:
            self.nodes[prefix] = self._sums(prefix)[:3]
            return
        lo = hi = at
        room = READ_GROUPS - counts[at]
        for _ in range(len(keys)):  # grow to both sides by turns
            grown = False
            if lo and counts[lo - 1] <= room and keys[lo - 1] not in self.nodes:
                lo, room, grown = lo - 1, room - counts[lo - 1], True
            if hi + 1 < len(keys) and counts[hi + 1] <= room and keys[hi + 1] not in self.nodes:
                hi, room, grown = hi + 1, room - counts[hi + 1], True
            if not grown:
                break
        rows = self.groups.where((F.col("digest") >= keys[lo]) & (F.col("digest") < keys[hi] + "g")).select("digest", "w").collect()
        rows.sort()
        for key, own in itertools.groupby(rows, lambda r: r["digest"][: len(prefix)]):
            own = list(own)
            self.nodes[key] = [r["digest"] for r in own], [1] * len(own), [0, *itertools.accumulate(r["w"] for r in own)]

    def boundary(self, most: int, prefix: str = "") -> tuple[int, str | None]:
        """The last sum of leading groups that is not over ``most``, and where the next group begins (None: the end)."""
        if prefix not in self.nodes:
            self._open(prefix)
        keys, counts, sums = self.nodes[prefix]
        at = bisect.bisect_right(sums, most) - 1
        if at == len(keys):
            return sums[at], None
        if sums[at] == most or len(keys[at]) > 60:
            return sums[at], keys[at]
        below, start = self.boundary(most - sums[at], keys[at])
        return sums[at] + below, start or keys[at + 1]  # a range is never used up: its sum is over what was left

    def cuts(self, capacity: int, shards: int) -> list[str] | None:
        """Where shards 1, 2 ... begin, or None if the capacity is too small."""
        found, done = [], 0
        for _ in range(shards):
            done, start = self.boundary(done + capacity)
            if start is None:
                return found
            found.append(start)
        return None


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Smallest feasible capacity and the digests at which shards 1, 2 ... begin. ``groups``: digest (unique), w."""
    ranges = _Ranges(groups)
    if not ranges.total:
        return 0, []
    low = max(-(-ranges.total // shards), ranges.largest)
    high = min(-(-ranges.total // shards) + ranges.largest, ranges.total)
    high = max(low, high)
    while low < high:
        middle = (low + high) // 2
        if ranges.cuts(middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, ranges.cuts(low, shards)


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row; slots count from 0 in each shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    light = stored(docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.sha2(body.cast("binary"), 256).alias("digest")))
    groups = stored(light.groupBy("digest").agg(F.sum("size").alias("w")), "digest")
    _, cuts = minimax_cuts(groups, shards)
    shard = sum(((F.col("digest") >= c).cast("int") for c in cuts), F.lit(0))
    placed = light.withColumn("shard", shard)
    order = F.sha2(F.concat_ws(" ", F.col("doc_id").cast("string"), "digest"), 256)
    out = ranked(placed, "shard", group_counts(placed, "shard"), ["doc_id", "digest"], f"{P}slot", order)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col(f"{P}slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
