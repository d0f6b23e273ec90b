"""Mixing sources to target weights: Pfair scheduling (operator 3).

Each source's rows form blocks. An ideal mix serves all sources at once, each at a rate in proportion to its weight, one
block a slot in all; a source that has no more blocks leaves its share to the others. Block j of a source is served
between its virtual times j / w and (j + 1) / w; the slots in which these times fall are its release time and its
deadline. In each slot the released block with the earliest deadline goes. As the ideal mix serves each block within its
window, every block goes in its window, so after every slot each source is within less than one block of its ideal
share, which is its weight's share of the slots as long as no source has run out.

The slot of virtual time v has a closed form, the sum of min(blocks, w v) over all sources; weights are taken as the exact
fractions that they are, without rounding. Each row goes out exactly once. The driver simulates the slots in time that
grows with the number of blocks and the logarithm of that of sources; blocks grow with the table, so that there are
MAX_BLOCKS at most.

Edge cases: a null source counts as the source "" ; a source without a target gets its row share; sources with a
target but no rows are left out; blocks with one deadline go in the order of their exact virtual times, then of sources'
names; an empty table gives an empty result; repeated rows are rows of their own; the last block of a source may be
short; ``mix`` replaces columns of the names that it adds, ``mixed`` leaves all columns as they are, whatever their names.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from array import array
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_GROUPS, P, group_counts, ranked

#: Rows of a block, at least; most blocks (and as many more as there are sources), which bounds the driver's work.
BLOCK_ROWS, MAX_BLOCKS = 64, 2_000_000
#: Most blocks whose schedule is broadcast; a longer one is joined by a shuffle.
BROADCAST_BLOCKS = 1 << 18

COLUMNS = ("mix_phase", "mix_slot", "mix_release", "mix_deadline")


def exact_parts(weights: Mapping[str, float]) -> dict[str, int]:
    """Weights as whole parts in exactly their proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    whole = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * whole) for s, x in exact.items()}


class Ideal:
    """The ideal mix of ``blocks`` of each source at rates in proportion to whole ``parts``."""

    def __init__(self, parts: Mapping[str, int], blocks: Mapping[str, int]):
        self.parts = parts
        # phases end where a source runs out, at virtual time blocks / parts
        ends = sorted((Fraction(blocks[s], parts[s]), s) for s in blocks)
        self.times = [v for v, _ in ends]
        self.done = [0, *itertools.accumulate(blocks[s] for _, s in ends)]
        gone = [0, *itertools.accumulate(parts[s] for _, s in ends)]
        self.rates = [gone[-1] - x for x in gone]

    def moments(self, source: str, blocks: int) -> Iterator[tuple[int, int, int]]:
        """Phase, and floor and ceiling of the slot, at which the ideal mix has served 0, 1 ... ``blocks`` of a source."""
        q, phase, times, done, rates, last = self.parts[source], 0, self.times, self.done, self.rates, len(self.times) - 1
        end = times[0]
        for j in range(blocks + 1):
            while phase < last and j * end.denominator >= end.numerator * q:
                phase += 1
                end = times[phase]
            slots = done[phase] * q + j * rates[phase]
            yield phase, slots // q, -(-slots // q)


def pfair(parts: Mapping[str, int], blocks: Mapping[str, int]) -> dict[str, list[array]]:
    """Phase, slot, release and deadline of each source's blocks, by earliest deadline first among released blocks."""
    blocks = {s: n for s, n in blocks.items() if n}
    ideal = Ideal(parts, blocks)
    names = sorted(blocks)
    out = {s: [array("i"), array("q"), array("q"), array("q")] for s in names}
    moments = [ideal.moments(s, blocks[s]) for s in names]
    before = [next(m) for m in moments]

    def window(i: int) -> tuple[int, int, int]:
        """Release, deadline and source of the source's next block."""
        phase, release, _ = before[i]
        before[i] = after = next(moments[i])
        columns = out[names[i]]
        columns[0].append(phase)
        columns[2].append(release)
        columns[3].append(after[2])
        return release, after[2], i

    waiting = [window(i) for i in range(len(names))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []  # deadline, source
    left = [blocks[s] for s in names]
    for t in range(sum(left)):
        while waiting and waiting[0][0] <= t:
            _, deadline, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, i))
        deadline, i = heapq.heappop(ready)
        assert t < deadline
        out[names[i]][1].append(t)
        left[i] -= 1
        if left[i]:
            heapq.heappush(waiting, window(i))
    return out


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> pa.Table:
    """Source, block, phase, slot, release and deadline of each block."""
    made = pfair(exact_parts({s: weights[s] for s in blocks if blocks[s]}), blocks)
    columns: list[list] = [[] for _ in range(6)]
    for s, own in made.items():
        n = len(own[0])
        columns[0].append(pa.array([s], pa.string()).take(pa.array([0] * n, pa.int64())))
        columns[1].append(pa.array(range(n), pa.int64()))
        for column, values, kind in zip(columns[2:], own, (pa.int32(), pa.int64(), pa.int64(), pa.int64())):
            column.append(pa.array(memoryview(values), kind))
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.chunked_array(c, k) for c, k in zip(columns, kinds)], [f"{P}s3", f"{P}block2", *(f"{P}{c}" for c in COLUMNS)])


def size_weights(counts: Mapping[str, int], exponent: float) -> dict[str, float]:
    """Target weights that flatten the sources' sizes: count to the power of ``exponent``."""
    return {s: n**exponent for s, n in counts.items()}


def _scheduled(docs: DataFrame, weights: Mapping[str, float] | None = None, exponent: float = 0.7, block_rows: int | None = None, source: str = "source", keys: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, int]:
    """``docs`` with the schedule in columns of private names; the number of slots.

    Rows within a source are in hash order of ``keys``.
    """
    spark = docs.sparkSession
    s, rank, block = f"{P}source", f"{P}rank", f"{P}block"
    rows = docs.withColumn(s, F.coalesce(F.col(source).cast("string"), F.lit("")))
    counts = group_counts(rows, s)
    total = sum(counts.values())
    block_rows = block_rows or max(BLOCK_ROWS, -(-total // MAX_BLOCKS))
    if weights is None:
        weights = size_weights(counts, exponent)
    targets = {k: float(weights.get(k, 0)) or n / total for k, n in counts.items()}
    sizes = {k: -(-n // block_rows) for k, n in counts.items()}
    blocks = schedule(sizes, targets)
    placed = spark.createDataFrame(blocks)
    if len(blocks) <= BROADCAST_BLOCKS:
        placed = F.broadcast(placed)
    out = ranked(rows, s, counts, list(keys), rank)
    out = out.withColumn(block, F.expr(f"{rank} div {block_rows}"))
    out = out.join(placed, (F.col(s) == F.col(f"{P}s3")) & (F.col(block) == F.col(f"{P}block2")))
    out = out.withColumn(f"{P}position", F.expr(f"{P}mix_slot * {block_rows} + {rank} % {block_rows}"))
    return out.drop(s, rank, f"{P}s3", f"{P}block2"), sum(sizes.values())


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with mix_phase, mix_block, mix_slot, mix_release, mix_deadline and mix_position.

    mix_position orders the mix; it skips numbers only after short last blocks. Slots count from the start of the mix;
    mix_phase is the number of sources that the ideal mix has used up before the block.
    """
    made = {"mix_block": f"{P}block", "mix_position": f"{P}position", **{c: f"{P}{c}" for c in COLUMNS}}
    out, _ = _scheduled(docs, **options)
    return out.select(*(c for c in docs.columns if c not in made), *(F.col(own).alias(name) for name, own in made.items()))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` laid out in the order of the mix; same columns."""
    out, slots = _scheduled(docs, **options)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.expr(f"cast({P}mix_slot * {parts} div {max(slots, 1)} as int)")
    return out.repartitionById(parts, place).sortWithinPartitions(f"{P}position").select(*docs.columns)
