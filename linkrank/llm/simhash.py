"""SimHash near-dedup: generalised pigeonhole search (operator 7).

To find all 64-bit fingerprints within tau bits of one another, the bits are dealt to parts so that correlated bits lie
together, and part i gets a threshold t(i) with the sum of t(i) + 1 equal to tau + 1: any such pair is within t(i) in
some part. Dynamic programming picks the thresholds (also -1: part not probed) with the least estimated cost; the
estimates come from a bounded sample (SAMPLE fingerprints) and never change the result. A part with t bits to spare
is probed by its masks: t of its bits left out in each way. Fingerprints that agree on a mask are compared in full.

Equal fingerprints are linked first and searched once. A bucket of over ``cap`` fingerprints is not compared all
against all: its free bits are split into tau + 1 parts of which one must agree, twice, and what is still large is
grouped with each tau of the free bits left out, where all members of a group link to the least of them. This loses
no link.

Edge cases: a null or empty text has the fingerprint zero and is linked like any other; texts with fewer words than a
shingle are one shingle; equal texts share a fingerprint; repeated rows each give a row; null ids are never a
component's id unless it has no other; texts of any length are read whole; an empty table gives an empty result; only
texts and ids are read, so other columns may have any names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, discarded, released, spread, stored, text_batches, trimmed
from .components import components

#: Fingerprints that estimates are made from.
SAMPLE = 2048
#: Largest bucket that is compared all against all.
CAP = 256
#: Cost of one probe row in comparisons.
ROW_COST = 8.0

#: Near copies: words of a shingle, differing bits of fingerprints that are compared first, and texts of each shingle that
#: are compared with all its others before all pairs are.
COPY_SHINGLE, COPY_TAU, PIVOTS = 5, 3, 6
#: Hashes that a bucket gets on average, and least and most buckets.
BUCKET_HASHES, BUCKETS, MOST_BUCKETS = 1 << 20, 96, 1 << 17
#: Rows of a block whose places are named by 16 bits.
BLOCK_BITS, BLOCK_MASK = 12, 4095
#: The bucket in hot hashes' keys; no other has so high a number.
HOT_BUCKET = 1 << 20
#: Sets sampled to find hot hashes, and the share (and least number) of them that a hot hash is in.
HOT_SAMPLE, HOT_SHARE, HOT_LEAST = 20_000, 0.002, 20
#: Most uids of texts with candidates that are broadcast.
BROADCAST_UIDS = 500_000

DEALT = "bucket int, block long, hot boolean, place binary, low binary"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words, parted by ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    return [joined[a : b - 1] for a, b in zip([0, *ends], ends[size - 1 :])]


def majority(digests: bytes, width: int) -> np.ndarray:
    """Bits set in over half of the digests of ``width`` bytes, as 64-bit words."""
    rows = np.frombuffer(digests, np.uint8).reshape(-1, width)
    if not len(rows):
        return np.zeros(width // 8, np.uint64)
    counts = np.zeros(width * 8, np.int64)
    for at in range(0, len(rows), 65_536):
        counts += np.unpackbits(rows[at : at + 65_536], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(rows), bitorder="little").view("<u8")


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The contract's fingerprint: majority of the XXH64 of word shingles, repeats included."""
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(s, seed) for s in shingles(words_of(text), size)], "<u8")
    return int(majority(hashes.tobytes(), 8)[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint as a signed 64-bit integer."""
    return F.pandas_udf(lambda s: trimmed(pd.Series([fingerprint(x) for x in s], dtype="uint64").astype("int64")), "long")(text)


# --- which masks to probe ---


def bit_groups(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Deals the columns of ``bits`` to parts of nearly equal width, the most correlated together."""
    width = bits.shape[1]
    with np.errstate(all="ignore"):
        alike = np.abs(np.nan_to_num(np.corrcoef(bits.T), nan=1.0)).reshape(width, width)
    left, out = list(range(width)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        start = max(left, key=lambda j: (alike[j, left].sum(), -j))
        group = [start]
        left.remove(start)
        while len(group) < size:
            best = max(left, key=lambda j: (alike[j, group].sum(), -j))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def agreeing_masks(bits: np.ndarray, group: list[int], most: int) -> list[float]:
    """For t = 0..most: the mean number of a part's t-masks on which a pair agrees, from a sample's pairs.

    Rare agreements can't be seen in a sample, so the counts are at least those of independent bits.
    """
    part = bits[:, group].astype(np.float32)
    width = len(group)
    distance = np.rint(part.sum(1)[:, None] + part.sum(1)[None, :] - 2 * part @ part.T).astype(int)[np.triu_indices(len(bits), 1)]
    seen = np.bincount(distance, minlength=width + 1)[: width + 1] / max(1, len(distance))
    mean = bits[:, group].mean(0) if len(bits) else np.full(width, 0.5)
    alone = np.array([1.0])
    for p in 2 * mean * (1 - mean):
        alone = np.convolve(alone, [1 - p, p])
    share = np.maximum(seen, alone)
    return [float(sum(share[d] * math.comb(width - d, t - d) for d in range(t + 1))) for t in range(most + 1)]


def allocate(costs: list[list[float]], tau: int) -> list[int]:
    """Thresholds with the least sum of costs[i][t] and sum of (t + 1) equal to tau + 1; -1 costs nothing."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t in range(-1, min(tau - used, len(cost) - 1) + 1):
                new = (total + (cost[t] if t >= 0 else 0.0), [*chosen, t])
                if used + t + 1 not in step or new < step[used + t + 1]:
                    step[used + t + 1] = new
        best = step
    return best[tau + 1][1]


def probe_masks(sample: np.ndarray, rows: int, tau: int, most_parts: int = 8) -> list[int]:
    """The cheapest masks that cover every pair within ``tau`` bits, for ``rows`` fingerprints like the sample's."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    if len(bits) < 2:
        bits = np.zeros((2, 64), np.uint8)
    best = None
    for parts in range(1, most_parts + 1):
        groups = bit_groups(bits, parts)
        costs = []
        for g in groups:
            agree = agreeing_masks(bits, g, min(tau, len(g) - 1))
            costs.append([rows * rows / 2 * a + rows * ROW_COST * math.comb(len(g), t) for t, a in enumerate(agree)])
        chosen = allocate(costs, tau)
        total = sum(c[t] for c, t in zip(costs, chosen) if t >= 0)
        if best is None or total < best[0]:
            best = total, groups, chosen
    _, groups, chosen = best
    out = []
    for g, t in zip(groups, chosen):
        if t >= 0:
            out += [sum(1 << b for b in g) - sum(1 << b for b in spared) for spared in itertools.combinations(g, t)]
    return out


def finer_masks(mask: int, tau: int) -> list[int]:
    """``mask`` with one of tau + 1 parts of its free bits added: a pair within tau bits agrees on one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[i :: tau + 1]) for i in range(tau + 1)]


def spared_masks(mask: int, tau: int) -> list[int]:
    """All bits but ``tau`` that ``mask`` leaves free, in each way: who agrees on one is within tau bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    everything = (1 << 64) - 1
    return [everything - sum(1 << b for b in x) for x in itertools.combinations(free, min(tau, len(free)))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# --- links ---


def _probes(rows: DataFrame, finer: dict, column: str) -> DataFrame:
    """Each row with each of the masks that ``finer`` gives for its ``column``; a bounded table of masks is broadcast."""
    table = [(k, signed(m)) for k, masks in finer.items() for m in masks]
    name = f"{P}from"
    kind = dict(rows.dtypes)[column]
    masks = rows.sparkSession.createDataFrame(table, f"{name} {kind}, {P}mask long")
    out = rows.join(F.broadcast(masks), F.col(column) == F.col(name)).drop(name)
    out = out.drop("mask").withColumnRenamed(f"{P}mask", "mask")
    return out.withColumn("key", F.col("p").bitwiseAND(F.col("mask")))


def spanning_forest(bucket: np.ndarray, p: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of links within ``tau`` bits that connect each bucket as all such links would: shortest first, and
    among equals in a hash order. ``bucket`` is sorted."""
    found = []
    for step in range(1, len(bucket)):
        i = np.flatnonzero(bucket[step:] == bucket[:-step])
        if not len(i):
            break
        d = np.bitwise_count(p[i] ^ p[i + step])
        i, d = i[d <= tau], d[d <= tau]
        found.append(np.stack([i, i + step, d.astype(np.int64)]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j, d = np.concatenate(found, 1)
    mixed = (p[i] ^ (p[j] << np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((mixed, d))
    root = list(range(len(bucket)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for at, a, b in zip(order.tolist(), i[order].tolist(), j[order].tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            kept.append(at)
    return i[kept], j[kept]


def _forests(tau: int):
    """Links of each bucket's spanning forest, from rows sorted by bucket; a bucket may go on in the next batch."""

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        r, mask, key, p, node = rows
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
        i, j = spanning_forest(np.cumsum(new), p.view(np.uint64), tau)
        return trimmed(pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("r", "mask", "key", "p", "node")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            last = len(rows[0]) - 1
            same = (rows[0] == rows[0][last]) & (rows[1] == rows[1][last]) & (rows[2] == rows[2][last])
            cut = int(np.flatnonzero(~same).max(initial=-1)) + 1
            if cut:
                yield links([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
        if held is not None:
            yield links(held)

    return run


def near_links(points: DataFrame, tau: int, cap: int = CAP, sparse: bool = False) -> DataFrame:
    """Links a, b (a < b) that connect whatever is connected by pairs within ``tau`` bits. ``points``: r, p, node.

    r names the fingerprint where a node has several; nodes of one r and p are linked to the least of them. All links
    are between nodes within tau bits in some r. With ``sparse`` a bucket gives a spanning forest of its links in
    place of all, so their number can't grow with the square of a class of copies, and a bucket that is still over
    ``cap`` at the third level gives none: its masks with tau bits left out can be millions, too many for the driver to
    broadcast. So the links may then connect less, and the caller needs another search that is complete.
    """
    spark = points.sparkSession
    least = points.groupBy("r", "p").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
    least = stored(least)
    same = points.join(least.where("n > 1").select(F.col("r").alias("r2"), F.col("p").alias("p2"), F.col("node").alias("a")), (F.col("r") == F.col("r2")) & (F.col("p") == F.col("p2")))
    out = same.where("a < node").select("a", F.col("node").alias("b"))
    least = least.select("r", "p", "node")
    counts = {x["r"]: x["count"] for x in least.groupBy("r").count().collect()}
    # about SAMPLE fingerprints of each r, in hash order; the hash decides alone, so no task ranks all rows of one r
    steps = spark.createDataFrame([(r, max(1, n // SAMPLE)) for r, n in counts.items()], f"{P}r int, {P}step long")
    taken = least.join(F.broadcast(steps), F.col("r") == F.col(f"{P}r")).where(F.pmod(F.xxhash64("p"), F.col(f"{P}step")) == 0)
    samples: dict[int, list[int]] = {r: [] for r in counts}
    for x in taken.select("r", "p").collect():
        samples[x["r"]].append(x["p"])
    samples = {r: sorted(p) for r, p in samples.items()}
    plan = {r: probe_masks(np.array(p, np.int64).view(np.uint64), counts[r], tau) for r, p in samples.items()}
    if not plan:
        return out
    bucket = ["r", "mask", "key"]
    level, columns = _probes(least, plan, "r"), ["r", "mask", "key", "p", "node"]
    masks = sorted({m for x in plan.values() for m in x})
    for depth in range(3):
        sizes = level.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        full = stored(level.select(*columns).join(sizes, bucket))
        light = full.where(F.col("n") <= cap)
        if sparse:
            near = light.select(*columns[:2], "key", "p", "node").repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(_forests(tau), "a long, b long")
        else:
            a = light.select(*bucket, F.col("node").alias("a"), F.col("p").alias("pa"))
            b = light.select(*bucket, F.col("node").alias("b"), F.col("p").alias("pb"))
            # the comparison is part of the join, so only links leave it
            close = F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= tau
            near = a.join(b.withColumnsRenamed({k: f"{k}2" for k in bucket}), [F.col(k) == F.col(f"{k}2") for k in bucket] + [F.col("a") < F.col("b"), close])
        out = out.unionByName(near.select("a", "b"))
        heavy = full.where(F.col("n") > cap).select(*columns)
        if sparse and depth == 2 or not heavy.limit(1).count():
            return out.distinct()
        if depth < 2:
            level = _probes(heavy, {signed(m): finer_masks(m, tau) for m in masks}, "mask")
            masks = sorted({f for m in masks for f in finer_masks(m, tau)})
    groups = _probes(heavy, {signed(m): spared_masks(m, tau) for m in masks}, "mask")
    first = groups.groupBy(*bucket).agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    linked = groups.select(*bucket, F.col("node").alias("b")).join(first, bucket).where("a < b")
    return out.unionByName(linked.select("a", "b")).distinct()


# --- the operator ---


def near_duplicates(docs: DataFrame, tau: int = 2, cap: int = CAP, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint and component_id (the least doc_id reachable over links) of each row."""
    text_batches(docs.sparkSession)
    light = stored(docs.select(F.col(key).alias("doc_id"), fingerprints(F.col(text)).alias("p")))
    nodes = stored(light.groupBy("p").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    links = near_links(nodes.select(F.lit(0).alias("r"), "p", F.col("p").alias("node")), tau, cap)
    roots = stored(components(links))
    least = roots.join(nodes, F.col("node") == F.col("p")).groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(least, "root").select(F.col("node").alias(f"{P}p"), "component_id")
    named = nodes.join(linked, F.col("p") == F.col(f"{P}p"), "left").select(F.col("p").alias(f"{P}p"), F.coalesce("component_id", "first").alias("component_id"), "n")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    out = spread(light, named, F.col("p") == F.col(f"{P}p"), "n", total)
    return out.select("doc_id", F.lpad(F.lower(F.hex("p")), 16, "0").alias("fingerprint"), "component_id")


# --- near copies of the pipeline ---


def packed(hashes: np.ndarray) -> bytes:
    """Sorted 48-bit shingle hashes, six bytes each."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def hash_set(text: str | None) -> np.ndarray:
    """The text's distinct five-word shingles as sorted 64-bit hashes."""
    hashes = b"".join([xxhash.xxh3_64_digest(w, 100) for w in shingles(words_of(text), COPY_SHINGLE)])
    return np.unique(np.frombuffer(hashes, "<u8"))


def shingle_set(text: str | None) -> bytes:
    """The packed set of the text's shingle hashes."""
    return packed(np.unique(hash_set(text) >> np.uint64(16)))


def spared(size: int) -> int:
    """How many shingles of a set of ``size`` a set of similarity 0.8 or more may lack: a fifth."""
    return size // 5


def sketch_size(size: int) -> int:
    """How many of a set's least hashes its sketch holds: those that a near copy may lack, a tenth of the set, and one."""
    return min(size, spared(size) + size // 10 + 1)


def least_shared(size: int) -> int:
    """How many hashes of a set's sketch are in the sketch of each near copy, at least.

    A near copy lacks ``spared`` shingles at most, so a sketch has size // 10 + 1 common ones at least. These are the
    least common ones on both sides, so both sketches have as many as the smaller side grants, whose size is four
    fifths of ``size`` at least.
    """
    return (size - size // 5) // 10 + 1


SUMMARY = "p long, size int, same binary, sketch binary"


def summaries(text: Column) -> Column:
    """The fingerprint of the text's shingle set, the set's size and digest, and the sketch of its least hashes."""

    def run(texts: pd.Series) -> pd.DataFrame:
        released()
        rows = []
        for x in texts:
            hashes = hash_set(x)
            p = majority(hashes.tobytes(), 8)
            short = np.unique(hashes >> np.uint64(16))
            rows.append((int(p.view(np.int64)[0]), len(short), xxhash.xxh3_128_digest(short.tobytes()), packed(short[: sketch_size(len(short))])))
        return trimmed(pd.DataFrame(rows, columns=["p", "size", "same", "sketch"]).astype({"p": "int64", "size": "int32"}))

    return F.pandas_udf(run, SUMMARY)(text)


def _entries(uids: np.ndarray, sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """uid and hash of each member of packed sets."""
    return np.repeat(uids, [len(s) // 6 for s in sets]), unpacked(b"".join(sets))


def _dealt(buckets: int, column: str, hot: np.ndarray):
    """The hashes of packed sets by bucket of hash ranges: rows of a bucket, a block of uids, places in the block and the
    hashes' low 32 bits. Hot hashes stay with their block (in bucket block % buckets), by their number among hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, x = _entries(batch.column("uid").to_numpy(), batch.column(column).to_pylist())
            if not len(uid):
                continue
            at = np.searchsorted(hot, x)
            common = (hot[np.minimum(at, len(hot) - 1)] == x) if len(hot) else np.zeros(len(x), bool)
            block = uid >> BLOCK_BITS
            bucket = np.where(common, block % buckets, ((x * np.uint64(buckets)) >> np.uint64(48)).astype(np.int64))
            low = np.where(common, at.astype(np.uint64), x)
            order = np.lexsort((bucket, common, block))
            block, bucket, common = block[order], bucket[order], common[order]
            place, low = (uid[order] & BLOCK_MASK).astype("<u2"), low[order].astype("<u4")
            new = np.ones(len(block), bool)
            new[1:] = (block[1:] != block[:-1]) | (bucket[1:] != bucket[:-1]) | (common[1:] != common[:-1])
            starts = np.flatnonzero(new)
            ends = [*starts[1:].tolist(), len(block)]
            cut = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(starts.tolist(), ends)], pa.binary())
            columns = [pa.array(bucket[starts].astype(np.int32)), pa.array(block[starts]), pa.array(common[starts]), cut(place), cut(low)]
            yield trimmed(pa.RecordBatch.from_arrays(columns, ["bucket", "block", "hot", "place", "low"]))

    return run


def _bucket_rows(batches: Iterator[pa.RecordBatch], estimates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """uid, key and count of what ``_dealt`` sent to a partition. A key stands for one hash in all partitions; counts are
    exact but for hot hashes, which have an estimate."""
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        places, lows = batch.column("place").to_pylist(), batch.column("low").to_pylist()
        lengths = [len(x) // 2 for x in places]
        uid = (np.repeat(batch.column("block").to_numpy(), lengths) << BLOCK_BITS) | np.frombuffer(b"".join(places), "<u2")
        hot = np.repeat(batch.column("hot").to_numpy(zero_copy_only=False), lengths)
        bucket = np.where(hot, HOT_BUCKET, np.repeat(batch.column("bucket").to_numpy(), lengths).astype(np.int64))
        parts.append((uid, bucket << 32 | np.frombuffer(b"".join(lows), "<u4"), hot))
    if not parts:
        return None
    uid, key, hot = (np.concatenate(x) for x in zip(*parts))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    counts = counts[inverse]
    if hot.any():
        counts[hot] = estimates[key[hot] & 0xFFFFFFFF]
    return uid, key, counts


def _shared(estimates: np.ndarray):
    """How many of a uid's hashes other sets have, too. A hash's rows are in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _bucket_rows(batches, estimates)
        if rows is not None:
            uid, _, counts = rows
            uids, n = np.unique(uid[counts > 1], return_counts=True)
            for at in range(0, len(uids), 50_000):
                yield trimmed(pa.RecordBatch.from_arrays([pa.array(uids[at : at + 50_000]), pa.array(n[at : at + 50_000].astype(np.int32))], ["uid", "n"]))

    return run


def _counted(estimates: np.ndarray):
    """Of each uid, the number of hashes that no other set has, and the shared ones with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _bucket_rows(batches, estimates)
        if rows is None:
            return
        uid, key, counts = rows
        order = np.argsort(uid, kind="stable")
        uid, key, counts = uid[order], key[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]]))
        ends = np.append(starts[1:], len(uid))
        for at in range(0, len(starts), 20_000):
            first, last = starts[at : at + 20_000], ends[at : at + 20_000]
            k, n = key[first[0] : last[-1]], counts[first[0] : last[-1]]
            several = n > 1
            before = np.concatenate([[0], np.cumsum(several)])
            offsets = before[np.append(first, last[-1]) - first[0]]
            own = (last - first) - np.diff(offsets)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(n[several]), pa.array(k[several])], ["n", "key"]))
            yield trimmed(pa.RecordBatch.from_arrays([pa.array(uid[first]), pa.array(own, pa.int32()), lists], ["uid", "own", "shared"]))

    return run


def hot_hashes(sets: DataFrame, column: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that HOT_SHARE or more of a sample of about HOT_SAMPLE sets have, sorted, and how many sets may have them.

    Their number is bounded by that of the sample's hashes over HOT_SHARE * HOT_SAMPLE. They are known to be shared, so
    their entries needn't meet in one task to be counted. ``sets``: uid and packed sets.
    """
    step = max(1, rows // HOT_SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = np.unique(unpacked(b"".join(batch.column(column).to_pylist())), return_counts=True)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)), pa.array(n)], ["x", "n"])

    least = max(HOT_LEAST, int(HOT_SHARE * rows / step))
    taken = sets.where(F.pmod(F.xxhash64("uid"), F.lit(step)) == 0).select(column)
    found = taken.mapInArrow(run, "x long, n long").groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    found.sort()
    return np.array([r["x"] for r in found], np.uint64), np.array([r["n"] * step for r in found], np.int64)


def _buckets(hashes: int) -> int:
    return min(MOST_BUCKETS, max(BUCKETS, math.ceil(hashes / BUCKET_HASHES)))


def _may_have_copies(sets: DataFrame, rows: int) -> DataFrame:
    """uid of the sets of which so many sketch hashes are in other sketches as a near copy has. ``sets``: uid, size, sketch."""
    buckets = _buckets((sets.agg(F.sum(F.octet_length("sketch"))).first()[0] or 0) // 6)
    hot, estimates = hot_hashes(sets, "sketch", rows)
    dealt = sets.select("uid", "sketch").mapInArrow(_dealt(buckets, "sketch", hot), DEALT)
    shared = dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(_shared(estimates), "uid long, n int").groupBy("uid").agg(F.sum("n").alias("n"))
    least = F.expr("(size - size div 5) div 10 + 1")
    return shared.join(sets.select(F.col("uid").alias("u"), "size"), F.col("uid") == F.col("u")).where(F.col("n") >= least).select("uid")


def _similar(sets: pd.Series) -> pd.Series:
    """Whether both of a pair's sets have a Jaccard similarity of 0.8 or more."""
    out = []
    for x, y in sets:
        common = len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True))
        out.append(9 * common >= 4 * (len(x) + len(y)) // 6)
    return trimmed(pd.Series(out, dtype=bool))


def _alike(links: DataFrame, sets: DataFrame) -> DataFrame:
    """The links whose texts' shingle sets have a Jaccard similarity of 0.8 or more, as a stored table.

    Only sets that a link names are shuffled, to the link.
    """
    ends = links.select(F.explode(F.array(*(F.struct(F.col(x).alias("end"), F.lit(i).alias("i"), "a", "b") for i, x in enumerate("ab")))).alias("e")).select("e.*")
    ends = stored(ends)
    both = sets.join(_few(ends, ends.count()), F.col("uid") == F.col("end")).groupBy("a", "b").agg(F.collect_list("parts").alias("parts"))
    out = stored(both.where(F.pandas_udf(_similar, "boolean")("parts")).select("a", "b"))
    discarded(ends)
    return out


def _rarest(sets: DataFrame, rows: int) -> DataFrame:
    """uid, size, own, place, key: the shingles of which two sets of Jaccard similarity 0.8 share one at least.

    Shingles are ordered by the number of sets that have them. Sets of such similarity have at least four fifths of each
    one's shingles in common, so of the others plus one, taken rarest first, one is common. A shingle of one set is
    never common, so a set with enough of these has no near copy.
    """
    buckets = _buckets((sets.agg(F.sum(F.octet_length("parts"))).first()[0] or 0) // 6)
    hot, estimates = hot_hashes(sets, "parts", rows)
    dealt = sets.select("uid", "parts").mapInArrow(_dealt(buckets, "parts", hot), DEALT)
    counted = dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(_counted(estimates), "uid long, own int, shared array<struct<n:long,key:long>>")
    tallied = counted.groupBy("uid").agg(F.sum("own").cast("int").alias("own"), F.flatten(F.collect_list("shared")).alias("shared"))
    tallied = tallied.withColumn("size", F.col("own") + F.size("shared"))
    wanted = F.expr("size div 5").cast("int") + 1 - F.col("own")
    rarest = tallied.where(wanted > 0).select("uid", "size", "own", F.slice(F.array_sort("shared"), 1, F.greatest(wanted, F.lit(0))).alias("rarest"))
    return rarest.select("uid", "size", "own", F.posexplode("rarest").alias("at", "x")).select("uid", "size", "own", (F.col("own") + F.col("at")).alias("place"), "x.key")


def _may_be(x: str, y: str) -> Column:
    """Whether the shingles from the places of rows x and y on are enough for 0.8, if that is the first common one."""
    c = lambda side, name: F.col(f"{side}.{name}")
    left = F.least(c(x, "size") - c(x, "place"), c(y, "size") - c(y, "place"))
    return 9 * left >= 4 * (c(x, "size") + c(y, "size"))


def _ordered(x: str, y: str) -> list[Column]:
    a, b = F.col(f"{x}.uid"), F.col(f"{y}.uid")
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` (uid, size, own, place, key) with their roots and n, of the keys whose sets are of several classes."""
    rooted = members.join(components(found).withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    keys = rooted.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("n")).where("r1 < r2").select("key", "n")
    return stored(rooted.join(keys, "key"))


def _across(members: DataFrame) -> DataFrame:
    """a and b of all pairs of ``members`` that share a key, are of different classes and may be alike.

    Of each key the largest class is only paired with the others, so a large class of copies among a few other texts
    isn't paired with itself.
    """
    main = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max(F.struct("size", "root"))["root"].alias("main"))
    every = members.join(main, "key")
    x, y = every.where(F.col("root") != F.col("main")).alias("x"), every.alias("y")
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.uid") < F.col("y.uid"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & once & _may_be("x", "y"))
    return pairs.select(*_ordered("x", "y")).distinct()


def copy_classes(docs: DataFrame, cap: int = CAP, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Near copies: (each distinct text's digest, uid, least doc_id, its rows with that doc_id and its rows; uid and root of linked ones).

    Texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    1. Each text gives the fingerprint of its set, and a sketch: its least hashes. A set of which too few sketch hashes
       are in other sketches has no near copy; only the others' sets are made and compared.
    2. The fingerprints' generalised pigeonhole search gives links, which are compared in full. Fingerprints that lie too
       close together for its buckets are left to the next step.
    3. A fingerprint finds most near copies, not all. So the sets' rarest shingles, of which near copies share one, give the
       rest: texts of different classes that share one are compared in full. Of each shingle's texts, that with the
       fewest shingles of its own is compared with all others first, so a class of copies of one text takes
       comparisons in proportion to its size. While over ``cap`` texts of a shingle are of several classes, up to PIVOTS
       texts in turn are compared so; then all pairs of different classes are.
    """
    text_batches(docs.sparkSession)
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    light = docs.select(F.col(key).alias("doc_id"), F.unhex(digest).alias("digest"), summaries(F.col(text)).alias("s"))
    light = stored(light.select("doc_id", "digest", "s.*", F.monotonically_increasing_id().alias("uid")))
    # of equal texts one row's uid counts
    rows = light.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "same", "size", "p")).alias("x"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    groups = rows.groupBy("digest").agg(F.min(F.struct(order.alias("order"), "n")).alias("least"), F.sum("n").alias("rows"), F.min("x").alias("x"))
    groups = stored(groups.select("digest", F.col("least.order.doc_id").alias("first"), F.col("least.n").alias("n"), "rows", "x.*"))
    # equal sets: all are linked to the least, which alone is compared with others
    least = groups.groupBy("same").agg(F.min("uid").alias("a"), F.count(F.lit(1)).alias("several")).where("several > 1")
    found = stored(groups.join(least, "same").where("a < uid").select("a", F.col("uid").alias("b")))
    compared = groups.join(found.select(F.col("b").alias("u")), F.col("uid") == F.col("u"), "left_anti").select("uid")
    total = compared.count()
    sketches = light.select("uid", "size", "sketch").join(_few(compared.select(F.col("uid").alias("u")), total), F.col("uid") == F.col("u")).drop("u")
    wanted = stored(_may_have_copies(sketches if total <= BROADCAST_UIDS else stored(sketches), total))
    left = wanted.count()
    wanted = stored(groups.join(wanted, "uid").select("uid", "digest", "first", "n", "p"))
    sets = stored(_sets(docs, _few(wanted.select("uid", F.col("digest").alias(f"{P}digest"), F.col("first").alias(f"{P}first"), F.col("n").alias(f"{P}n")), left), text, key))
    near = near_links(wanted.select(F.lit(0).alias("r"), "p", F.col("uid").alias("node")), COPY_TAU, cap, sparse=True)
    found = found.unionByName(_alike(near, sets))
    members = _open(_rarest(sets, left), found)
    for _ in range(PIVOTS):
        if not members.where(F.col("n") > 1).limit(1).count():
            return groups, components(found)
        pivots = members.groupBy("key").agg(F.min(F.struct("own", "uid", "size", "place", "root")).alias("x")).select("key", "x.*")
        x, y = members.alias("x"), pivots.alias("y")
        pairs = x.join(y, F.col("x.key") == F.col("y.key")).where((F.col("x.root") != F.col("y.root")) & _may_be("x", "y"))
        more = _alike(pairs.select(*_ordered("x", "y")).distinct(), sets)
        rest = members.drop("root", "n").join(pivots.select(F.col("key").alias("k"), F.col("uid").alias("u")), (F.col("key") == F.col("k")) & (F.col("uid") == F.col("u")), "left_anti")
        found, last = found.unionByName(more), members
        members = _open(rest, found)
        discarded(last)
        if not members.where(F.col("n") > cap).limit(1).count():
            break
    more = _alike(_across(members), sets)
    return groups, components(found.unionByName(more))


def _few(rows: DataFrame, count: int) -> DataFrame:
    """``rows``, to be broadcast if there are BROADCAST_UIDS at most."""
    return F.broadcast(rows) if count <= BROADCAST_UIDS else rows


def _sets(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """uid and the packed shingle set of the texts in ``wanted``: each one's row with its least id."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    rows = docs.select(F.col(key).alias(f"{P}id"), F.col(text).alias(f"{P}text"), digest.alias(f"{P}own"))
    rows = rows.join(wanted, (F.col(f"{P}own") == F.col(f"{P}digest")) & F.col(f"{P}id").eqNullSafe(F.col(f"{P}first"))).select("uid", f"{P}text", f"{P}n")
    # rows that repeat id and text in full
    rows = rows.where(F.col(f"{P}n") == 1).unionByName(rows.where(F.col(f"{P}n") > 1).dropDuplicates(["uid"]))
    return rows.select("uid", F.pandas_udf(lambda s: trimmed(pd.Series([shingle_set(x) for x in s], dtype=object)), "binary")(f"{P}text").alias("parts"))


def deduplicated(docs: DataFrame, cap: int = CAP, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each class of near copies, that with the least doc_id (then digest); same columns.

    Null ids come last; null and empty texts, and texts without words, are copies of one another; rows that repeat in
    full leave one; an empty table gives an empty result; other columns stay as they are, whatever their names.
    """
    groups, roots = copy_classes(docs, cap, text, key)
    roots = stored(roots)
    # of each class, all members but the least go
    members = groups.join(roots, F.col("uid") == F.col("node"))
    order = F.struct(F.col("first").isNull(), F.col("first"), F.col("digest"))
    least = members.groupBy("root").agg(F.min(order).alias("least"))
    gone = members.join(least, "root").where(order != F.col("least")).select(F.col("uid").alias(f"{P}gone"))
    # most texts are of one row that stays; only the others are looked up
    looked = groups.join(gone, F.col("uid") == F.col(f"{P}gone"), "left").where((F.col("rows") > 1) | F.col(f"{P}gone").isNotNull())
    looked = stored(looked.select(F.col("digest").alias(f"{P}digest"), F.col("first").alias(f"{P}first"), F.col("n").alias(f"{P}n"), f"{P}gone"))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    found = docs.join(_few(looked, looked.count()), digest == F.col(f"{P}digest"), "left")
    found = found.where(F.col(f"{P}digest").isNull() | (F.col(f"{P}gone").isNull() & F.col(key).eqNullSafe(F.col(f"{P}first"))))
    if not looked.where(F.col(f"{P}n") > 1).limit(1).count():
        return found.select(*docs.columns)
    # rows that repeat id and text in full: only texts with several such rows can have them
    once = found.where(F.coalesce(f"{P}n", F.lit(1)) == 1).select(*docs.columns)
    more = found.where(F.col(f"{P}n") > 1).dropDuplicates([f"{P}digest"]).select(*docs.columns)
    return once.unionByName(more)
