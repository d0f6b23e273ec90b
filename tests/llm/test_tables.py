"""Operators on small tables: brute-force results, nulls, empty tables, repeated rows, clashing columns."""

import hashlib
import itertools
import json
import math
import os
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkrank.llm import bpe, chat, classifier, common, licenses, media, mixing, rules, sharding, simhash, warc

P = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def rows():
    rng = random.Random(8)
    base = prose(rng, 200)
    near = base.split()
    near[100] = "changed"
    out = [(i, prose(rng, rng.randint(1, 120)), "en", f"s{i % 3}", 1) for i in range(40)]
    out += [(100, base, "en", "hot", 1), (101, base, "en", "hot", 1), (102, " ".join(near), "en", "hot", 1), (100, base, "en", "hot", 1)]
    out += [(200, None, None, None, None), (201, "", "", "", 0), (202, " \n\t ", None, "s0", 3), (None, "no id here at all", "en", None, 2), (203, "x" * 300_000, "en", "s1", 1), (204, "two words", "en", "s1", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).withColumns({"digest": F.lit("mine"), "key": F.lit(1), "u": F.lit(2), "n": F.lit(3), "rank": F.lit(4), "p": F.lit(5), "score": F.lit(6)})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return docs.where("false")


def key(x):
    return tuple((v is not None, v) for v in x)


# --- sharding ---


def minimax(weights, shards):
    """By trying all capacities that a contiguous run can have."""
    sums = sorted({sum(weights[i:j]) for i in range(len(weights)) for j in range(i + 1, len(weights) + 1)})
    for capacity in sums:
        used, room = 1, capacity
        for w in weights:
            if w > capacity:
                break
            if w > room:
                used, room = used + 1, capacity
            room -= w
        else:
            if used <= shards:
                return capacity


@pytest.mark.parametrize("read", [50_000, 3])
def test_minimax(spark, monkeypatch, read):
    monkeypatch.setattr(sharding, "READ_GROUPS", read)
    rng = random.Random(read)
    for n, hot in ((1, 0), (5, 0), (40, 0), (40, 500)):
        groups = {hashlib.sha256(str(i).encode()).hexdigest(): rng.randint(1, 30) for i in range(n)}
        if hot:
            groups[next(iter(groups))] = hot
        df = spark.createDataFrame(list(groups.items()), "digest string, w long")
        capacity, cuts = sharding.minimax_cuts(df, 4)
        assert capacity == minimax([groups[k] for k in sorted(groups)], 4)
        loads = np.zeros(len(cuts) + 1)
        for k, w in groups.items():
            loads[sum(k >= c for c in cuts)] += w
        assert loads.max() == capacity and len(loads) <= 4


def test_shards(spark, docs, empty):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == docs.count()
    text = {}
    for i, t, *_ in rows():
        text.setdefault(i, (t or "").encode())
    by_text, slots = {}, {}
    for r in got:
        raw = text[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by_text.setdefault(raw, set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values()) and set(slots) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0


# --- mixing ---


def shares(weights, blocks, v):
    """How much of each source the ideal mix has served at virtual time v, by the definition."""
    return {s: min(Fraction(n), Fraction(weights[s]) * v) for s, n in blocks.items()}


@pytest.mark.parametrize("weights,blocks", [
    ({"hot": 0.9} | {f"s{i}": 0.001 for i in range(100)}, {"hot": 900} | {f"s{i}": 2 for i in range(100)}),
    ({f"s{i}": float(n**0.7) for i, n in enumerate((70_000, 9_000, 800, 50))}, {f"s{i}": n for i, n in enumerate((2000, 900, 700, 600))}),
    ({"a": 1.0, "b": 1e-9}, {"a": 3000, "b": 5}),
    ({"a": 1.0, "b": 1.0, "c": 2.0}, {"a": 100, "b": 10, "c": 1}),
    ({"a": 3.0}, {"a": 7}),
])
def test_schedule_keeps_to_the_exact_weights(weights, blocks):
    rows = mixing.schedule(blocks, weights).to_pylist()
    p = lambda r, name: r[f"__lr_{name}"]
    assert sorted(p(r, "mix_slot") for r in rows) == list(range(sum(blocks.values())))
    assert all(p(r, "mix_release") <= p(r, "mix_slot") < p(r, "mix_deadline") for r in rows)
    assert all([p(r, "block2") for r in rows if p(r, "s3") == s] == list(range(n)) for s, n in blocks.items())
    # windows by the definition: the ideal mix's slots at the times when it begins and ends a block
    for r in rows[:: max(1, len(rows) // 300)]:
        s, j = p(r, "s3"), p(r, "block2")
        begin, end = (sum(shares(weights, blocks, x / Fraction(weights[s])).values()) for x in (Fraction(j), Fraction(j + 1)))
        assert p(r, "mix_release") == math.floor(begin) and p(r, "mix_deadline") == math.ceil(end)
        assert p(r, "mix_phase") == sum(Fraction(n) / Fraction(weights[k]) <= Fraction(j) / Fraction(weights[s]) for k, n in blocks.items())
    # until a source runs out, each is within less than one block of its weight's share after every slot
    total, seen = sum(map(Fraction, weights.values())), dict.fromkeys(blocks, 0)
    order = {p(r, "mix_slot"): p(r, "s3") for r in rows}
    first = min(Fraction(n) * total / Fraction(weights[s]) for s, n in blocks.items())
    for t in range(math.floor(first)):
        seen[order[t]] += 1
        assert all(abs(seen[s] - (t + 1) * Fraction(w) / total) < 1 for s, w in weights.items())


def test_a_million_slots_stay_within_a_block():
    weights = {"a": 1 / 3, "b": 2 / 3, "c": 0.123}
    made = mixing.pfair(mixing.exact_parts(weights), {"a": 300_000, "b": 600_000, "c": 110_700})
    total = sum(weights.values())
    for s, w in weights.items():
        slots = np.asarray(made[s][1], float)
        taken, ideal = np.arange(len(slots)), slots * (w / total)
        assert len(slots) and (np.abs(taken - ideal) < 1 + 1e-6).all()


def test_many_sources_are_planned_fast():
    began = time.time()
    blocks = {f"s{i:05}": 1 + i % 7 for i in range(10_000)}
    rows = mixing.schedule(blocks, {s: float(n) ** 0.7 for s, n in blocks.items()})
    assert rows.num_rows == sum(blocks.values()) and time.time() - began < 10


def test_mix_leaves_own_columns(docs):
    odd = docs.withColumns({"mix_slot": F.lit("mine"), "mix_block": F.lit("too"), "q": F.lit(1)})
    assert {(r["mix_slot"], r["mix_block"]) for r in mixing.mixed(odd, block_rows=4).collect()} == {("mine", "too")}
    out = mixing.mix(odd, block_rows=4)
    assert len(set(out.columns)) == len(out.columns) and dict(out.dtypes)["mix_slot"] == "bigint"


def test_mix(docs, empty):
    out = mixing.mix(docs, block_rows=4).collect()
    assert len(out) == docs.count() and len({r["mix_position"] for r in out}) == len(out)
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in out)
    slot = {}
    for r in out:
        slot.setdefault(r["mix_slot"], set()).add(r["source"] or "")
    assert all(len(s) == 1 for s in slot.values())
    laid = mixing.mixed(docs, block_rows=4)
    assert laid.columns == docs.columns and sorted(map(key, laid.collect())) == sorted(map(key, docs.collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mix(docs, weights={"hot": 5.0, "gone": 1.0}, block_rows=1).count() == docs.count()


def test_ranked(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'x', 'y') AS g")
    out = common.ranked(df, "g", common.group_counts(df, "g"), ["id"], "r").collect()
    for g, n in (("x", 1000), ("y", 2000)):
        assert sorted(r["r"] for r in out if r["g"] == g) == list(range(n))


def test_ranked_by_a_digest(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'x', 'y') AS g")
    digest = F.sha2(F.col("id").cast("string"), 256)
    out = common.ranked(df, "g", common.group_counts(df, "g"), ["id"], "r", digest).collect()
    for g in "xy":
        mine = sorted((r["r"], r["id"]) for r in out if r["g"] == g)
        want = sorted((i for i in range(3000) if (i % 3 == 0) == (g == "x")), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
        assert mine == list(enumerate(want))


# --- near-dedup ---


def classes(points, tau):
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(points):
        for j in range(i):
            if bin(a ^ points[j]).count("1") <= tau:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(points))]


@pytest.mark.parametrize("tau,cap", [(2, 256), (2, 1), (2, 3), (3, 2)])
def test_links_connect_all(spark, tau, cap):
    rng = random.Random(tau * 10 + cap)
    points = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            points.add(x)
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
    points = sorted(points)
    df = spark.createDataFrame([(0, simhash.signed(p), i) for i, p in enumerate(points)], "r int, p long, node long")
    links = [tuple(r) for r in simhash.near_links(df, tau, cap).collect()]
    assert all(a < b and bin(points[a] ^ points[b]).count("1") <= tau for a, b in links)
    want = classes(points, tau)
    from linkrank.llm.components import components

    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    got = [roots.get(i, i) for i in range(len(points))]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_long_chain(spark):
    from linkrank.llm.components import components

    n = 300
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    for small in (1000, 0):  # in one task, and in rounds
        got = components(spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b"), small).collect()
        assert len(got) == n and {r["root"] for r in got} == {0}
        assert components(spark.range(0).selectExpr("id AS a", "id AS b"), small).count() == 0
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long"), small).collect()}
        want = {}
        for a, b in pairs:
            x, y = want.setdefault(a, {a}), want.setdefault(b, {b})
            if x is not y:
                x |= y
                want.update(dict.fromkeys(y, x))
        assert got == {i: min(x) for i, x in want.items() if len(x) > 1}


def test_hot_keys_change_nothing(spark, monkeypatch):
    """Joins with hot keys apart give the same: a star about one node in rounds, and rows of one fingerprint."""
    from linkrank.llm import common
    from linkrank.llm.components import components

    left = spark.range(50).selectExpr("id", "id div 40 AS k")
    right = left.groupBy("k").count().selectExpr("k AS key", "k * 10 AS x", "count AS n")
    texts = edited_copies(random.Random(7)) + reordered_copies(random.Random(8)) + ["one two three"] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for least in (common.HOT_ROWS, 2):
        monkeypatch.setattr(common, "HOT_ROWS", least)
        joined = common.spread(left, right, F.col("k") == F.col("key"), "n", 50)
        assert joined.columns == ["id", "k", "key", "x"]
        assert sorted(map(tuple, joined.collect())) == [(i, i // 40, i // 40, i // 40 * 10) for i in range(50)]
        star = components(spark.range(1, 60).selectExpr("id AS a", "0L AS b"), 0).collect()
        assert len(star) == 60 and {r["root"] for r in star} == {0}
        found.append(sorted(map(tuple, simhash.near_duplicates(df).collect())))
    assert found[0] == found[1]


def test_near_duplicates(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    text = rows()
    assert len(got) == len(text)
    prints = sorted({r["fingerprint"] for r in got})
    root = dict(zip(prints, classes([int(p, 16) for p in prints], 2)))
    least = {}
    for r in got:
        if r["doc_id"] is not None:
            c = root[r["fingerprint"]]
            least[c] = min(least.get(c, 1 << 60), r["doc_id"])
    assert all(r["component_id"] == least.get(root[r["fingerprint"]]) for r in got)
    want = {i: f"{simhash.fingerprint(t):016x}" for i, t, *_ in text}
    assert all(r["fingerprint"] == want[r["doc_id"]] for r in got)
    assert simhash.near_duplicates(empty).count() == 0


def test_deduplicated(docs, empty):
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(100) == 1 and 101 not in ids and 102 not in ids  # copies, near copies and a repeated row
    assert set(range(40)) <= set(ids) and None in ids and 203 in ids
    assert sum(i in ids for i in (200, 201, 202)) == 1  # texts without words are alike
    assert simhash.deduplicated(empty).count() == 0


def edited_copies(rng):
    """Copies edited each in other places from one base: like the base, not like one another."""
    base = prose(rng, 300).split()
    out = [base]
    for _ in range(80):
        x = list(base)
        for at in rng.sample(range(300), 6):
            x[at] = prose(rng, 1)
        out.append(x)
    return [" ".join(x) for x in out]


def appended_copies(rng):
    """Copies with a passage appended."""
    out = []
    for _ in range(40):
        base = prose(rng, rng.randint(100, 400))
        out += [base, base + " " + prose(rng, int(len(base.split()) * rng.uniform(0.1, 0.22)))]
    return out


def repeated_copies(rng):
    """Copies that repeat a run of their own words."""
    out = []
    for _ in range(40):
        base = prose(rng, rng.randint(100, 200)).split()
        run = base[40:60]
        out += [" ".join(base), " ".join(base + run * int(len(base) * 0.6 / 20))]
    return out


def reordered_copies(rng):
    """Texts of the same words: sentences in other orders, two of which are near copies of one another."""
    out = []
    for _ in range(12):
        lines = [prose(rng, 40) for _ in range(12)]
        swapped = lines[:-2] + lines[:-3:-1]
        out += [" ".join(lines), " ".join(swapped)] + [" ".join(" ".join(rng.sample(x.split(), 40)) for x in lines) for _ in range(8)]
    return out


def shingle_classes(texts):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return set(root)


@pytest.mark.parametrize("make", [edited_copies, appended_copies, repeated_copies, reordered_copies])
def test_near_copies_are_all_found(spark, make):
    texts = make(random.Random(3))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for cap in (simhash.CAP, 3):
        assert {r["doc_id"] for r in simhash.deduplicated(df, cap).collect()} == shingle_classes(texts)


def test_crowded_fingerprints(spark, monkeypatch):
    """A large class whose fingerprints crowd the buckets takes no large table of masks, and no copy is lost."""
    rng, base = random.Random(8), prose(random.Random(9), 120).split()
    texts = []
    for _ in range(40):
        x = list(base)
        for at in rng.sample(range(120), 2):
            x[at] = prose(rng, 1)
        texts.append(" ".join(x))
    texts += edited_copies(rng)
    sent, probes = [], simhash._probes

    def counted(rows, finer, column):
        sent.append(sum(map(len, finer.values())))
        return probes(rows, {k: v[:1] for k, v in finer.items()} if sent[-1] > 100_000 else finer, column)

    monkeypatch.setattr(simhash, "_probes", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.deduplicated(df, 1).collect()} == shingle_classes(texts)
    assert len(sent) == 3 and max(sent) < 100_000


def test_pairs_across_classes(spark):
    """Each pair of texts of different classes that share a shingle, once, whichever class is the largest."""
    rng, members = random.Random(10), set()
    root = {uid: rng.choice([1, 1, 1, 1, 2, 3]) if uid > 3 else uid for uid in range(1, 40)}
    for key in range(5):
        members |= {(uid, key) for uid in rng.sample(range(1, 40), 15)}
    rows = [(uid, 100, 0, 0, key, root[uid]) for uid, key in sorted(members)]
    df = spark.createDataFrame(rows, "uid long, size int, own int, place int, key long, root long")
    want = {(a, b) for a, k in members for b, other in members if k == other and a < b and root[a] != root[b]}
    found = [tuple(r) for r in simhash._across(df).collect()]
    assert len(found) == len(want) and set(found) == want


def all_pairs_classes(texts):
    """The least place of each class, from the overlaps of every text with every other."""
    names, sets = {}, []
    for x in texts:
        w = x.lower().split()
        sets.append(np.array(sorted({names.setdefault(tuple(w[i : i + 5]), len(names)) for i in range(max(1, len(w) - 4))})))
    sizes = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    begins = np.searchsorted(flat[order], np.arange(len(names) + 1))
    holders = member[order]
    root = np.arange(len(texts))
    for i, s in enumerate(sets):
        common = np.bincount(np.concatenate([holders[begins[k] : begins[k + 1]] for k in s]), minlength=len(sets))
        for j in np.flatnonzero(9 * common >= 4 * (sizes + sizes[i])):
            if root[i] != root[j]:
                root[np.isin(root, (root[i], root[j]))] = min(root[i], root[j])
    return set(root.tolist())


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_near_copies_of_the_tables(spark, scale):
    """No near copy of all pairs is missed, and nothing else goes."""
    path = f"/root/testdata/{scale}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path)
    found = sorted({(r["doc_id"], r["text"] or "") for r in docs.collect()})
    kept = all_pairs_classes([x for _, x in found])
    assert {r["doc_id"] for r in simhash.deduplicated(docs).collect()} == {found[i][0] for i in kept}


def test_sketches_keep_near_copies():
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randint(1, 60)
        a = {rng.getrandbits(48) for _ in range(n)}
        b = set(rng.sample(sorted(a), len(a) - rng.randint(0, len(a) // 5))) | {rng.getrandbits(48) for _ in range(rng.randint(0, 8))}
        if 9 * len(a & b) >= 4 * (len(a) + len(b)):
            x, y = (set(sorted(s)[: simhash.sketch_size(len(s))]) for s in (a, b))
            assert len(x & y) >= max(simhash.least_shared(len(a)), simhash.least_shared(len(b)))


@pytest.mark.parametrize("share", [2.0, 0.01])  # no hot hashes, and all that two sets have
def test_hot_hashes_lose_no_copy(spark, monkeypatch, share):
    monkeypatch.setattr(simhash, "HOT_SHARE", share)
    monkeypatch.setattr(simhash, "HOT_LEAST", 2 if share < 1 else 10**9)
    texts = edited_copies(random.Random(5)) + appended_copies(random.Random(6))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.deduplicated(df).collect()} == shingle_classes(texts)


# --- rules, classifier, tokens ---


def test_rules(docs, labels, empty):
    got = {r["doc_id"]: r for r in rules.judged(docs, labels).collect()}
    assert got[200]["n_words"] == 0 and got[200]["base_failed"] and not got[200]["kept"] and got[204]["base_failed"]
    assert got[100]["n_words"] == 200 and got[203]["word_chars"] == 300_000
    kept = rules.kept(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {i for i, r in got.items() if r["kept"]}
    assert rules.judged(empty, labels).count() == 0
    no = rules.judged(docs, labels.where("false")).collect()
    assert all(r["kept"] != r["base_failed"] for r in no)


def sentence(rng, n=14):
    return " ".join(rng.choice(["the", "of", "and", "in", *WORDS]) for _ in range(n)).capitalize() + " of the plain."


def test_lines_in_good_texts_are_marked(spark):
    rng = random.Random(4)
    good = ["\n".join(sentence(rng) for _ in range(rng.randint(3, 9))) for _ in range(150)]
    bad = ["\n".join("BUY!! | $$$ | MENU!! | CLICK" for _ in range(rng.randint(2, 8))) for _ in range(50)]
    mixed = []
    for _ in range(40):
        lines = [sentence(rng) for _ in range(10)]
        lines[4:4] = ["HOME!! | MENU!! | CLICK!! | SHARE!!"] * 2
        mixed.append("\n".join(lines))
    rows = [(i, x, "en", "s", 1) for i, x in enumerate(good + bad + mixed)]
    table = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(i, int(not 150 <= i < 200), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    field = rules.train_on(table, marks)
    for x in mixed:
        assert field.viterbi(rules.line_masks(x.encode())[0], {}) == [1] * 4 + [0] * 2 + [1] * 6
    got = {r["doc_id"]: r for r in rules.judged(table, marks).collect()}
    assert all(0 < got[i]["content_share"] < 1 and got[i]["kept"] for i in range(200, 240))
    # kept by the definition, with the best of all label sequences of short texts
    value = lambda x, y: field.begin[y[0]] + sum(x[i, v] for i, v in enumerate(y)) + sum(field.steps[a, b] for a, b in zip(y, y[1:]))
    for i, x, *_ in rows[:150:15] + rows[150:200:10]:
        masks, sizes = rules.line_masks(x.encode())
        scores = rules.bits(masks) @ field.features
        best = max(itertools.product((0, 1), repeat=len(masks)), key=lambda y: value(scores, y))
        share = sum(n for n, y in zip(sizes, best) if y) / sum(sizes)
        assert got[i]["content_share"] == pytest.approx(share) and got[i]["kept"] == (share >= 0.5 and not got[i]["base_failed"])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_texts_can_be_mixed(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    out = rules.judged(read("documents"), read("labels"))
    assert out.where("content_share > 0 AND content_share < 1").count() >= 20


def test_classifier(spark, docs, labels, empty):
    rng = random.Random(1)
    made = [(i, prose(rng, 60) + "." if i % 2 else "$$$ ### BUY!! " * rng.randint(5, 30), "en", "s", 1) for i in range(300)]
    table = spark.createDataFrame(made, SCHEMA)
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = classifier.scored(table, marks).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)
    odd = classifier.scored(docs, labels).collect()
    assert len(odd) == docs.count() and all(r["score"] is not None for r in odd)
    assert len({r["score"] for r in odd if r["doc_id"] in (200, 201)}) == 1
    assert classifier.kept(docs, labels).columns == docs.columns
    assert classifier.scored(empty, labels).count() == 0
    assert {r["score"] for r in classifier.scored(docs, labels.where("false")).collect()} == {0.5}


def test_labels_of_held_out_rows_are_not_used(spark):
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    ids = [r[0] for r in rules.labelled_sample(marks, 1000).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert rules.labelled_sample(marks, 10).count() == 10


def test_tokens(spark, docs, empty):
    made = bpe.Tokenizer(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for r in made.round_trip(docs).collect():
        assert (r["n_tokens"] == 0) == (r["doc_id"] in (200, 201))
    coded = made.encode(docs)
    assert coded.columns == [c for c in docs.columns if c != "text"] + ["ids"]
    back = made.decode(coded.select("doc_id", "ids"))
    want = sorted(key((i, t or "")) for i, t, *_ in rows())
    assert sorted(key((r["doc_id"], r["text"])) for r in back.collect()) == want
    digests = {r["doc_id"]: r["decoded_sha256"] for r in made.round_trip(docs).collect()}
    assert all(digests[i] == hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in rows())
    assert made.round_trip(empty).count() == 0 and made.encode(empty).count() == 0
    odd = docs.withColumn("ids", F.lit("mine"))  # a column of the result's name is replaced
    assert made.encode(odd).columns == coded.columns and made.encode(odd).where(F.size("ids") > 0).count() == coded.where(F.size("ids") > 0).count()
    assert made.decode(coded.select("ids", F.lit("mine").alias("text"))).where("text = 'mine'").count() == 0
    assert made.round_trip(odd.withColumn("n_tokens", F.lit("mine"))).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def clashing(docs):
    """Extra columns with the names that operators work with or return."""
    names = "score predicted held_out shard slot size law digest fingerprint component_id uid p node n lines kept v same parts hits license_id ids tracks x y"
    return docs.withColumns({c: F.lit("mine") for c in names.split()})


def test_clashing_columns(spark, docs, labels):
    odd = clashing(docs)
    for run in (lambda d: classifier.scored(d, labels), lambda d: rules.judged(d, labels), lambda d: sharding.shard_documents(d, 4), simhash.near_duplicates,
                media.text_media, lambda d: licenses.scan_licenses(d, licenses.known_digests(spark))):
        plain, got = run(docs), run(odd)
        assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    for run in (lambda d: classifier.kept(d, labels), lambda d: rules.kept(d, labels), simhash.deduplicated, mixing.mixed):
        got = run(odd)
        assert got.columns == odd.columns and sorted(key(r[:5]) for r in got.collect()) == sorted(key(r[:5]) for r in run(docs).collect())
        assert got.where("score <> 'mine' OR shard <> 'mine' OR p <> 'mine'").count() == 0


# --- licences ---


def test_licenses(spark, empty, monkeypatch):
    mit = licenses.LICENSES["MIT"]
    cases = {
        1: mit.upper().replace("year holder", "2019 Someone"),
        2: mit.replace("\n", "\n\n * ").replace("sublicense", "sublicence").replace('"', "'").replace("Copyright (c) year holder", "© 2020 A, B"),
        3: mit + " More.",
        4: "Some text.\nLicensed under CC BY-NC 4.0.\nlicenced UNDER cc by-nc 4.0!\nReleased under the MIT License.",
        5: "Licenced under the Apache Licence, version 2.0",
        6: "", 7: None, 8: "...",
    }
    df = spark.createDataFrame(list(cases.items()) + [(5, cases[5])], "doc_id long, text string").withColumn("digest", F.lit("x"))
    known = licenses.known_digests(spark)
    found = lambda out: sorted((r["doc_id"], r["license_id"], list(r["line_license_ids"]), r["n_license_lines"]) for r in out.collect())
    got = found(licenses.scan_licenses(df, known))
    apache = (5, "Apache-2.0-notice", ["Apache-2.0-notice"], 1)
    assert got == [
        (1, "MIT", [], 0), (2, "MIT", [], 0), (3, None, [], 0), (4, None, ["CC-BY-NC-4.0-notice", "MIT-notice"], 3), apache, apache,
        (6, None, [], 0), (7, None, [], 0), (8, None, [], 0)]
    assert licenses.scan_licenses(empty, known).count() == 0
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 3)
    assert found(licenses.scan_licenses(df, known)) == got
    twice = spark.createDataFrame([("b", "Same text"), ("a", "same, TEXT"), ("c", "")], "license_id string, text string")
    assert [r["license_id"] for r in licenses.known_digests(spark, twice).collect()] == ["a"]
    marks = spark.createDataFrame([(1, "e\u0301te"), (2, "e te")], "doc_id long, text string")  # a letter with a combining mark is a letter
    assert len({r["canonical_sha256"] for r in licenses.scan_licenses(marks, known).collect()}) == 2


def canonical(text):
    """A licence's canonical form, step by step on words."""
    lines = []
    for line in text.lower().split("\n"):
        if re.match(r"^[^\w]*(copyright\b( *(\(c\)|©|[0-9]| by )| year)|\(c\) |©|all rights reserved)", line):
            continue
        words = re.findall(r"[^\W_]+", re.sub(r"^[ \t]*\(?([0-9]{1,2}|[a-z])[.)][ \t]", "", line))
        words = [w for x in words for w in licenses.SPELLINGS.get(x, x).split()]
        lines += ["  ".join(words)] if words else []
    return hashlib.sha256("  ".join(lines).encode()).hexdigest()


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts")
def test_whole_licenses(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0-Perl"}
    rows, want = [], {}
    for i, (name, license_id) in enumerate(files.items()):
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8", errors="replace") as f:
            text = f.read()
        changed = re.sub(r"\bLICENSE\b", "LICENCE", text.upper().replace("\n", "  \n\n").replace(",", " ;"))
        rows += [(3 * i, text), (3 * i + 1, "Copyright (c) 2024 Somebody\n" + changed), (3 * i + 2, text + " And more.")]
        want |= {3 * i: license_id, 3 * i + 1: license_id, 3 * i + 2: None}
        assert canonical(text) == licenses.DIGESTS[license_id], name
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_digests(spark)).collect()
    assert {r["doc_id"]: r["license_id"] for r in out} == want


# --- chat ---


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"instruction": "a", "input": "", "output": "b"},
        {"instruction": "a", "output": "b"},
        {"prompt": "a", "response": "b"},
        {"completion": "b", "prompt": "a"},
        {"system": "s", "prompt": "a", "response": "b"},
        {"messages": []},
        {"other": {"x": [1, {"y": 2}]}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, None), (10, "not json")], "i int, record string")
    out = {r["i"]: r for r in chat.canonical_turns(df).collect()}
    turns = {i: None if r["turns"] is None else [(t["role"], t["text"]) for t in r["turns"]] for i, r in out.items()}
    plain = [("user", "a"), ("assistant", "b")]
    assert [turns[i] for i in range(6)] == [plain] * 6 and turns[6] == [("system", "s"), *plain] and turns[7] == []
    assert turns[8] is None and out[8]["layout"] is None and turns[9] is None and turns[10] is None
    paths = df.where("i = 8").select(chat.field_paths(F.col("record"))).first()[0]
    assert paths == ["other", "other.x", "other.x[].y"]
    assert out[0]["fingerprint"] == chat.fingerprint_of(["messages", "messages[].role", "messages[].content"])
    odd = chat.canonical_turns(df.withColumns({"layout": F.lit("mine"), "turns": F.lit(1), "fingerprint": F.lit(2)}).withColumnRenamed("record", "messages"), "messages")
    assert odd.columns == ["i", "messages", "fingerprint", "layout", "turns"]
    assert {r["i"]: r["fingerprint"] for r in odd.collect()} == {i: r["fingerprint"] for i, r in out.items()}


def paths_of(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            name = path + re.sub(r"[\\.\[]", lambda m: "\\" + m[0], k)
            yield name
            yield from paths_of(v, name + ".")
    elif isinstance(value, list):
        for v in value:
            yield from paths_of(v, path.removesuffix(".") + "[].")


def test_paths_of_any_depth(spark):
    rng = random.Random(3)

    def made(depth):
        kind = rng.random()
        if depth and kind < 0.5:
            return {rng.choice(["a", "b.c", "d[]", "e\\f", "", "[", "]{", "a:"]): made(depth - 1) for _ in range(rng.randint(0, 3))}
        if depth and kind < 0.75:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([1, None, True, "x", '{"q": [1]}', 'a": "b', "\\", "é\n"])

    values = [made(7) if i % 2 else {"a": made(7)} for i in range(300)] + [{"a": {"b": {"c": {"d": 1}}}}, {"a": {"b": {"c": {"e": 1}}}}, {"a.b": 1}, {"a": {"b": 1}}]
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False, indent=rng.choice([None, 1]))) for i, v in enumerate(values)], "i int, record string")
    got = {r["i"]: r["p"] for r in df.select("i", chat.field_paths(F.col("record")).alias("p")).collect()}
    unescape = lambda v: {(json.dumps(k, ensure_ascii=False)[1:-1]): unescape(x) for k, x in v.items()} if isinstance(v, dict) else [unescape(x) for x in v] if isinstance(v, list) else v  # noqa: E731  names as written
    for i, v in enumerate(values):
        assert got[i] == sorted(set(paths_of(unescape(v)))), v
    marks = [chat.fingerprint_of(got[i]) for i in range(300, 304)]
    assert len(set(marks)) == 4


def test_format_round_trip(spark):
    rng = random.Random(9)
    bits = ["<|", "|>", "\\", "\\|", "\n", "<", "|", "im_end", "<|im_start|>assistant\n", "é漢😀", " ", "a", "\\n", '"', "\t"]
    data = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "too\nl", "", None, "a\\n"])
            data.append((c, t, role, rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))])))
    data += [data[0], (None, 0, "user", "x"), (1000, None, "assistant", "tie"), (1000, None, "assistant", "tie2")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1)).unionByName(chat.control_conversation(spark).withColumn("record", F.lit(1)))
    made = chat.format_conversations(df)
    want = {}
    for c, t, r, x in [*data, (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]:
        want.setdefault(c, []).append((t is not None, t, r or "", x or ""))
    out = {r["conv_id"]: r for r in chat.digests(made).collect()}
    assert set(out) == set(want)
    for c, turns in want.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        text = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert (out[c]["n_turns"], out[c]["turns_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in made.collect():
        raw = r["formatted"].encode()
        covered = [raw[x["start"] : x["start"] + x["bytes"]].decode() for x in r["loss"]]
        assert covered == [t["text"].replace("\\", "\\\\").replace("<|", "<\\|") for t in r["turns"] if t["role"] == "assistant"]
    odd = made.select("conv_id", "turns", F.lit("mine").alias("loss"), F.lit("too").alias("formatted"))
    assert chat.formatted(odd).columns == ["conv_id", "turns", "formatted", "loss"]
    assert chat.digests(chat.format_conversations(df.where("false"))).count() == 0


# --- media ---


def test_containers():
    for n in (1, 2, 31, 32, 33, 100):
        payload = bytes(i * 7 % 256 for i in range(n * media.FRAME))
        stored = media.mux(payload)
        (track,) = media.tracks(stored)
        assert media.payload(stored, track) == payload
        track = track.shown()
        assert (track["codec"], track["handler"], track["samples"], track["duration"]) == ("raw ", "vide", n, n * media.FRAME_TICKS)
        for i, k in enumerate(track["keyframes"]):
            at = i * media.KEYFRAME_EVERY * media.FRAME
            assert stored[k["start"] : k["start"] + k["bytes"]] == payload[at : at + media.FRAME]
    with pytest.raises(ValueError):
        media.mux(b"")


def test_sample_tables():
    # two chunks of different sizes with gaps, sizes per sample, no sync table, a 64-bit box size, 4-bit sizes
    import struct

    sizes, chunks = [3, 5, 2, 7], [200, 300]
    def build(size_box):
        stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(70))), media.full(b"stts", struct.pack(">IIIII", 2, 1, 10, 3, 20)),
                         media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 3, 1, 2, 1, 1)), size_box, media.full(b"co64", struct.pack(">IQQ", 2, *chunks)))
        mdhd = media.box(b"mdhd", struct.pack(">IQQIQHH", 1 << 24, 0, 0, 1000, 70, 0, 0))
        moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))))
        return moov + struct.pack(">I4sQ", 1, b"mdat", 1016) + bytes(1000)
    for size_box in (media.full(b"stsz", struct.pack(">IIIIII", 0, 4, *sizes)), media.full(b"stz2", struct.pack(">II", 4, 4), bytes([0x35, 0x27])), media.full(b"stz2", struct.pack(">II", 16, 4), struct.pack(">4H", *sizes))):
        track = media.tracks(build(size_box))[0].shown()
        assert [(k["start"], k["bytes"]) for k in track["keyframes"]] == [(200, 3), (203, 5), (208, 2), (300, 7)]
        assert (track["codec"], track["timescale"], track["duration"]) == ("avc1", 1000, 70)


def fragmented():
    """A track without samples of its own, and two fragments: sizes by sample, and by default."""
    import struct

    F_ = media.full
    trak = media.box(b"trak", F_(b"tkhd", struct.pack(">IIII", 0, 0, 7, 0)), media.box(b"mdia", F_(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), media.box(b"minf", media.box(b"stbl", F_(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(70)))))))
    head = media.box(b"moov", trak, media.box(b"mvex", F_(b"trex", struct.pack(">IIIII", 7, 1, 40, 6, 0x10000))))

    def moof(size):
        first = media.box(b"traf", F_(b"tfhd", struct.pack(">I", 7), flags=0x20000), F_(b"trun", struct.pack(">IiI", 3, size + 8, 0), struct.pack(">3I", 4, 5, 6), flags=0x205))
        return media.box(b"moof", first)

    def plain(size):
        return media.box(b"moof", media.box(b"traf", F_(b"tfhd", struct.pack(">I", 7), flags=0x20000), F_(b"trun", struct.pack(">Ii", 2, size + 8), flags=0x1)))

    one, two = moof(len(moof(0))), plain(len(plain(0)))
    return head + one + media.box(b"mdat", b"aaaabbbbbcccccc") + two + media.box(b"mdat", b"ddddddeeeeee")


def test_fragments():
    stored = fragmented()
    (track,) = media.tracks(stored)
    assert media.payload(stored, track) == b"aaaabbbbbccccccddddddeeeeee"
    got = track.shown()
    assert (got["track_id"], got["samples"], got["duration"], got["codec"]) == (7, 5, 200, "avc1")
    assert [stored[k["start"] : k["start"] + k["bytes"]] for k in got["keyframes"]] == [b"aaaa"]  # the others aren't sync samples by default


def test_malformed_containers():
    import struct

    stbl = lambda *parts: media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", media.box(b"stbl", *parts)))))
    places = media.full(b"stco", struct.pack(">II", 1, 0)), media.full(b"stsc", struct.pack(">IIII", 1, 1, 9, 1))
    one = media.full(b"stsz", struct.pack(">II", 4, 3))
    bad = [
        stbl(media.full(b"stz2", struct.pack(">II", 0, 4))),  # no such field size
        stbl(media.full(b"stsz", struct.pack(">II", 1, (1 << 31) - 1)), *places),  # more samples than bytes
        stbl(media.full(b"stsz", struct.pack(">II", 0, (1 << 32) - 1)), *places),
        stbl(one, *places, media.full(b"stss", struct.pack(">II", 1, 0))),  # sync samples count from 1
        stbl(one, *places, media.full(b"stss", struct.pack(">II", 1, 4))),
        stbl(media.full(b"stsd", struct.pack(">I", 1)), one, *places),  # no entry
        stbl(one, places[0]),
        stbl(one, places[0], media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 1, 1, 1, 1, 1))),
    ]
    for x in bad:
        with pytest.raises(media.Malformed):
            media.tracks(x)
    assert media.tracks(stbl(media.full(b"stsd", struct.pack(">I", 0)), one, *places))[0].codec == ""
    deep = b""
    for _ in range(1500):
        deep = media.box(b"moov", deep)
    assert media.tracks(deep) == []


def test_mutated_containers():
    rng = random.Random(7)
    good = [media.mux(bytes(range(192)) * 40), fragmented()]
    for i in range(10_000):
        x = bytearray(good[i % 2])
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(min(len(x), 900))
            if rng.random() < 0.2:
                del x[at : at + rng.randint(1, 9)]
            elif rng.random() < 0.5:
                x[at : at + 4] = rng.choice([b"\0\0\0\0", b"\xff\xff\xff\xff", b"\x7f\xff\xff\xff", b"\0\0\0\1"])
            else:
                x[at] = rng.randrange(256)
        try:
            shown = [t.shown() for t in media.tracks(bytes(x))]
        except media.Malformed:
            continue
        assert all(0 <= k["start"] <= k["start"] + k["bytes"] <= len(x) for t in shown for k in t["keyframes"])


def test_media_columns(spark, docs, empty):
    clash = spark.createDataFrame([(1, "t", "p", media.mux(b"a" * 192))], "error int, tracks string, probed string, media binary")
    (got,) = media.media_columns(clash).collect()
    assert got.asDict().keys() == {"probed", "tracks", "error"} and got["probed"] == "p" and got["tracks"][0]["samples"] == 1
    good = media.mux(b"a" * 192)
    broken = [good, b"", None, good[:100], b"\0\0\0\4free", b"\0\0\0\x08free", good[:24] + b"\xff" * 4 + good[28:]]
    df = spark.createDataFrame([(i, m, "mine") for i, m in enumerate(broken)], "i int, media binary, other string")
    got = {r["i"]: r for r in media.media_columns(df).collect()}
    assert len(got) == 7 and got[0]["error"] is None and got[0]["tracks"][0]["codec"] == "raw "
    assert [got[i]["error"] is not None for i in range(1, 7)] == [True, True, True, True, False, True]
    out = media.text_media(docs).collect()
    assert len(out) == docs.count()
    want = {i: media.framed(t) for i, t, *_ in rows()}
    for r in out:
        p = want[r["doc_id"]]
        assert len(p) % 192 == 0 and len(p) > 0
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        m = media.mux(p)
        assert (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest())
    assert media.text_media(empty).count() == 0


# --- WARC ---


def test_warc_records():
    page = "<html><head><title>T &amp; x</title></head><body><p>One <b>two</b></p><script>var x='<p>';</script><!-- no --><a href='/l?a=1&amp;b=2'>three</a> &lt;4<br>five<style>p{}</style></body>"
    raw = warc.response("http://x.org/é", page.encode())
    headers, block, after = warc.parse(raw)
    assert after == len(raw) and warc.get(headers, "warc-type") == "response"
    meta, text = warc.derivatives(raw)
    assert meta[2] == text[2] == warc.get(headers, "WARC-Record-ID") and meta[3] == "http://x.org/é"
    h, body, _ = warc.parse(text[8])
    assert body.decode() == "One two\nthree <4\nfive" and warc.get(h, "WARC-Refers-To") == text[2] and warc.get(h, "WARC-Block-Digest") == warc.sha1(body) == text[6]
    h, body, _ = warc.parse(meta[8])
    envelope = json.loads(body)["Envelope"]
    http = envelope["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert http["HTML-Metadata"] == {"Head": {"Title": "T & x"}, "Links": [{"path": "A@/href", "url": "/l?a=1&b=2"}]}
    assert envelope["WARC-Header-Metadata"]["WARC-Payload-Digest"] == http["Entity-Digest"] == meta[5] == warc.sha1(page.encode())
    assert warc.derivatives(raw) == [meta, text]
    both = warc.gzip_member(raw) + warc.gzip_member(meta[8])
    assert list(warc.split_records(both)) == [raw, meta[8]] and list(warc.split_records(raw + text[8])) == [raw, text[8]]


def test_warc_tables(spark, tmp_path):
    good = warc.response("http://a", b"<p>x")
    cases = [good, None, b"", b"junk", good[:-10], warc.build([("WARC-Type", "request"), ("WARC-Record-ID", "<x>")], b""), good.replace(b"<p>x", b"<p>y")]
    df = spark.createDataFrame([(i, r, "mine") for i, r in enumerate(cases)], "i int, raw binary, error string").drop("error")
    out = warc.derive(df, "raw", "i").collect()
    assert sorted((r["i"], r["record_type"] or "", r["error"] is not None) for r in out) == [(0, "conversion", False), (0, "metadata", False)] + [(i, "", True) for i in range(1, 7)]
    pages = spark.createDataFrame([(1, "http://a", "<p>x"), (1, "http://a", "<p>x"), (2, None, None), (3, "", "y" * 100_000)], "page_id long, url string, html string").withColumn("record", F.lit(0))
    got = warc.page_derivatives(pages).collect()
    assert len(got) == 8 and {r["record_type"] for r in got} == {"metadata", "conversion"}
    assert {r["content_length"] for r in got if r["page_id"] == 2 and r["record_type"] == "conversion"} == {0}
    assert warc.page_derivatives(pages.where("false")).count() == 0
    (tmp_path / "a.warc.gz").write_bytes(warc.gzip_member(good) * 3)
    (tmp_path / "b.warc.gz").write_bytes((warc.gzip_member(good) * 2)[:-9])
    (tmp_path / "c.warc.gz").write_bytes(good + b"junk")
    (tmp_path / "d.warc.gz").write_bytes(b"")
    got = sorted((r["path"][-9], r["record"] == good, r["error"] is not None) for r in warc.read_warc(spark, str(tmp_path / "*.warc.gz")).collect())
    assert got == [("a", True, False)] * 3 + [("b", False, True), ("b", True, False), ("c", False, True), ("c", True, False)]
    with pytest.raises(ValueError):
        warc.derive(df.withColumn("error", F.lit(1)), "raw", "error")


def answer(http, body):
    block = b"HTTP/1.1 200 OK\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in http) + b"\r\n" + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>"), ("WARC-Concurrent-To", "<urn:x:2>"), ("warc-concurrent-to", "<urn:x:3>"), ("WARC-Date", "2020-01-01T00:00:00Z")]
    return warc.build(headers, block)


def test_warc_headers_and_encodings():
    import gzip

    page = "<title>T</title><p>gr\u00fcn"
    chunks = lambda x: b"".join(b"%x;a=b\r\n%s\r\n" % (len(c), c) for c in (x[:5], x[5:])) + b"0\r\n\r\n"
    zipped = gzip.compress(page.encode("latin-1"))
    kind = ("Content-Type", "text/html; charset=iso-8859-1")
    made = warc.derivatives(answer([kind, ("Set-Cookie", "a=1"), ("set-cookie", "b=2"), ("Content-Encoding", "gzip"), ("Transfer-Encoding", "chunked")], chunks(zipped)))
    assert [x[0] for x in made] == ["metadata", "conversion"]
    assert warc.parse(made[1][8])[1].decode() == "T\ngr\u00fcn" and made[1][5] == warc.sha1(zipped)
    envelope = json.loads(warc.parse(made[0][8])[1])["Envelope"]
    assert envelope["WARC-Header-Metadata"]["WARC-Concurrent-To"] == ["<urn:x:2>", "<urn:x:3>"]
    assert envelope["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]["Set-Cookie"] == ["a=1", "b=2"]
    for http, body, want in [
        ([("Content-Type", "image/png")], b"\x89PNG", None), ([("Content-Encoding", "br")], b"x", None), ([("Content-Encoding", "gzip")], b"no gzip", None),
        ([("Content-Type", "text/plain")], b"a <b> c", "a <b> c"), ([("Content-Encoding", "deflate")], zlib.compress(b"<p>x"), "x"), ([("Transfer-Encoding", "chunked")], b"<p>put together", "put together"),
        ([("Content-Type", "text/html; charset=idna")], b"<p>\xff", "\ufffd"),
    ]:
        made = warc.derivatives(answer(http, body))
        texts = [warc.parse(x[8])[1].decode() for x in made if x[0] == "conversion"]
        assert texts == ([] if want is None else [want]) and made[0][0] == "metadata"


def test_gzip_members_take_linear_time():
    member = warc.gzip_member(warc.response("http://a", random.Random(1).randbytes(8000)))
    whole = member * (64_000_000 // len(member))
    began = time.time()
    assert sum(1 for _ in warc.split_records(whole)) == len(whole) // len(member) and time.time() - began < 5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_conversions_hold_a_parser_s_text(spark):
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.hidden, self.out, self.links = 0, [], []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in warc.HIDDEN
            self.out.append("\n" if tag in warc.BLOCKS else "")
            self.links += [v for k, v in attrs if tag == "a" and k == "href"]

        def handle_endtag(self, tag):
            self.hidden -= tag in warc.HIDDEN
            self.out.append("\n" if tag in warc.BLOCKS else "")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = warc.derive(pages, warc.responses("url", "html"), "page_id").collect()
    made = {(r["page_id"], r["record_type"]): r for r in found}
    assert len(made) == 2 * pages.count()
    for p in pages.collect():
        parser = Text()
        parser.feed(p["html"] or "")
        parser.close()
        text, meta = (warc.parse(made[p["page_id"], k]["record"])[1].decode() for k in ("conversion", "metadata"))
        assert text.split() == "".join(parser.out).split(), p["page_id"]
        facts = json.loads(meta)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
        assert [x["url"] for x in facts["Links"] if x["path"] == "A@/href"] == parser.links
