"""Tokens, fingerprints, rules and statistics of single texts, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from linkrank.llm import bpe, classifier, rules, simhash

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

ODD = ["", " ", "\n", "a", "  leading", "don't we'll I'VE", "漢字 かな", "é́ ŕ", "😀😀 x", "\x1c\x1d\x85\xa0　", "aaaa" * 300, "=" * 5001, "<|endoftext|>", "tab\tand\r\nlines\n\n\n", "x" * 70_000]


def texts(n=400):
    rng = random.Random(3)
    return ODD + ["".join(rng.choice(rng.choice(["abcé漢😀 \n\t", "aaaa", "the ation ing", "0123 ", "!!??$$ 　\xa0"])) for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.read_ranks(f)


def test_tokens_equal_library(ranks):
    codec = bpe.Codec(ranks, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in texts():
        ids = np.frombuffer(codec.encode(t), "<u4")
        assert ids.tolist() == library.encode_ordinary(t)
        assert "".join(codec.decode(ids)) == t


def test_bounds_change_nothing(ranks, monkeypatch):
    for name in ("MAX_STATES", "MAX_PAIRS", "MAX_PIECES"):
        monkeypatch.setattr(bpe, name, 8)
    small, usual = bpe.Codec(ranks, P.PATTERN), bpe.Codec(ranks, P.PATTERN)
    monkeypatch.undo()
    for t in texts(60):
        assert small.encode(t) == usual.encode(t)


def test_lookahead_is_bounded(ranks):
    fst = bpe.Transducer(ranks)
    raw = (b"abcdefgh" * 4000)
    state, ends = fst.start, []
    for x in raw:
        state, token = state.moves.get(x) or fst._move(state, x)
        ends.append(token)
    sent, done = fst._fixed(state, ends)
    assert len(raw) - done < 200 and b"".join(fst.bytes_of[t] for t in sent) == raw[:done]


def test_utf8_stream():
    rng = random.Random(1)
    for _ in range(400):
        raw = "".join(rng.choice("aé漢😀") for _ in range(20)).encode()
        if rng.random() < 0.5:
            raw = bytes(rng.choice(raw) for _ in range(30))
        stream, out, at = bpe.Utf8Stream(), "", 0
        while at < len(raw):
            step = rng.randint(1, 5)
            out += stream.feed(raw[at : at + step])
            at += step
        assert out + stream.feed(b"", last=True) == raw.decode("utf-8", "replace")


def test_fingerprint():
    for t in [None, *texts(100)]:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in runs]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(t) == want


def test_spark_has_the_same_hash(spark):
    values = ["", "a", "some words here", "é漢" * 20]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "s string").selectExpr("xxhash64(s)").collect()]
    assert [x & (1 << 64) - 1 for x in got] == [xxhash.xxh64_intdigest(v.encode(), 42) for v in values]


@pytest.mark.parametrize("tau", [1, 2, 3, 5])
def test_masks_cover_every_pair(tau):
    rng = np.random.default_rng(tau)
    skewed = (rng.random((500, 64)) < np.linspace(0.02, 0.6, 64)).astype(np.uint64)
    sample = (skewed << np.arange(64, dtype=np.uint64)).sum(1).astype(np.uint64)
    for rows in (10, 10**5, 10**9):
        masks = simhash.probe_masks(sample, rows, tau)
        for _ in range(300):
            flips = sum(1 << int(b) for b in rng.choice(64, tau, replace=False))
            assert any(not flips & m for m in masks)
    mask = masks[0]
    for _ in range(200):
        free = [b for b in range(64) if not mask >> b & 1]
        flips = sum(1 << int(b) for b in rng.choice(free, tau, replace=False))
        assert any(not flips & m for m in simhash.finer_masks(mask, tau))


def test_allocation_is_least():
    rng = random.Random(2)
    for _ in range(30):
        costs = [[rng.random() * 10 for _ in range(3)] for _ in range(4)]
        total = lambda t: sum(c[x] for c, x in zip(costs, t) if x >= 0)
        import itertools

        best = min(total(t) for t in itertools.product(range(-1, 3), repeat=4) if sum(x + 1 for x in t) == 3)
        chosen = simhash.allocate(costs, 2)
        assert sum(x + 1 for x in chosen) == 3 and total(chosen) == pytest.approx(best)


def brute_measures(t):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {j for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def test_measures():
    rng = random.Random(4)
    cases = texts(100) + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["x y\nx y\n\n \nx y ", "#a <b> |c|"]
    for t in cases:
        raw = t.encode()
        assert rules.measures(raw, raw.split()) == brute_measures(t), t


def test_viterbi_is_best():
    import itertools

    rng = np.random.default_rng(1)
    field = rules.Field(rng.normal(size=(rules.N_FEATURES, 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        masks = [int(m) for m in rng.integers(0, 1 << rules.N_FEATURES, n)]
        x = rules.bits(masks) @ field.features
        value = lambda y: field.begin[y[0]] + sum(x[i, v] for i, v in enumerate(y)) + sum(field.steps[a, b] for a, b in zip(y, y[1:]))
        got = field.viterbi(masks, {})
        assert value(got) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=n))))
    assert field.viterbi([], {}) == []


def test_field_learns():
    rng = random.Random(6)
    good = ["\n".join(f"This is the line of plain words number {rng.random()}." for _ in range(5)) for _ in range(60)]
    bad = ["\n".join("CLICK!! | $$$ | MENU!!" for _ in range(5)) for _ in range(20)]
    masks = [rules.line_masks(t.encode())[0] for t in good + bad]
    field = rules.train(masks, [1] * 60 + [0] * 20, rounds=60)
    known = {}
    assert all(all(field.viterbi(m, known)) for m in masks[:60]) and not any(any(field.viterbi(m, known)) for m in masks[60:])
    mixed = rules.line_masks((good[0] + "\n" + "\n".join(["CLICK!! | $$$ | MENU!!"] * 6)).encode())[0]
    assert field.viterbi(mixed, known) == [1] * 5 + [0] * 6
    assert not rules.train([], []).features.any()
    assert rules.first_labels([0, 1 << 5, 1 << 4 | 1 << 15], 1) == [1, 0, 1] and rules.first_labels([0, 1 << 5, 1 << 4 | 1 << 15], 0) == [0, 0, 1]
    assert rules.agreeing([1, 0], [3, 2], 1, [1, 1]) == [1, 0] and rules.agreeing([1, 0], [2, 2], 1, [1, 1]) == [1, 1]


def test_isotonic():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, 200).astype(float)
    y = (rng.random(200) < x / 20).astype(float)
    xs, ys = classifier.isotonic(x, y)
    fit = np.interp(x, xs, ys)
    assert (np.diff(ys) >= 0).all() and fit.mean() == pytest.approx(y.mean())
    # no other non-decreasing fit on a grid of pooled means is better at any single step
    order = np.argsort(x, kind="stable")
    assert (np.diff(fit[order]) >= -1e-12).all()
    assert ((fit - y) ** 2).sum() <= ((y.mean() - y) ** 2).sum()
    xs, ys = classifier.isotonic(np.array([1.0, 2.0, 3.0]), np.array([1.0, 0.0, 1.0]))
    assert ys.tolist() == [0.5, 0.5, 1.0, 1.0] and xs.tolist() == [1.0, 2.0, 3.0, 3.0]


def test_statistics_are_finite():
    for t in texts(100):
        s = classifier.statistics(t.encode())
        assert len(s) == classifier.N_STATS and np.isfinite(s).all()


def test_features_approximate_a_kernel():
    model = classifier.unfitted(features=4096)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, classifier.N_STATS))
    z = model.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * classifier.N_STATS))
    assert np.abs(z @ z.T - want).max() < 0.08




def test_spanning_forest():
    rng = np.random.default_rng(5)
    for tau in (1, 3):
        bucket = np.sort(rng.integers(0, 12, 200))
        centres = rng.integers(0, 1 << 63, 12).astype(np.uint64)
        p = centres[bucket] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 6, 200).astype(np.uint64))
        i, j = simhash.spanning_forest(bucket, p, tau)
        assert (bucket[i] == bucket[j]).all() and (np.bitwise_count(p[i] ^ p[j]) <= tau).all()

        def classes(pairs):
            root = list(range(200))
            for a, b in pairs:
                x, y = root[a], root[b]
                root = [y if v == x else v for v in root]
            return [root.index(v) for v in root]

        every = [(a, b) for a in range(200) for b in range(a) if bucket[a] == bucket[b] and bin(int(p[a] ^ p[b])).count("1") <= tau]
        assert classes(every) == classes(zip(i.tolist(), j.tolist())) and len(i) == 200 - len(set(classes(every)))
    # rows of one bucket in several batches
    import pyarrow as pa

    rows = {"r": [0] * 6, "mask": [1] * 6, "key": [7, 7, 7, 8, 9, 9], "p": [0, 1, 3, 0, 4, 5], "node": [10, 11, 12, 13, 14, 15]}
    batch = pa.RecordBatch.from_pydict(rows)
    for size in (1, 2, 3, 6):
        out = [b.to_pylist() for b in simhash._forests(1)(batch.slice(k, size) for k in range(0, 6, size))]
        assert sorted((x["a"], x["b"]) for b in out for x in b) == [(10, 11), (11, 12), (14, 15)]
    assert list(simhash._forests(1)(iter([]))) == []
