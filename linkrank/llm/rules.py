"""Quality rules: line sequence labelling with a linear-chain conditional random field (operator 5).

Each line with a word gets binary features; Viterbi decoding marks it as content or boilerplate. A text is kept if at
least half of its characters in such lines are content and the base rules hold.

The field is trained on a bounded sample of labelled texts (TRAIN_DOCS; rows with crc32(doc_id) mod 5 = 0 are left out;
texts that would bring the sample over TRAIN_LINES lines are left out, too). Labels are of texts, so those of lines are
latent: a line begins with its text's label unless its own features say otherwise, and after each fit the decoded labels
take over wherever they leave most of a good text content and most of a bad one boilerplate. Only the feature masks and
sizes of the sample's lines come to the driver.

Base rules fail a text with under 50 words, or with more than half of its words in repeated 3-word windows.

Edge cases: a null text has no words and fails; a text without lines has content share 0; without usable labels of both
kinds every line is content, so the base rules alone decide; of labelled rows that repeat an id the least masks count;
of equally good label sequences content goes before boilerplate; repeated rows each give a row; an empty table gives an
empty result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, released, text_batches, trimmed

#: Most labelled texts, and most of their lines, that training takes.
TRAIN_DOCS, TRAIN_LINES = 4000, 400_000

MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 50, 50, 0.5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Frequent function words, and words usual in page furniture.
FUNCTION_WORDS = frozenset(b"the of and to in is that for it with as by this are on be from der die und das den von zu mit ist im le la les des et un une est dans que qui en el los las por con del se una para".split())
FURNITURE = re.compile(rb"(?i)\b(?:copyright|cookies?|click|subscribe|sign up|log ?in|menu|share|privacy|terms of|read more|https?://|www\.)")
SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_ENDS = (b".", b"!", b"?", b'"', b":", b";")
N_FEATURES = 20
#: Features that alone speak against a line: said before, symbols, capitals, digits, bars, shouting, few kinds of words, furniture.
AGAINST = sum(1 << i for i in (5, 8, 9, 11, 12, 13, 17, 18))
#: Features of prose: the line ends as a sentence does, and a fifth of its words are function words.
PROSE = 1 << 4 | 1 << 15
#: Fits after the first, each from the labels that the one before decodes.
REFITS = 2


def measures(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """The base measures of a text's UTF-8; words are parted by ASCII white space."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    chars = sum(len(w) for w in words)
    if not raw.isascii():
        chars = len(b"".join(words).decode("utf-8", "replace"))
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated


def line_mask(line: bytes, seen: bool) -> int:
    """The binary features of a line, as bits."""
    words = line.split()
    n, size = len(words), len(line)
    without = lambda chars: size - len(line.translate(None, chars))
    upper, lower, digits, symbols = without(_UPPER), without(_LOWER), without(_DIGITS), without(SYMBOLS)
    letters = upper + lower
    common = sum(w in FUNCTION_WORDS for w in words)
    kinds = len(set(words))
    tests = (
        True, n <= 3, 4 <= n <= 10, n > 30, line.rstrip().endswith(_ENDS), seen,
        symbols > 0, symbols * 50 > size, symbols * 12 > size, upper * 2 > letters > 0, upper * 5 > letters > 0,
        digits * 5 > size, line.count(b"|") > 2, b"!!" in line, common == 0, common * 5 > n,
        kinds * 2 < n, kinds * 4 < n, bool(FURNITURE.search(line)), size > 15 * n,
    )
    return sum(1 << i for i, x in enumerate(tests) if x)


def line_masks(raw: bytes) -> tuple[list[int], list[int]]:
    """Feature masks and sizes of the lines with a word."""
    masks, sizes, seen = [], [], set()
    for line in raw.split(b"\n"):
        if line.strip():
            masks.append(line_mask(line, line in seen))
            sizes.append(len(line))
            seen.add(line)
    return masks, sizes


@dataclass
class Field:
    """Weights of the two labels (0 boilerplate, 1 content): of features, begins, and steps from label to label."""

    features: np.ndarray  # (N_FEATURES, 2)
    begin: np.ndarray  # (2,)
    steps: np.ndarray  # (2, 2)

    def viterbi(self, masks: list[int], known: dict[int, tuple[float, float]]) -> list[int]:
        """The best labels of a sequence; ``known`` keeps the scores of masks."""
        if not masks:
            return []
        (aa, ab), (ba, bb) = self.steps.tolist()
        a, b = self.begin.tolist()
        back = []
        for i, mask in enumerate(masks):
            score = known.get(mask)
            if score is None:
                score = known[mask] = tuple((bits([mask]) @ self.features)[0].tolist())
            if i:
                to_a, to_b = a + aa >= b + ba, a + ab > b + bb
                back.append((to_a, to_b))
                a, b = (a + aa if to_a else b + ba), (a + ab if to_b else b + bb)
            a, b = a + score[0], b + score[1]
        label = 0 if a > b else 1
        out = [label]
        for to_a, to_b in reversed(back):
            label = 0 if (to_b if label else to_a) else 1
            out.append(label)
        out.reverse()
        return out


def bits(masks) -> np.ndarray:
    return (np.asarray(masks, np.int64)[..., None] >> np.arange(N_FEATURES) & 1).astype(float)


def untrained() -> Field:
    return Field(np.zeros((N_FEATURES, 2)), np.zeros(2), np.zeros((2, 2)))


def first_labels(masks: list[int], label: int) -> list[int]:
    """What a text's label and a line's own features say: a good text's lines are content but for those with features
    against them, a bad one's are boilerplate but for prose without such features."""
    if label:
        return [0 if m & AGAINST else 1 for m in masks]
    return [1 if m & PROSE == PROSE and not m & AGAINST else 0 for m in masks]


def agreeing(lines: list[int], sizes: list[int], label: int, others: list[int]) -> list[int]:
    """``lines`` if more than half of the characters have the text's label, else ``others``."""
    return lines if 2 * sum(n for n, y in zip(sizes, lines) if y == label) > sum(sizes) else others


def train(sequences: list[list[int]], labels: list[int], sizes: list[list[int]] | None = None, rounds: int = 60, refits: int = REFITS) -> Field:
    """A field from the line masks of texts and the texts' labels; lines' labels are latent. ``sizes``: characters of lines."""
    if len(set(labels)) < 2 or not any(sequences):
        return untrained()
    sizes = sizes or [[1] * len(s) for s in sequences]
    lines = [agreeing(first_labels(s, y), n, y, [y] * len(s)) for s, y, n in zip(sequences, labels, sizes)]
    field = fit(sequences, lines, rounds)
    for _ in range(refits):
        known: dict[int, tuple[float, float]] = {}
        after = [agreeing(field.viterbi(s, known), n, y, before) for s, y, n, before in zip(sequences, labels, sizes, lines)]
        if after == lines:
            break
        lines = after
        field = fit(sequences, lines, rounds // 2, field)
    return field


def fit(sequences: list[list[int]], lines: list[list[int]], rounds: int = 60, start: Field | None = None, rate: float = 0.1, decay: float = 1e-3, length: int = 64) -> Field:
    """Maximum likelihood of line labels by forward-backward and Adam steps; long sequences are cut into pieces of ``length``."""
    cut = ((tuple(s[i : i + length]), tuple(y[i : i + length])) for s, y in zip(sequences, lines) for i in range(0, len(s), length))
    pieces = Counter(cut)  # equal pieces are worked on once
    if not pieces:
        return untrained()
    n, t = len(pieces), max(len(s) for s, _ in pieces)
    masks, on, y = np.zeros((n, t), np.int64), np.zeros((n, t), bool), np.zeros((n, t), np.int64)
    for i, (s, marks) in enumerate(pieces):
        masks[i, : len(s)], on[i, : len(s)], y[i, : len(s)] = s, True, marks
    times = np.array(list(pieces.values()), float)
    # lines with one mask have one score, so features are looked up by distinct mask
    kinds, which = np.unique(masks, return_inverse=True)
    which, x = which.reshape(masks.shape), bits(kinds)
    # both labels weigh the same, whatever their numbers: a piece counts by those of its lines
    ones = (y * on).sum(1)
    zeros = on.sum(1) - ones
    share = ones / (ones + zeros)
    weight = times * (share * 0.5 / max(1.0, (times * share).sum()) + (1 - share) * 0.5 / max(1.0, (times * (1 - share)).sum()))
    sizes = (len(kinds), N_FEATURES)
    theta = np.zeros(N_FEATURES * 2 + 2 + 4) if start is None else np.concatenate([start.features.ravel(), start.begin, start.steps.ravel()])
    split = lambda v: (v[: sizes[1] * 2].reshape(-1, 2), v[sizes[1] * 2 : -4], v[-4:].reshape(2, 2))
    want = np.eye(2)[y] * on[..., None]
    seen = np.einsum("nti,ntj->nij", want[:, :-1], want[:, 1:])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    add = lambda z, axis: (top := z.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - top).sum(axis))
    for step in range(1, rounds + 1):
        w, begin, steps = split(theta)
        local = (x @ w)[which]
        alpha, beta = np.empty((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = begin + local[:, 0]
        for i in range(1, t):
            alpha[:, i] = np.where(on[:, i, None], add(alpha[:, i - 1, :, None] + steps, 1) + local[:, i], alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            beta[:, i] = np.where(on[:, i + 1, None], add(steps + (local[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0.0)
        z = add(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * on[..., None]
        miss = (p - want) * weight[:, None, None]
        by_kind = np.stack([np.bincount(which.ravel(), miss[..., k].ravel(), sizes[0]) for k in (0, 1)], 1)
        both = np.exp(alpha[:, :-1, :, None] + steps + (local + beta)[:, 1:, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
        gradient = np.concatenate([(x.T @ by_kind).ravel(), miss[:, 0].sum(0), ((both.sum(1) - seen) * weight[:, None, None]).sum(0).ravel()]) + decay * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w, begin, steps = split(theta)
    return Field(w.copy(), begin.copy(), steps.copy())


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled doc_id and quality that training may use, in hash order."""
    use = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    return use.select(F.col("doc_id").alias(f"{P}id"), F.col("quality").cast("int").alias(f"{P}quality")).orderBy(F.xxhash64(f"{P}id"), f"{P}id", f"{P}quality").limit(most)


def train_on(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Field:
    text_batches(docs.sparkSession)
    sample = labelled_sample(labels, TRAIN_DOCS)
    rows = docs.select(F.col(key).alias(f"{P}key"), F.col(text).alias(f"{P}text")).join(F.broadcast(sample), F.col(f"{P}key") == F.col(f"{P}id"))
    masks = F.pandas_udf(lambda s: s.map(lambda x: _packed((x or "").encode("utf-8", "replace"))), "array<long>")
    found = rows.select(f"{P}key", f"{P}quality", masks(f"{P}text").alias("lines")).groupBy(f"{P}key", f"{P}quality").agg(F.min("lines").alias("lines"))
    sequences, sizes, marks, taken = [], [], [], 0
    for r in sorted(found.toLocalIterator(), key=lambda r: (r[0], r[1])):  # TRAIN_DOCS rows at most
        if taken + len(r["lines"]) <= TRAIN_LINES:
            taken += len(r["lines"])
            sequences.append([x & (1 << N_FEATURES) - 1 for x in r["lines"]])
            sizes.append([x >> N_FEATURES for x in r["lines"]])
            marks.append(r[f"{P}quality"])
    return train(sequences, marks, sizes)


def _packed(raw: bytes) -> list[int]:
    """Mask and size of each line as one number."""
    return [m | n << N_FEATURES for m, n in zip(*line_masks(raw))]


def verdict(field: Field, text: Column) -> Column:
    """A struct of the base measures, content_share, base_failed and kept."""

    def judge(texts: pd.Series) -> pd.DataFrame:
        released()
        known: dict[int, tuple[float, float]] = {}
        rows = []
        for text in texts:
            raw = (text or "").encode("utf-8", "replace")
            words = raw.split()
            base = measures(raw, words)
            failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
            masks, sizes = line_masks(raw)
            good = sum(s for s, y in zip(sizes, field.viterbi(masks, known)) if y)
            share = good / sum(sizes) if sizes else 0.0
            rows.append((*base, share, failed, not failed and share >= MIN_CONTENT))
        return trimmed(pd.DataFrame(rows, columns=[*MEASURES, "content_share", "base_failed", "kept"]))

    kinds = ", ".join(f"{x} long" for x in MEASURES)
    return F.pandas_udf(judge, f"{kinds}, content_share double, base_failed boolean, kept boolean")(text)


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id with the verdict's columns."""
    return docs.select(F.col(key).alias("doc_id"), verdict(train_on(docs, labels, text, key), F.col(text)).alias("v")).select("doc_id", "v.*")


def kept(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the rules keep; same columns."""
    field = train_on(docs, labels, text, key)
    return docs.withColumn(f"{P}v", verdict(field, F.col(text))).where(f"{P}v.kept").select(*docs.columns)
