"""Quality classifier: random Fourier features, ridge scores, isotonic calibration (operator 9).

Statistics of a whole text are scaled and sent through random Fourier features, whose inner products approximate a
Gaussian kernel. Each partition of the training sample sums its part of the normal equations; the driver adds the
parts, whose number is bounded, and solves for ridge weights. Isotonic regression on labelled texts that the weights
have not seen turns ridge scores into chances.

The sample is bounded (TRAIN_DOCS labelled texts in hash order). Rows with crc32(doc_id) mod 5 = 0 are never used for
training, those with 4 calibrate, the others fit. Only texts are inputs of a score.

Edge cases: null texts count as empty; empty texts get the score of their (zero) statistics; without labels of both
kinds every score is 0.5; where the calibration rows have one label only, the fitted rows calibrate; equal texts have
equal scores, and texts whose chances tie are ordered by their ridge scores; texts of any length are read whole; repeated
rows each give a row; an empty table gives an empty result; only texts and ids are read, so other columns may have any
names and keep their values.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, stored, text_batches, trimmed
from .rules import FUNCTION_WORDS, labelled_sample

TRAIN_DOCS = 20_000
#: Partitions of the training sample: each sends one matrix to the driver.
TRAIN_PARTS = 8
FEATURES, RIDGE, SEED = 256, 1e-3, 7
THRESHOLD = 0.3
#: Share of the score that orders texts with equal chances by their ridge score.
ORDERING = 1e-3

_CLASSES = ("upper", "lower", "digit", "space", "newline", "symbol", "mark", "high", "bang", "bar")


def _classes() -> np.ndarray:
    out = np.zeros((256, len(_CLASSES)))
    for i, members in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\r", b"\n", b"#*$%&<>", b".,;:?'\"()-", range(128, 256), b"!", b"|")):
        out[list(members), i] = 1
    return out


CLASSES = _classes()
N_STATS = len(_CLASSES) + 13


def statistics(raw: bytes) -> list[float]:
    """Statistics of a whole text's UTF-8."""
    if not raw:
        return [0.0] * N_STATS
    size = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (counts @ CLASSES) / size
    used = counts[counts > 0] / size
    words = raw.split()
    n = len(words) or 1
    kinds = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = len(lines) or 1
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    pairs = len(set(zip(words, words[1:])))
    upper, lower = shares[0], shares[1]
    return [
        *shares.tolist(), float(-(used * np.log(used)).sum()), np.log1p(len(words)), np.log1p(size / n), upper / (upper + lower) if upper + lower else 0.0,
        len(kinds) / n, max(kinds.values(), default=0) / n, pairs / n, sum(kinds[w] for w in FUNCTION_WORDS) / n,
        np.log1p(len(lines)), np.log1p(size / m), 1 - len(set(lines)) / m, ends / m, np.log1p(max(map(len, words), default=0)),
    ]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: non-decreasing knots (x, y) to interpolate between; equal x are pooled first."""
    at, which = np.unique(x, return_inverse=True)
    weights = np.bincount(which).astype(float)
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for mean, weight, place in zip(np.bincount(which, y) / weights, weights, at):
        blocks.append([mean, weight, place, place])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + m * w) / (b[1] + w), b[1] + w, last
    xs = np.array([e for b in blocks for e in b[2:4]])
    return xs, np.repeat([b[0] for b in blocks], 2)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray  # the last is the constant
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        out = np.cos(z @ self.project + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([out, np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots[0]):
            return np.full(len(x), 0.5)
        raw = self.ridge(x)
        chance = np.interp(raw, *self.knots)
        return np.clip((1 - ORDERING) * chance + ORDERING / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0)


def unfitted(features: int = FEATURES, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    # a kernel as wide as the usual distance between scaled statistics
    project = rng.normal(0, 1 / np.sqrt(N_STATS), (N_STATS, features))
    none = np.empty(0)
    return Model(np.zeros(N_STATS), np.ones(N_STATS), project, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), (none, none))


def _stats(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics((x or "").encode("utf-8", "replace")) for x in texts], dtype=object)


def _summed(rows: DataFrame, part) -> list[np.ndarray]:
    """Adds up arrays that ``part`` makes of each partition's (statistics, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column("x").to_numpy(zero_copy_only=False))
                made = part(x, b.column("y").to_numpy(zero_copy_only=False).astype(float))
                total = made if total is None else [s + t for s, t in zip(total, made)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[m.astype("<f8").tobytes() for m in total]], pa.list_(pa.binary()))], ["sums"])

    found = [[np.frombuffer(m, "<f8") for m in r["sums"]] for r in rows.coalesce(TRAIN_PARTS).mapInArrow(run, "sums array<binary>").collect()]
    return [sum(m) for m in zip(*found)]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    text_batches(docs.sparkSession)
    model = unfitted()
    sample = labelled_sample(labels, TRAIN_DOCS)
    rows = docs.select(F.col(key).alias(f"{P}key"), F.col(text).alias(f"{P}text")).join(F.broadcast(sample), F.col(f"{P}key") == F.col(f"{P}id"))
    fold = F.crc32(F.col(f"{P}key").cast("string").cast("binary")) % 5
    rows = stored(rows.select(F.pandas_udf(_stats, "array<double>")(f"{P}text").alias("x"), F.col(f"{P}quality").alias("y"), (fold == 4).alias("calibrate")))
    fit = rows.where(~F.col("calibrate"))
    sums = _summed(fit, lambda x, y: [np.array([len(y), y.sum()]), x.sum(0), (x * x).sum(0)])
    if not sums or not 0 < sums[0][1] < sums[0][0]:
        return model
    n = sums[0][0]
    model.centre = sums[1] / n
    model.scale = np.sqrt(np.maximum(sums[2] / n - model.centre**2, 0)) + 1e-6
    # both labels weigh the same
    up, down = n / (2 * sums[0][1]), n / (2 * (n - sums[0][1]))

    def normal(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z, w = model.features(x), np.where(y > 0.5, up, down)
        return [((z * w[:, None]).T @ z).ravel(), (z * w[:, None]).T @ y]

    gram, moment = _summed(fit, normal)
    size = len(moment)
    model.weights = np.linalg.solve(gram.reshape(size, size) + RIDGE * n / size * np.eye(size), moment)
    held = rows.where("calibrate").select("x", "y").limit(TRAIN_DOCS).toPandas()
    if held["y"].nunique() < 2:
        held = fit.select("x", "y").limit(TRAIN_DOCS).toPandas()
    model.knots = isotonic(model.ridge(np.stack(held["x"].to_numpy())), held["y"].to_numpy(float))
    return model


def score(model: Model, text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        x = np.array([statistics((t or "").encode("utf-8", "replace")) for t in texts]).reshape(-1, N_STATS)
        return trimmed(pd.Series(model.score(x)))

    return F.pandas_udf(run, "double")(text)


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    out = docs.select(F.col(key).alias("doc_id"), score(train(docs, labels, text, key), F.col(text)).alias("score"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject; same columns. It learns from labelled rows of
    ``learn_from`` (by default ``docs``), which should still have bad ones."""
    model = train(docs if learn_from is None else learn_from, labels, text, key)
    return docs.withColumn(f"{P}score", score(model, F.col(text))).where(F.col(f"{P}score") >= THRESHOLD).select(*docs.columns)
