"""Quality classifier over document statistics.

Random Fourier features approximate a Gaussian kernel on standardised statistics of the whole
text; normal equations are summed per partition and added up in two levels, so the driver gets
a few fixed-size matrices whatever the corpus; ridge scores are then calibrated by isotonic
regression on a fixed grid of score bins.

Learned from every labelled training row. Labels, language, source and ids are never inputs.

Defined results: a null text counts as empty; an empty text has all statistics 0 and a score
like any other; null labels teach nothing; a document labelled twice counts twice; without any
training row every score is 0.5; repeated rows count each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, bounded_batches, tidied

FEATURES = 192
RIDGE = 1.0
GRID = 2048
FAN_IN = 8
_SETS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".!?",
    "comma": b",;:",
    "bang": b"!",
    "sign": b"#$%&*+<=>@^_~\\",
    "bar": b"|/",
    "quote": b"\"'()[]{}`",
    "line": b"\n\r",
    "blank": b" \t",
}
_MEMBER = np.array([[c in s for c in range(256)] for s in _SETS.values()] + [[c > 127 for c in range(256)], [c < 32 for c in range(256)]], np.float64).T
N_STATS = _MEMBER.shape[1] + 12


def statistics(text: str | None) -> np.ndarray:
    """Shares of byte classes, lengths, repetition of words and lines, byte entropy."""
    out = np.zeros(N_STATS)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    k = _MEMBER.shape[1]
    out[:k] = hist @ _MEMBER
    p = hist[hist > 0]
    n = max(1, len(words))
    distinct = len(set(words))
    out[k:] = [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        len(raw) / n,
        distinct / n,
        np.log1p(distinct),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)),
        np.log1p(len(raw) / max(1, len(lines))),
        -(p * np.log(p)).sum(),
        hist.max(),
        sum(map(len, set(words))) / max(1, distinct),
        len(max(words, key=len, default=b"")) ** 0.5,
    ]
    return out


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [statistics(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(_stats), "doc_id long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    at: np.ndarray  # isotonic knots: raw scores and what they mean
    means: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return features(x, self.mean, self.scale, self.w, self.phase) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.means)


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, phase: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([np.sqrt(2 / len(phase)) * np.cos(z @ w + phase), np.ones((len(x), 1))], axis=1)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, N_STATS)


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """Sum over all rows of part(x, y), an array of the given size: per partition, then in
    FAN_IN tasks, then here."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(_matrix(b), b.column("y").to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for s in b.column("s").to_pylist():
                total += np.frombuffer(s)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    got = rows.mapInArrow(tidied(first), "s binary").repartition(FAN_IN).mapInArrow(tidied(second), "s binary").collect()
    return sum((np.frombuffer(bytes(r["s"])) for r in got), np.zeros(size))


def isotonic(n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted means of y/n made non-decreasing by pooling adjacent violators; n > 0."""
    blocks: list[list[float]] = []  # weight, sum, bins
    for w, s in zip(n, y, strict=True):
        blocks.append([w, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            for i in range(3):
                blocks[-1][i] += last[i]
    return np.concatenate([np.full(int(k), s / w) for w, s, k in blocks])


def fit(train: DataFrame) -> Model | None:
    """From rows (x, y)."""
    moments = _summed(train, lambda x, y: np.concatenate([[len(y)], x.sum(0), (x * x).sum(0)]), 1 + 2 * N_STATS)
    n = moments[0]
    if not n:
        return None
    mean = moments[1 : 1 + N_STATS] / n
    scale = np.sqrt(np.maximum(moments[1 + N_STATS :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    r = np.random.default_rng(7)
    w = r.standard_normal((N_STATS, FEATURES)) / np.sqrt(2 * N_STATS)
    phase = r.uniform(0, 2 * np.pi, FEATURES)
    d = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = features(x, mean, scale, w, phase)
        return np.concatenate([z.T @ z, (z.T @ y)[:, None]], axis=1)

    eq = _summed(train, normal, d * (d + 1)).reshape(d, d + 1)
    penalty = np.eye(d) * RIDGE
    penalty[-1, -1] = 1e-6
    beta = np.linalg.solve(eq[:, :d] + penalty, eq[:, d])
    model = Model(mean, scale, w, phase, beta, np.zeros(1), np.zeros(1))

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.raw(x) + 0.5) / 2 * GRID).astype(np.int64), 0, GRID - 1)
        return np.stack([np.bincount(at, minlength=GRID), np.bincount(at, y, GRID)])

    count, good = _summed(train, binned, 2 * GRID).reshape(2, GRID)
    used = np.flatnonzero(count)
    model.at = (used + 0.5) / GRID * 2 - 0.5
    # the ends stay inside (0, 1)
    model.means = np.clip(isotonic(count[used], good[used]), 1e-4, 1 - 1e-4)
    return model


def score(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; held_out is a condition on doc_id."""
    scratch = Scratch(docs.sparkSession)
    stats = scratch.save(document_statistics(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("y is not null")
    train = scratch.save(stats.filter(~held_out).join(known, "doc_id").select("x", "y"))
    model = fit(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b)) if model and b.num_rows else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = stats.mapInArrow(tidied(run), "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
