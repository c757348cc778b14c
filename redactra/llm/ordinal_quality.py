"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade >= k | x) = sigmoid(w . x - t_k) with one weight vector w for all grades and thresholds t_1 < t_2 < ... kept in
order by their parametrisation (the first one, then logarithms of the steps). The expected grade is the sum of these tail
probabilities; selection goes by the tail probability of a grade.

The model is fitted on at most ``max_rows`` rated documents, those with the smallest hash of their id (a bounded sample,
the only one here); every document is scored. Weights and thresholds have a fixed size whatever the corpus.

Features are presence-weighted hashed words, word shapes (letters and digits folded), and binned shares of the whole text.

Defined results: a null or empty text has the bias feature alone. Null ratings aren't used; a document rated more than
once counts with its highest grade. Without ratings, or with ratings of one grade only, weights are zero and the
thresholds follow the grades' smoothed frequencies. Repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, slices, words

BITS, MAX_ROWS = 16, 8000
_FOLD = bytes.maketrans(b"abcdefghijklmnopqrstuvwxyz123456789", b"a" * 26 + b"0" * 9)
_RUN = re.compile(rb"(.)\1{2,}")


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))


def shape(word: bytes) -> bytes:
    """The word with letters as a, digits as 0, bytes beyond ASCII as a, and runs cut to two."""
    folded = bytes(97 if b > 127 else b for b in word.translate(_FOLD))
    return _RUN.sub(rb"\1\1", folded)


class Featurizer:
    """Texts to (indices, values); words' indices are remembered up to a bound."""

    def __init__(self, bits: int = BITS, remember: int = 300_000):
        self.mask, self.remember, self.seen = (1 << bits) - 1, remember, {}

    def slot(self, name: bytes) -> int:
        return xxhash.xxh3_64_intdigest(name) & self.mask

    def pair(self, word: bytes) -> tuple[int, int]:
        if (got := self.seen.get(word)) is None:
            if len(self.seen) >= self.remember:
                self.seen.clear()
            got = self.seen[word] = (self.slot(b"w:" + word), self.slot(b"s:" + shape(word)))
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = words(text)
        tf: dict[int, float] = {}
        n = len(tokens)
        if n:
            counts: dict[bytes, int] = {}
            for w in tokens:
                counts[w] = counts.get(w, 0) + 1
            shapes: dict[int, int] = {}
            for w, c in counts.items():
                a, b = self.pair(w)
                tf[a] = tf.get(a, 0) + 0.5 * math.sqrt(c / n)
                shapes[b] = shapes.get(b, 0) + c
            for b, c in shapes.items():
                tf[b] = tf.get(b, 0) + math.sqrt(c / n)
            upper = sum(map(str.isupper, text)) / max(1, len(text))
            marks = 1 - sum(map(str.isalpha, text)) / max(1, len(text) - text.count(" "))
            for name, v in (("distinct", math.log(len(counts)) / math.log(n) if n > 1 else 1), ("upper", math.sqrt(upper)), ("marks", math.sqrt(max(0, marks))), ("top", max(counts.values()) / n), ("length", min(1, math.log10(n) / 5))):
                for k in (10, 20):
                    tf[self.slot(f"b:{name}:{k}:{int(v * k)}".encode())] = 1.0
        tf[self.slot(b"bias")] = 1.0
        return np.fromiter(tf, np.int64, len(tf)), np.fromiter(tf.values(), float, len(tf))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, bits: int = BITS, l2: float = 3e-4, rounds: int = 200, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood with a ridge on the weights, by Adam on all rows; the same rows give the same model."""
    share = (np.bincount(grades, minlength=n_grades) + 0.5) / (len(grades) + 0.5 * n_grades)
    tail = np.cumsum(share[::-1])[::-1][1:]
    start = np.log((1 - tail) / tail)
    w = np.zeros(1 << bits)
    if len(np.unique(grades)) < 2:
        return OrdinalModel(w, start, bits)
    idx = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows])
    ends = np.cumsum([len(r[0]) for r in rows])
    at = ends - np.array([len(r[0]) for r in rows])
    row = np.repeat(np.arange(len(rows)), ends - at)
    theta = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    moment = [np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))]
    for t in range(1, rounds + 1):
        steps = np.exp(theta[1:])
        cuts = theta[0] + np.concatenate([[0], np.cumsum(steps)])
        z = np.add.reduceat(val * w[idx], at)
        s = 1 / (1 + np.exp(np.clip(cuts[None, :] - z[:, None], -40, 40)))  # P(y >= k)
        full = np.hstack([np.ones((len(z), 1)), s, np.zeros((len(z), 1))])
        slope = np.hstack([np.zeros((len(z), 1)), s * (1 - s), np.zeros((len(z), 1))])
        i = np.arange(len(z))
        p = np.maximum(full[i, grades] - full[i, grades + 1], 1e-12)
        up, down = slope[i, grades] / p, slope[i, grades + 1] / p
        dz = -(up - down) / len(z)
        dcut = np.zeros((len(z), n_grades + 1))
        dcut[i, grades] += up
        dcut[i, grades + 1] -= down
        dcut = dcut[:, 1:-1].sum(axis=0) / len(z)
        dtheta = np.concatenate([[dcut.sum()], [dcut[k + 1 :].sum() * steps[k] for k in range(len(steps))]])
        grad = np.concatenate([np.bincount(idx, val * dz[row], len(w)) + l2 * w, dtheta])
        moment[0] = 0.9 * moment[0] + 0.1 * grad
        moment[1] = 0.999 * moment[1] + 0.001 * grad**2
        move = rate * (moment[0] / (1 - 0.9**t)) / (np.sqrt(moment[1] / (1 - 0.999**t)) + 1e-8)
        w -= move[: len(w)]
        theta -= move[len(w) :]
    return OrdinalModel(w, theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))]), bits)


def train(df: DataFrame, ratings: DataFrame, n_grades: int, max_rows: int = MAX_ROWS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """``ratings``: (id, grade), grades from 0.

    Features are made on the executors; at most ``max_rows`` rows reach the driver, each with 12 bytes for each of its hashed
    features, of which there are 2 ** ``bits`` at most however long its text. Of several texts with one id the least is taken.
    """
    rated = ratings.select(F.col(id_col).alias("id"), F.col("grade").cast("int").alias("grade")).dropna()
    rated = rated.filter(F.col("grade").between(0, n_grades - 1)).groupBy("id").agg(F.max("grade").alias("grade"))
    some = hash_sample(rated, max_rows, "id")
    # At most max_rows rows of two numbers: a proven bound.
    joined = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(some), "id")
    joined = joined.groupBy("id").agg(F.min("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text")

    def run(batches):
        make = Featurizer(bits)
        for b in slices(batches):
            made = [make(x) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())), pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32()))], names=["grade", "idx", "val"])

    got = joined.mapInArrow(run, "grade int, idx array<int>, val array<float>").toPandas()
    got = got.iloc[np.lexsort((got["idx"].map(len), got["grade"]))] if len(got) else got
    rows = [(np.asarray(a, np.int64), np.asarray(b, float)) for a, b in zip(got["idx"], got["val"], strict=True)]
    return fit(rows, got["grade"].to_numpy(int), n_grades, bits)


def score(df: DataFrame, model: OrdinalModel, tail_grade: int = 1, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, tail_probability, top_probability, kept) of every document."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        make = Featurizer(m.bits)
        for b in slices(batches):
            z = np.array([v @ m.weights[i] for i, v in map(make, b.column(1).to_pylist())])
            tails = m.tails(z)
            tail = tails[:, tail_grade - 1]
            cols = [tails.sum(axis=1), tail, tails[:, -1]]
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.float64()) for c in cols), pa.array(tail >= keep_from, pa.bool_())], names=names)

    names = [id_col, "expected_grade", "tail_probability", "top_probability", "kept"]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, expected_grade double, tail_probability double, top_probability double, kept boolean")


def grade(quality: Column, toxic: Column) -> Column:
    """Grades from two binary ratings: 0 low quality, 1 good but toxic, 2 good and clean; null where the rating that decides is null."""
    return F.when(quality == 0, 0).when(quality == 1, F.when(toxic == 1, 1).when(toxic == 0, 2))
