"""Quality classifier: naive-Bayes support vectors.

A text is the set of its hashed n-grams: words, word pairs, and runs of one to three characters.  A word that equals
the one before it becomes a token of its own, so that the n-grams show repetition.  Each indicator is
scaled by the log ratio of its smoothed frequencies in the two classes, and a linear hinge-loss model is fitted to the
scaled vectors by dual coordinate descent.  Scores are the margins through a logistic curve fitted to the same
sample.

The fit takes at most ``sample`` labelled rows of each class, those with the smallest hash of doc_id; that is the only
bound, and scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 18
SIZE = 1 << BITS
SAMPLE = 3000
THRESHOLD = 0.3
REPEATED = np.uint64(0x9E3779B97F4A7C15)
#: Slots of a text above which a table of all slots is cheaper than a sort.
MANY = 40_000


def features(text: bytes, memory: common.WordHash) -> np.ndarray:
    """The sorted slots of a text's n-grams."""
    shift = np.uint64(64 - BITS)
    hashes = memory.of(text.split())
    if len(hashes) > 1:
        again = np.concatenate([[False], hashes[1:] == hashes[:-1]])
        hashes = np.where(again, REPEATED, hashes)
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1 << 40)
    parts = [common.mixed(hashes), common.rolling(hashes, 2)] + [common.rolling(codes, n) for n in (1, 2, 3)]
    slots = (np.concatenate(parts) >> shift).astype(np.int32)
    if len(slots) > MANY:
        seen = np.zeros(SIZE, bool)
        seen[slots] = True
        return np.flatnonzero(seen).astype(np.int32)
    return np.unique(slots)


@dataclass
class Model:
    weights: np.ndarray  # float32, SIZE
    slope: float
    offset: float

    def score(self, slots: np.ndarray) -> float:
        z = self.slope * float(self.weights[slots].sum(dtype=np.float64)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, rounds: int = 12, seed: int = 5) -> Model:
    """rows: the slots of each text; labels: 0 or 1.  With one class only, every score is that class."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    if len(set(y)) < 2:
        return Model(np.zeros(SIZE, np.float32), 0.0, 0.0 if len(y) == 0 else 4.0 * float(y[0]))
    seen = {}
    for side in (1.0, -1.0):
        n = np.ones(SIZE)
        for row, label in zip(rows, y, strict=True):
            if label == side:
                n[row] += 1
        seen[side] = n
    known = (seen[1.0] + seen[-1.0]) > 3  # a slot of a single text says nothing of its class
    ratio = np.where(known, np.log((seen[1.0] / seen[1.0].sum()) / (seen[-1.0] / seen[-1.0].sum())), 0.0)
    norm = [float(np.sqrt((ratio[row] ** 2).sum())) or 1.0 for row in rows]
    # dual coordinate descent for min |w|^2 / 2 + c * sum of hinge losses, vectors of length one, bias as a feature
    w, bias, alpha, order = np.zeros(SIZE), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x = ratio[rows[i]] / norm[i]
            slope = y[i] * (float(w[rows[i]] @ x) + bias) - 1
            new = min(max(alpha[i] - slope / 2.0, 0.0), c)  # |x|^2 + 1 = 2
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    # margins are of unit vectors while fitting; a mean over slots keeps long and short texts comparable
    scaled = (w * ratio).astype(np.float32)
    margin = np.array([float(scaled[row].sum()) / n for row, n in zip(rows, norm, strict=True)]) + bias
    slope, offset = _logistic(margin, y > 0)
    return NormedModel(scaled, slope, offset, (ratio**2).astype(np.float32), bias)


@dataclass
class NormedModel(Model):
    squares: np.ndarray = None  # float32, SIZE: the squared scale of each slot
    bias: float = 0.0

    def score(self, slots: np.ndarray) -> float:
        length = float(np.sqrt(self.squares[slots].sum(dtype=np.float64))) or 1.0
        z = self.slope * (float(self.weights[slots].sum(dtype=np.float64)) / length + self.bias) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y) = 1 / (1 + exp(-(slope * x + offset))) by Newton steps; classes weigh alike."""
    weight = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    aim = np.where(y, 1 - 1 / (y.sum() + 2), 1 / ((~y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weight * (p - aim), weight * p * (1 - p) + 1e-9
        grad = np.array([(g * x).sum() + 1e-4 * a, g.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-4, (h * x).sum()], [(h * x).sum(), h.sum()]])
        da, db = np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
        a, b = a - float(np.clip(da, -5, 5)), b - float(np.clip(db, -5, 5))
        if abs(da) + abs(db) < 1e-6:
            break
    return a, b


def held_out(doc_id):
    """Rows that no fit may learn labels from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _slots(batches):
    memory = common.WordHash()
    for batch in batches:
        got = [features(t, memory).tobytes() for t in common.string_rows(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(got, pa.binary())], ["label", "slots"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: doc_id, quality.  Learns from rows that are not held out, at most ``sample`` of each class; of a doc_id with
    several labels the largest counts, of one with several texts the least."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    order = F.xxhash64(F.lit(5), "doc_id")
    picked = None
    for side in (0, 1):
        got = known.where(F.when(F.col("label") > 0, 1).otherwise(0) == side).orderBy(order, "doc_id").limit(sample)
        picked = got if picked is None else picked.unionByName(got)
    picked = common.written(picked.select(F.col("doc_id").alias("l_id"), "label"), "classifier-sample")  # at most 2 * sample rows
    rows = docs.select("doc_id", common.text_bytes().alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("l_id")).select("doc_id", "label", "text")
    # of a doc_id that has several texts the least one counts, so that reruns agree
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("label", "text").mapInArrow(_slots, "label int, slots binary")
    got = sorted((bytes(r["slots"]), r["label"]) for r in rows.collect())  # the sample; in an order that no partitioning changes
    return fit([np.frombuffer(s, np.int32) for s, _ in got], np.array([x for _, x in got]))


def _score(model: Model, extra: list[str]):
    def run(batches):
        memory = common.WordHash()
        for batch in common.slices(batches):
            score = [model.score(features(t, memory)) for t in common.string_rows(batch.column("__text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in extra), pa.array(score, pa.float64())], [*extra, "__score"])

    return run


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs and __score, for each row.  A null text is scored as an empty one."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.select(*keep, common.text_bytes().alias("__text"))
    return rows.mapInArrow(_score(model, keep), f"{schema}, __score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    A null or empty text gets the score of a text without n-grams.  A null doc_id is not held out and has no
    label.  Repeated rows get equal scores.  Without labels, or with one class, scores are constant; an empty table
    gives an empty result.  Of docs only doc_id and text are read."""
    model = train(docs, labels, sample)
    out = scored(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("__score").alias("score"), F.when(F.col("__score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
