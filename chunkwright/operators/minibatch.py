"""A linear classifier trained by mini-batch Adam, many of them at once where their rows overlap.

Rows are dealt to parts by a hash of their key and shuffled within each part anew for each epoch, by a seeded sort. A task
streams its part in Arrow batches, cuts it into mini-batches and makes a step for each; after an epoch weights, moments and
step counts of the parts are averaged in one aggregate, by the number of their batches. With one part this is plain Adam.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import block_ranks
from ..sources.store import read_text, write_text
from .labels import seeded_order

BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Adam:
    learning_rate: float = 1e-3
    batch_size: int = 32
    epochs: int = 100
    seed: int = 0
    #: Rows that one task trains on; the rows in all divided by it give the number of parts.
    part_rows: int = 65_536


def part_of(key: Column, parts: int) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % parts


def batch_windows(rows: DataFrame, key: str, size: int, seed: int, epoch: int = 0, parts: int = 1) -> DataFrame:
    """``rows`` with part, batch and place: the mini-batches of an epoch, in seeded order within each part.

    A part is ranked in ranges of the shuffle key, so one part of any size is spread over tasks.
    """
    keyed = rows.withColumn("part", part_of(F.col(key), parts)).withColumn("__order", seeded_order(seed + epoch, key))
    ranked = block_ranks(keyed, "__order", "part", rank="__rank", size="__size")
    return ranked.withColumn("batch", F.floor(F.col("__rank") / size).cast("long")).withColumn("place", F.col("__rank") % size).drop("__order", "__rank", "__size")


def start(d: int, seed: int) -> np.ndarray:
    """Weights and bias of a new model: uniform within 1 / sqrt(d)."""
    return np.random.default_rng(seed).uniform(-1, 1, d + 1) / math.sqrt(max(1, d))


class State:
    """Weights (the bias last), first and second moments, and steps made."""

    def __init__(self, flat: np.ndarray):
        n = (len(flat) - 1) // 3
        self.w, self.m, self.v, self.t = flat[:n].copy(), flat[n : 2 * n].copy(), flat[2 * n : 3 * n].copy(), float(flat[-1])

    @classmethod
    def new(cls, w: np.ndarray) -> State:
        return cls(np.concatenate([w, np.zeros(2 * len(w) + 1)]))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w, self.m, self.v, [self.t]])

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One step of Adam on a batch; the mean loss before it."""
        z = x @ self.w[:-1] + self.w[-1]
        loss = float(np.mean(np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))))
        off = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
        self.move(np.append(off @ x, off.sum()), rate)
        return loss

    def move(self, gradient: np.ndarray, rate: float) -> None:
        self.t += 1
        self.m = BETA1 * self.m + (1 - BETA1) * gradient
        self.v = BETA2 * self.v + (1 - BETA2) * gradient**2
        self.w = self.w - rate * (self.m / (1 - BETA1**self.t)) / (np.sqrt(self.v / (1 - BETA2**self.t)) + EPSILON)


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists of numbers as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors must have one length")
    return flat.reshape(len(column), -1)


def one_epoch(dealt: DataFrame, states: list[State], p: Adam, epoch: int) -> tuple[list[State], list[float]]:
    """States after an epoch, and the mean of all batches' losses, of each model. ``dealt`` has part, key, embedding, label and fold; model j leaves fold j out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, waiting, done, losses = None, [], [], [], []

        def advance(j: int, rest: bool) -> None:
            x, y = waiting[j]
            size = p.batch_size
            upto = len(y) if rest else len(y) // size * size
            for a in range(0, upto, size):
                losses[j] += own[j].step(x[a : min(a + size, upto)], y[a : min(a + size, upto)], p.learning_rate)
                done[j] += 1
            waiting[j] = (x[upto:], y[upto:])

        def finished() -> Iterator[pa.RecordBatch]:
            for j in range(len(states) if at is not None else 0):
                advance(j, True)
                if done[j]:
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([done[j]], pa.int64()), pa.array([losses[j]]), pa.array([own[j].flat() * done[j]], pa.list_(pa.float64()))], names=["model", "batches", "loss", "state"])

        for batch in batches:
            parts, folds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            y, x = batch.column(2).to_numpy(zero_copy_only=False), matrix(batch.column(3))
            cuts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else []
            for a, b in zip(cuts, [*cuts[1:], len(parts)]):
                if parts[a] != at:
                    yield from finished()
                    at = parts[a]
                    own, done, losses = [State(s.flat()) for s in states], [0] * len(states), [0.0] * len(states)
                    waiting = [(x[:0], y[:0])] * len(states)
                for j in range(len(states)):
                    mine = folds[a:b] != j
                    waiting[j] = (np.concatenate([waiting[j][0], x[a:b][mine]]), np.concatenate([waiting[j][1], y[a:b][mine]]))
                    advance(j, False)
        yield from finished()

    shuffled = dealt.sortWithinPartitions("part", seeded_order(p.seed + epoch, "key"), "key", "label")
    parts = shuffled.select("part", "fold", "label", "embedding").mapInArrow(run, "model int, batches long, loss double, state array<double>")
    sums = parts.groupBy("model").agg(F.sum("batches").alias("batches"), F.sum("loss").alias("loss"), vector_to_array(Summarizer.sum(array_to_vector("state"))).alias("state"))
    after, losses = list(states), [0.0] * len(states)
    for r in sums.collect():  # one row for each model
        after[r.model], losses[r.model] = State(np.array(r.state) / r.batches), r.loss / r.batches
    return after, losses


def fit_models(rows: DataFrame, p: Adam, key: str | None = None, folds: int = 1) -> tuple[list[np.ndarray], list[list[float]]]:
    """Weights (the bias last) of ``folds`` models, and the losses of each epoch, from (embedding, label) rows.

    With several models ``rows`` has ``fold``, and model j learns from the rows of other folds: all of them advance in the
    same scan of an epoch. Rows without an embedding or a label are left out. Without a ``key`` column equal rows are
    told apart by nothing, which changes nothing.
    """
    named = (F.col(key) if key else F.xxhash64("embedding", "label")).cast("string")
    fold = F.col("fold") if folds > 1 else F.lit(-1)
    usable = rows.where("embedding IS NOT NULL AND label IS NOT NULL").select(named.alias("key"), fold.cast("int").alias("fold"), F.col("label").cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    n, d = usable.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    parts = max(1, -(-n // p.part_rows))
    states, losses = [State.new(start(d or 0, p.seed)) for _ in range(folds)], [[] for _ in range(folds)]
    dealt = usable.withColumn("part", part_of(F.col("key"), parts)).repartition(parts, "part").persist()
    try:
        for epoch in range(p.epochs if n else 0):
            states, lost = one_epoch(dealt, states, p, epoch)
            for own, x in zip(losses, lost):
                own.append(x)
    finally:
        dealt.unpersist()
    return [s.w for s in states], losses


def dot(vector: str, weights: str) -> Column:
    products = F.zip_with(vector, weights, lambda x, w: x.cast("double") * w)
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def probability(rows: DataFrame, models: list[np.ndarray], fold: str | None = None) -> DataFrame:
    """``rows`` with the probability of label 1, by the only model or by the one of the row's fold."""
    known = rows.sparkSession.createDataFrame([(j, w[:-1].tolist(), float(w[-1])) for j, w in enumerate(models)], "__model int, __w array<double>, __b double")
    joined = rows.join(F.broadcast(known), F.col(fold) == F.col("__model") if fold else F.lit(True))  # as many rows as models
    return joined.select(*rows.columns, (1 / (1 + F.exp(-(dot("embedding", "__w") + F.col("__b"))))).alias("probability"))


def save(spark: SparkSession, path: str, weights: np.ndarray, losses: list[float], p: Adam) -> None:
    write_text(spark, f"{path}/adam.json", json.dumps({"weights": weights.tolist(), "losses": losses, "adam": p.__dict__}))


def load(spark: SparkSession, path: str) -> tuple[np.ndarray, list[float], Adam] | None:
    text = read_text(spark, f"{path}/adam.json")
    if text is None:
        return None
    saved = json.loads(text)
    return np.array(saved["weights"]), saved["losses"], Adam(**saved["adam"])
