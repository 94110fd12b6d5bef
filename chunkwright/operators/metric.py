"""Metric learning: a linear map of embeddings, fitted so that anchors come nearer to positives than to negatives.

The loss of a triplet is ``max(0, |W(a - p)| - |W(a - n)| + margin)``. Its gradient is a sum of outer products, so each task
adds up one matrix for its triplets, the matrices are summed in an aggregate, and the driver moves the map by Adam.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import minibatch

#: Added to every difference before its norm is taken, which keeps the gradient defined where two vectors are equal.
SHIFT = 1e-6


@dataclass(frozen=True)
class Triplets:
    margin: float = 0.5
    learning_rate: float = 0.01
    epochs: int = 10


def with_vectors(triplets: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(anchor, positive, negative) vectors of triplets of keys; a triplet with a key that is null or has no vector is left out."""
    out = triplets
    for name in ("anchor", "positive", "negative"):
        out = out.join(vectors.select(F.col(key).alias(name), F.col("embedding").cast("array<double>").alias(f"{name}_v")), name)
    return out.select(*[F.col(f"{name}_v").alias(name) for name in ("anchor", "positive", "negative")])


def margin_loss(margin: float, anchor: str = "anchor", positive: str = "positive", negative: str = "negative") -> Column:
    """The loss of a row's vectors as they are."""

    def distance(a: str, b: str) -> Column:
        squares = F.zip_with(a, b, lambda x, y: (x - y + F.lit(SHIFT)) * (x - y + F.lit(SHIFT)))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))

    return F.greatest(F.lit(0.0), distance(anchor, positive) - distance(anchor, negative) + F.lit(margin))


def loss_and_gradient(w: np.ndarray, a: np.ndarray, p: np.ndarray, n: np.ndarray, margin: float) -> tuple[float, np.ndarray]:
    """Sums over rows of vectors."""
    near, far = (a - p) @ w.T + SHIFT, (a - n) @ w.T + SHIFT
    d_near, d_far = np.linalg.norm(near, axis=1), np.linalg.norm(far, axis=1)
    loss = d_near - d_far + margin
    on = loss > 0
    unit = lambda x, d: x[on] / np.maximum(d[on], 1e-12)[:, None]
    return float(loss[on].sum()), unit(near, d_near).T @ (a - p)[on] - unit(far, d_far).T @ (a - n)[on]


def mean_loss_and_gradient(triplets: DataFrame, w: np.ndarray, margin: float) -> tuple[float, np.ndarray, int]:
    """(mean loss, its gradient, triplets) of a table of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, gradient = 0, 0.0, np.zeros_like(w)
        for batch in batches:
            if batch.num_rows:
                lost, g = loss_and_gradient(w, *(minibatch.matrix(batch.column(i)) for i in range(3)), margin)
                n, loss, gradient = n + batch.num_rows, loss + lost, gradient + g
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([gradient.ravel()], pa.list_(pa.float64()))], names=["n", "loss", "g"])

    parts = triplets.select("anchor", "positive", "negative").mapInArrow(run, "n long, loss double, g array<double>")
    r = parts.agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")).first()
    if not r.n:
        return 0.0, np.zeros_like(w), 0
    return r.loss / r.n, np.array(r.g).reshape(w.shape) / r.n, r.n


def fit_projection(triplets: DataFrame, p: Triplets = Triplets()) -> tuple[np.ndarray, list[float]]:
    """The map, beginning from the identity, and the mean loss before each step and after the last. Without triplets it stays the identity."""
    held = triplets.persist()
    try:
        first = held.select(F.size("anchor")).first()
        if first is None:
            return np.eye(1), []
        w, losses = np.eye(first[0]), []
        state = minibatch.State.new(w.ravel())
        for _ in range(p.epochs):
            loss, gradient, _ = mean_loss_and_gradient(held, w, p.margin)
            losses.append(loss)
            state.move(gradient.ravel(), p.learning_rate)
            w = state.w.reshape(w.shape)
        return w, [*losses, mean_loss_and_gradient(held, w, p.margin)[0]]
    finally:
        held.unpersist()


def project(rows: DataFrame, w: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``rows`` with ``vector`` mapped by ``w``, in Arrow batches; null vectors stay null."""
    at = rows.columns.index(vector)
    schema = T.StructType([f if i != at else T.StructField(vector, T.ArrayType(T.FloatType())) for i, f in enumerate(rows.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            known = column.drop_null()
            mapped = iter((minibatch.matrix(known) @ w.T).astype(np.float32)) if len(known) else iter(())
            made = pa.array([next(mapped) if x else None for x in column.is_valid().to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.mapInArrow(run, schema)
