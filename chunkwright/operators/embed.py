"""Embedding of chunks: a protocol, two built-in embedders, and masked mean pooling."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import read_text, write_text
from . import metric


class Embedder(Protocol):
    def key(self) -> str:
        """What tells this embedder's vectors from any other's: kind, settings, model and version."""

    def embed(self, chunks: DataFrame) -> DataFrame:
        """``chunks`` with ``embedding ARRAY<FLOAT>``."""


def named(what: str, name: str | None) -> str:
    if not name:
        raise ValueError(f"vectors of {what} without a name cannot be stored: nothing would tell them from others")
    return f"named-{name}"


class HashingEmbedder:
    """Signed feature hashing of a chunk's tokens to a unit vector; built-in expressions only."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def key(self) -> str:
        return f"hashing-{self.dimensions}"

    def save(self, spark: SparkSession, path: str) -> None:
        """Write what makes this embedder, for ``load``."""
        write_text(spark, f"{path}/embedder.json", json.dumps({"dimensions": self.dimensions}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HashingEmbedder | None:
        """The embedder saved at ``path``; None if there is none."""
        saved = read_text(spark, f"{path}/embedder.json")
        return cls(**json.loads(saved)) if saved else None

    def vector(self, tokens: Column) -> Column:
        d = self.dimensions
        hashes = F.transform(tokens, lambda t: F.xxhash64(t))
        # A token's slot, or its complement where the sign is negative; a slot's value is what the one occurs more often than the other.
        slot = lambda h: F.pmod(h, F.lit(d).cast("long"))
        codes = F.transform(hashes, lambda h: F.when(F.shiftright(h, 32).bitwiseAND(F.lit(1)) == 1, slot(h)).otherwise(F.bitwise_not(slot(h))))
        without = lambda c, code: F.size(F.array_remove(c, code))
        sums = lambda c: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(d - 1).cast("long")), lambda k: (without(c, F.bitwise_not(k)) - without(c, k)).cast("double"))
        norm = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-9))
        # arrays of one item name what would be worked out again at each use
        once = lambda value, use: F.transform(F.array(value), use)[0]
        unit = once(codes, lambda c: once(sums(c), lambda v: once(norm(v), lambda n: F.transform(v, lambda x: (x / n).cast("float")))))
        return F.when(tokens.isNotNull(), unit)

    def embed(self, chunks: DataFrame) -> DataFrame:
        return chunks.withColumn("embedding", self.vector(F.col("tokens")))


class PrecomputedEmbedder:
    """Vectors from a table, joined on the chunk's key. ``name`` tells the table's state from others, where results are stored."""

    def __init__(self, vectors: DataFrame, *keys: str, name: str | None = None):
        self.vectors, self.keys, self.name = vectors, list(keys), name

    def key(self) -> str:
        return named("a table of vectors", self.name)

    def embed(self, chunks: DataFrame) -> DataFrame:
        return chunks.join(self.vectors, self.keys)


class CallableEmbedder:
    """Any batch function from token lists to a matrix; ``load`` runs once in each worker task. ``name`` tells model and version, where results are stored."""

    def __init__(self, load: Callable[[], Callable[[list[list[str]]], np.ndarray]], batch: int = 64, name: str | None = None):
        self.load, self.batch, self.name = load, batch, name

    def key(self) -> str:
        return named("a function", self.name)

    def embed(self, chunks: DataFrame) -> DataFrame:
        load, size, at = self.load, self.batch, chunks.columns.index("tokens")
        schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            for batch in batches:
                for first in range(0, batch.num_rows, size):
                    part = batch.slice(first, size)
                    vectors = np.asarray(model(part.column(at).to_pylist()), np.float32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors.tolist(), pa.list_(pa.float32()))], names=[*part.schema.names, "embedding"])

        return chunks.mapInArrow(run, schema)


class ProjectedEmbedder:
    """Another embedder's vectors under a fitted linear map."""

    def __init__(self, inner: Embedder, matrix: np.ndarray):
        self.inner, self.matrix = inner, np.asarray(matrix, float)

    def key(self) -> str:
        return f"{self.inner.key()}-mapped-{hashlib.sha256(self.matrix.tobytes()).hexdigest()[:16]}"

    def embed(self, chunks: DataFrame) -> DataFrame:
        return metric.project(self.inner.embed(chunks), self.matrix)


def mean_pool(token_vectors: DataFrame, *keys: str) -> DataFrame:
    """Masked mean of token vectors (key..., mask, vector) for each key; the divisor is at least 1e-9. A vector stays one value: tasks pass on one sum for each key."""
    weighted = F.transform("vector", lambda x: x.cast("double") * F.col("mask"))
    sums = token_vectors.groupBy(*keys).agg(Summarizer.sum(array_to_vector(weighted)).alias("s"), F.sum("mask").cast("double").alias("m"))
    return sums.select(*keys, F.transform(vector_to_array("s"), lambda x: x / F.greatest(F.col("m"), F.lit(1e-9))).alias("pooled"))


def group_means(vectors: DataFrame, group: str, value: str = "embedding") -> DataFrame:
    """(group, mean): the mean vector of each group."""
    known = vectors.where(F.col(value).isNotNull())
    return known.groupBy(group).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(value).cast("array<double>")))).alias("mean"))
