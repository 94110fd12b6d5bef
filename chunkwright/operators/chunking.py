"""Overlapping token windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def windows(ids: Column, size: int, stride: int) -> Column:
    """All windows of up to ``size`` items that start at 0, stride, 2 stride, ... below the length."""
    starts = F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(ids, i + 1, size))


def chunk(files: DataFrame, size: int, stride: int, ids: str = "tokens", key: str = "file") -> DataFrame:
    """(key, chunk_index, tokens), one row per window; files without tokens give none. No shuffle."""
    return files.select(key, F.posexplode(windows(F.col(ids), size, stride)).alias("chunk_index", "tokens"))


def tokenize(files: DataFrame, text: str = "text") -> DataFrame:
    return files.withColumn("tokens", tokens(F.col(text)))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks and files in all."""
    per_file = chunks.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.sum("n").alias("n_chunks"), F.count(F.lit(1)).alias("n_files"))


def file_chunk_list(chunks: DataFrame) -> DataFrame:
    """Each file's chunks as one ordered list; bounded by one file's length."""
    return chunks.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "tokens"))).alias("chunks"))
