"""Confident chunks and training triplets from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labels import seeded_order


def confident(scores: DataFrame, threshold: float) -> DataFrame:
    """Chunks strictly above the threshold."""
    return scores.where(F.col("probability") > threshold)


def detection_summary(scores: DataFrame, threshold: float) -> DataFrame:
    """Chunks and files in all and with a confident chunk: counted per file first, so nothing is made distinct twice."""
    per_file = scores.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("probability") > threshold).alias("kept"))
    return per_file.agg(F.sum("n").alias("n_chunks"), F.sum("kept").alias("n_kept"), F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("kept") > 0).alias("n_detected"))


def _numbered(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Positions 0, 1, ... in seeded order, ranked within ranges of the shuffle key and offset by their counts."""
    keyed = rows.withColumn("__k", seeded_order(seed, key)).withColumn("__b", F.substring("__k", 1, 2))
    counts = keyed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))  # at most 256 rows
    ranked = keyed.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__k", key)))
    return ranked.join(before, "__b").withColumn("idx", (F.col("__r") + F.col("__o") - 1).cast("long")).drop("__k", "__b", "__r", "__o")


def triplets(positives: DataFrame, negatives: DataFrame, key: str, seed: int) -> DataFrame:
    """(idx, anchor, positive, negative) keys: each anchor with another positive and its own negative, if there are enough.

    The other positive is ``1 + hash mod (n - 1)`` places on, so never the anchor. Fewer than two positives
    give no triplets.
    """
    anchors = _numbered(positives.select(key), key, seed)
    n = anchors.count()
    if n < 2:
        return anchors.select("idx", F.col(key).alias("anchor"), F.col(key).alias("positive"), F.col(key).alias("negative")).limit(0)
    step = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}+"), F.col("idx").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(n - 1))
    left = anchors.select("idx", F.col(key).alias("anchor"), F.pmod(F.col("idx") + 1 + step, F.lit(n)).alias("other"))
    right = anchors.select(F.col("idx").alias("other"), F.col(key).alias("positive"))
    foes = _numbered(negatives.select(key), key, seed).select("idx", F.col(key).alias("negative"))
    return left.join(right, "other").join(foes, "idx", "left").select("idx", "anchor", "positive", "negative")
