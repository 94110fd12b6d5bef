"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def star_forest(edges: DataFrame) -> DataFrame:
    """(u, v) for every vertex ``u`` but the least of its component, ``v`` that least one.

    ``edges`` has bigint columns u and v. Self links and nulls say nothing and fall away; repeated edges
    count once; no edges give no rows. Every round is written to the shared folder, which cuts lineage,
    and only two figures of it reach the driver. Minima are pre-aggregated, and the joins that follow
    have plain exchanges, which adaptive execution splits at hot vertices.
    """
    now = stage_table(edges.select("u", "v").where("u <> v"), "edges")
    before = None
    signature = _signature(now)
    while signature[0] and signature != before:
        before = signature
        now = stage_table(_small_star(_large_star(now)), "edges")
        signature = _signature(now)
    return now
