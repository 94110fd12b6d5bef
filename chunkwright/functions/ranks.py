"""Exact ranks without ranking a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def block_ranks(rows: DataFrame, key: str, *group: str, rank: str = "rank", size: str = "size", blocks: int = 64) -> DataFrame:
    """``rows`` with ``rank`` from 0 by ``key`` within ``group``, and the group's ``size``.

    Ranks are taken within ranges of the key and raised by what lies in the ranges before. The ranges come from a bounded
    random sample, which decides how even the work is and nothing else. Null keys come first. Rows of equal keys share a
    range and follow each other in any order, so a key should tell rows apart.
    """
    sample = rows.select(key).where(F.col(key).isNotNull()).orderBy(F.rand(1)).limit(16 * blocks).collect()
    values = sorted(r[0] for r in sample)
    bounds = sorted({values[len(values) * i // blocks] for i in range(1, blocks)}) if values else []
    below = F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(key)) if bounds else None
    blocked = rows.withColumn("__block", F.when(F.col(key).isNull(), -1).otherwise(F.size(below) if bounds else F.lit(0)))
    counts = blocked.groupBy(*group, "__block").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # at most blocks + 1 rows each
    offsets = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__block").alias("__of"), F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*group)).alias(size))
    ranked = blocked.withColumn("__r", F.row_number().over(Window.partitionBy(*group, "__block").orderBy(F.asc_nulls_first(key))))
    same = F.col("__block") == F.col("__of")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return ranked.join(offsets, same).select(*rows.columns, (F.col("__r") - 1 + F.col("__before")).cast("long").alias(rank), F.col(size).cast("long").alias(size))
