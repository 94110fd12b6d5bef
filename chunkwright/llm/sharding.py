"""Proportional stratified interleaving of documents into shards.

Rows are shuffled by a seeded hash within each source and ranked there; the rank divided by the source's
size is a row's fractional rank. Sorted by it, any contiguous cut holds every source in its share, so
cutting the order into equal runs gives shards that match the mixture and whose row counts differ by one
at most. Neither ranking gathers a source or the table: both go bucket by bucket over an order-preserving
bucket of the sort key (top bits of the hash, then the fraction's leading digits), with bucket counts summed
before. A source with a third of all rows is therefore dealt over as many buckets as it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table


@dataclass(frozen=True)
class Sharding:
    shards: int = 8
    seed: int = 20_240_601
    #: Rows that a ranking bucket should hold.
    bucket_rows: int = 2_048


def _bits(rows: int, bucket_rows: int) -> int:
    return min(30, max(0, (rows // bucket_rows).bit_length()))


def shuffle_key(params: Sharding) -> Column:
    """Where a row stands in its source's shuffle: a hash of all that tells rows apart, since ids may be missing or repeat."""
    return F.xxhash64(F.lit(params.seed), "doc_id", "text_crc32", "size")


def stratified_shards(docs: DataFrame, params: Sharding = Sharding()) -> DataFrame:
    """(doc_id, source, size, text_crc32, position, shard, slot), one row per input row.

    ``size`` is the text's UTF-8 bytes (none if null) plus one; a null source is a source of its own.
    Equal hashes are ordered by doc_id (nulls first), checksum and size, so only rows alike in all of them
    may swap. Texts of any length count whole, and only their numbers are shuffled; other columns are left out,
    whatever their names. Copies of a text are placed one by one: a group may hold a third of all rows, which no
    shard could take whole under the law of equal row counts. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("stratum"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("shuffled", shuffle_key(params))
    rows = stage_table(rows, "sizes")
    total = rows.count()
    bits = _bits(total, params.bucket_rows)
    ties = [F.col("doc_id").asc_nulls_first(), "text_crc32", "size"]

    rows = rows.withColumn("bucket", F.shiftright("shuffled", 64 - bits) if bits else F.lit(0).cast("long"))
    in_source = Window.partitionBy("stratum").orderBy("bucket")
    counts = (
        rows.groupBy("stratum", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "stratum",
            "bucket",
            (F.sum("n").over(in_source) - F.col("n")).alias("before"),
            F.sum("n").over(Window.partitionBy("stratum")).alias("of"),
        )
    )
    rank = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("shuffled", *ties))
    ranked = (
        rows.withColumn("rank", rank)
        .join(counts, ["stratum", "bucket"])
        .withColumn("fraction", (2 * (F.col("rank") + F.col("before")) - 1).cast("double") / (2 * F.col("of")))
        .withColumn("part", F.floor(F.col("fraction") * float(1 << bits)))
        .drop("bucket", "before", "of", "rank", "shuffled")
    )
    ranked = stage_table(ranked, "fractions")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    placed = (
        ranked.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("fraction", "stratum", *ties)))
        .join(parts, "part")
        .withColumn("position", F.col("rank") + F.col("before") - 1)
    )
    n, s = max(1, total), params.shards
    shard = F.expr(f"((position + 1) * {s} - 1) div {n}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.col("position").cast("long").alias("position"),
        "shard",
        F.expr(f"cast(position - (cast(shard as bigint) * {n}) div {s} as bigint)").alias("slot"),
    )
