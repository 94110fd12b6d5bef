"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of ``documents``; the last
returns the packed pieces. ``run`` writes every stage as Parquet in the shared folder and reads it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.llm import langid, simhash
from chunkwright.llm.decontaminate import EVERY, drop_contaminated
from chunkwright.llm.line_dedup import dedup_lines, without_words
from chunkwright.llm.packing import pack_documents
from chunkwright.session import drop_staged, stage_table, staged_tables
from chunkwright.sources.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near repeats of earlier lines; those of which no word is left go."""
    done = dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & without_words(F.col("text"))
    return done.where(~F.coalesce(emptied, F.lit(False))).select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), EVERY)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and the sequences they lie in."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Hyperdimensional profiles, XXH64 fingerprints and tokenizers have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; what a stage has staged goes when its result is written.

    Null and empty texts fall at the first stage. Rows that share a doc_id, or have none, are documents of their
    own. Texts of any length are read whole; other columns pass under any name up to packing. An empty
    ``documents`` gives no rows, an empty ``benchmark`` drops nothing.
    """
    docs, before = table(spark, sf_dir, "documents"), staged_tables()
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
        drop_staged(spark, *before, staged_tables()[-1])
    return docs
