"""File scores of a drop folder, kept current by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking
from ..sources.store import exists


def stream_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def running_file_scores(documents: DataFrame, score: Callable, size: int, stride: int) -> DataFrame:
    """(file, n_chunks, max_score) over a stream of (file, text): chunked and scored row by row, one aggregate per file. NaN is left out, as in ``file_max_score``."""
    chunks = chunking.chunk(chunking.tokenize(documents), size, stride)
    scored = chunks.select("file", score(F.array_join("tokens", " ")).alias("probability"))
    best = F.max(F.when(~F.isnan("probability"), F.col("probability")))
    return scored.groupBy("file").agg(F.count(F.lit(1)).alias("n_chunks"), F.greatest(F.coalesce(best, F.lit(0.0)), F.lit(0.0)).alias("max_score"))


def start(scores: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep ``table`` current: each batch adds a folder of the files that it changed, and no file is held on the driver.

    A batch that is run again after a failure replaces its own folder.
    """

    def add(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    return scores.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """Each file's row of the last batch that changed it."""
    if not exists(spark, table):
        return spark.createDataFrame([], "file string, n_chunks long, max_score double")
    rows = spark.read.parquet(table)
    return rows.groupBy("file").agg(F.max_by(F.struct("n_chunks", "max_score"), "batch").alias("x")).select("file", "x.*")
