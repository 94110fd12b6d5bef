"""Embedded chunks stored by content.

A content is embedded once for given settings, whatever files hold it and wherever these lie. Each run that meets new
contents adds a batch: a folder of chunks and one of keys, which is written last and makes the batch count. What a crashed
writer left has no keys and is passed over. Two writers at once may store a content twice; readers take one of the two.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import drop_table, stage_table
from .files import missing_files
from .store import delete, exists, list_names

KEYS = "content_key string, path string"


def content_key(lang: Column, content: Column) -> Column:
    """A digest of what a file's chunks depend on besides the settings."""
    digest = F.sha2(F.concat_ws("\x00", F.coalesce(lang, F.lit("")), F.coalesce(content, F.lit(""))), 256)
    return F.coalesce(digest, F.lit(""))  # never null; said so, since joins would work it out once more to ask


@dataclass
class ChunkCache:
    root: str
    #: Of the last call of ``embedded``: contents and chunks that had to be embedded.
    added: dict[str, int] = field(default_factory=dict)

    def folder(self, settings: dict) -> str:
        return f"{self.root}/embedded/{hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]}"

    def batches(self, spark: SparkSession, settings: dict) -> list[str]:
        """Folders of the finished batches, oldest name first."""
        folder = self.folder(settings)
        return [f"{folder}/{name}" for name in list_names(spark, folder) if exists(spark, f"{folder}/{name}/keys/_SUCCESS")]

    def _read(self, spark: SparkSession, paths: list[str], part: str, schema) -> DataFrame:
        """Rows of some batches with ``batch``, the name of the one they are in."""
        if not paths:
            return spark.createDataFrame([], schema).withColumn("batch", F.lit(""))
        rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*[f"{p}/{part}" for p in paths])
        return rows.withColumn("batch", F.element_at(F.split("_metadata.file_path", "/"), -3))

    def keys(self, spark: SparkSession, settings: dict) -> DataFrame:
        """(content_key, path, batch): one row for each stored content and batch, with a path it was first met under."""
        return self._read(spark, self.batches(spark, settings), "keys", KEYS)

    def embedded(self, files: DataFrame, settings: dict, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(file, chunk_index, tokens, embedding) of rows (file, lang, content); ``make`` embeds the contents that are not stored yet.

        ``make`` gets rows (file, lang, content) with the content's key as file. Files of equal contents share their
        chunks; a file without chunks gives no row.
        """
        spark = files.sparkSession
        keyed = files.select("file", "lang", "content", content_key(F.col("lang"), F.col("content")).alias("content_key"))
        # Digests are worked out once, and which contents are new; of the texts, each is shuffled once, to meet those.
        owned = stage_table(keyed.select("file", "content_key"), "contents")
        stored = self.keys(spark, settings)
        new = stage_table(owned.groupBy("content_key").agg(F.min("file").alias("file")).join(stored, "content_key", "left_anti"), "new")
        # a new content has one file, so both keys are distinct where the content's is, and copies do not meet in one task
        work = keyed.join(new, ["content_key", "file"], "left_semi").dropDuplicates(["content_key", "file"])
        chunks = make(work.select(F.col("content_key").alias("file"), "lang", "content")).withColumnRenamed("file", "content_key")
        contents, counts = new.count(), {}
        if contents:
            path = f"{self.folder(settings)}/{uuid.uuid4().hex}"
            seen = Observation()
            chunks.observe(seen, F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk_index") == 0).alias("chunked")).write.parquet(f"{path}/chunks")
            new.select("content_key", F.col("file").alias("path")).write.parquet(f"{path}/keys")
            counts = seen.get
        self.added = {"contents": contents, "chunks": counts.get("chunks", 0), "contents_with_chunks": counts.get("chunked", 0)}
        paths = self.batches(spark, settings)
        owner = self._read(spark, paths, "keys", KEYS).groupBy("content_key").agg(F.min("batch").alias("batch"))
        found = self._read(spark, paths, "chunks", chunks.schema)
        drop_table(spark, new)
        return owned.join(owner, "content_key").join(found, ["content_key", "batch"]).select("file", *[c for c in chunks.columns if c != "content_key"])

    def gone(self, files: DataFrame, settings: dict) -> DataFrame:
        """Paths that contents were stored under and that no file has any more."""
        return missing_files(self.keys(files.sparkSession, settings), files.select(F.col("file").alias("path")))

    def clear(self, files: DataFrame, settings: dict) -> int:
        """Drop what no file needs and what is stored twice; returns how many contents went. Not to be called while others write."""
        spark = files.sparkSession
        paths = self.batches(spark, settings)
        stored = self._read(spark, paths, "keys", KEYS)
        needed = files.select(content_key(F.col("lang"), F.col("content")).alias("content_key")).distinct()
        live = stored.join(needed, "content_key", "left_semi").groupBy("content_key").agg(F.min(F.struct("batch", "path")).alias("x")).select("content_key", "x.path", "x.batch")
        before, after = stored.count(), live.count()
        if before > after:
            path = f"{self.folder(settings)}/{uuid.uuid4().hex}"
            if after:
                schema = spark.read.parquet(f"{paths[0]}/chunks").schema
                self._read(spark, paths, "chunks", schema).join(live, ["content_key", "batch"], "left_semi").drop("batch").write.parquet(f"{path}/chunks")
                live.drop("batch").write.parquet(f"{path}/keys")
            for old in paths:
                delete(spark, old)
        return before - after
