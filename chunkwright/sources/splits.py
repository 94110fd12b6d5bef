"""Versioned splits of a source tree into training and evaluation files.

Files are not moved. A split is a snapshot, a table below the root, and a small pointer file that names the current
snapshot and the one before. The pointer is replaced by one atomic rename once the snapshot is whole, so a writer that is
killed leaves the old split readable.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DISCARDED, POSITIVE, UNRELATED
from ..functions.ranks import block_ranks
from ..operators.labels import seeded_order
from .store import read_text, rename, write_text

# By stratum, the folder of its files and the folder that its evaluation files stand for.
FOLDERS = {
    POSITIVE: ("training/crypto", "evaluation/novel_crypto"),
    UNRELATED: ("training/non_crypto/non_crypto_dataset", "evaluation/non_crypto/non_crypto_dataset"),
    DISCARDED: ("training/non_crypto/discarded_dataset", "evaluation/non_crypto/discarded_dataset"),
}
SCHEMA = "path string, stratum string, split string"


def stratum(path: Column) -> Column:
    """The stratum of a path relative to the data folder; null outside the three folders."""
    chosen = F.lit(None).cast("string")
    for name, (folder, _) in FOLDERS.items():
        chosen = F.when(path.startswith(f"{folder}/"), name).otherwise(chosen)
    return chosen


def place(path: Column, of: Column, split: Column) -> Column:
    """Where a file stands under the split: evaluation files in their evaluation folder, with the rest of their path kept."""
    moved = path
    for name, (folder, to) in FOLDERS.items():
        moved = F.when((split == "evaluation") & (of == name), F.concat(F.lit(to), F.substring(path, F.lit(len(folder) + 1), F.char_length(path)))).otherwise(moved)
    return moved


def assign(files: DataFrame, before: DataFrame, n: int, seed: int) -> DataFrame:
    """(path, stratum, split) of files (path, stratum): those of ``before`` stay where they were, new ones fill each stratum up to ``n`` evaluation files, in seeded order.

    Files that are gone leave their place to new ones. Repeated paths count once.
    """
    known = files.where("path IS NOT NULL AND stratum IS NOT NULL").dropDuplicates(["path"])
    kept = known.join(before.select("path", "split"), "path")
    new = known.join(before, "path", "left_anti").withColumn("__order", F.concat(seeded_order(seed, "path"), "path"))
    held = kept.groupBy("stratum").agg(F.count_if(F.col("split") == "evaluation").alias("held"))
    ranked = block_ranks(new, "__order", "stratum", rank="__rank", size="__size").join(F.broadcast(held), "stratum", "left")  # one row for each stratum
    chosen = F.when(F.col("__rank") < n - F.coalesce("held", F.lit(0)), "evaluation").otherwise("training")
    return kept.select("path", "stratum", "split").unionByName(ranked.select("path", "stratum", chosen.alias("split")))


@dataclass(frozen=True)
class Splits:
    root: str

    def _pointer(self, spark: SparkSession) -> dict:
        text = read_text(spark, f"{self.root}/CURRENT")
        return json.loads(text) if text else {"snapshot": None, "before": []}

    def _point(self, spark: SparkSession, pointer: dict) -> None:
        new = f"{self.root}/CURRENT.{uuid.uuid4().hex}"
        write_text(spark, new, json.dumps(pointer))
        rename(spark, new, f"{self.root}/CURRENT")

    def read(self, spark: SparkSession) -> DataFrame:
        """The current split; empty before the first and after the last reset."""
        name = self._pointer(spark)["snapshot"]
        return spark.read.schema(SCHEMA).parquet(f"{self.root}/{name}") if name else spark.createDataFrame([], SCHEMA)

    def prepare(self, files: DataFrame, n: int, seed: int) -> DataFrame:
        """Make the split of files (path, stratum) current and return it."""
        spark = files.sparkSession
        pointer, name = self._pointer(spark), f"snapshot-{uuid.uuid4().hex}"
        assign(files, self.read(spark), n, seed).write.parquet(f"{self.root}/{name}")
        self._point(spark, {"snapshot": name, "before": [*pointer["before"], pointer["snapshot"]]})
        return self.read(spark)

    def reset(self, spark: SparkSession) -> DataFrame:
        """Make the split before the current one current again and return it; without one, all files are training files and the split is empty."""
        pointer = self._pointer(spark)
        *before, last = pointer["before"] or [None]
        self._point(spark, {"snapshot": last, "before": before})
        return self.read(spark)
