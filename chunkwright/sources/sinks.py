"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode("overwrite").parquet(path)


def write_group_json(scores: DataFrame, path: str) -> None:
    """One folder of JSON lines for each group: a file with its scored chunks."""
    nested = scores.groupBy("grp", "file").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "probability", "clear_text"))).alias("chunks"))
    nested.write.mode("overwrite").partitionBy("grp").json(path)


def write_representations(shown: DataFrame, path: str, folders: bool = False, rows: int = 50_000) -> None:
    """(file, text) as JSON lines in files of at most ``rows`` rows; with ``folders`` as one folder for each file, holding its text, which suits some thousand files."""
    out = shown.select("text", "file").write.mode("overwrite")
    out.partitionBy("file").text(path) if folders else out.option("maxRecordsPerFile", rows).json(path)


def write_summaries(tables: dict[str, DataFrame], path: str) -> None:
    """The summary tables of a search, each as a CSV below ``path``."""
    for name, table in tables.items():
        write_csv(table, f"{path}/{name}.csv")


def write_csv(df: DataFrame, path: str) -> None:
    """A summary of a few rows as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
