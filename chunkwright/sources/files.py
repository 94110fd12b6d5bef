"""Readers of source trees, cached artefacts and run folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``: path only, so no content is read. A missing folder lists nothing."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "path string")
        raise


def read_sources(spark: SparkSession, root: str, strict: bool = False, drop_bad: bool = False) -> DataFrame:
    """(path, lang, content) of the recognised source files below ``root``.

    Only suffixes of known languages are opened. Bad bytes become U+FFFD; ``strict`` raises instead,
    ``drop_bad`` drops them and them alone: a U+FFFD that stands in a file stays.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{c,h,cpp,hpp,hh,cc}").load(root)
    content = F.decode("content", F.lit("UTF-8")) if strict else F.col("content").cast("string")
    if drop_bad:
        # Genuine ones step aside while the bad bytes' replacements go; the mark is doubled where it stands for itself.
        hidden = F.replace(F.replace(content, F.lit("\x01"), F.lit("\x01a")), F.lit("\uFFFD"), F.lit("\x01b"))
        bare = F.replace(F.make_valid_utf8(hidden), F.lit("\uFFFD"), F.lit(""))
        content = F.replace(F.replace(bare, F.lit("\x01b"), F.lit("\uFFFD")), F.lit("\x01a"), F.lit("\x01"))
    return raw.select("path", language(F.col("path")).alias("lang"), content.alias("content")).where("lang IS NOT NULL")


def missing_files(cached: DataFrame, present: DataFrame) -> DataFrame:
    """Cached paths that are gone; must be empty before a cache is used."""
    return cached.select("path").distinct().join(present.select("path"), "path", "left_anti")


def read_reports(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """(path, payload) of the HTML reports below ``root``; payloads that cannot be read are null."""
    pages = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    found = F.regexp_extract("value", r'"(?:dashboard-payload|payload-data)"[^>]*>([A-Za-z0-9+/=\s]+)<', 1)
    data = F.nullif(F.regexp_replace(found, r"\s", ""), F.lit(""))
    return pages.select("path", F.from_json(F.unbase64(data).cast("string"), schema).alias("payload"))


STATS_SCHEMA = "stats STRUCT<best_f1_threshold: DOUBLE, best_f1_metrics: STRUCT<novel_crypto_tp: BIGINT, novel_crypto_fn: BIGINT, non_crypto_unrelated_fp: BIGINT, non_crypto_discarded_fp: BIGINT>>"
# Fixed value: the folders of runs that the scan of old reports takes.
RUN_FOLDER = r"^text_random_forest_classifier_evaluation_([0-9]+)$"


def scan_reports(spark: SparkSession, root: str) -> DataFrame:
    """(folder, threshold, f1) of the reports in run folders below ``root``, least F1 first; others are passed over.

    Absent figures count as 0, as does F1 where it is undefined.
    """
    pages = read_reports(spark, root, STATS_SCHEMA).where("payload IS NOT NULL")
    pages = pages.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("page"), "payload.stats")
    runs = pages.where(F.col("folder").rlike(RUN_FOLDER) & (F.col("page") == "evaluation_report.html"))
    count = lambda c: F.coalesce(F.col(f"stats.best_f1_metrics.{c}"), F.lit(0))
    tp, fn, fp = count("novel_crypto_tp"), count("novel_crypto_fn"), count("non_crypto_unrelated_fp") + count("non_crypto_discarded_fp")
    f1 = F.coalesce(F.try_divide((2 * tp).cast("double"), 2 * tp + fp + fn), F.lit(0.0))
    return runs.select("folder", F.col("stats.best_f1_threshold").alias("threshold"), f1.alias("f1")).orderBy("f1", "folder")


def read_json_artefacts(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """One row for each file ``name`` below ``root`` that parses under ``schema``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root).withColumn("path", F.col("_metadata.file_path")).where("_corrupt IS NULL").drop("_corrupt")
