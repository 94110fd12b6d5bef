"""Small files and folders in any store that Spark reaches."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    store, where = _at(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(where)) if store.exists(where) else []


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file, unless there is one: of several callers exactly one gets True."""
    store, where = _at(spark, path)
    store.mkdirs(where.getParent())
    return bool(store.createNewFile(where))


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Replace ``new`` by ``old`` in one step, where the store renames in one."""
    jvm = spark._jvm
    path, options = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Options.Rename
    flags = spark.sparkContext._gateway.new_array(options, 1)
    flags[0] = options.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(old).toUri(), spark._jsc.hadoopConfiguration())
    files.rename(path(old), path(new), flags)


def age(spark: SparkSession, path: str) -> float:
    """Seconds since a file was written, by the driver's clock."""
    store, where = _at(spark, path)
    return time.time() - store.getFileStatus(where).getModificationTime() / 1000


def delete(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced if it is there."""
    store, where = _at(spark, path)
    out = store.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """One small file; None if there is none."""
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()[0]
