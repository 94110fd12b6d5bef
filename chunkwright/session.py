"""Session construction and the shared working folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_SHARED_DIR = "/tmp/checkpoints/chunkwright"
_STAGED: list[str] = []
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def local_session(app: str = "chunkwright", cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, on one machine only, an own one where that is unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = DEFAULT_SHARED_DIR
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/chunkwright-{tag}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, tag: str, repeats: bool = True) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read rather than a recomputation of everything upstream. Where values such as
    hashes seldom repeat (``repeats``), Parquet need not look for them in a dictionary.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, tag)
    df.write.option("parquet.enable.dictionary", str(repeats).lower()).parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Suggest a collection to the driver: Spark deletes the shuffle files of finished plans that nothing refers to any more."""
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, in rows and bytes, where the session leaves Spark's default: whole texts are long rows.

    A batch lies in the executor's and in the Python worker's memory at once. The setting holds for the session,
    since plans read it when they run.
    """
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "512")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def _delete(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def drop_table(spark: SparkSession, staged: DataFrame) -> None:
    """Delete one staged table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        _delete(spark, folder)


def staged_tables() -> list[str]:
    """Folders of the tables staged and not yet dropped, oldest first."""
    return list(_STAGED)


def drop_staged(spark: SparkSession, *keep: str) -> int:
    """Delete the tables staged so far but for ``keep``, once nothing built on them is needed; returns how many there were."""
    n = 0
    for path in [p for p in _STAGED if p not in keep]:
        _STAGED.remove(path)
        n += _delete(spark, path)
    return n
