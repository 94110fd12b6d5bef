"""Label flags, label lookup, evaluation groups and the reproducible split."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DISCARDED, POSITIVE, UNRELATED
from .substring import first_containing

FLAGS = ("training", "evaluation", "crypto", "discarded", "non_crypto")


# The folders that mark a file.
MARKS = {
    "training": ("training",),
    "evaluation": ("evaluation",),
    "crypto": ("training/crypto", "evaluation/novel_crypto"),
    "discarded": ("discarded_dataset",),
    "non_crypto": ("non_crypto_dataset",),
}


def label_flags(path: Column) -> list[Column]:
    """Five flags, each true if the path contains one of its folders."""
    return [reduce(or_, [path.contains(m) for m in marks]).alias(flag) for flag, marks in MARKS.items()]


def lookup_labels(files: DataFrame, inventory: DataFrame, key: str = "file_key") -> DataFrame:
    """Flags of each file by equality of the key; of several inventory rows the first by path; all false if none."""
    first = inventory.groupBy(key).agg(*[F.min_by(f, "path").alias(f) for f in FLAGS])
    return files.join(first, key, "left").select(files["*"], *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS])


def lookup_labels_by_substring(files: DataFrame, inventory: DataFrame, q: int = 4) -> DataFrame:
    """``files`` with the flags of the first inventory row, by ``ord``, whose path contains the file's key; all false if none.

    Distinct keys are looked up through an inverted index of the paths' q-grams, so no pair without a common gram is tested.
    ``ord`` tells the inventory's rows apart.
    """
    found = first_containing(files, inventory, q)
    flagged = found.join(inventory.select("ord", *FLAGS), "ord").drop("ord")
    return files.join(flagged, "file_key", "left").select(files["*"], *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS])


def is_training_positive() -> Column:
    return F.col("training") & F.col("crypto")


def is_training_negative() -> Column:
    return F.col("training") & (F.col("non_crypto") | F.col("discarded")) & ~is_training_positive()


def evaluation_group() -> Column:
    """First match wins: positive, unrelated, discarded; null outside evaluation."""
    return F.when(F.col("evaluation"), F.when(F.col("crypto"), POSITIVE).when(F.col("non_crypto"), UNRELATED).when(F.col("discarded"), DISCARDED))


# The folders of an evaluated code base, and the group that each stands for.
CODE_BASE_GROUPS = {
    "data/evaluation/novel_crypto": POSITIVE,
    "data/evaluation/non_crypto/non_crypto_dataset": UNRELATED,
    "data/evaluation/non_crypto/discarded_dataset": DISCARDED,
}


def code_base_groups(path: Column) -> Column:
    """All groups whose folder the path contains: each is looked for by itself, so a file may have several or none."""
    return F.filter(F.array(*[F.when(path.contains(folder), group) for folder, group in CODE_BASE_GROUPS.items()]), lambda g: g.isNotNull())


def group_from_labels() -> Column:
    """The group of a labelled document: toxic, else by quality."""
    return F.when(F.col("toxic") == 1, POSITIVE).when(F.col("quality") == 1, UNRELATED).when(F.col("quality") == 0, DISCARDED)


def seeded_order(seed: int, *keys: str) -> Column:
    """A reproducible shuffle key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def exact_split(files: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """``files`` with ``split``: exactly min(n, size) of each stratum are ``evaluation``, the rest ``training``.

    The cut is found from a bounded top-n of each stratum, taken over salted parts first, so no stratum is
    ranked whole in one task.
    """
    keyed = files.select(stratum, key, seeded_order(seed, key).alias("__k"), F.pmod(F.xxhash64(key), F.lit(64)).alias("__salt"))
    part = Window.partitionBy(stratum, "__salt").orderBy("__k", key)
    few = keyed.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= n).drop("__r")
    chosen = few.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy("__k", key))).where(F.col("__r") <= n)
    chosen = chosen.select(key, F.lit("evaluation").alias("split"))
    return files.join(chosen, key, "left").withColumn("split", F.coalesce("split", F.lit("training")))
