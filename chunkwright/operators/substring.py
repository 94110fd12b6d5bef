"""Substring lookup through an inverted index of q-grams.

Every path lists its distinct q-grams (postings). A key that is contained in a path has all its q-grams there, so it is enough
to look where its rarest one is listed, and to test the key itself there. No pair is looked at that shares no gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def grams(text: Column, q: Column | int) -> Column:
    """Distinct substrings of ``q`` characters; none of shorter texts."""
    q = F.lit(q) if isinstance(q, int) else q
    n = F.char_length(text) - q + 1
    return F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, q))).otherwise(F.array().cast("array<string>")))


def first_containing(keys: DataFrame, inventory: DataFrame, q: int = 4) -> DataFrame:
    """(file_key, ord): each distinct key with the least ``ord`` of the (ord, path) rows whose path contains it; keys without one are left out.

    Keys of fewer than ``q`` characters are grams themselves, so the index holds grams of their lengths too, where there are
    such keys. A key that is its own gram needs no test: the gram's first path is the answer, and is known from the
    index alone. The longer keys go to the paths of their rarest gram, dealt by (gram, salt), so that a gram listed by very
    many paths or asked for by very many keys is met in several tasks. Null keys are contained in nothing, the
    empty one in every path.
    """
    wanted = keys.select("file_key").where("file_key IS NOT NULL").distinct()
    paths = inventory.select("ord", "path").where("path IS NOT NULL")
    lengths = sorted(r[0] for r in wanted.select(F.least(F.char_length("file_key"), F.lit(q)).alias("n")).distinct().collect())  # q + 1 numbers at most
    if not lengths:
        return wanted.select("file_key", F.lit(None).cast(inventory.schema["ord"].dataType).alias("ord")).limit(0)
    listed = F.flatten(F.array(*[grams(F.col("path"), n) for n in lengths if n])) if any(lengths) else F.array().cast("array<string>")
    postings = paths.select("ord", "path", F.explode(F.array_distinct(listed)).alias("gram"))
    index = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    whole = wanted.where((F.char_length("file_key") <= q) & (F.col("file_key") != ""))
    found = whole.join(index.withColumnRenamed("gram", "file_key"), "file_key").select("file_key", F.col("first").alias("ord"))
    if 0 in lengths:
        found = found.unionByName(paths.agg(F.min("ord").alias("ord")).where("ord IS NOT NULL").select(F.lit("").alias("file_key"), "ord"))
    if lengths[-1] < q:
        return found
    # A gram that no path lists, counted as 0, is the rarest there can be, and its keys meet nothing.
    long = wanted.where(F.char_length("file_key") > q).select("file_key", F.explode(grams(F.col("file_key"), q)).alias("gram"))
    rarest = long.join(index, "gram", "left").groupBy("file_key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    asked = rarest.select("file_key", F.col("r.gram").alias("gram"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    useful = postings.join(rarest.select(F.col("r.gram").alias("gram")).distinct(), "gram", "left_semi")
    met = useful.withColumn("salt", F.pmod(F.xxhash64("ord"), F.lit(SALTS)).cast("int")).join(asked, ["gram", "salt"]).where(F.col("path").contains(F.col("file_key")))
    return found.unionByName(met.groupBy("file_key").agg(F.min("ord").alias("ord")))
