"""File scores, threshold sweeps and operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DISCARDED, POSITIVE, UNRELATED

#: The sweep's grid: k / 1000 for k in [FIRST, LAST].
FIRST, LAST = 5, 999
COUNTS = ("tp", "fn", "unrelated_tn", "unrelated_fp", "discarded_tn", "discarded_fp")


def file_max_score(scores: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file, grp, max_score): the greatest chunk probability, NaN left out, 0 without any.

    With ``files`` (file, grp), files without a chunk get a row too.
    """
    usable = F.when(~F.isnan("probability"), F.col("probability"))
    best = scores.groupBy("file", "grp").agg(F.greatest(F.coalesce(F.max(usable), F.lit(0.0)), F.lit(0.0)).alias("max_score"))
    if files is None:
        return best
    return files.select("file", "grp").join(best, ["file", "grp"], "left").select("file", "grp", F.coalesce("max_score", F.lit(0.0)).alias("max_score"))


def greatest_score(scores: Column) -> Column:
    """``file_max_score`` of one file's chunk scores in an array."""
    return F.greatest(F.coalesce(F.array_max(F.filter(scores, lambda x: ~F.isnan(x))), F.lit(0.0)), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def add_rates(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of rows of the six counts; 0 where undefined."""
    fp = F.col("unrelated_fp") + F.col("discarded_fp")
    out = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + fp)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _count(score: Column, threshold: Column) -> list[Column]:
    hit = score >= threshold
    is_ = lambda g: F.col("grp") == g
    return [
        F.count_if(is_(POSITIVE) & hit).alias("tp"),
        F.count_if(is_(POSITIVE) & ~hit).alias("fn"),
        F.count_if(is_(UNRELATED) & ~hit).alias("unrelated_tn"),
        F.count_if(is_(UNRELATED) & hit).alias("unrelated_fp"),
        F.count_if(is_(DISCARDED) & ~hit).alias("discarded_tn"),
        F.count_if(is_(DISCARDED) & hit).alias("discarded_fp"),
    ]


def metrics_at(file_scores: DataFrame, threshold: float) -> DataFrame:
    """Counts and rates at one threshold, inclusive: one row."""
    return add_rates(file_scores.agg(*_count(F.col("max_score"), F.lit(threshold)))).withColumn("threshold", F.lit(threshold))


def grid(spark: SparkSession) -> DataFrame:
    return spark.range(FIRST, LAST + 1).select(F.col("id").alias("k"), (F.col("id") / F.lit(1000.0)).alias("threshold"))


def sweep_by_grid(file_scores: DataFrame) -> DataFrame:
    """The plain sweep: the fixed 995-row grid is broadcast to the scores. The bucketed sweep does the same work once per score."""
    pairs = file_scores.join(F.broadcast(grid(file_scores.sparkSession)), F.lit(True))
    return add_rates(pairs.groupBy("threshold").agg(*_count(F.col("max_score"), F.col("threshold"))))


def grid_bucket(score: Column, first: int, last: int) -> Column:
    """The greatest k with k / 1000 <= score, within bounds."""
    guess = F.floor(score * 1000)
    exact = F.when((guess + 1) / F.lit(1000.0) <= score, guess + 1).when(guess / F.lit(1000.0) > score, guess - 1).otherwise(guess)
    return F.greatest(F.lit(first), F.least(F.lit(last), exact)).cast("long")


def threshold_sweep(file_scores: DataFrame) -> DataFrame:
    """Counts and rates at every grid threshold from one aggregate of the scores.

    A score falls to the greatest k with k / 1000 <= score; suffix sums over at most 996 rows give the hits.
    """
    bucket = grid_bucket(F.col("max_score"), FIRST - 1, LAST)
    groups = {"p": POSITIVE, "u": UNRELATED, "d": DISCARDED}
    by = file_scores.groupBy(bucket.alias("k")).agg(*[F.count_if(F.col("grp") == g).alias(c) for c, g in groups.items()])
    line = file_scores.sparkSession.range(FIRST - 1, LAST + 1).select(F.col("id").alias("k")).join(by, "k", "left").na.fill(0)
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = line.select("k", *[F.sum(c).over(above).alias(f"{c}_hit") for c in groups], *[F.sum(c).over(whole).alias(f"{c}_all") for c in groups])
    counts = sums.where(F.col("k") >= FIRST).select(
        (F.col("k") / F.lit(1000.0)).alias("threshold"),
        F.col("p_hit").alias("tp"),
        (F.col("p_all") - F.col("p_hit")).alias("fn"),
        (F.col("u_all") - F.col("u_hit")).alias("unrelated_tn"),
        F.col("u_hit").alias("unrelated_fp"),
        (F.col("d_all") - F.col("d_hit")).alias("discarded_tn"),
        F.col("d_hit").alias("discarded_fp"),
    )
    return add_rates(counts)


_POINT = ("threshold", *COUNTS, "f1")


def _point(sweep: DataFrame, *order: Column) -> DataFrame:
    return sweep.agg(F.max_by(F.struct(*_POINT), F.struct(*order)).alias("p")).select("p.*")


def best_f1_point(sweep: DataFrame) -> DataFrame:
    """Greatest F1, then lowest threshold."""
    return _point(sweep, F.col("f1"), -F.col("threshold"))


def min_fn_point(sweep: DataFrame) -> DataFrame:
    """Fewest misses, then greatest F1, then lowest threshold."""
    return _point(sweep, -F.col("fn"), F.col("f1"), -F.col("threshold"))


def min_fp_point(sweep: DataFrame) -> DataFrame:
    """Fewest false alarms, then greatest F1, then lowest threshold."""
    return _point(sweep, -(F.col("unrelated_fp") + F.col("discarded_fp")), F.col("f1"), -F.col("threshold"))


def operating_points(sweep: DataFrame) -> DataFrame:
    """The three points, from one pass over the sweep."""
    t, f1, fp = F.col("threshold"), F.col("f1"), F.col("unrelated_fp") + F.col("discarded_fp")
    orders = {"best_f1": F.struct(f1, -t), "min_fn": F.struct(-F.col("fn"), f1, -t), "min_fp": F.struct(-fp, f1, -t)}
    row = sweep.agg(*[F.max_by(F.struct(*_POINT), o).alias(name) for name, o in orders.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("point"), F.col(name).alias("p")) for name in orders])).alias("x")).select("x.point", "x.p.*")


def decisions(file_scores: DataFrame, threshold: float) -> DataFrame:
    """Each file's predicted and actual class and whether they agree."""
    predicted, actual = F.col("max_score") >= threshold, F.col("grp") == POSITIVE
    return file_scores.select("file", "grp", "max_score", predicted.alias("predicted"), actual.alias("actual"), (predicted == actual).alias("correct"))
