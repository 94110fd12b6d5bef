"""Grids of runs, resuming, flattening, ranking and phase choices."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .evaluate import ratio


def _values(spark: SparkSession, name: str, kind: str, values: list) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def product(sides: list[DataFrame]) -> DataFrame:
    """Every combination of the values of some short tables, as a grid of settings has few."""
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), sides)


def forest_grid(spark: SparkSession) -> DataFrame:
    """27 settings: trees x depth (0: unbounded) x leaf size."""
    n, d, m = _values(spark, "n_estimators", "int", [100, 300, 500]), _values(spark, "max_depth", "int", [10, 20, 0]), _values(spark, "min_samples_leaf", "int", [1, 2, 5])
    return product([n, d, m])


def linear_grid(spark: SparkSession) -> DataFrame:
    """48 settings: learning rate x batch size x epochs."""
    r, b, e = _values(spark, "learning_rate", "double", [0.0001, 0.0005, 0.001, 0.005]), _values(spark, "batch_size", "int", [16, 32, 64]), _values(spark, "epochs", "int", [50, 100, 200, 500])
    return product([r, b, e])


def still_to_run(grid: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Grid rows without a run that left both artefacts."""
    whole = done.where("has_config AND has_evaluation")
    return grid.join(whole, list(keys), "left_anti")


def with_metrics(runs: DataFrame) -> DataFrame:
    """precision, recall, f1 and accuracy from tp, fn, fp, tn; 0 for failed runs."""
    ok = F.col("status") == "success"
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    out = runs.withColumn("val_precision", F.when(ok, ratio(tp, tp + fp)).otherwise(0.0)).withColumn("val_recall", F.when(ok, ratio(tp, tp + fn)).otherwise(0.0))
    p, r = F.col("val_precision"), F.col("val_recall")
    return out.withColumn("val_f1", ratio(2 * p * r, p + r)).withColumn("val_accuracy", F.when(ok, ratio(tp + tn, tp + tn + fp + fn)).otherwise(0.0))


def rounded(value: Column) -> Column:
    return F.round(value, 4)


def ranking(runs: DataFrame) -> DataFrame:
    """``rank`` (text) of every run with metrics: by F1 as shown with 4 decimals, then by experiment_id; failed runs last as N/A.

    The F1 of a few thousand experiments at most: one ordered window.
    """
    ok = runs.where("status = 'success'").withColumn("rank", F.row_number().over(Window.orderBy(F.desc(rounded(F.col("val_f1"))), "experiment_id")).cast("string"))
    return ok.unionByName(runs.where("status <> 'success'").withColumn("rank", F.lit("N/A")))


def best_per_classifier(runs: DataFrame) -> DataFrame:
    """The best run of each classifier, ranked among themselves."""
    ok = runs.where("status = 'success'")
    best = ok.groupBy("classifier_type").agg(F.max_by(F.struct(*[c for c in ok.columns if c != "classifier_type"]), F.struct(rounded(F.col("val_f1")), -F.col("experiment_id"))).alias("r")).select("classifier_type", "r.*")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(rounded(F.col("val_f1"))), "experiment_id")))


def mean_f1(runs: DataFrame, key: str) -> DataFrame:
    """Mean F1 of the successful runs by ``key``, with the first run's number for ties."""
    return runs.where("status = 'success'").groupBy(key).agg(F.avg("val_f1").alias("mean_f1"), F.min("experiment_id").alias("first"))


def choose(means: DataFrame, key: str, default) -> DataFrame:
    """The key of the greatest mean, the earliest of ties, or the default if there is none."""
    return means.agg(F.coalesce(F.max_by(key, F.struct("mean_f1", -F.col("first"))), F.lit(default)).alias(key))


def parameter_text(row: DataFrame, prefix: str = "param_") -> Column:
    """name=value of all ``prefix`` columns, comma-joined; nulls are empty."""
    names = [c for c in row.columns if c.startswith(prefix)]
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c.replace(prefix, '')}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in names])


def flatten_parameters(runs: DataFrame, names: list[str]) -> DataFrame:
    """``hyperparameters`` map to param_<name> columns."""
    return runs.select(*[c for c in runs.columns if c != "hyperparameters"], *[F.try_element_at("hyperparameters", F.lit(n)).alias(f"param_{n}") for n in names])


def export_columns(runs: DataFrame) -> DataFrame:
    """The summary table as text: rates with four decimals, seconds with two."""
    rates = {c: F.format_string("%.4f", F.col(c)) for c in ("val_precision", "val_recall", "val_f1", "val_accuracy") if c in runs.columns}
    return runs.withColumns(rates | {"runtime_sec": F.format_string("%.2f", F.col("runtime_sec"))})


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """Rows of runs of different kinds under one header: all columns in order of first appearance, nulls where a kind has none."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def last_written(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the one written last; of several written at once the greatest by its other columns, in their order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(F.col(order).alias("__at"), *rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def summaries(runs: DataFrame) -> dict[str, DataFrame]:
    """The three summary tables: metrics of every run, the ranking with its parameters as text, the best of each classifier."""
    detailed = runs.withColumn("param_details", parameter_text(runs))
    return {"metrics": export_columns(runs), "ranking": export_columns(ranking(detailed)), "best_models": export_columns(best_per_classifier(detailed))}


def execute(settings: list[dict], run: Callable[[dict], dict]) -> list[dict]:
    """Run each setting; a failure is a row with status ``failed`` and its trace, and the rest go on."""
    rows = []
    for i, setting in enumerate(settings, 1):
        began, row = time.monotonic(), {"experiment_id": i, **setting}
        try:
            row |= {"status": "success", **run(setting)}
        except Exception:
            row |= {"status": "failed", "error": traceback.format_exc()}
        rows.append(row | {"runtime_sec": time.monotonic() - began})
    return rows
