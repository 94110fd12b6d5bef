"""Queries over runs: every slice of the documents by source and language is evaluated by itself, and its row is a run.

The source stands for a run's model and the language for its classifier; a slice without any positive file is a failed run.
The summaries read what these evaluations give, so their work grows with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import POSITIVE
from ..functions import text as X
from ..operators import experiments
from ..sources.tables import table
from .queries import SCORES, file_scores_of, query

THRESHOLD = 0.8
OVERLAPS = (0.25, 0.125, 0.5, 0.0)


def runs_of(spark: SparkSession, base: str) -> DataFrame:
    """One row for each source and language, with its counts at the threshold and the rates of these."""
    docs = table(spark, base, "documents").select(F.col("doc_id").cast("string").alias("file"), "source", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    scored = docs.join(file_scores_of(spark, base), "file")
    hit, positive = F.col("max_score") >= THRESHOLD, F.col("grp") == POSITIVE
    counts = [F.count_if(c).alias(name) for name, c in (("tp", positive & hit), ("fn", positive & ~hit), ("fp", ~positive & hit), ("tn", ~positive & ~hit))]
    slices = scored.groupBy("source", "lang").agg(*counts, (F.sum("n_chars") / F.lit(100.0)).alias("runtime_sec"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", "source", "lang")), 1, 8), 16, 10).cast("long")
    status = F.when(F.col("tp") + F.col("fn") > 0, "success").otherwise("failed")
    named = slices.select(
        number.alias("experiment_id"),
        F.concat(F.lit("docs/"), "source", F.lit("-v1.5")).alias("embedding_model"),
        F.element_at(F.array(*map(F.lit, OVERLAPS)), (number % 4 + 1).cast("int")).alias("overlap_proportion"),
        F.col("lang").alias("classifier_type"),
        *[F.when(status == "success", F.col(c)).alias(c) for c in ("tp", "fn", "fp", "tn")],
        "runtime_sec",
        status.alias("status"),
    )
    return experiments.with_metrics(named)


RUNS = f"""{SCORES}, scored AS (SELECT source, coalesce(lang, 'none') AS lang, coalesce(n_chars, 0) AS n_chars, grp = 'novel_crypto' AS pos, max_score >= {THRESHOLD} AS hit
  FROM file_scores JOIN documents ON file = CAST(documents.doc_id AS VARCHAR)),
slices AS (SELECT source, lang, count(*) FILTER (pos AND hit) AS tp, count(*) FILTER (pos AND NOT hit) AS fn, count(*) FILTER (NOT pos AND hit) AS fp, count(*) FILTER (NOT pos AND NOT hit) AS tn,
  sum(n_chars)::DOUBLE / 100.0::DOUBLE AS runtime_sec, CAST('0x' || left(md5(source || '|' || lang), 8) AS BIGINT) AS number FROM scored GROUP BY source, lang),
runs0 AS (SELECT number AS experiment_id, 'docs/' || source || '-v1.5' AS embedding_model, ([0.25, 0.125, 0.5, 0.0])[number % 4 + 1]::DOUBLE AS overlap_proportion, lang AS classifier_type,
  CASE WHEN tp + fn > 0 THEN tp END AS tp, CASE WHEN tp + fn > 0 THEN fn END AS fn, CASE WHEN tp + fn > 0 THEN fp END AS fp, CASE WHEN tp + fn > 0 THEN tn END AS tn,
  runtime_sec, CASE WHEN tp + fn > 0 THEN 'success' ELSE 'failed' END AS status FROM slices),
runs1 AS (SELECT *, CASE WHEN status = 'success' AND tp + fp > 0 THEN tp::DOUBLE / (tp + fp)::DOUBLE ELSE 0.0::DOUBLE END AS val_precision,
  CASE WHEN status = 'success' AND tp + fn > 0 THEN tp::DOUBLE / (tp + fn)::DOUBLE ELSE 0.0::DOUBLE END AS val_recall,
  CASE WHEN status = 'success' THEN (tp + tn)::DOUBLE / (tp + tn + fp + fn)::DOUBLE ELSE 0.0::DOUBLE END AS val_accuracy FROM runs0),
runs AS (SELECT *, CASE WHEN val_precision + val_recall > 0 THEN 2 * val_precision * val_recall / (val_precision + val_recall) ELSE 0.0::DOUBLE END AS val_f1 FROM runs1)"""
RANKED = "ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY round(val_f1, 4) DESC, experiment_id) AS VARCHAR) AS rank FROM runs WHERE status = 'success')"


def shown(value: Column) -> Column:
    return F.round(value, 6)


@query(f"WITH {RUNS} SELECT experiment_id, round(val_precision, 6) AS val_precision, round(val_recall, 6) AS val_recall, round(val_f1, 6) AS val_f1, round(val_accuracy, 6) AS val_accuracy, status FROM runs")
def run_metrics(spark, base):
    return runs_of(spark, base).select("experiment_id", *[shown(F.col(c)).alias(c) for c in ("val_precision", "val_recall", "val_f1", "val_accuracy")], "status")


@query(f"WITH {RUNS} SELECT experiment_id, printf('%.4f', round(val_precision, 4)) AS val_precision, printf('%.4f', round(val_recall, 4)) AS val_recall, printf('%.4f', round(val_f1, 4)) AS val_f1, printf('%.4f', round(val_accuracy, 4)) AS val_accuracy, printf('%.2f', round(runtime_sec, 2)) AS runtime_sec FROM runs")
def run_export(spark, base):
    return experiments.export_columns(runs_of(spark, base)).select("experiment_id", "val_precision", "val_recall", "val_f1", "val_accuracy", "runtime_sec")


@query(f"WITH {RUNS} SELECT embedding_model, round(avg(val_f1), 6) AS mean_f1 FROM runs WHERE status = 'success' GROUP BY embedding_model")
def run_mean_by_model(spark, base):
    return experiments.mean_f1(runs_of(spark, base), "embedding_model").select("embedding_model", shown(F.col("mean_f1")).alias("mean_f1"))


@query(f"WITH {RUNS} SELECT overlap_proportion, round(avg(val_f1), 6) AS mean_f1 FROM runs WHERE status = 'success' GROUP BY overlap_proportion")
def run_mean_by_overlap(spark, base):
    return experiments.mean_f1(runs_of(spark, base), "overlap_proportion").select("overlap_proportion", shown(F.col("mean_f1")).alias("mean_f1"))


def _best(key: str, default: str) -> str:
    return f"(SELECT {key} FROM (SELECT {key}, round(avg(val_f1), 9) AS m, min(experiment_id) AS i FROM runs WHERE status = 'success' GROUP BY {key}) ORDER BY m DESC, i LIMIT 1), {default}"


@query(f"WITH {RUNS} SELECT coalesce({_best('embedding_model', repr('none'))}) AS embedding_model, coalesce({_best('overlap_proportion', '0.25::DOUBLE')}) AS overlap_proportion")
def run_choice(spark, base):
    """The model and the overlap of the greatest mean F1, as a phased search takes them on."""
    runs = runs_of(spark, base)
    mean = lambda key: experiments.mean_f1(runs, key).withColumn("mean_f1", F.round("mean_f1", 9))
    return experiments.choose(mean("embedding_model"), "embedding_model", "none").join(experiments.choose(mean("overlap_proportion"), "overlap_proportion", 0.25), F.lit(True))  # one row each


@query(f"WITH {RUNS}, {RANKED} SELECT rank, experiment_id, round(val_f1, 4) AS val_f1, status FROM ranked UNION ALL SELECT 'N/A', experiment_id, 0.0, status FROM runs WHERE status <> 'success'")
def run_ranking(spark, base):
    return experiments.ranking(runs_of(spark, base)).select("rank", "experiment_id", F.round("val_f1", 4).alias("val_f1"), "status")


@query(f"""WITH {RUNS}, best AS (SELECT *, row_number() OVER (PARTITION BY classifier_type ORDER BY round(val_f1, 4) DESC, experiment_id) AS r FROM runs WHERE status = 'success')
SELECT row_number() OVER (ORDER BY round(val_f1, 4) DESC, experiment_id) AS rank, classifier_type, experiment_id FROM best WHERE r = 1""")
def run_best_per_classifier(spark, base):
    return experiments.best_per_classifier(runs_of(spark, base)).select(F.col("rank").cast("long").alias("rank"), "classifier_type", "experiment_id")


@query(f"WITH {RUNS} SELECT experiment_id FROM runs WHERE status = 'success' ORDER BY round(val_f1, 9), experiment_id LIMIT 1")
def run_least(spark, base):
    ok = runs_of(spark, base).where("status = 'success'")
    return ok.agg(F.min_by("experiment_id", F.struct(F.round("val_f1", 9), "experiment_id")).alias("experiment_id")).where("experiment_id IS NOT NULL")


@query(f"WITH {RUNS}, {RANKED} SELECT rank, experiment_id FROM ranked ORDER BY CAST(rank AS INTEGER) LIMIT 5")
def run_top5(spark, base):
    ranked = experiments.ranking(runs_of(spark, base)).where("status = 'success'")
    return ranked.orderBy(F.col("rank").cast("int")).limit(5).select("rank", "experiment_id")


@query(f"WITH {RUNS} SELECT count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status <> 'success') AS failed FROM runs")
def run_totals(spark, base):
    return runs_of(spark, base).agg(F.count_if(F.col("status") == "success").alias("ok"), F.count_if(F.col("status") != "success").alias("failed"))


@query(f"""WITH {RUNS} SELECT experiment_id, replace(replace(list_extract(string_split(embedding_model, '/'), -1), '-', '_'), '.', '_') AS model_tag,
  CASE WHEN overlap_proportion > 0 THEN 'overlap_1_' || CAST(floor(1 / overlap_proportion) AS BIGINT) ELSE 'overlap_none' END AS overlap_tag, CAST(trunc(512 * overlap_proportion) AS INTEGER) AS overlap FROM runs""")
def run_tags(spark, base):
    size = F.lit(512)
    return runs_of(spark, base).select("experiment_id", X.model_tag(F.col("embedding_model")).alias("model_tag"), X.overlap_tag(F.col("overlap_proportion")).alias("overlap_tag"), (size * F.col("overlap_proportion")).cast("int").alias("overlap"))


_GRID = f"""grid AS (SELECT embedding_model, classifier_type, threshold FROM (SELECT DISTINCT embedding_model FROM runs), (SELECT DISTINCT classifier_type FROM runs), (VALUES ({THRESHOLD}::DOUBLE), (0.9::DOUBLE)) t(threshold)),
done AS (SELECT embedding_model, classifier_type, {THRESHOLD}::DOUBLE AS threshold FROM runs WHERE status = 'success')"""


def grid_of(spark: SparkSession, base: str) -> DataFrame:
    """Every model with every classifier at two thresholds."""
    return experiments.product([runs_of(spark, base).select(c).distinct() for c in ("embedding_model", "classifier_type")] + [spark.createDataFrame([(THRESHOLD,), (0.9,)], "threshold double")])


@query(f"WITH {RUNS}, {_GRID} SELECT * FROM grid")
def run_grid(spark, base):
    return grid_of(spark, base)


@query(f"WITH {RUNS}, {_GRID} SELECT * FROM grid ANTI JOIN done USING (embedding_model, classifier_type, threshold)")
def runs_left(spark, base):
    """What of the grid has no finished run; failed ones left no evaluation."""
    done = runs_of(spark, base).select("embedding_model", "classifier_type", F.lit(THRESHOLD).alias("threshold"), F.lit(True).alias("has_config"), (F.col("status") == "success").alias("has_evaluation"))
    return experiments.still_to_run(grid_of(spark, base), done, "embedding_model", "classifier_type", "threshold")


@query(f"""WITH {RUNS} SELECT experiment_id, 'classifier=' || classifier_type || ', overlap=' || CAST(overlap_proportion AS VARCHAR) || ', tp=' || coalesce(CAST(tp AS VARCHAR), '') AS param_details FROM runs""")
def run_parameters(spark, base):
    """Parameters of a run as text, from a map of them."""
    with_map = runs_of(spark, base).select("experiment_id", F.map_from_arrays(F.array(F.lit("classifier"), F.lit("overlap"), F.lit("tp")), F.array("classifier_type", F.col("overlap_proportion").cast("string"), F.col("tp").cast("string"))).alias("hyperparameters"))
    flat = experiments.flatten_parameters(with_map, ["classifier", "overlap", "tp"])
    return flat.select("experiment_id", experiments.parameter_text(flat).alias("param_details"))
