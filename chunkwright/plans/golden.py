"""Published runs whose summaries the experiment functions must reproduce."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import FOREST, LINEAR
from ..operators import experiments

_BERT, _T5, _QWEN = "microsoft/codebert-base", "Salesforce/codet5-small", "Qwen/Qwen2.5-7B-Instruct"

#: experiment_id, embedding_model, overlap_proportion, classifier_type, tp, fn, fp, tn, runtime_sec
RUNS = [
    (1, _BERT, 0.25, FOREST, 45, 5, 2, 98, 40.72),
    (2, _BERT, 0.25, LINEAR, 48, 2, 8, 92, 43.64),
    (3, _T5, 0.25, FOREST, 46, 4, 3, 97, 32.36),
    (4, _T5, 0.25, LINEAR, 46, 4, 7, 93, 37.39),
    (5, _QWEN, 0.25, FOREST, 48, 2, 6, 94, 4772.00),
    (6, _QWEN, 0.25, LINEAR, 49, 1, 5, 95, 23.27),
    (7, _QWEN, 0.125, FOREST, 46, 4, 1, 99, 3973.45),
    (8, _QWEN, 0.125, LINEAR, 50, 0, 9, 91, 20.99),
    (9, _QWEN, 0.5, FOREST, 46, 4, 4, 96, 5998.65),
    (10, _QWEN, 0.5, LINEAR, 47, 3, 6, 94, 22.80),
    (12, _QWEN, 0.125, FOREST, 47, 3, 1, 99, 32.70),
]
#: A failed run, for the paths that failures take.
FAILED = (99, _T5, 0.5, LINEAR, None, None, None, None, 3.5)
COLUMNS = "experiment_id int, embedding_model string, overlap_proportion double, classifier_type string, tp int, fn int, fp int, tn int, runtime_sec double, status string"


def rows() -> list[tuple]:
    return [(*r, "success") for r in RUNS] + [(*FAILED, "failed")]


def runs(spark: SparkSession) -> DataFrame:
    return experiments.with_metrics(spark.createDataFrame(rows(), COLUMNS))
