"""Binary classifiers over embedded chunks, by name."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FOREST, LINEAR
from ..functions.ranks import block_ranks
from ..session import new_shared_path
from ..sources.store import delete, exists
from . import minibatch

#: The library's deepest tree; stands for an unbounded depth.
MAX_DEPTH = 30


class NotTrainedError(RuntimeError):
    pass


def with_complement(scores: DataFrame) -> DataFrame:
    """``scores`` with ``complement``, the probability of label 0."""
    return scores.withColumn("complement", 1 - F.col("probability"))


class Classifier:
    """Fits on (embedding, label 0/1) rows and adds ``probability`` of label 1."""

    def __init__(self, estimator):
        self.estimator, self.model = estimator, None

    def fit(self, vectors: DataFrame) -> "Classifier":
        self.model = self.estimator.fit(vectors.select(array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label")))
        return self

    def score(self, vectors: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotTrainedError("the classifier has not been trained")
        out = self.model.transform(vectors.withColumn("features", array_to_vector("embedding")))
        return out.select(*vectors.columns, vector_to_array("probability")[1].alias("probability"))

    def score_both(self, vectors: DataFrame) -> DataFrame:
        """``score`` with ``complement``, the probability of label 0."""
        return with_complement(self.score(vectors))

    def losses(self) -> list[float]:
        """The training loss of each epoch; empty for models that are not fitted by epochs."""
        if self.model is None:
            raise NotTrainedError("the classifier has not been trained")
        return []

    def save(self, path: str) -> None:
        if self.model is None:
            raise NotTrainedError("the classifier has not been trained")
        PipelineModel([self.model]).write().overwrite().save(path)

    def load(self, path: str) -> bool:
        """Whether there was a model at ``path``, in whatever store; one that cannot be read is an error."""
        if not exists(SparkSession.active(), path):
            return False
        self.model = PipelineModel.load(path).stages[0]
        return True


class PrefixForest(Classifier):
    """A forest that answers for its first trees, too: one fit of many trees stands for forests of fewer."""

    def __init__(self, estimator: RandomForestClassifier):
        super().__init__(estimator)
        self.votes = None

    def fit(self, vectors: DataFrame) -> "PrefixForest":
        super().fit(vectors)
        self.votes = None
        return self

    def prefixes(self, vectors: DataFrame, *cuts: int) -> DataFrame:
        """``vectors`` with ``probabilities``: of label 1 by the first ``n`` trees, for each n of ``cuts``.

        Each tree tells the leaf that a row falls into; the leaf's share of label 1 is the tree's vote.
        """
        if self.model is None:
            raise NotTrainedError("the classifier has not been trained")
        if self.votes is None:
            self.votes = leaf_votes(vectors.sparkSession, self.model)
        most = self.model.getNumTrees
        if not all(1 <= n <= most for n in cuts):
            raise ValueError(f"the forest has {most} trees")
        leaves = self.model.copy().setLeafCol("__leaf").setPredictionCol("").setRawPredictionCol("").setProbabilityCol("")
        out = leaves.transform(vectors.withColumn("features", array_to_vector("embedding"))).withColumn("__leaf", vector_to_array("__leaf"))
        known = vectors.sparkSession.createDataFrame([(self.votes,)], "__votes array<array<double>>")  # the model's leaves
        votes = F.transform("__leaf", lambda leaf, tree: F.get(F.get("__votes", tree), leaf.cast("int")))
        mean = lambda n: F.aggregate(F.slice("__v", 1, n), F.lit(0.0), lambda a, x: a + x) / n
        voted = out.join(F.broadcast(known), F.lit(True)).select(*vectors.columns, votes.alias("__v"))
        return voted.select(*vectors.columns, F.array(*[mean(n) for n in cuts]).alias("probabilities"))

    def first(self, n: int) -> "Classifier":
        """The forest of the first ``n`` trees, to score with."""
        return FirstTrees(self, n)


class FirstTrees(Classifier):
    def __init__(self, whole: PrefixForest, n: int):
        super().__init__(whole.estimator)
        self.whole, self.n, self.model = whole, n, whole.model

    def score(self, vectors: DataFrame) -> DataFrame:
        scored = self.whole.prefixes(vectors, self.n)
        return scored.select(*vectors.columns, F.col("probabilities")[0].alias("probability"))


def leaf_votes(spark: SparkSession, model) -> list[list[float]]:
    """Each tree's leaves in the order in which the library numbers them, as shares of label 1. As large as the model."""
    path = new_shared_path(spark, "forest")
    model.write().save(path)
    try:
        nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").where("leftChild < 0")
        stats = F.col("impurityStats")
        share = F.coalesce(F.try_divide(F.get(stats, F.lit(1)), F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)), F.lit(0.0))
        trees = nodes.groupBy("treeID").agg(F.sort_array(F.collect_list(F.struct("id", share.alias("p")))).alias("leaves"))
        rows = trees.select("treeID", F.transform("leaves", lambda x: x.p).alias("p")).orderBy("treeID").collect()
    finally:
        delete(spark, path)
    return [list(r.p) for r in rows]


def forest(n_estimators: int = 200, max_depth: int | None = None, min_samples_leaf: int = 1, seed: int = 0) -> Classifier:
    return PrefixForest(RandomForestClassifier(numTrees=n_estimators, maxDepth=min(MAX_DEPTH, max_depth or MAX_DEPTH), minInstancesPerNode=min_samples_leaf, seed=seed))


class AdamClassifier(Classifier):
    """The linear classifier by mini-batch Adam; ``key`` names the rows, if the table has a column that does."""

    def __init__(self, params: minibatch.Adam, key: str | None = None):
        super().__init__(params)
        self.key, self.history = key, []

    def fit(self, vectors: DataFrame) -> "AdamClassifier":
        (self.model,), (self.history,) = minibatch.fit_models(vectors, self.estimator, self.key if self.key in vectors.columns else None)
        return self

    def score(self, vectors: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotTrainedError("the classifier has not been trained")
        return minibatch.probability(vectors, [self.model])

    def losses(self) -> list[float]:
        """The mean of the batches' losses in each epoch."""
        if self.model is None:
            raise NotTrainedError("the classifier has not been trained")
        return list(self.history)

    def save(self, path: str) -> None:
        if self.model is None:
            raise NotTrainedError("the classifier has not been trained")
        minibatch.save(SparkSession.active(), path, self.model, self.history, self.estimator)

    def load(self, path: str) -> bool:
        if not exists(SparkSession.active(), path):
            return False
        found = minibatch.load(SparkSession.active(), path)
        if found is None:
            raise ValueError(f"there is no model of this kind at {path}")
        self.model, self.history, self.estimator = found
        return True


def linear(epochs: int = 100, learning_rate: float = 1e-3, batch_size: int = 32, seed: int = 0, key: str | None = None) -> Classifier:
    return AdamClassifier(minibatch.Adam(learning_rate, batch_size, epochs, seed), key)


REGISTRY = {FOREST: forest, LINEAR: linear}


def get_classifier(name: str, **hyperparameters) -> Classifier:
    if name not in REGISTRY:
        raise ValueError(f"unknown classifier {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**hyperparameters)


def training_set(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    return positives.withColumn("label", F.lit(1.0)).unionByName(negatives.withColumn("label", F.lit(0.0)))


def linear_score(vector: Column, weights: Column, bias: Column | None = None) -> Column:
    """w.x + b over arrays."""
    dot = F.aggregate(F.zip_with(vector, weights, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda a, x: a + x)
    return dot + bias if bias is not None else dot


def folds(rows: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """``rows`` with ``fold``: stratified, unshuffled, contiguous by key within each label; ranked in ranges of the key."""
    return block_ranks(rows, key, label, rank="__rank", size="__size").withColumn("fold", F.floor(F.col("__rank") * k / F.col("__size")).cast("int")).drop("__rank", "__size")


def cross_validate(rows: DataFrame, make, key: str, k: int = 5) -> DataFrame:
    """(fold, accuracy): one row for each fold.

    Linear classifiers of all folds are trained in the same scans; others one after another.
    """
    split = folds(rows, "label", key, k).persist()
    hit = F.avg(((F.col("probability") >= 0.5) == (F.col("label") == 1)).cast("double")).alias("accuracy")
    try:
        first = make()
        if isinstance(first, AdamClassifier):
            models, _ = minibatch.fit_models(split, first.estimator, key, k)
            found = minibatch.probability(split, models, "fold").groupBy("fold").agg(hit).collect()
        else:
            found = []
            for i in range(k):
                part = make().fit(split.where(F.col("fold") != i)).score(split.where(F.col("fold") == i))
                found += part.groupBy("fold").agg(hit).collect()
    finally:
        split.unpersist()
    return rows.sparkSession.createDataFrame([(r.fold, r.accuracy) for r in found], "fold int, accuracy double")


def cv_summary(accuracies: DataFrame) -> DataFrame:
    return accuracies.agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"))
