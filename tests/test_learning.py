"""Training: mini-batch Adam and folds against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwright.config import LINEAR
from chunkwright.functions.ranks import block_ranks
from chunkwright.operators import classify, labels, metric, minibatch, mining


def vectors(spark, n, d=3, seed=0, parts=3):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.7 * (i % 2), 1) for _ in range(d)], float(i % 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label double").repartition(parts)


def plain_adam(spark, rows, p, folds=None, leave=None):
    """Adam as it is written down, over the seeded orders of one part."""
    ids = spark.createDataFrame([(str(r[0]),) for r in rows], "key string")
    by_id = {str(r[0]): (np.array(r[1], np.float32).astype(float), r[2]) for r in rows}
    d = len(rows[0][1])
    w = np.random.default_rng(p.seed).uniform(-1, 1, d + 1) / np.sqrt(d)
    m, v, t, losses = np.zeros(d + 1), np.zeros(d + 1), 0, []
    for epoch in range(p.epochs):
        order = [r.key for r in ids.orderBy(labels.seeded_order(p.seed + epoch, "key")).collect()]
        order = [k for k in order if folds is None or folds[k] != leave]
        lost = []
        for a in range(0, len(order), p.batch_size):
            x = np.array([np.append(by_id[k][0], 1) for k in order[a : a + p.batch_size]])
            y = np.array([by_id[k][1] for k in order[a : a + p.batch_size]])
            q = 1 / (1 + np.exp(-x @ w))
            lost.append(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)))
            g = x.T @ (q - y) / len(y)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - p.learning_rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        losses.append(np.mean(lost))
    return w, losses


@pytest.mark.parametrize("batch,rate,epochs", [(8, 0.01, 3), (32, 0.05, 2), (200, 0.01, 2)])
def test_one_part_is_plain_adam(spark, batch, rate, epochs):
    rows, df = vectors(spark, 101)
    p = minibatch.Adam(rate, batch, epochs, seed=4)
    (w,), (losses,) = minibatch.fit_models(df, p, "vec_id")
    want, lost = plain_adam(spark, rows, p)
    assert np.allclose(w, want) and np.allclose(losses, lost) and len(losses) == epochs


def test_settings_matter_and_parts_learn(spark):
    _, df = vectors(spark, 400)
    fit = lambda **k: minibatch.fit_models(df, minibatch.Adam(**{"learning_rate": 0.05, "batch_size": 16, "epochs": 2, "seed": 1, **k}), "vec_id")
    base = fit()[0][0]
    assert all(not np.allclose(base, fit(**k)[0][0]) for k in ({"learning_rate": 0.01}, {"batch_size": 32}, {"epochs": 3}, {"seed": 2}))
    assert np.array_equal(base, fit()[0][0])
    _, (losses,) = fit(part_rows=60, epochs=6)  # seven parts, averaged
    assert losses[-1] < losses[0]


def test_folds_in_one_pass_equal_separate_fits(spark):
    rows, df = vectors(spark, 90)
    split = classify.folds(df, "label", "vec_id", 4)
    at = {str(r.vec_id): r.fold for r in split.collect()}
    p = minibatch.Adam(0.05, 8, 2, seed=3)
    models, losses = minibatch.fit_models(split, p, "vec_id", 4)
    accuracies = []
    for j in range(4):
        want, lost = plain_adam(spark, rows, p, at, j)
        assert np.allclose(models[j], want) and np.allclose(losses[j], lost)
        mine = [r for r in rows if at[str(r[0])] == j]
        accuracies.append(np.mean([(np.append(np.array(r[1], np.float32), 1) @ want >= 0) == (r[2] == 1) for r in mine]))
    found = classify.cross_validate(df, lambda: classify.linear(2, 0.05, 8, 3), "vec_id", 4)
    assert np.allclose([r.accuracy for r in found.orderBy("fold").collect()], accuracies)
    r = classify.cv_summary(found).first()
    assert np.isclose(r.mean_accuracy, np.mean(accuracies)) and np.isclose(r.std_accuracy, np.std(accuracies))
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_odd_rows(spark):
    none = spark.createDataFrame([], "embedding array<double>, label double")
    c = classify.get_classifier(LINEAR, epochs=2).fit(none)
    assert c.losses() == [] and c.score(none).count() == 0
    some = spark.createDataFrame([(None, 1.0), ([1.0, 2.0], None), ([1.0, 0.0], 1.0), ([1.0, 0.0], 1.0)], "embedding array<double>, label double")
    assert len(classify.get_classifier(LINEAR, epochs=2).fit(some).losses()) == 2
    with pytest.raises(Exception, match="one length"):
        classify.get_classifier(LINEAR, epochs=1).fit(spark.createDataFrame([([1.0, 2.0], 0.0), ([1.0], 1.0)], "embedding array<double>, label double"))


def test_batches_and_ranks(spark):
    df = spark.range(700).withColumn("g", F.when(F.col("id") < 650, "a"))
    got = block_ranks(df, "id", "g", blocks=8).collect()
    assert {(r.id, r["rank"], r["size"]) for r in got} == {(i, i if i < 650 else i - 650, 650 if i < 650 else 50) for i in range(700)}
    assert block_ranks(df.limit(0), "id", "g").count() == 0
    rows = minibatch.batch_windows(df, "id", 32, 5, epoch=1, parts=3).collect()
    for part in range(3):
        mine = sorted((r.batch, r.place) for r in rows if r.part == part)
        assert mine == [(i // 32, i % 32) for i in range(len(mine))] and len(mine) > 150
    order = [r.id for r in sorted((r for r in rows if r.part == 0), key=lambda r: (r.batch, r.place))]
    want = [r.id for r in df.where(minibatch.part_of(F.col("id"), 3) == 0).orderBy(labels.seeded_order(6, "id")).collect()]
    assert order == want


def test_triplet_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(3)
    a, p, n, w = rng.normal(size=(20, 4)), rng.normal(size=(20, 4)), rng.normal(size=(20, 4)), rng.normal(size=(4, 4))
    _, g = metric.loss_and_gradient(w, a, p, n, 0.5)
    for i in range(4):
        for j in range(4):
            step = np.zeros((4, 4))
            step[i, j] = 1e-6
            slope = (metric.loss_and_gradient(w + step, a, p, n, 0.5)[0] - metric.loss_and_gradient(w - step, a, p, n, 0.5)[0]) / 2e-6
            assert abs(slope - g[i, j]) < 1e-4


def test_projection_learns_and_handles_short_negatives(spark):
    rng = np.random.default_rng(4)
    rows = [(f"p{i}", [float(x) for x in rng.normal([1, 0, 0], [0.1, 2, 2])]) for i in range(30)] + [(f"n{i}", [float(x) for x in rng.normal([-1, 0, 0], [0.1, 2, 2])]) for i in range(12)]
    vectors = spark.createDataFrame(rows, "k string, embedding array<float>")
    keys = mining.triplets(vectors.where("k LIKE 'p%'").select("k"), vectors.where("k LIKE 'n%'").select("k"), "k", 1)
    assert keys.count() == 30 and keys.where("negative IS NULL").count() == 18
    with_v = metric.with_vectors(keys, vectors, "k")
    assert with_v.count() == 12
    loss, _, n = metric.mean_loss_and_gradient(with_v.repartition(4), np.eye(3), 0.5)
    assert n == 12 and abs(loss - with_v.agg(F.avg(metric.margin_loss(0.5))).first()[0]) < 1e-9
    w, losses = metric.fit_projection(with_v, metric.Triplets(learning_rate=0.05, epochs=15))
    assert losses[-1] < 0.8 * losses[0] and len(losses) == 16
    mapped = {r.k: r.embedding for r in metric.project(vectors.union(spark.createDataFrame([("none", None)], vectors.schema)), w).collect()}
    assert mapped["none"] is None and np.allclose(mapped["p3"], w @ np.array(rows[3][1]), atol=1e-5)
    assert metric.fit_projection(with_v.limit(0))[1] == []


def test_first_trees_answer_like_forests_of_their_own(spark):
    rows, df = vectors(spark, 120, seed=6)
    c = classify.get_classifier("random_forest_classifier", n_estimators=9, max_depth=4, seed=2).fit(df)
    got = {r.vec_id: r.probabilities for r in c.prefixes(df, 1, 4, 9).collect()}
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = df.withColumn("features", array_to_vector("embedding"))
    per_tree = [{r.vec_id: r.p for r in t.transform(ready).select("vec_id", vector_to_array("probability")[1].alias("p")).collect()} for t in c.model.trees]
    for i, values in got.items():
        assert np.allclose(values, [np.mean([t[i] for t in per_tree[:n]]) for n in (1, 4, 9)])
    whole = {r.vec_id: r.probability for r in c.score(df).collect()}
    assert all(abs(whole[i] - v[2]) < 1e-12 for i, v in got.items())
    assert {r.vec_id: r.probability for r in c.first(4).score(df).collect()} == {i: v[1] for i, v in got.items()}
    with pytest.raises(ValueError):
        c.prefixes(df, 10)
