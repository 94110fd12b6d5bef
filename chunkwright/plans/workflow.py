"""The end-to-end plans: train and evaluate, with or without fine-tuning, score a code base, search hyper-parameters.

Each is one lazily composed plan per step over explicit inputs. What is worth storing between runs are the embedded
chunks, which ``ChunkCache`` keeps by content, and what a run found, which its folder keeps.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import FOREST, LINEAR, Params
from ..functions.represent import Representation, data_flow_text, represent
from ..functions.text import tokens
from ..operators import chunking, classify, embed, evaluate, experiments, labels, metric, mining
from ..sources.cache import ChunkCache
from ..sources.store import age, create_new, delete, read_text, write_text


def fingerprint(rows: DataFrame) -> list:
    """What tells one set of rows from another: how many there are, and a hash of them in any order."""
    h = F.xxhash64(*sorted(rows.columns))
    return [str(x) for x in rows.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()]


def chunk_files(files: DataFrame, p: Params, graph: Representation = data_flow_text) -> DataFrame:
    """(file, chunk_index, tokens) of rows (file, lang, content)."""
    shown = files.select("file", represent(p.representation, F.col("content"), F.col("lang"), graph).alias("text"))
    return chunking.chunk(shown.withColumn("tokens", tokens(F.col("text"))), p.chunk_size, p.stride)


def settings(embedder: embed.Embedder, p: Params) -> dict:
    """All that decides a content's embedded chunks."""
    return {"representation": p.representation, "size": p.chunk_size, "stride": p.stride, "embedder": embedder.key()}


def embed_files(files: DataFrame, embedder: embed.Embedder, p: Params, cache: ChunkCache | None = None) -> DataFrame:
    """Embedded chunks of rows (file, lang, content); with a cache only contents that it lacks are embedded."""
    make = lambda some: embedder.embed(chunk_files(some, p))
    return make(files) if cache is None else cache.embedded(files, settings(embedder, p), make)


def some(chunks: DataFrame) -> DataFrame:
    """``chunks``, of which there must be any."""
    if chunks.isEmpty():
        raise ValueError("there are no chunks to work on")
    return chunks


def training_rows(embedded: DataFrame, flags: DataFrame) -> DataFrame:
    """(embedding, label) of the training files' chunks; ``flags`` has file and the five flags."""
    rows = embedded.join(flags, "file")
    pos = rows.where(labels.is_training_positive()).select("embedding")
    neg = rows.where(labels.is_training_negative()).select("embedding")
    return classify.training_set(pos, neg)


def train(embedded: DataFrame, flags: DataFrame, p: Params) -> classify.Classifier:
    return classify.get_classifier(p.classifier, **p.hyperparameters).fit(training_rows(embedded, flags))


Trainer = Callable[[DataFrame, DataFrame, Params], classify.Classifier]


def score_groups(embedded: DataFrame, flags: DataFrame, model: classify.Classifier) -> DataFrame:
    """(file, grp, chunk_index, probability, clear_text) of the evaluation files."""
    rows = embedded.join(flags.select("file", labels.evaluation_group().alias("grp")).where("grp IS NOT NULL"), "file")
    scored = model.score(rows)
    return scored.select("file", "grp", "chunk_index", "probability", F.array_join("tokens", " ").alias("clear_text"))


@dataclass
class Evaluation:
    scores: DataFrame
    file_scores: DataFrame
    sweep: DataFrame
    points: dict[str, dict]
    #: Chunks and files scored, in all and by group, as the scan for the points met them.
    counts: dict[str, int] = field(default_factory=dict)
    #: Of the training, and of the fine-tuning if there was one.
    losses: dict[str, list[float]] = field(default_factory=dict)


def evaluate_scores(scores: DataFrame, files: DataFrame | None = None) -> Evaluation:
    """Sweep and operating points; three rows reach the driver. What is counted is observed on the way, without a scan of its own."""
    seen, first = Observation(), F.col("chunk_index") == 0
    groups = {"positive": labels.POSITIVE, "unrelated": labels.UNRELATED, "discarded": labels.DISCARDED}
    watched = scores.observe(seen, F.count(F.lit(1)).alias("chunks"), F.count_if(first).alias("files"), *[F.count_if(first & (F.col("grp") == g)).alias(f"{name}_files") for name, g in groups.items()])
    sweep = evaluate.threshold_sweep(evaluate.file_max_score(watched, files))
    points = {r.point: r.asDict() for r in evaluate.operating_points(sweep).collect()}
    file_scores = evaluate.file_max_score(scores, files)
    return Evaluation(scores, file_scores, evaluate.threshold_sweep(file_scores), points, dict(seen.get))


def evaluate_model(embedded: DataFrame, flags: DataFrame, model: classify.Classifier) -> Evaluation:
    known = flags.select("file", labels.evaluation_group().alias("grp")).where("grp IS NOT NULL")
    found = evaluate_scores(score_groups(embedded, flags, model), known)
    found.losses["training"] = model.losses()
    return found


def train_and_evaluate(files: DataFrame, flags: DataFrame, embedder: embed.Embedder, p: Params, cache: ChunkCache | None = None, trainer: Trainer = train) -> Evaluation:
    embedded = some(embed_files(files, embedder, p, cache))
    return evaluate_model(embedded, flags, trainer(embedded, flags, p))


def tune_and_evaluate(files: DataFrame, flags: DataFrame, embedder: embed.Embedder, p: Params, triplets: metric.Triplets = metric.Triplets(), cache: ChunkCache | None = None) -> tuple[Evaluation, embed.ProjectedEmbedder]:
    """The long way: a first classifier finds confident chunks, their triplets teach a map of the vectors, and a second classifier is trained and evaluated on the mapped ones."""
    embedded = some(embed_files(files, embedder, p, cache))
    matrix, losses = fine_tune(embedded, flags, train(embedded, flags, p), p, triplets)
    mapped = metric.project(embedded, matrix)
    found = evaluate_model(mapped, flags, train(mapped, flags, p))
    found.losses["fine-tuning"] = losses
    return found, embed.ProjectedEmbedder(embedder, matrix)


def mine_triplets(embedded: DataFrame, flags: DataFrame, model: classify.Classifier, p: Params) -> DataFrame:
    """Triplets of chunk keys from the confident chunks of training positives, for an encoder's fine-tuning."""
    rows = embedded.join(flags, "file").withColumn("chunk", F.concat_ws("#", "file", "chunk_index"))
    sure = mining.confident(model.score(rows.where(labels.is_training_positive())), p.threshold)
    return mining.triplets(sure, rows.where(labels.is_training_negative()), "chunk", p.seed)


def fine_tune(embedded: DataFrame, flags: DataFrame, model: classify.Classifier, p: Params, triplets: metric.Triplets = metric.Triplets()):
    """(matrix, losses) of the map that the confident chunks' triplets teach. Anchors without a negative teach nothing; none at all is an error."""
    vectors = embedded.select(F.concat_ws("#", "file", "chunk_index").alias("chunk"), "embedding")
    matrix, losses = metric.fit_projection(metric.with_vectors(mine_triplets(embedded, flags, model, p), vectors, "chunk"), triplets)
    if not losses:
        raise ValueError("there are no confident chunks to learn from")
    return matrix, losses


def scan_code_base(files: DataFrame, embedder: embed.Embedder, model: classify.Classifier, p: Params, cache: ChunkCache | None = None) -> DataFrame:
    """Every file of a code base with its greatest chunk probability and the decision at the threshold."""
    scored = model.score(embed_files(files, embedder, p, cache)).withColumn("grp", F.lit("scanned"))
    whole = evaluate.file_max_score(scored, files.select("file", F.lit("scanned").alias("grp")))
    return whole.select("file", "max_score", (F.col("max_score") >= p.threshold).alias("flagged"))


def evaluate_code_base(files: DataFrame, embedder: embed.Embedder, model: classify.Classifier, p: Params, cache: ChunkCache | None = None) -> Evaluation:
    """The evaluation of a code base whose paths tell the groups; a file in several groups counts in each, one in none in no."""
    scored = model.score(some(embed_files(files, embedder, p, cache)))
    groups = files.select("file", F.explode(labels.code_base_groups(F.col("file"))).alias("grp"))
    named = scored.join(groups, "file").select("file", "grp", "chunk_index", "probability", F.array_join("tokens", " ").alias("clear_text"))
    return evaluate_scores(named, groups)


def run_row(p: Params, e: Evaluation) -> dict:
    """A run's counts at its best F1, as the summary tables need them, and the figures of its other two points."""
    false = lambda x: x["unrelated_fp"] + x["discarded_fp"]
    b = e.points["best_f1"]
    row = {"tp": b["tp"], "fn": b["fn"], "fp": false(b), "tn": b["unrelated_tn"] + b["discarded_tn"], "f1": b["f1"], "threshold": b["threshold"]}
    for name in ("min_fn", "min_fp"):
        x = e.points[name]
        row |= {f"{name}_{k}": v for k, v in (("threshold", x["threshold"]), ("fn", x["fn"]), ("fp", false(x)), ("f1", x["f1"]))}
    return row | {"chunk_size": p.chunk_size, "overlap": p.overlap, "counts": e.counts, "losses": e.losses}


#: What of a run is in evaluation.json.
EVALUATED = ("tp", "fn", "fp", "tn", "f1", "threshold", *(f"{p}_{k}" for p in ("min_fn", "min_fp") for k in ("threshold", "fn", "fp", "f1")))


def log_lines(setting: dict, row: dict, embedded: dict[str, int]) -> list[str]:
    """A run's training.log."""
    lines = [f"setting {json.dumps(setting, sort_keys=True)}", f"status {row['status']}, {row['runtime_sec']:.2f} s"]
    lines += [f"newly embedded: {n} {name}" for name, n in embedded.items()]
    lines += [f"scored: {n} {name}" for name, n in row.get("counts", {}).items()]
    for what, losses in row.get("losses", {}).items():
        lines += [f"{what} epoch {i} of {len(losses)}: loss {x:.6f}" for i, x in enumerate(losses, 1)]
    return lines + [f"{k} {row[k]}" for k in EVALUATED if k in row]


@dataclass(frozen=True)
class Runs:
    """Folders of runs. A folder's name says the setting and the data, so other data have other folders.

    A run is claimed by creating a file, which only one of several searches can do; the others wait for its result. A
    claim older than ``stale_after`` seconds is taken for one of a dead search, and is taken over.
    """

    root: str
    stale_after: float = 6 * 3600
    poll: float = 1.0

    def recorded(self, spark: SparkSession, setting: dict, data: list, run: Callable[[dict], dict], embedded: Callable[[], dict[str, int]] = dict) -> dict:
        """One run with its files, or what its files say of it."""
        at = f"{self.root}/{hashlib.sha256(json.dumps([setting, data], sort_keys=True).encode()).hexdigest()[:16]}"
        known = self.read(spark, at)
        while known is None and not create_new(spark, f"{at}/claim"):
            try:
                if age(spark, f"{at}/claim") > self.stale_after:
                    delete(spark, f"{at}/claim")
                    continue
            except Exception:
                pass  # the claim went meanwhile
            time.sleep(self.poll)
            known = self.read(spark, at)
        if known is not None:
            return known
        try:
            known = self.read(spark, at)  # it may have come between the look and the claim
            if known is None:
                known = self.write(spark, at, setting, experiments.execute([setting], run)[0], embedded())
        finally:
            delete(spark, f"{at}/claim")
        return known

    def read(self, spark: SparkSession, at: str) -> dict | None:
        config, evaluation = (read_text(spark, f"{at}/{name}.json") for name in ("config", "evaluation"))
        if config and evaluation:
            try:
                return json.loads(config) | json.loads(evaluation)
            except ValueError:
                pass  # a broken file: the run is done again
        return None

    def write(self, spark: SparkSession, at: str, setting: dict, row: dict, embedded: dict[str, int]) -> dict:
        write_text(spark, f"{at}/training.log", "\n".join(log_lines(setting, row, embedded)) + "\n")
        if row["status"] == "success":
            write_text(spark, f"{at}/evaluation.json", json.dumps({k: v for k, v in row.items() if k in EVALUATED}))
        else:
            write_text(spark, f"{at}/error.log", row["error"])
        write_text(spark, f"{at}/config.json", json.dumps(row, indent=2))
        return row


class GrownForests:
    """One fit for all forests of a search that differ by their number of trees alone."""

    def __init__(self, most: dict[tuple, int]):
        self.most, self.grown, self.locks, self.guard = most, {}, {}, threading.Lock()

    @staticmethod
    def shape(h: dict) -> tuple:
        return tuple(sorted((k, v) for k, v in h.items() if k != "n_estimators"))

    def trainer(self, at: tuple) -> Trainer:
        def fit(embedded: DataFrame, flags: DataFrame, p: Params) -> classify.Classifier:
            n, shape = p.hyperparameters.get("n_estimators"), self.shape(p.hyperparameters)
            if p.classifier != FOREST or n is None:
                return train(embedded, flags, p)
            most = max(n, self.most.get(shape, n))
            with self.guard:
                lock = self.locks.setdefault((at, shape), threading.Lock())
            with lock:  # runs of one shape wait for the first of them
                if (at, shape) not in self.grown:
                    self.grown[at, shape] = train(embedded, flags, replace(p, hyperparameters=p.hyperparameters | {"n_estimators": most}))
            return self.grown[at, shape].first(n)

        return fit


def in_pool(spark: SparkSession, settings: list[dict], one: Callable[[dict], dict], parallel: int) -> list[dict]:
    """``one`` of each setting, up to ``parallel`` at once, in order: each in a job group and a scheduler pool of its own."""

    def grouped(i: int) -> dict:
        sc = spark.sparkContext
        sc.setJobGroup(f"run-{i}", json.dumps(settings[i], sort_keys=True), interruptOnCancel=True)
        sc.setLocalProperty("spark.scheduler.pool", f"run-{i % max(1, parallel)}")
        try:
            return one(settings[i])
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)
            sc.setLocalProperty("spark.jobGroup.id", None)

    if parallel <= 1:
        return [one(s) for s in settings]
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(inheritable_thread_target(spark)(grouped), range(len(settings))))


#: Settings of the first two phases.
STANDARD = {FOREST: {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 1}, LINEAR: {"learning_rate": 1e-3, "batch_size": 32, "epochs": 100}}


def search(
    files: DataFrame,
    flags: DataFrame,
    embedders: dict[str, embed.Embedder],
    base: Params,
    forest: list[dict],
    linear: list[dict],
    overlaps: tuple[float, ...] = (0.25, 0.125, 0.5),
    standard: dict[str, dict] = STANDARD,
    cache: ChunkCache | None = None,
    results: str | Runs | None = None,
    parallel: int = 1,
) -> list[dict]:
    """Phased search: the model by its mean F1 over both classifiers, then the overlap, then each grid.

    The driver only loops over settings, up to ``parallel`` runs of a phase at once; a failed run stops no other. Embedded
    chunks are shared by all runs of a model and overlap, and forests that differ by their number of trees are one fit,
    whose first trees answer for the smaller ones. Below ``results`` each run leaves config.json, training.log and
    evaluation.json or error.log; a run that left a result for the same setting and data is not run again.
    """
    spark = files.sparkSession
    folders = Runs(results) if isinstance(results, str) else results
    data = [*fingerprint(files), *fingerprint(flags), base.representation, base.size, base.seed, base.threshold] if folders else []
    most: dict[tuple, int] = {}
    for h in [*forest, standard.get(FOREST, {})]:
        if h.get("n_estimators"):
            most[GrownForests.shape(h)] = max(h["n_estimators"], most.get(GrownForests.shape(h), 0))
    forests, caches = GrownForests(most), threading.local()

    def run(setting: dict) -> dict:
        p = replace(base, model=setting["embedding_model"], overlap_proportion=setting["overlap_proportion"], classifier=setting["classifier_type"], hyperparameters=setting["hyperparameters"])
        caches.own = replace(cache, added={}) if cache else None
        return run_row(p, train_and_evaluate(files, flags, embedders[p.model], p, caches.own, forests.trainer((p.model, p.overlap_proportion))))

    def added() -> dict[str, int]:
        own = getattr(caches, "own", None)
        return own.added if own else {}

    def one(setting: dict) -> dict:
        if folders is None:
            return experiments.execute([setting], run)[0]
        key = embedders[setting["embedding_model"]].key()
        return folders.recorded(spark, setting, [*data, key], run, added)

    def execute(settings: list[dict]) -> list[dict]:
        return in_pool(spark, settings, one, parallel)

    def both(model: str, overlap: float) -> list[dict]:
        return [{"embedding_model": model, "overlap_proportion": overlap, "classifier_type": c, "hyperparameters": standard[c]} for c in (FOREST, LINEAR)]

    def best(rows: list[dict], key: str, default):
        means: dict = {}
        for r in rows:
            if r["status"] == "success":
                means.setdefault(r[key], []).append(r["f1"])
        return max(means, key=lambda k: sum(means[k]) / len(means[k])) if means else default

    rows = execute([s for m in embedders for s in both(m, overlaps[0])])
    model = best(rows, "embedding_model", base.model)
    rows += execute([s for o in overlaps[1:] for s in both(model, o)])
    overlap = best([r for r in rows if r["embedding_model"] == model], "overlap_proportion", base.overlap_proportion)
    settings = [{"embedding_model": model, "overlap_proportion": overlap, "classifier_type": c, "hyperparameters": h} for c, grid in ((FOREST, forest), (LINEAR, linear)) for h in grid]
    rows += execute(settings)
    return [row | {"experiment_id": i} for i, row in enumerate(rows, 1)]
