"""Command line: python -m chunkwright.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FOREST, LINEAR, Params
from .functions.represent import represent
from .operators import classify, embed, experiments, labels, metric, report_parts
from .plans import workflow
from .sources import files as sources
from .sources import sinks, splits
from .sources.cache import ChunkCache
from .sources.store import read_text, write_text


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="chunkwright", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    split = commands.add_parser("split", help="deal the files of a data folder into training and evaluation, by stratum; files dealt before stay")
    split.add_argument("root")
    split.add_argument("--out", required=True, help="folder of the versioned split")
    split.add_argument("--n", type=int, default=50, help="evaluation files of each stratum")
    split.add_argument("--seed", type=int, default=20240601)
    split.add_argument("--reset", action="store_true", help="back to the split before")
    shown = commands.add_parser("represent", help="write the anonymised data flow of a source tree, or print it")
    shown.add_argument("root")
    shown.add_argument("--out")
    for name, does in (("train", "train on a data folder, evaluate, and leave model, evaluation.json and a report"), ("search", "search hyper-parameters on a data folder")):
        made = commands.add_parser(name, help=does)
        made.add_argument("root")
        made.add_argument("--out", required=True)
        made.add_argument("--split", help="folder of a versioned split; without it the folders of the files tell")
        made.add_argument("--representation", choices=("text", "graph"), default="text")
        made.add_argument("--dimensions", type=int, default=64, help="of the hashing embedder")
        made.add_argument("--size", type=int, help="tokens of a chunk")
        if name == "train":
            made.add_argument("--classifier", choices=(FOREST, LINEAR), default=LINEAR)
            made.add_argument("--settings", type=json.loads, default={}, help="hyper-parameters as JSON")
            made.add_argument("--threshold", type=float, default=0.95)
            made.add_argument("--fine-tune", action="store_true", help="teach a map of the vectors on the way")
        else:
            made.add_argument("--quick", action="store_true", help="one overlap and one setting of each classifier")
            made.add_argument("--parallel", type=int, default=1)
    base = commands.add_parser("scan", help="score every file of a code base with a trained model")
    base.add_argument("root")
    base.add_argument("--model", required=True, help="what train has left")
    base.add_argument("--out", required=True)
    scan = commands.add_parser("scan-reports", help="list the reports of run folders by F1")
    scan.add_argument("root")
    return out


def labelled(spark: SparkSession, root: str, split: str | None) -> tuple[DataFrame, DataFrame]:
    """(files, flags) of a data folder, paths relative to it; under a split each file is labelled by the place that the split gives it."""
    files = relative(sources.read_sources(spark, root, drop_bad=True), root).withColumnRenamed("path", "file")
    at = files.select("file", F.concat(F.lit("/"), "file").alias("place"))
    if split:
        dealt = splits.Splits(split).read(spark)
        at = dealt.select(F.col("path").alias("file"), F.concat(F.lit("/"), splits.place(F.col("path"), F.col("stratum"), F.col("split"))).alias("place"))
    return files, at.select("file", *labels.label_flags(F.col("place")))


def relative(found: DataFrame, root: str) -> DataFrame:
    """``found`` with paths relative to the folder ``root``."""
    home = "/" + root.rstrip("/").split("/")[-1] + "/"
    if "://" in root or root.startswith("/"):
        home = root.split("://")[-1].rstrip("/") + "/"
    return found.withColumn("path", F.substring("path", F.locate(home, F.col("path")) + len(home), F.char_length("path")))


def train(spark: SparkSession, args: argparse.Namespace) -> int:
    files, flags = labelled(spark, args.root, args.split)
    p = Params(classifier=args.classifier, representation=args.representation, threshold=args.threshold, size=args.size, hyperparameters=args.settings)
    embedder, cache = embed.HashingEmbedder(args.dimensions), ChunkCache(f"{args.out}/cache")
    embedded = workflow.some(workflow.embed_files(files, embedder, p, cache))
    model, losses = workflow.train(embedded, flags, p), {}
    if args.fine_tune:
        matrix, losses["fine-tuning"] = workflow.fine_tune(embedded, flags, model, p)
        embedded = metric.project(embedded, matrix)
        model = workflow.train(embedded, flags, p)
        write_text(spark, f"{args.out}/map.json", json.dumps(matrix.tolist()))
    found = workflow.evaluate_model(embedded, flags, model)
    found.losses.update(losses)
    model.save(f"{args.out}/model")
    embedder.save(spark, f"{args.out}/embedder")
    write_text(spark, f"{args.out}/evaluation.json", json.dumps(workflow.run_row(p, found)))
    settings = {"classifier": p.classifier, "representation": p.representation, "threshold": p.threshold, "size": p.size}
    write_text(spark, f"{args.out}/settings.json", json.dumps(settings))
    report_parts.write_report(found.scores, found.file_scores, found.points, f"{args.out}/report", p.threshold)
    best = found.points["best_f1"]
    print(f"best F1 {best['f1']:.4f} at {best['threshold']:.3f}")
    return 0


def scan(spark: SparkSession, args: argparse.Namespace) -> int:
    saved = read_text(spark, f"{args.model}/settings.json")
    embedder = embed.HashingEmbedder.load(spark, f"{args.model}/embedder")
    p = Params(**json.loads(saved)) if saved else None
    model = classify.get_classifier(p.classifier) if p else None
    if model is None or embedder is None or not model.load(f"{args.model}/model"):
        print(f"there is no model at {args.model}")
        return 1
    matrix = read_text(spark, f"{args.model}/map.json")
    by = embed.ProjectedEmbedder(embedder, json.loads(matrix)) if matrix else embedder
    files = relative(sources.read_sources(spark, args.root, drop_bad=True), args.root).withColumnRenamed("path", "file")
    sinks.write_table(workflow.scan_code_base(files, by, model, p, ChunkCache(f"{args.out}/cache")), f"{args.out}/scores")
    scored = spark.read.parquet(f"{args.out}/scores").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged")).first()
    print(f"{scored.flagged} of {scored.n} files at or over {p.threshold:g}")
    return 0


def search(spark: SparkSession, args: argparse.Namespace) -> int:
    files, flags = labelled(spark, args.root, args.split)
    settings = lambda grid: [{k: v for k, v in r.asDict().items() if v} for r in grid.collect()]  # noqa: E731  depth 0 is no bound
    forest, linear, overlaps = settings(experiments.forest_grid(spark)), settings(experiments.linear_grid(spark)), (0.25, 0.125, 0.5)
    if args.quick:
        forest, linear, overlaps = [{"n_estimators": 20, "max_depth": 10}], [{"learning_rate": 0.005, "batch_size": 32, "epochs": 10}], (0.25,)
    standard = {FOREST: forest[0], LINEAR: linear[0]} if args.quick else workflow.STANDARD
    base, embedders = Params(model="hashing", representation=args.representation, size=args.size), {"hashing": embed.HashingEmbedder(args.dimensions)}
    rows = workflow.search(files, flags, embedders, base, forest, linear, overlaps, standard, ChunkCache(f"{args.out}/cache"), f"{args.out}/runs", args.parallel)
    write_text(spark, f"{args.out}/runs.json", "\n".join(json.dumps(r) for r in rows) + "\n")
    ok = [r for r in rows if r["status"] == "success"]
    for r in sorted(ok, key=lambda r: (-round(r["f1"], 4), r["experiment_id"]))[:5]:
        print(f"{r['experiment_id']}: F1 {r['f1']:.4f}, {r['classifier_type']}, overlap {r['overlap_proportion']:g}, {r['hyperparameters']}")
    return 0 if ok else 1


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "scan-reports":
        found = sources.scan_reports(spark, args.root).collect()  # one row for each report
        for r in found:
            print(f"{r.folder}: threshold {r.threshold if r.threshold is None else format(r.threshold, '.3f')}, F1 {r.f1:.6f}")
        return 0 if found else 1
    if args.command in ("train", "scan", "search"):
        return {"train": train, "scan": scan, "search": search}[args.command](spark, args)
    if args.command == "split":
        kept = splits.Splits(args.out)
        if args.reset:
            kept.reset(spark)
            return 0
        found = relative(sources.list_files(spark, args.root), args.root)
        dealt = kept.prepare(found.withColumn("stratum", splits.stratum(F.col("path"))), args.n, args.seed)
        for r in dealt.groupBy("stratum", "split").count().orderBy("stratum", "split").collect():
            print(f"{r.stratum}: {r['count']} {r.split}")
        return 0
    read = sources.read_sources(spark, args.root, drop_bad=True)
    text = read.select(F.col("path").alias("file"), represent("graph", F.col("content"), F.col("lang")).alias("text"))
    if args.out:
        sinks.write_representations(text, args.out)
    else:
        for r in text.orderBy("file").toLocalIterator():
            print(r.text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
