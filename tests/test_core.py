"""Core operators: hand-made cases, brute force and invariants."""

import base64
import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkwright.config import DISCARDED, FOREST, LINEAR, POSITIVE, UNRELATED, Params
from chunkwright.functions import represent as R
from chunkwright.functions import text as X
from chunkwright.functions.arrays import prefix_sums
from chunkwright.operators import chunking, classify, embed, evaluate, experiments, labels, mining, report, substring
from chunkwright.plans import golden, queries, workflow
from chunkwright.sources import cache, sinks
from chunkwright.sources import files as sources
from chunkwright.streaming import drop_folder


def test_params():
    p = Params()
    assert (p.chunk_size, p.overlap, p.stride, p.model_tag, p.overlap_tag) == (512, 128, 384, "codebert_base", "overlap_1_4")
    big = Params(model="Qwen/Qwen2.5-7B-Instruct", overlap_proportion=0.125)
    assert (big.chunk_size, big.overlap, big.overlap_tag) == (8192, 1024, "overlap_1_8")
    assert Params(model="x").chunk_size == 512 and Params(overlap_proportion=0).overlap_tag == "overlap_none"


def test_languages_and_keys(spark):
    paths = ["a/b.c", "b.h", "x/y/z.cpp", "q.hpp", "q.hh", "q.cc", "q.cxx", "q.py", "q.java", "q", "c.c.txt"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", X.language(F.col("p")).alias("l"), X.wide_language(F.col("p")).alias("w"), X.path_tail(F.col("p")).alias("k"), X.basename(F.col("p")).alias("b")).collect()
    assert [r.l for r in rows] == ["c", "c", "cpp", "cpp", "cpp", "cpp", None, None, None, None, None]
    assert [r.w for r in rows][6:9] == ["cpp", "python", "java"]
    assert [r.k for r in rows][:3] == ["a/b.c", "b.h", "y/z.cpp"] and rows[2].b == "z.cpp"


def test_comments(spark):
    cases = [('a // "x" \nb', "c", "a \nb"), ("a /* // */ b", "c", "a /* "), ("x//1\r\ny", "cpp", "x\ny"), ("/* open", "c", "/* open"), ("a // b", None, "a // b"), (None, "c", None)]
    got = [r[0] for r in spark.createDataFrame([c[:2] for c in cases], "t string, l string").select(X.strip_comments(F.col("t"), F.col("l"))).collect()]
    assert got == [c[2] for c in cases]


@pytest.mark.parametrize("size,stride", [(4, 3), (4, 4), (5, 2)])
def test_windows(spark, size, stride):
    rows = spark.createDataFrame([(n, list(range(n))) for n in range(0, 14)], "n int, ids array<int>").select("n", "ids", chunking.windows(F.col("ids"), size, stride).alias("w")).collect()
    for r in rows:
        assert [list(w) for w in r.w] == [r.ids[i : i + size] for i in range(0, r.n, stride)]
        assert len(r.w) == math.ceil(r.n / stride)
        assert [x for w in r.w for x in w[:stride]] == r.ids


def brute_sweep(scores):
    out = []
    for k in range(5, 1000):
        t = k / 1000
        n = lambda g, hit: sum(gg == g and (s >= t) == hit for gg, s in scores)
        tp, fn, utn, ufp, dtn, dfp = n(POSITIVE, True), n(POSITIVE, False), n(UNRELATED, False), n(UNRELATED, True), n(DISCARDED, False), n(DISCARDED, True)
        p = tp / (tp + ufp + dfp) if tp + ufp + dfp else 0.0
        r = tp / (tp + fn) if tp + fn else 0.0
        out.append((t, tp, fn, utn, ufp, dtn, dfp, 2 * p * r / (p + r) if p + r else 0.0))
    return out


@pytest.mark.parametrize("kind", ["mixed", "none", "negatives", "positives", "equal"])
def test_sweeps_and_points_against_brute_force(spark, kind):
    rng = random.Random(kind)
    groups = {"negatives": [UNRELATED, DISCARDED], "positives": [POSITIVE]}.get(kind, [POSITIVE, UNRELATED, DISCARDED])
    values = lambda: rng.choice([0.0, 1.0, 0.004, rng.randint(0, 1000) / 1000, rng.random()])
    scores = [] if kind == "none" else [(rng.choice(groups), 0.5 if kind == "equal" else values()) for _ in range(60)]
    df = spark.createDataFrame([(str(i), g, s) for i, (g, s) in enumerate(scores)], "file string, grp string, max_score double")
    want = brute_sweep(scores)
    names = ["threshold", *evaluate.COUNTS, "f1"]
    for sweep in (evaluate.threshold_sweep(df), evaluate.sweep_by_grid(df)) if scores else (evaluate.threshold_sweep(df),):
        got = sorted(tuple(r[n] for n in names) for r in sweep.collect())
        assert got == want
    points = {r.point: tuple(r[n] for n in names) for r in evaluate.operating_points(evaluate.threshold_sweep(df)).collect()}
    assert points["best_f1"] == min(want, key=lambda w: (-w[7], w[0]))
    assert points["min_fn"] == min(want, key=lambda w: (w[2], -w[7], w[0]))
    assert points["min_fp"] == min(want, key=lambda w: (w[4] + w[6], -w[7], w[0]))


def test_file_scores(spark):
    nan = float("nan")
    s = spark.createDataFrame([("a", POSITIVE, 0.2), ("a", POSITIVE, nan), ("b", POSITIVE, nan), ("c", UNRELATED, None)], "file string, grp string, probability double")
    f = spark.createDataFrame([("a", POSITIVE), ("b", POSITIVE), ("c", UNRELATED), ("d", UNRELATED)], "file string, grp string")
    assert {r.file: r.max_score for r in evaluate.file_max_score(s, f).collect()} == {"a": 0.2, "b": 0.0, "c": 0.0, "d": 0.0}
    arrays = spark.createDataFrame([([0.2, nan],), ([nan],), ([None],), ([],), ([-1.0],)], "x array<double>").select(evaluate.greatest_score(F.col("x")).alias("m"))
    assert [r.m for r in arrays.collect()] == [0.2, 0.0, 0.0, 0.0, 0.0]


def test_split_is_exact_and_stable(spark):
    rows = [(i, "big" if i < 900 else "small") for i in range(920)]
    df = spark.createDataFrame(rows, "id long, grp string")
    one = {(r.id): r.split for r in labels.exact_split(df, "grp", "id", 50, 1).collect()}
    two = {(r.id): r.split for r in labels.exact_split(df.repartition(7), "grp", "id", 50, 1).collect()}
    assert one == two and len(one) == 920
    assert sum(v == "evaluation" for k, v in one.items() if k < 900) == 50
    assert all(v == "evaluation" for k, v in one.items() if k >= 900)
    assert one != {r.id: r.split for r in labels.exact_split(df, "grp", "id", 50, 2).collect()}


def test_label_lookups(spark):
    inv = ["x/training/crypto/a.c", "x/evaluation/non_crypto_dataset/a.c", "x/evaluation/discarded_dataset/b.c"]
    df = spark.createDataFrame(list(enumerate(inv)), "ord int, path string").select("ord", "path", *labels.label_flags(F.col("path")))
    got = {r.file_key: (r.training, r.crypto, r.discarded) for r in labels.lookup_labels_by_substring(spark.createDataFrame([("a.c",), ("b.c",), ("none",)], "file_key string"), df).collect()}
    assert got == {"a.c": (True, True, False), "b.c": (False, False, True), "none": (False, False, False)}


@pytest.mark.parametrize("q", [1, 3, 4])
def test_substring_index_against_all_pairs(spark, q):
    rng = random.Random(q)
    word = lambda n: "".join(rng.choice("ab/é") for _ in range(n))
    paths = [(i * 3 % 61, word(rng.randrange(12))) for i in range(61)] + [(99, None)]
    keys = [word(rng.randrange(7)) for _ in range(150)] + ["", "", None, "zzzzzz", "z", "aaaaaaa" * 9]
    inventory = spark.createDataFrame(paths, "ord long, path string")
    asked = spark.createDataFrame([(k,) for k in keys], "file_key string")
    found = substring.first_containing(asked, inventory, q)
    want = {k: min(o for o, p in paths if p is not None and k in p) for k in set(keys) - {None} if any(p is not None and k in p for _, p in paths)}
    assert {r.file_key: r.ord for r in found.collect()} == want and found.count() == len(want)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    flagged = labels.lookup_labels_by_substring(asked, inventory.select("ord", "path", *labels.label_flags(F.col("path"))), q)
    assert flagged.count() == len(keys)
    assert substring.first_containing(asked.limit(0), inventory, q).count() == substring.first_containing(asked, inventory.limit(0), q).count() == 0


def test_triplets(spark):
    df = lambda n, at=0: spark.createDataFrame([(f"k{i + at}",) for i in range(n)], "k string")
    for n, m in ((0, 3), (1, 3), (2, 3), (40, 10)):
        got = mining.triplets(df(n), df(m, 1000), "k", 5).collect()
        assert len(got) == (n if n > 1 else 0)
        assert all(r.anchor != r.positive for r in got) and len({r.anchor for r in got}) == len(got)
        assert sum(r.negative is not None for r in got) == min(len(got), m)


def test_representation(spark):
    code = "int total = 0; // sum\nfor (int i = 0; i < LIMIT_A; i++) {\n  total += i * 2;\n}\nbefore(x) {\n}\nABCD = total;\n}"
    got = spark.createDataFrame([(code, "c")], "t string, l string").select(R.data_flow_text(F.col("t"), F.col("l"))).first()[0]
    assert got.split("\n") == [
        "v3 = 0",
        "LOOP_START_DEPTH_1",
        "for (v2 = 0; v2 < CONST_LIMIT_A; v2++) {",
        "v3 += v2 * 2",
        "LOOP_END_DEPTH_1",
        "LOOP_START_DEPTH_1",
        "LOOP_END_DEPTH_1",
        "v0 = v3",
    ]
    row = spark.createDataFrame([("a", None)], "t string, l string")
    assert row.select(R.represent("text", F.col("t"), F.col("l"))).first()[0] == "a"
    assert row.select(R.represent("graph", F.col("t"), F.col("l"))).first()[0] == ""


def test_golden_ranking(spark):
    runs = golden.runs(spark)
    shown = {r.experiment_id: r for r in experiments.export_columns(runs).collect()}
    assert (shown[12].val_f1, shown[12].val_precision, shown[12].val_recall, shown[12].val_accuracy) == ("0.9592", "0.9792", "0.9400", "0.9733")
    assert (shown[6].val_f1, shown[6].val_accuracy) == ("0.9423", "0.9600") and shown[99].val_f1 == "0.0000"
    best = {r.classifier_type: (r.rank, r.experiment_id) for r in experiments.best_per_classifier(runs).collect()}
    assert best == {FOREST: (1, 12), LINEAR: (2, 6)}
    ranks = {r.experiment_id: r["rank"] for r in experiments.ranking(runs).collect()}
    assert ranks[12] == "1" and ranks[99] == "N/A" and len(ranks) == len(golden.rows())
    none = experiments.mean_f1(runs.where("status = 'failed'"), "embedding_model")
    assert experiments.choose(none, "embedding_model", "fallback").first()[0] == "fallback"


def test_grids_choices_and_totals(spark):
    forests, linears = experiments.forest_grid(spark), experiments.linear_grid(spark)
    assert forests.distinct().count() == 27 and linears.distinct().count() == 48
    done = [(100, 10, m, True, True) for m in (1, 2, 5)] + [(300, 10, 1, True, False), (300, 10, 2, False, True)]
    keys = ("n_estimators", "max_depth", "min_samples_leaf")
    left = experiments.still_to_run(forests, spark.createDataFrame(done, "n_estimators int, max_depth int, min_samples_leaf int, has_config boolean, has_evaluation boolean"), *keys)
    assert {tuple(r) for r in left.collect()} == {tuple(r) for r in forests.collect()} - {(100, 10, m) for m in (1, 2, 5)}
    runs = golden.runs(spark)
    ok = [r for r in runs.collect() if r.status == "success"]
    mean = lambda key, rows: {k: sum(r.val_f1 for r in rows if r[key] == k) / sum(r[key] == k for r in rows) for k in {r[key] for r in rows}}
    assert {r.embedding_model: round(r.mean_f1, 9) for r in experiments.mean_f1(runs, "embedding_model").collect()} == {k: round(v, 9) for k, v in mean("embedding_model", ok).items()}
    first, second = [r for r in ok if r.experiment_id <= 6], [r for r in ok if 5 <= r.experiment_id <= 10]
    for key, some, default in (("embedding_model", first, "x"), ("overlap_proportion", second, 0.25)):
        means = mean(key, some)
        ids = [r.experiment_id for r in some]
        chosen = experiments.choose(experiments.mean_f1(runs.where(F.col("experiment_id").isin(ids)), key), key, default).first()[0]
        assert chosen == max(means, key=lambda k: means[k])
    tags = golden.runs(spark).select("embedding_model", "overlap_proportion", X.model_tag(F.col("embedding_model")).alias("m"), X.overlap_tag(F.col("overlap_proportion")).alias("o"))
    assert all((r.m, r.o) == (Params(model=r.embedding_model).model_tag, Params(overlap_proportion=r.overlap_proportion).overlap_tag) for r in tags.collect())


def test_parameters_text(spark):
    df = spark.createDataFrame([(1, {"trees": "5"})], "experiment_id int, hyperparameters map<string,string>")
    flat = experiments.flatten_parameters(df, ["trees", "depth"])
    assert flat.columns == ["experiment_id", "param_trees", "param_depth"]
    assert flat.select(experiments.parameter_text(flat)).first()[0] == "trees=5, depth="


def test_report_round_trip(spark):
    text = "</script> \"quoted\" 'é😀'\r\nline 2"
    scores = spark.createDataFrame([("f", POSITIVE, 0, 0.25, text), ("f", POSITIVE, 1, 0.75, "b"), ("g", UNRELATED, 0, 0.5, "c")], "file string, grp string, chunk_index int, probability double, clear_text string")
    back = {r.file: r.entry for r in report.decode(report.encode(report.entry_json(scores))).collect()}
    assert back["f"].chunks[0].clear_text == text and back["f"].max_score == 0.75
    stats = evaluate.best_f1_point(evaluate.threshold_sweep(evaluate.file_max_score(scores)))
    payload = report.whole_payload(scores, stats, "text", LINEAR, 0.95)
    data = json.loads(base64.b64decode(payload))
    assert data["files"]["f"]["chunks"][0]["clear_text"] == text and data["config"]["default_threshold"] == 0.95
    page = report.render(payload, 0.5, 0.25, 0.75, 0.95, POSITIVE)
    assert payload in page and "</script> " not in page.split("payload-data")[1].split("</script>")[0]
    assert [r.line for r in report.chunk_lines(scores, "f", 0).collect()] == text.split("\r\n")
    assert report.file_details(scores, "f", 0.5).first().html.startswith("&lt;/script&gt;")
    assert [r.file for r in report.list_files(evaluate.file_max_score(scores), 0.6, search="G").collect()] == ["g"]


def test_report_and_source_files(spark, tmp_path):
    (tmp_path / "src" / "sub").mkdir(parents=True)
    for name, body in {"a.c": b"int x;", "sub/b.hpp": b"y \xff z", "c.py": b"no"}.items():
        (tmp_path / "src" / name).write_bytes(body)
    rows = {r.path.rsplit("/", 1)[1]: (r.lang, r.content) for r in sources.read_sources(spark, str(tmp_path / "src")).collect()}
    assert rows == {"a.c": ("c", "int x;"), "b.hpp": ("cpp", "y � z")}
    assert sources.list_files(spark, str(tmp_path / "src")).count() == 3 and sources.list_files(spark, str(tmp_path / "none")).count() == 0
    gone = spark.createDataFrame([("p",), ("q",)], "path string")
    assert [r.path for r in sources.missing_files(gone, gone.where("path = 'p'")).collect()] == ["q"]
    scores = spark.createDataFrame([("f", POSITIVE, 0, 0.5, "t")], "file string, grp string, chunk_index int, probability double, clear_text string")
    payload = report.whole_payload(scores, spark.createDataFrame([(0.5,)], "best double"), "text", LINEAR, 0.95)
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "r.html").write_text(report.render(payload, 0.5, 0.5, 0.5, 0.95, POSITIVE))
    (tmp_path / "html" / "bad.html").write_text("<p>nothing</p>")
    got = {r.path.rsplit("/", 1)[1]: r.payload for r in sources.read_reports(spark, str(tmp_path / "html"), "stats STRUCT<best: DOUBLE>").collect()}
    assert got["r.html"].stats.best == 0.5 and got["bad.html"] is None
    (tmp_path / "runs" / "1").mkdir(parents=True)
    (tmp_path / "runs" / "1" / "config.json").write_text('{"id": 3,\n "name": "n"}')
    assert sources.read_json_artefacts(spark, str(tmp_path / "runs"), "config.json", "id INT, name STRING").first().id == 3
    sinks.write_group_json(scores, str(tmp_path / "json"))
    sinks.write_csv(scores, str(tmp_path / "csv"))
    sinks.write_table(scores, str(tmp_path / "pq"), "grp")
    assert spark.read.json(str(tmp_path / "json")).first().grp == POSITIVE and spark.read.parquet(str(tmp_path / "pq")).count() == 1


def test_classifiers_and_embedders(spark, tmp_path):
    rng = random.Random(0)
    rows = spark.createDataFrame([(i, [rng.gauss(i % 2, 0.3), rng.gauss(0, 1)], float(i % 2)) for i in range(80)], "id int, embedding array<float>, label double")
    for name, hyper in ((FOREST, {"n_estimators": 5, "max_depth": None}), (LINEAR, {"learning_rate": 0.05, "epochs": 20})):
        model = classify.get_classifier(name, **hyper)
        with pytest.raises(classify.NotTrainedError):
            model.score(rows)
        scored = model.fit(rows).score(rows)
        assert scored.where((F.col("probability") >= 0.5) == (F.col("label") == 1)).count() >= 72
        assert model.score(rows.limit(0)).count() == 0
        path = str(tmp_path / name)
        assert not classify.get_classifier(name).load(path)
        model.save(path)
        again = classify.get_classifier(name)
        assert again.load(path) and again.score(rows).orderBy("id").collect() == scored.orderBy("id").collect()
    with pytest.raises(ValueError):
        classify.get_classifier("other")
    chunks = spark.createDataFrame([("f", 0, ["a", "b", "a"]), ("f", 1, [])], "file string, chunk_index int, tokens array<string>")
    v = [r.embedding for r in embed.HashingEmbedder(8).embed(chunks).orderBy("chunk_index").collect()]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-5 and not any(v[1])
    out = embed.CallableEmbedder(lambda: lambda batch: [[len(t), 1.0] for t in batch]).embed(chunks).orderBy("chunk_index").collect()
    assert [list(r.embedding) for r in out] == [[3.0, 1.0], [0.0, 1.0]]


def test_workflow_end_to_end(spark, tmp_path):
    rng = random.Random(1)
    rows, flags = [], []
    for i in range(60):
        folder, word = [("training/crypto", "key"), ("training/non_crypto_dataset", "pixel"), ("evaluation/novel_crypto", "key"), ("evaluation/non_crypto_dataset", "pixel")][i % 4]
        rows.append((f"{folder}/{i}.c", "c", " ".join(rng.choice([word, "x", "y"]) for _ in range(40))))
        flags.append((f"{folder}/{i}.c",))
    files = spark.createDataFrame(rows, "file string, lang string, content string")
    marks = spark.createDataFrame(flags, "file string").select("file", *labels.label_flags(F.col("file")))
    p, store = Params(size=16, hyperparameters={"learning_rate": 0.05, "epochs": 15}), cache.ChunkCache(str(tmp_path / "store"))
    e = workflow.train_and_evaluate(files, marks, embed.HashingEmbedder(16), p, store)
    assert e.points["best_f1"]["f1"] == 1.0 and e.points["best_f1"]["tp"] == 15
    embedded = workflow.embed_files(files, embed.HashingEmbedder(16), p, store)
    model = workflow.train(embedded, marks, p)
    scanned = workflow.scan_code_base(files, embed.HashingEmbedder(16), model, p).collect()
    assert len(scanned) == 60
    assert workflow.mine_triplets(embedded, marks, model, Params(size=16, threshold=0.5)).count() > 10
    found = workflow.search(files, marks, {"m": embed.HashingEmbedder(16)}, Params(model="m", size=16), [{"n_estimators": 3}], [{"epochs": 5}, {"bad": 1}], overlaps=(0.25,), cache=store)
    assert [r["status"] for r in found] == ["success"] * 4 + ["failed"] and "experiment_id" in found[0]


def test_streaming_file_scores(spark, tmp_path):
    folder, schema, out = str(tmp_path / "drop"), "file string, text string", str(tmp_path / "scores")
    score = lambda text: F.when(text.startswith("nan"), F.lit(float("nan"))).otherwise(queries.score_of(text))
    assert drop_folder.current(spark, out).count() == 0
    spark.createDataFrame([("a", "one two three four five"), ("b", "x"), ("n", "nan")], schema).write.parquet(folder)
    running = drop_folder.running_file_scores(drop_folder.stream_documents(spark, folder, schema), score, 3, 2)
    q = drop_folder.start(running, out, str(tmp_path / "check"))
    q.processAllAvailable()
    spark.createDataFrame([("a", "six seven")], schema).write.mode("append").parquet(folder)
    q.processAllAvailable()
    q.stop()
    got = {r.file: r for r in drop_folder.current(spark, out).collect()}
    assert {f: r.n_chunks for f, r in got.items()} == {"a": 4, "b": 1, "n": 1} and got["n"].max_score == 0.0
    everything = spark.read.parquet(folder)
    chunks = chunking.chunk(chunking.tokenize(everything), 3, 2).select("file", score(F.array_join("tokens", " ")).alias("p"))
    want = {r.file: r.m for r in chunks.where(~F.isnan("p")).groupBy("file").agg(F.max("p").alias("m")).collect()}
    assert all(abs(got[f].max_score - m) < 1e-12 for f, m in want.items())


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=150))
def test_prefix_sums_property(spark, values):
    df = spark.createDataFrame([(values,)], "a array<bigint>").select(F.expr(prefix_sums("a")))
    assert df.first()[0] == [sum(values[:i]) for i in range(len(values) + 1)]


def test_staged_tables_can_be_dropped(spark):
    from chunkwright.session import drop_staged, stage_table

    assert stage_table(spark.range(3), "t").count() == 3
    assert drop_staged(spark) >= 1 and drop_staged(spark) == 0


def test_entry_and_queries_have_matching_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3
