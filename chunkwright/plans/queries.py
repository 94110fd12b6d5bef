"""Every operator as a query over the given tables, with its DuckDB equivalent where SQL can express it.

Documents stand in for files, labels for their groups, embeddings for embedded chunks. A chunk's score is the sigmoid of a closed form of its text, so both engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import FOREST, LINEAR, Params
from ..functions import represent as R
from ..functions import text as X
from ..operators import chunking, classify, embed, evaluate, experiments, labels, metric, minibatch, mining, report
from ..session import new_shared_path
from ..sources import cache, splits
from ..sources.tables import table
from . import workflow

SIZE, STRIDE, SEED = 128, 96, 20240601
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Files ------------------------------------------------------------------------------------------------------

SUFFIXES = (".c", ".h", ".cpp", ".hpp", ".hh", ".cc", ".cxx", ".py", "")
FOLDERS = ("data/training/crypto/", "data/evaluation/novel_crypto/", "data/training/non_crypto_dataset/", "data/evaluation/non_crypto_dataset/", "data/evaluation/discarded_dataset/", "data/other/")


def files(spark: SparkSession, base: str) -> DataFrame:
    """(file, path, text) of every document, with a path of its own."""
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % n + 1).cast("int"))
    docs = table(spark, base, "documents").select("doc_id", "text", "source")
    path = F.concat(pick(FOLDERS, 6), F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), pick(SUFFIXES, 9))
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("file"), path.alias("path"), "text")


def _list(xs: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


FILES = f"""files AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS file, text,
  ({_list(FOLDERS)})[doc_id % 6 + 1] || source || '/f' || doc_id || ({_list(SUFFIXES)})[doc_id % 9 + 1] AS path FROM documents)"""
LANG = """CASE WHEN regexp_matches(path, '\\.(c|h)$') THEN 'c' WHEN regexp_matches(path, '\\.(cpp|hpp|hh|cc)$') THEN 'cpp' END"""
TAIL = "array_to_string(string_split(path, '/')[-2:], '/')"


@query(f"WITH {FILES} SELECT path, {LANG} AS lang FROM files WHERE {LANG} IS NOT NULL")
def lang_filter(spark, base):
    return files(spark, base).select("path", X.language(F.col("path")).alias("lang")).where("lang IS NOT NULL")


@query(f"WITH {FILES} SELECT path, {TAIL} AS file_key FROM files")
def path_tail_key(spark, base):
    return files(spark, base).select("path", X.path_tail(F.col("path")).alias("file_key"))


FLAGS_SQL = """contains(path, 'training') AS training, contains(path, 'evaluation') AS evaluation,
  contains(path, 'training/crypto') OR contains(path, 'evaluation/novel_crypto') AS crypto,
  contains(path, 'discarded_dataset') AS discarded, contains(path, 'non_crypto_dataset') AS non_crypto"""


@query(f"WITH {FILES} SELECT path, {FLAGS_SQL} FROM files")
def label_flags(spark, base):
    return files(spark, base).select("path", *labels.label_flags(F.col("path")))


# Every file is listed where it lies, and every third one in a training folder too, under the same key.
@query(f"""WITH {FILES}, listed AS (SELECT path FROM files UNION ALL SELECT 'data/training/crypto/' || {TAIL} FROM files WHERE doc_id % 3 = 0),
inventory AS (SELECT {TAIL} AS file_key, path, {FLAGS_SQL} FROM listed),
firsts AS (SELECT file_key, {', '.join(f'arg_min({f}, path) AS {f}' for f in labels.FLAGS)} FROM inventory GROUP BY file_key)
SELECT f.path, {', '.join(f'coalesce({f}, false) AS {f}' for f in labels.FLAGS)} FROM files f LEFT JOIN firsts ON file_key = {TAIL.replace('path', 'f.path')}""")
def label_lookup(spark, base):
    f = files(spark, base).select("doc_id", "path", X.path_tail(F.col("path")).alias("file_key"))
    again = f.where("doc_id % 3 = 0").select(F.concat(F.lit("data/training/crypto/"), "file_key").alias("path"))
    listed = f.select("path").unionByName(again).select("path", X.path_tail(F.col("path")).alias("file_key"))
    inventory = listed.select("path", "file_key", *labels.label_flags(F.col("path")))
    return labels.lookup_labels(f.select("path", "file_key"), inventory).drop("file_key")


# The inventory lists every file where it lies and every third one in a training folder first; keys are tails of paths, names alone, and short ones.
_LISTED = f"""listed AS (SELECT doc_id * 2 + 1 AS ord, path FROM files UNION ALL SELECT doc_id * 2, 'data/training/crypto/' || {TAIL} FROM files WHERE doc_id % 3 = 0),
flagged AS (SELECT ord, path AS inv_path, {FLAGS_SQL} FROM listed),
keys AS (SELECT {TAIL} AS file_key FROM files UNION ALL SELECT list_extract(string_split(path, '/'), -1) FROM files UNION ALL SELECT left(text, 3) FROM files)"""


@query(f"""WITH {FILES}, {_LISTED}, firsts AS (SELECT k.file_key, min(ord) AS ord FROM (SELECT DISTINCT file_key FROM keys) k JOIN flagged ON contains(inv_path, k.file_key) GROUP BY k.file_key)
SELECT keys.file_key, {', '.join(f'coalesce({f}, false) AS {f}' for f in labels.FLAGS)} FROM keys LEFT JOIN firsts USING (file_key) LEFT JOIN flagged USING (ord)""")
def label_join_first_match(spark, base):
    f = files(spark, base)
    tail = X.path_tail(F.col("path"))
    again = f.where("doc_id % 3 = 0").select((F.col("doc_id") * 2).alias("ord"), F.concat(F.lit("data/training/crypto/"), tail).alias("path"))
    inventory = f.select((F.col("doc_id") * 2 + 1).alias("ord"), "path").unionByName(again).select("ord", "path", *labels.label_flags(F.col("path")))
    keys = [f.select(k.alias("file_key")) for k in (tail, F.element_at(F.split("path", "/"), -1), F.left("text", F.lit(3)))]
    return labels.lookup_labels_by_substring(keys[0].unionByName(keys[1]).unionByName(keys[2]), inventory)


@query(f"""WITH {FILES}, flagged AS (SELECT path, {FLAGS_SQL} FROM files), routed AS (SELECT path, CASE WHEN evaluation AND crypto THEN 'novel_crypto'
  WHEN evaluation AND non_crypto THEN 'non_crypto_unrelated' WHEN evaluation AND discarded THEN 'non_crypto_discarded' END AS grp FROM flagged)
SELECT path, grp FROM routed WHERE grp IS NOT NULL""")
def eval_group_route(spark, base):
    flagged = files(spark, base).select("path", *labels.label_flags(F.col("path")))
    return flagged.select("path", labels.evaluation_group().alias("grp")).where("grp IS NOT NULL")


@query(f"""WITH {FILES}, flagged AS (SELECT path, {FLAGS_SQL} FROM files)
SELECT path, CASE WHEN crypto THEN 1 ELSE 0 END AS label FROM flagged WHERE training AND (crypto OR non_crypto OR discarded)""")
def training_rows(spark, base):
    flagged = files(spark, base).select("path", *labels.label_flags(F.col("path")))
    pos = flagged.where(labels.is_training_positive()).select("path", F.lit(1).alias("label"))
    return pos.unionByName(flagged.where(labels.is_training_negative()).select("path", F.lit(0).alias("label")))


def grouped_documents(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, file, text, grp) of all documents; the group of those without a label is null."""
    docs, marks = table(spark, base, "documents").select("doc_id", "text"), table(spark, base, "labels").select("doc_id", labels.group_from_labels().alias("grp"))
    return docs.join(marks, "doc_id", "left").select("doc_id", F.col("doc_id").cast("string").alias("file"), "text", "grp")


GROUP_SQL = "CASE WHEN toxic = 1 THEN 'novel_crypto' WHEN quality = 1 THEN 'non_crypto_unrelated' WHEN quality = 0 THEN 'non_crypto_discarded' END"
GROUPED = f"grouped AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS file, text, {GROUP_SQL} AS grp FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"""WITH {GROUPED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('{SEED}|' || doc_id), doc_id) AS r FROM grouped WHERE grp IS NOT NULL)
SELECT doc_id, grp, CASE WHEN r <= 50 THEN 'evaluation' ELSE 'training' END AS split FROM ranked""")
def split_exact_n(spark, base):
    return labels.exact_split(grouped_documents(spark, base).where("grp IS NOT NULL").select("doc_id", "grp"), "grp", "doc_id", 50, SEED).select("doc_id", "grp", "split")


@query("SELECT md5('20240601|' || doc_id) AS ord_key, doc_id FROM documents")
def shuffle_order(spark, base):
    return table(spark, base, "documents").select(labels.seeded_order(SEED, "doc_id").alias("ord_key"), "doc_id")


_STRATA = ("training/crypto", "training/non_crypto/non_crypto_dataset", "training/non_crypto/discarded_dataset")
_STRATUM_NAMES = tuple(splits.FOLDERS)


@query(f"""WITH tree AS (SELECT ({_list(_STRATA)})[doc_id % 3 + 1] || '/' || source || '/f' || doc_id || '.c' AS path, ({_list(_STRATUM_NAMES)})[doc_id % 3 + 1] AS stratum, doc_id % 10 < 2 AS old FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum, old ORDER BY md5('{SEED}|' || path)) AS r FROM tree),
held AS (SELECT stratum, count(*) FILTER (old AND r <= 50) AS held FROM ranked GROUP BY stratum),
dealt AS (SELECT path, stratum, CASE WHEN CASE WHEN old THEN r <= 50 ELSE r <= 50 - held END THEN 'evaluation' ELSE 'training' END AS split FROM ranked JOIN held USING (stratum))
SELECT path, stratum, split, CASE WHEN split = 'training' THEN path WHEN stratum = 'novel_crypto' THEN replace(path, 'training/crypto/', 'evaluation/novel_crypto/') ELSE replace(path, 'training/', 'evaluation/') END AS place FROM dealt""")
def versioned_split(spark, base):
    """The split of all documents after one of the tree as it was, when a fifth of them were there."""
    pick = F.element_at(F.array(*map(F.lit, _STRATA)), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat(pick, F.lit("/"), "source", F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".c"))
    tree = table(spark, base, "documents").select(path.alias("path"), (F.col("doc_id") % 10 < 2).alias("old")).withColumn("stratum", splits.stratum(F.col("path")))
    kept = splits.Splits(new_shared_path(spark, "splits"))
    kept.prepare(tree.where("old"), 50, SEED)
    return kept.prepare(tree, 50, SEED).withColumn("place", splits.place(F.col("path"), F.col("stratum"), F.col("split")))


# Chunks and scores --------------------------------------------------------------------------------------------

TOKENS = "regexp_extract_all(text, '[^ \\t\\r\\n\\f]+')"
CHUNKS = f"""tok AS (SELECT file, grp, {TOKENS} AS t FROM grouped),
chunks AS (SELECT file, grp, i AS chunk_index, t[i * {STRIDE} + 1 : i * {STRIDE} + {SIZE}] AS tokens
  FROM (SELECT file, grp, t, unnest(range(CAST(ceil(len(t) / {STRIDE}.0) AS BIGINT))) AS i FROM tok))"""
SCORES = f"""{GROUPED}, {CHUNKS}, scores AS (SELECT file, grp, CAST(chunk_index AS INTEGER) AS chunk_index, array_to_string(tokens, ' ') AS clear_text,
  round(1 / (1 + exp(-((length(array_to_string(tokens, ' ')) * 7 % 101) / 20.0::DOUBLE - 2.0::DOUBLE))), 6) AS probability FROM chunks),
file_scores AS (SELECT g.file, g.grp, coalesce(max(probability), 0.0) AS max_score FROM grouped g LEFT JOIN scores s ON s.file = g.file WHERE g.grp IS NOT NULL GROUP BY g.file, g.grp)"""


def chunks_of(spark: SparkSession, base: str) -> DataFrame:
    tok = chunking.tokenize(grouped_documents(spark, base))
    return tok.select("file", "grp", F.posexplode(chunking.windows(F.col("tokens"), SIZE, STRIDE)).alias("chunk_index", "tokens"))


def score_of(text: Column) -> Column:
    return F.round(X.sigmoid((F.char_length(text) * 7 % 101) / F.lit(20.0) - 2.0), 6)


def scores_of(spark: SparkSession, base: str) -> DataFrame:
    text = F.array_join("tokens", " ")
    return chunks_of(spark, base).select("file", "grp", "chunk_index", text.alias("clear_text"), score_of(text).alias("probability"))


def file_scores_of(spark: SparkSession, base: str) -> DataFrame:
    """Of the files that have a group. A file's greatest score comes from its own row: the join with the groups is the only shuffle."""
    files = grouped_documents(spark, base).where("grp IS NOT NULL").select("file", "grp", "text")
    found = F.transform(chunking.windows(X.tokens(F.col("text")), SIZE, STRIDE), lambda w: score_of(F.array_join(w, " ")))
    return files.select("file", "grp", evaluate.greatest_score(found).alias("max_score"))


@query(f"SELECT doc_id, len({TOKENS}) AS n_tokens FROM documents")
def tokens_count(spark, base):
    return table(spark, base, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"WITH {GROUPED}, {CHUNKS} SELECT file, chunk_index, array_to_string(tokens, ' ') AS clear_text, len(tokens) AS n FROM chunks")
def chunk_windows(spark, base):
    return chunks_of(spark, base).select("file", F.col("chunk_index").cast("long").alias("chunk_index"), F.array_join("tokens", " ").alias("clear_text"), F.size("tokens").cast("long").alias("n"))


_CONTENTS = "contents AS (SELECT doc_id, coalesce(text, '') AS content FROM documents)"


@query(f"""WITH {GROUPED}, {CHUNKS}, {_CONTENTS}, new AS (SELECT count(DISTINCT content) AS n FROM contents WHERE doc_id % 20 = 0 AND content NOT IN (SELECT content FROM contents WHERE doc_id % 20 <> 0))
SELECT file, chunk_index, array_to_string(tokens, ' ') AS clear_text, n AS n_embedded FROM chunks, new""")
def cached_chunks(spark, base):
    """Chunks of all documents, of which those of every twentieth have changed since the last time and are embedded anew."""
    now = files(spark, base).select("file", F.lit(None).cast("string").alias("lang"), F.col("text").alias("content"))
    before = now.withColumn("content", F.when(F.col("file").cast("long") % 20 == 0, F.concat(F.coalesce("content", F.lit("")), F.lit(" before"))).otherwise(F.col("content")))
    kept, p = cache.ChunkCache(new_shared_path(spark, "cache")), Params(size=SIZE, overlap_proportion=(SIZE - STRIDE) / SIZE)
    workflow.embed_files(before, embed.HashingEmbedder(8), p, kept)
    chunks = workflow.embed_files(now, embed.HashingEmbedder(8), p, kept)
    return chunks.select("file", F.col("chunk_index").cast("long").alias("chunk_index"), F.array_join("tokens", " ").alias("clear_text"), F.lit(kept.added["contents"]).cast("long").alias("n_embedded"))


@query(f"WITH {GROUPED}, {CHUNKS} SELECT count(*) AS n_chunks, count(DISTINCT file) AS n_files FROM chunks")
def chunk_counts(spark, base):
    return chunking.chunk_counts(chunks_of(spark, base))


@query(f"WITH {GROUPED}, {CHUNKS} SELECT file, string_agg(len(tokens), ',' ORDER BY chunk_index) AS sizes FROM chunks GROUP BY file")
def file_chunk_list(spark, base):
    return chunking.file_chunk_list(chunks_of(spark, base)).select("file", F.array_join(F.transform("chunks", lambda c: F.size(c.tokens).cast("string")), ",").alias("sizes"))


@query(f"WITH {SCORES} SELECT file, grp, chunk_index, probability FROM scores")
def chunk_scores(spark, base):
    return scores_of(spark, base).select("file", "grp", "chunk_index", "probability")


@query(f"WITH {SCORES} SELECT grp, k, count(*) AS n FROM (SELECT grp, max(CASE WHEN t / 1000.0::DOUBLE <= max_score THEN t END) AS k FROM file_scores, range(1001) r(t) GROUP BY file, grp) GROUP BY grp, k")
def score_histogram(spark, base):
    """What the report's index holds of the scores."""
    return file_scores_of(spark, base).groupBy("grp", evaluate.grid_bucket(F.col("max_score"), 0, 1000).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCORES} SELECT file, grp, max_score FROM file_scores")
def file_max_score(spark, base):
    return file_scores_of(spark, base)


@query(f"WITH {SCORES} SELECT file, chunk_index, probability FROM scores WHERE probability > 0.95")
def confident_chunks(spark, base):
    return mining.confident(scores_of(spark, base), 0.95).select("file", "chunk_index", "probability")


@query(f"""WITH {SCORES} SELECT count(*) AS n_chunks, CAST(sum(CASE WHEN probability > 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept,
  count(DISTINCT file) AS n_files, count(DISTINCT CASE WHEN probability > 0.9 THEN file END) AS n_detected FROM scores""")
def detection_summary(spark, base):
    return mining.detection_summary(scores_of(spark, base), 0.9)


# Evaluation ---------------------------------------------------------------------------------------------------

_COUNT_SQL = """count(*) FILTER (grp = 'novel_crypto' AND max_score >= threshold) AS tp, count(*) FILTER (grp = 'novel_crypto' AND max_score < threshold) AS fn,
  count(*) FILTER (grp = 'non_crypto_unrelated' AND max_score < threshold) AS unrelated_tn, count(*) FILTER (grp = 'non_crypto_unrelated' AND max_score >= threshold) AS unrelated_fp,
  count(*) FILTER (grp = 'non_crypto_discarded' AND max_score < threshold) AS discarded_tn, count(*) FILTER (grp = 'non_crypto_discarded' AND max_score >= threshold) AS discarded_fp"""
_RATES = """rates AS (SELECT *, CASE WHEN tp + unrelated_fp + discarded_fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + unrelated_fp + discarded_fp)::DOUBLE END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn)::DOUBLE END AS recall FROM counts),
sweep AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rates)"""


def _swept(grid: str) -> str:
    return f"WITH {SCORES}, grid AS ({grid}), counts AS (SELECT threshold, {_COUNT_SQL} FROM file_scores, grid GROUP BY threshold), {_RATES}"


GRID = "SELECT k / 1000.0::DOUBLE AS threshold FROM range(5, 1000) t(k)"
SWEPT = _swept(GRID)
SWEEP_COLUMNS = "threshold, tp, fn, unrelated_tn, unrelated_fp, discarded_tn, discarded_fp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("threshold", *evaluate.COUNTS, *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(_swept("SELECT 0.95::DOUBLE AS threshold") + f" SELECT {SWEEP_COLUMNS} FROM sweep")
def metrics_at_threshold(spark, base):
    return _shown(evaluate.metrics_at(file_scores_of(spark, base), 0.95))


@query(f"{SWEPT} SELECT {SWEEP_COLUMNS} FROM sweep")
def threshold_sweep(spark, base):
    return _shown(evaluate.threshold_sweep(file_scores_of(spark, base)))


POINT_COLUMNS = "threshold, tp, fn, unrelated_tn, unrelated_fp, discarded_tn, discarded_fp, round(f1, 9) AS f1"
POINT_ORDER = {"best_f1": "f1 DESC, threshold", "min_fn": "fn, f1 DESC, threshold", "min_fp": "unrelated_fp + discarded_fp, f1 DESC, threshold"}


def _sweep(spark: SparkSession, base: str) -> DataFrame:
    return evaluate.threshold_sweep(file_scores_of(spark, base))


def _round_f1(df: DataFrame) -> DataFrame:
    return df.withColumn("f1", F.round("f1", 9))


@query(f"{SWEPT} SELECT {POINT_COLUMNS} FROM sweep ORDER BY {POINT_ORDER['best_f1']} LIMIT 1")
def best_f1_point(spark, base):
    return _round_f1(evaluate.best_f1_point(_sweep(spark, base)))


@query(f"{SWEPT} SELECT {POINT_COLUMNS} FROM sweep ORDER BY {POINT_ORDER['min_fn']} LIMIT 1")
def min_fn_point(spark, base):
    return _round_f1(evaluate.min_fn_point(_sweep(spark, base)))


@query(f"{SWEPT} SELECT {POINT_COLUMNS} FROM sweep ORDER BY {POINT_ORDER['min_fp']} LIMIT 1")
def min_fp_point(spark, base):
    return _round_f1(evaluate.min_fp_point(_sweep(spark, base)))


@query(SWEPT + " " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS point, {POINT_COLUMNS} FROM sweep ORDER BY {o} LIMIT 1)" for n, o in POINT_ORDER.items()))
def operating_points(spark, base):
    return _round_f1(evaluate.operating_points(_sweep(spark, base)))


@query(f"WITH {SCORES} SELECT file, grp, max_score, max_score >= 0.8 AS predicted, grp = 'novel_crypto' AS actual, (max_score >= 0.8) = (grp = 'novel_crypto') AS correct FROM file_scores")
def file_decisions(spark, base):
    return evaluate.decisions(file_scores_of(spark, base), 0.8)


@query(_swept("SELECT 0.9::DOUBLE AS threshold") + " SELECT printf('%.2f%%', 100 * f1) AS f1, printf('%.2f%%', 100 * precision) AS precision, printf('%.2f%%', 100 * recall) AS recall FROM sweep")
def report_headline(spark, base):
    return report.headline(file_scores_of(spark, base), 0.9)


@query(f"WITH {SCORES} SELECT file, grp, max_score, max_score >= 0.9 AS predicted, grp = 'novel_crypto' AS actual, (max_score >= 0.9) = (grp = 'novel_crypto') AS correct FROM file_scores WHERE grp = 'non_crypto_unrelated' AND contains(lower(file), '1')")
def report_file_list(spark, base):
    return report.list_files(file_scores_of(spark, base), 0.9, "non_crypto_unrelated", "1")


@query(f"WITH {SCORES} SELECT file, chunk_index, probability, clear_text FROM scores")
def payload_base64_roundtrip(spark, base):
    back = report.decode(report.encode(report.entry_json(scores_of(spark, base))))
    return back.select("file", F.explode("entry.chunks").alias("c")).select("file", F.col("c.index").alias("chunk_index"), "c.probability", "c.clear_text")


@query(f"WITH {SCORES} SELECT s.file, s.grp, max(probability) AS max_score, count(*) AS n_chunks, string_agg(probability, ',' ORDER BY chunk_index) AS listed FROM scores s GROUP BY s.file, s.grp")
def report_payload(spark, base):
    e = report.file_entries(scores_of(spark, base)).select("file", "entry.*")
    return e.select("file", F.col("group").alias("grp"), "max_score", F.size("chunks").cast("long").alias("n_chunks"), F.array_join(F.transform("chunks", lambda c: c.probability.cast("string")), ",").alias("listed"))


# Vectors ------------------------------------------------------------------------------------------------------


@query("""SELECT label, dim - 1 AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim""")
def group_mean_vectors(spark, base):
    means = embed.group_means(table(spark, base, "embeddings"), "label").select("label", F.posexplode("mean").alias("dim", "mean"))
    return means.select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


@query("""WITH t AS (SELECT vec_id % 50 AS seq, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS mask, embedding FROM embeddings),
l AS (SELECT seq, mask, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM t),
m AS (SELECT seq, dim, sum(x * mask) / greatest(sum(mask)::DOUBLE, 1e-9) AS v FROM l GROUP BY seq, dim)
SELECT seq, dim - 1 AS dim, round(v, 6) AS v FROM m""")
def mean_pool_vectors(spark, base):
    t = table(spark, base, "embeddings").select((F.col("vec_id") % 50).alias("seq"), F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1).alias("mask"), F.col("embedding").alias("vector"))
    pooled = embed.mean_pool(t, "seq")
    return pooled.select("seq", F.posexplode("pooled").alias("dim", "v")).select("seq", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v"))


WEIGHTS = """l AS (SELECT label < 3 AS pos, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
w AS (SELECT dim, avg(x) FILTER (pos) - avg(x) FILTER (NOT pos) AS w FROM l GROUP BY dim)"""


def _weights(spark: SparkSession, base: str) -> DataFrame:
    """One row: the mean vector of labels under 3 less that of the others."""
    means = embed.group_means(table(spark, base, "embeddings").select((F.col("label") < 3).alias("pos"), "embedding").where("pos IS NOT NULL"), "pos")
    return means.agg(F.zip_with(F.max(F.when(F.col("pos"), F.col("mean"))), F.max(F.when(~F.col("pos"), F.col("mean"))), lambda a, b: a - b).alias("w"))


@query(f"WITH {WEIGHTS} SELECT dim - 1 AS dim, round(w, 6) AS w FROM w")
def centroid_weights(spark, base):
    long = _weights(spark, base).select(F.posexplode("w").alias("dim", "w"))
    return long.select(F.col("dim").cast("long").alias("dim"), F.round("w", 6).alias("w"))


@query(f"""WITH {WEIGHTS}, e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)
SELECT vec_id, round(1 / (1 + exp(-sum(x * w))), 6) AS probability FROM e JOIN w USING (dim) GROUP BY vec_id""")
def linear_score(spark, base):
    vectors = table(spark, base, "embeddings").join(F.broadcast(_weights(spark, base)), F.lit(True))  # one row of the vectors' length
    return vectors.select("vec_id", F.round(X.sigmoid(classify.linear_score(F.col("embedding"), F.col("w"))), 6).alias("probability"))


def _labelled_vectors(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "embeddings")
    return classify.training_set(e.where("label < 3").drop("label"), e.where("label >= 3").drop("label"))


@query()
def rf_train_score(spark, base):
    rows = _labelled_vectors(spark, base)
    model = classify.get_classifier(FOREST, n_estimators=20, max_depth=5, seed=1).fit(rows)
    return model.score(rows).select("vec_id", "label", "probability")


@query()
def forest_prefixes(spark, base):
    """One fit of 40 trees answers for 10 and 20, too."""
    rows = _labelled_vectors(spark, base)
    grown = classify.get_classifier(FOREST, n_estimators=40, max_depth=5, seed=1).fit(rows).prefixes(rows, 10, 20, 40)
    return grown.select("vec_id", "label", *[F.col("probabilities")[i].alias(f"probability_{n}") for i, n in enumerate((10, 20, 40))])


def _adam() -> classify.Classifier:
    return classify.get_classifier(LINEAR, epochs=10, learning_rate=0.01, batch_size=32, key="vec_id")


@query()
def lr_train_score(spark, base):
    rows = _labelled_vectors(spark, base)
    return _adam().fit(rows).score(rows).select("vec_id", "label", "probability")


@query()
def cv_accuracy(spark, base):
    return classify.cv_summary(classify.cross_validate(_labelled_vectors(spark, base), _adam, "vec_id"))


@query(f"""WITH dealt AS (SELECT vec_id, CAST('0x' || left(md5(CAST(vec_id AS VARCHAR)), 8) AS BIGINT) % 4 AS part FROM embeddings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY md5('{SEED + 1}|' || vec_id)) - 1 AS r FROM dealt)
SELECT vec_id, part, r // 32 AS batch, r % 32 AS place FROM ranked""")
def batch_windows(spark, base):
    return minibatch.batch_windows(table(spark, base, "embeddings").select("vec_id"), "vec_id", 32, SEED, epoch=1, parts=4)


@query("""SELECT vec_id, CASE WHEN label < 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
  (row_number() OVER (PARTITION BY label < 3 ORDER BY vec_id) - 1) * 5 // count(*) OVER (PARTITION BY label < 3) AS fold FROM embeddings""")
def cv_folds(spark, base):
    return classify.folds(_labelled_vectors(spark, base), "label", "vec_id").select("vec_id", "label", F.col("fold").cast("long").alias("fold"))


# Mining -------------------------------------------------------------------------------------------------------

_TRIPLETS = f"""pos AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}|' || doc_id), doc_id) - 1 AS idx FROM labels WHERE toxic = 1),
neg AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}|' || doc_id), doc_id) - 1 AS idx FROM labels WHERE toxic = 0),
n AS (SELECT count(*) AS n FROM pos),
pairs AS (SELECT idx, doc_id AS anchor, (idx + 1 + CAST('0x' || left(md5('{SEED}+|' || idx), 8) AS BIGINT) % (n - 1)) % n AS other FROM pos, n)"""


@query(f"WITH {_TRIPLETS} SELECT pairs.idx, anchor, p.doc_id AS positive, q.doc_id AS negative FROM pairs JOIN pos p ON p.idx = other LEFT JOIN neg q ON q.idx = pairs.idx")
def triplet_assembly(spark, base):
    marks = table(spark, base, "labels")
    return mining.triplets(marks.where("toxic = 1"), marks.where("toxic = 0"), "doc_id", SEED)


def _triplet_vectors(spark: SparkSession, base: str) -> DataFrame:
    """Vectors of the triplets of labelled documents that have one; toxic ones are the positives."""
    vectors = table(spark, base, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    marks = table(spark, base, "labels").join(vectors.select("doc_id"), "doc_id", "left_semi")
    keys = mining.triplets(marks.where("toxic = 1"), marks.where("toxic = 0"), "doc_id", SEED)
    return metric.with_vectors(keys, vectors, "doc_id")


_VECTOR_TRIPLETS = _TRIPLETS.replace("FROM labels", "FROM labels SEMI JOIN embeddings ON doc_id = vec_id")
_FAR = "sqrt(list_sum(list_transform(list_zip(a.embedding, {0}.embedding), lambda x: pow(x[1]::DOUBLE - x[2]::DOUBLE + 1e-6, 2))))"


@query(f"""WITH {_VECTOR_TRIPLETS}, t AS (SELECT anchor, p.doc_id AS positive, q.doc_id AS negative FROM pairs JOIN pos p ON p.idx = other JOIN neg q ON q.idx = pairs.idx)
SELECT count(*) AS n, round(avg(greatest(0.0::DOUBLE, {_FAR.format('b')} - {_FAR.format('c')} + 0.5::DOUBLE)), 9) AS loss
FROM t JOIN embeddings a ON a.vec_id = anchor JOIN embeddings b ON b.vec_id = positive JOIN embeddings c ON c.vec_id = negative""")
def triplet_margin_loss(spark, base):
    return _triplet_vectors(spark, base).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(metric.margin_loss(0.5)), 9).alias("loss"))


@query()
def triplet_finetune(spark, base):
    """Vectors under the map that the triplets teach, with the loss before and after."""
    w, losses = metric.fit_projection(_triplet_vectors(spark, base))
    mapped = metric.project(table(spark, base, "embeddings").select("vec_id", "embedding"), w)
    first, last = (losses[0], losses[-1]) if losses else (None, None)
    return mapped.select("vec_id", "embedding", F.lit(first).cast("double").alias("loss_before"), F.lit(last).cast("double").alias("loss_after"))


WHITE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Code ---------------------------------------------------------------------------------------------------------

# Every document stands for a source file, of the language that its path says.


def code(spark: SparkSession, base: str) -> DataFrame:
    return files(spark, base).select("path", F.coalesce("text", F.lit("")).alias("code"), X.language(F.col("path")).alias("lang"))


CODE_SQL = f"{FILES}, langs AS (SELECT path, coalesce(text, '') AS code, {LANG} AS lang FROM files), " + """
bare AS (SELECT path, CASE WHEN lang IS NOT NULL THEN regexp_replace(regexp_replace(code, '//[^\\n]*', '', 'g'), '/\\*.*?\\*/', '', 'gs') ELSE code END AS b FROM langs)"""
IDENT_SQL = f"""{CODE_SQL}, ident AS (SELECT path, list_sort(list_filter(list_distinct(regexp_extract_all(b, '[\\p{{L}}\\p{{N}}_]+')),
  lambda w: regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*') AND NOT list_contains({_list(tuple(R.KEPT_WORDS))}, w))) AS ids FROM bare)"""


@query(f"WITH {CODE_SQL} SELECT path, b AS bare FROM bare")
def comment_strip(spark, base):
    return code(spark, base).select("path", X.strip_comments(F.col("code"), F.col("lang")).alias("bare"))


@query(f"WITH {IDENT_SQL} SELECT path, array_to_string(ids, ' ') AS ids FROM ident")
def identifier_set(spark, base):
    return code(spark, base).select("path", F.array_join(R.user_identifiers(X.strip_comments(F.col("code"), F.col("lang"))), " ").alias("ids"))


@query(f"""WITH {IDENT_SQL}, one AS (SELECT path, unnest(ids) AS name FROM ident),
m AS (SELECT *, upper(name) = name AND regexp_matches(name, '[A-Z]') AND length(name) > 4 AS macro FROM one)
SELECT path, name, CASE WHEN macro THEN 'CONST_' || name ELSE 'v' || (row_number() OVER (PARTITION BY path, macro ORDER BY name) - 1) END AS symbol FROM m""")
def symbol_numbering(spark, base):
    named = code(spark, base).select("path", F.explode(R.symbol_map(X.strip_comments(F.col("code"), F.col("lang")))).alias("name", "symbol"))
    return named


@query(f"""WITH {CODE_SQL}, line AS (SELECT path, trim(l, '{WHITE_CHARS}') AS l, n FROM (SELECT path, unnest(string_split(b, chr(10))) AS l, generate_subscripts(string_split(b, chr(10)), 1) AS n FROM bare)),
step AS (SELECT path, n, CASE WHEN (contains(l, 'for') OR contains(l, 'while')) AND (contains(l, '{{') OR suffix(l, ')')) THEN 1 WHEN contains(l, '}}') THEN -1 ELSE 0 END AS d FROM line WHERE l <> ''),
run AS (SELECT path, n, sum(d) OVER (PARTITION BY path ORDER BY n) AS s FROM step)
SELECT path, n, CAST(s - least(0, min(s) OVER (PARTITION BY path ORDER BY n)) AS BIGINT) AS depth FROM run""")
def loop_depth(spark, base):
    """Depth after each line: the running sum, less its least value so far if that is negative."""
    bare = code(spark, base).select("path", F.posexplode(F.split(X.strip_comments(F.col("code"), F.col("lang")), "\n")).alias("n", "l")).select("path", (F.col("n") + 1).cast("long").alias("n"), R.trimmed(F.col("l")).alias("l")).where("l <> ''")
    w = Window.partitionBy("path").orderBy("n")
    d = bare.withColumn("d", F.when(R.opens_loop(F.col("l")), 1).when(F.col("l").contains("}"), -1).otherwise(0)).withColumn("s", F.sum("d").over(w))
    return d.select("path", "n", (F.col("s") - F.least(F.lit(0), F.min("s").over(w))).cast("long").alias("depth"))


# Lines are rows here and depths come from windows; a line gives up to two parts, its marker and its cleaned text.
@query(rf"""WITH {IDENT_SQL}, one AS (SELECT path, unnest(ids) AS name FROM ident),
sym AS (SELECT path, name, CASE WHEN macro THEN 'CONST_' || name ELSE 'v' || (row_number() OVER (PARTITION BY path, macro ORDER BY name) - 1) END AS symbol
  FROM (SELECT *, upper(name) = name AND regexp_matches(name, '[A-Z]') AND length(name) > 4 AS macro FROM one)),
maps AS (SELECT path, map(list(name), list(symbol)) AS names FROM sym GROUP BY path),
broken AS (SELECT path, regexp_split_to_array(b, '\r\n|[\n\r\f\v\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM bare),
line AS (SELECT path, trim(l, '{WHITE_CHARS}') AS l, n FROM (SELECT path, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM broken)),
step AS (SELECT path, n, l, CASE WHEN (contains(l, 'for') OR contains(l, 'while')) AND (contains(l, '{{') OR suffix(l, ')')) THEN 1 WHEN contains(l, '}}') THEN -1 ELSE 0 END AS d FROM line WHERE l <> ''),
summed AS (SELECT *, sum(d) OVER (PARTITION BY path ORDER BY n) AS s FROM step),
deep AS (SELECT *, CAST(s - least(0, min(s) OVER (PARTITION BY path ORDER BY n)) AS BIGINT) AS depth FROM summed),
marked AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY path ORDER BY n), 0) AS above FROM deep),
renamed AS (SELECT path, n, trim(array_to_string(list_transform(regexp_extract_all(l, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: coalesce(names[w], w)), ''), '{WHITE_CHARS}') AS t
  FROM marked LEFT JOIN maps USING (path) WHERE regexp_matches(l, '[=+*/%&|^<>-]|\b[0-9]+\b')),
parts AS (SELECT path, n, 0 AS o, 'LOOP_START_DEPTH_' || depth AS part FROM marked WHERE d = 1 UNION ALL SELECT path, n, 0, 'LOOP_END_DEPTH_' || above FROM marked WHERE d = -1 AND above > 0
  UNION ALL SELECT path, n, 1, regexp_replace(regexp_replace(t, '\b({R.DROPPED_TYPES})\s+', '', 'g'), '\s*;\s*$', '') FROM renamed),
joined AS (SELECT path, string_agg(part, chr(10) ORDER BY n, o) AS representation FROM parts WHERE part <> '' GROUP BY path)
SELECT path, coalesce(representation, '') AS representation FROM bare LEFT JOIN joined USING (path)""")
def fallback_dfg(spark, base):
    return code(spark, base).select("path", R.data_flow_text(F.col("code"), F.col("lang")).alias("representation"))


# Paths and rows -----------------------------------------------------------------------------------------------

BASE_GROUPS = " || ".join(f"CASE WHEN contains(path, '{folder}') THEN ',{group}' ELSE '' END" for folder, group in labels.CODE_BASE_GROUPS.items())


@query(f"""WITH {FILES}, moved AS (SELECT replace(path, 'evaluation/non_crypto_dataset', 'evaluation/non_crypto/non_crypto_dataset') AS path FROM files)
SELECT path, {BASE_GROUPS} AS groups FROM moved""")
def code_base_routing(spark, base):
    path = F.replace("path", F.lit("evaluation/non_crypto_dataset"), F.lit("evaluation/non_crypto/non_crypto_dataset"))
    moved = files(spark, base).select(path.alias("path"))
    return moved.select("path", F.array_join(F.transform(labels.code_base_groups(F.col("path")), lambda g: F.concat(F.lit(","), g)), "").alias("groups"))


@query(f"WITH {FILES} SELECT path, CASE WHEN starts_with(path, 'data/evaluation/') THEN substr(path, length('data/evaluation/') + 1) ELSE path END AS relative FROM files")
def relative_path(spark, base):
    return files(spark, base).select("path", X.relative_path(F.col("path"), "data/evaluation").alias("relative"))


@query(f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents) SELECT doc_id, count(*) AS n FROM t WHERE regexp_full_match(w, '0x[0-9a-fA-F]+|[0-9]+') GROUP BY doc_id")
def numeric_literals(spark, base):
    words = table(spark, base, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("w"))
    return words.where(X.is_number(F.col("w"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, array_to_string(list_filter({TOKENS}, lambda w: w NOT IN ('the', 'of')), ' ') AS text FROM documents WHERE text IS NOT NULL")
def detokenized(spark, base):
    return table(spark, base, "documents").where("text IS NOT NULL").select("doc_id", X.detokenize(X.tokens(F.col("text")), "the", "of").alias("text"))


@query("""SELECT item AS conv_id, arg_max(text, turn) AS text FROM (SELECT conv_id AS item, turn, text FROM conversations) GROUP BY item""")
def last_written(spark, base):
    return experiments.last_written(table(spark, base, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn").select("conv_id", "text")


@query("SELECT doc_id, source, NULL AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def union_header(spark, base):
    return experiments.union_rows([table(spark, base, "documents").select("doc_id", "source"), table(spark, base, "pages").select(F.col("page_id").alias("doc_id"), "url")])


@query(f"WITH {SCORES} SELECT file, chunk_index, round(1 - probability, 6) AS complement FROM scores")
def complement_probability(spark, base):
    return classify.with_complement(scores_of(spark, base)).select("file", "chunk_index", F.round("complement", 6).alias("complement"))


@query()
def training_losses(spark, base):
    fitted = _adam().fit(_labelled_vectors(spark, base))
    return spark.createDataFrame(list(enumerate(fitted.losses())), "epoch int, loss double")
