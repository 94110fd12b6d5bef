"""The thin ``opN_<name>`` queries: each applies its operator to its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import hmm, infill, langid, pii, repair, sketch
from .chat import CLOSE, MIDDLE, OPEN, prefix_examples, read_back
from .decontaminate import EVERY, find_overlaps
from .line_dedup import dedup_lines
from .packing import pack_documents
from .sharding import stratified_shards
from .simhash import near_duplicates
from .token_files import read_token_files, write_token_files


def op1_boosted_pii(spark: SparkSession, base: str) -> DataFrame:
    found = pii.find_pii(table(spark, base, "documents").select("doc_id", "text"))
    of = F.transform("base", lambda x: x.kind)
    counts = [F.size(F.filter(of, lambda kind: kind == F.lit(at))).cast("long").alias(f"n_{name}") for at, name in enumerate(pii.BASE)]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text("base"), 256).alias("base_sha256"), pii.spans_text("base", "added").alias("spans"))


def op3_bottom_k_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    made = sketch.neighbour_sketches(table(spark, base, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketch.as_text(F.col("sketch")).alias("fingerprint"),
        sketch.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "n_shingles",
    )


def op5_spaced_seed_decontamination(spark: SparkSession, base: str) -> DataFrame:
    return find_overlaps(table(spark, base, "documents"), table(spark, base, "benchmark"), EVERY)


def op6_line_similarity_dedup(spark: SparkSession, base: str) -> DataFrame:
    done = dedup_lines(table(spark, base, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"))


#: The common tables of op6: every line's tokens in order of their true counts, prefixes, and near earlier lines.
LINE_DEDUP_SQL = r"""
lines AS (
  SELECT doc_id AS d, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line
  FROM {docs} WHERE text IS NOT NULL
), tokens AS (
  SELECT line, list_distinct(list_filter(string_split(translate(lower(line), chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '),
    lambda w: w <> '')) AS t
  FROM (SELECT DISTINCT line FROM lines)
), firsts AS (
  SELECT line, t, len(t) AS n, arg_min(d, (d, i)) AS d, arg_min(i, (d, i)) AS i
  FROM lines JOIN tokens USING (line) WHERE len(t) > 0 GROUP BY line, t
), words AS (SELECT line, n, d, i, t, unnest(t) AS w FROM firsts
), counted AS (SELECT w, count(*) AS c FROM words GROUP BY w
), ranked AS (
  SELECT line, n, d, i, t, w, row_number() OVER (PARTITION BY line ORDER BY c, w) AS pos FROM words JOIN counted USING (w)
), prefix AS (SELECT * FROM ranked WHERE pos <= n - (4 * n + 4) // 5 + 1
), near AS (
  SELECT DISTINCT l.line FROM prefix l JOIN prefix r ON l.w = r.w AND l.line <> r.line
  WHERE (r.d < l.d OR r.d = l.d AND r.i < l.i) AND 5 * l.n >= 4 * r.n AND 5 * r.n >= 4 * l.n
    AND len(list_intersect(l.t, r.t)) * 9 >= 4 * (l.n + r.n)
), kept AS (SELECT d, i FROM firsts WHERE line NOT IN (SELECT line FROM near)
), flagged AS (
  SELECT d, i, line, len(t) = 0 OR EXISTS (SELECT 1 FROM kept k WHERE k.d = lines.d AND k.i = lines.i) AS stays
  FROM lines JOIN tokens USING (line)
), deduped AS (
  SELECT d, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '') AS text, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed
  FROM flagged GROUP BY d
)"""
OP6_SQL = "WITH " + LINE_DEDUP_SQL.replace("{docs}", "documents") + """
SELECT doc_id, deduped.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents LEFT JOIN deduped ON doc_id = d
"""


def op2_harmonic_packing(spark: SparkSession, base: str) -> DataFrame:
    return pack_documents(table(spark, base, "documents"))


def op4_hyperdimensional_langid(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents")
    prototypes = langid.learn(docs.where(~langid.held_out()))
    return langid.predict(docs, prototypes).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_stratified_shards(spark: SparkSession, base: str) -> DataFrame:
    placed = stratified_shards(table(spark, base, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op9_prefix_target_chat(spark: SparkSession, base: str) -> DataFrame:
    said = f"{CLOSE}{OPEN} ok {MIDDLE}"
    added = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = table(spark, base, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return read_back(prefix_examples(turns))


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), segments AS (
  SELECT *, '[INST]' || regexp_replace(role, '([<\[]<?)(\\*)(/?(?:s|SYS|INST)[>\]]>?)', '\1\\\2\3', 'g')
    || '[/INST]' || regexp_replace(text, '([<\[]<?)(\\*)(/?(?:s|SYS|INST)[>\]]>?)', '\1\\\2\3', 'g') || '</s>' AS seg
  FROM turns
), ordered AS (
  SELECT *, row_number() OVER w AS rn, sum(length(seg)) OVER (w ROWS UNBOUNDED PRECEDING) AS upto,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM segments WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, seg)
)
SELECT conv_id, max(n) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR rn = n) AS BIGINT) AS formatted_chars
FROM ordered GROUP BY conv_id
"""


def op8_simhash_vptree(spark: SparkSession, base: str) -> DataFrame:
    found = near_duplicates(table(spark, base, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_arrow_token_files(spark: SparkSession, base: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, base, "documents")))


def op11_hidden_markov_model(spark: SparkSession, base: str) -> DataFrame:
    scored, lm = hmm.train_and_score(table(spark, base, "documents"), hmm.held_out(F.col("doc_id")), hmm.Hmm(), "doc_id")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(lm.classes.n).cast("long").alias("train_tokens"), "base_score", "score")


def op12_determinised_repair(spark: SparkSession, base: str) -> DataFrame:
    return repair.summary(repair.repair_conversations(repair.damage(table(spark, base, "conversations"))))


def op13_fill_in_middle(spark: SparkSession, base: str) -> DataFrame:
    cut = infill.fill_in_middle(table(spark, base, "documents").select("doc_id", "text"))
    restored = infill.restore(F.col("output"), F.col("form"))
    return cut.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


#: Lines are lists here, and a cut is the sum of the first lengths.
OP13_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), sized AS (
  SELECT doc_id, text, list_transform(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), lambda x: length(x)) AS sizes,
    CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM drawn
), cuts AS (
  SELECT *, len(sizes) AS n, least(h1 % (len(sizes) + 1), h2 % (len(sizes) + 1)) AS a, greatest(h1 % (len(sizes) + 1), h2 % (len(sizes) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM sized
), placed AS (
  SELECT *, CAST(coalesce(list_sum(sizes[1:a]), 0) AS BIGINT) AS p, CAST(coalesce(list_sum(sizes[1:b]), 0) AS BIGINT) AS q FROM cuts
), parts AS (SELECT *, substr(text, 1, p) AS prefix, substr(text, p + 1, q - p) AS middle, substr(text, q + 1) AS suffix FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_boosted_pii": op1_boosted_pii,
    "op3_bottom_k_fingerprints": op3_bottom_k_fingerprints,
    "op5_spaced_seed_decontamination": op5_spaced_seed_decontamination,
    "op6_line_similarity_dedup": op6_line_similarity_dedup,
    "op2_harmonic_packing": op2_harmonic_packing,
    "op4_hyperdimensional_langid": op4_hyperdimensional_langid,
    "op7_stratified_shards": op7_stratified_shards,
    "op9_prefix_target_chat": op9_prefix_target_chat,
    "op8_simhash_vptree": op8_simhash_vptree,
    "op10_arrow_token_files": op10_arrow_token_files,
    "op11_hidden_markov_model": op11_hidden_markov_model,
    "op12_determinised_repair": op12_determinised_repair,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op6_line_similarity_dedup": OP6_SQL,
    "op9_prefix_target_chat": OP9_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
