"""The report payload, its encodings, the page and the page's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base64_plain, html_escape
from .evaluate import decisions, metrics_at

FILE_SCHEMA = "STRUCT<filename: STRING, `group`: STRING, max_score: DOUBLE, chunks: ARRAY<STRUCT<index: INT, probability: DOUBLE, clear_text: STRING>>>"


def file_entries(scores: DataFrame) -> DataFrame:
    """(file, entry): what the report holds of each file, its chunks in order."""
    usable = F.coalesce(F.max(F.when(~F.isnan("probability"), F.col("probability"))), F.lit(0.0))
    chunks = F.sort_array(F.collect_list(F.struct(F.col("chunk_index").alias("index"), "probability", "clear_text")))
    by = scores.groupBy("file", "grp").agg(F.greatest(usable, F.lit(0.0)).alias("max_score"), chunks.alias("chunks"))
    return by.select("file", F.struct(F.col("file").alias("filename"), F.col("grp").alias("group"), "max_score", "chunks").alias("entry"))


def entry_json(scores: DataFrame) -> DataFrame:
    """(file, payload): each file's entry as JSON."""
    return file_entries(scores).select("file", F.to_json("entry").alias("payload"))


def encode(payloads: DataFrame) -> DataFrame:
    return payloads.select("file", base64_plain(F.col("payload").cast("binary")).alias("payload_b64"))


def decode(encoded: DataFrame) -> DataFrame:
    """(file, entry) back from base64 JSON."""
    return encoded.select("file", F.from_json(F.unbase64("payload_b64").cast("string"), FILE_SCHEMA).alias("entry"))


def whole_payload(scores: DataFrame, stats: DataFrame, input_type: str, classifier: str, threshold: float, max_files: int = 100_000) -> str:
    """The page's payload as base64. A page is for people: more than ``max_files`` files are an error."""
    entries = file_entries(scores)
    if entries.limit(max_files + 1).count() > max_files:
        raise ValueError(f"a report of more than {max_files} files; write the entries as a table instead")
    config = F.struct(F.lit(input_type).alias("input_type"), F.lit(classifier).alias("classifier_type"), F.lit(threshold).alias("default_threshold"))
    files = entries.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("file", "entry")))).alias("files"))
    one = stats.limit(1).select(F.struct("*").alias("stats")).join(files, F.lit(True))
    return one.select(base64_plain(F.to_json(F.struct("stats", "files", config.alias("config"))).cast("binary"))).first()[0]


PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="UTF-8"><title>Evaluation</title>
<style>body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #999;padding:.2em .6em}.wrong{color:#b00}</style></head>
<body><h1>Evaluation</h1><p>best F1 at @BEST@, fewest misses at @FN@, fewest false alarms at @FP@</p>
<label>threshold <input id="t" type="range" min="0" max="1" step="0.001" value="@DEFAULT@"></label> <output id="o"></output>
<label>group <select id="g"><option value="">all</option></select></label> <input id="q" placeholder="search"><p id="m"></p><table id="files"></table><pre id="text"></pre>
<script id="payload-data" type="text/plain">@PAYLOAD@</script>
<script>
const bytes = Uint8Array.from(atob(document.getElementById('payload-data').textContent), c => c.charCodeAt(0));
const data = JSON.parse(new TextDecoder().decode(bytes)), $ = id => document.getElementById(id), files = Object.values(data.files);
for (const g of new Set(files.map(f => f.group))) $('g').append(new Option(g, g));
function show() {
  const t = Number($('t').value), positive = f => f.group === '@POSITIVE@', hit = f => f.max_score >= t;
  $('o').textContent = t.toFixed(3);
  const n = (p, h) => files.filter(f => positive(f) === p && hit(f) === h).length, tp = n(true, true), fn = n(true, false), fp = n(false, true);
  const p = tp + fp ? tp / (tp + fp) : 0, r = tp + fn ? tp / (tp + fn) : 0, f1 = p + r ? 2 * p * r / (p + r) : 0;
  $('m').textContent = `F1 ${(100 * f1).toFixed(2)}% precision ${(100 * p).toFixed(2)}% recall ${(100 * r).toFixed(2)}%`;
  const q = $('q').value.toLowerCase(), g = $('g').value;
  $('files').replaceChildren(...files.filter(f => (!g || f.group === g) && f.filename.toLowerCase().includes(q)).sort((a, b) => b.max_score - a.max_score).map(f => {
    const row = document.createElement('tr');
    row.className = positive(f) === hit(f) ? '' : 'wrong';
    for (const v of [f.filename, f.group, f.max_score.toFixed(4), f.chunks.length]) row.insertCell().textContent = v;
    row.onclick = () => $('text').textContent = f.chunks.map(c => `#${c.index} ${c.probability.toFixed(4)}\\n` + c.clear_text.split(/\\r?\\n/).map((l, i) => `${i + 1}\\t${l}`).join('\\n')).join('\\n\\n');
    return row;
  }));
}
for (const id of ['t', 'g', 'q']) $(id).oninput = show;
show();
</script></body></html>
"""


def render(payload_b64: str, best: float, fewest_fn: float, fewest_fp: float, threshold: float, positive: str) -> str:
    values = {"@PAYLOAD@": payload_b64, "@BEST@": f"{best:.3f}", "@FN@": f"{fewest_fn:.3f}", "@FP@": f"{fewest_fp:.3f}", "@DEFAULT@": f"{threshold:g}", "@POSITIVE@": positive}
    page = PAGE
    for token, value in values.items():
        page = page.replace(token, value)
    return page


def list_files(file_scores: DataFrame, threshold: float, group: str | None = None, search: str = "") -> DataFrame:
    """The file list: filtered by group and case-blind substring, by score."""
    rows = decisions(file_scores, threshold)
    if group:
        rows = rows.where(F.col("grp") == group)
    return rows.where(F.lower("file").contains(search.lower())).orderBy(F.desc("max_score"), "file")


def file_details(scores: DataFrame, file: str, threshold: float) -> DataFrame:
    return scores.where(F.col("file") == file).select("chunk_index", "probability", (F.col("probability") >= threshold).alias("above"), html_escape(F.col("clear_text")).alias("html")).orderBy("chunk_index")


def chunk_lines(scores: DataFrame, file: str, chunk_index: int) -> DataFrame:
    """One chunk's text as numbered lines from 1."""
    one = scores.where((F.col("file") == file) & (F.col("chunk_index") == chunk_index))
    return one.select(F.posexplode(F.split("clear_text", "\r?\n")).alias("n", "line")).select((F.col("n") + 1).alias("n"), "line")


def headline(file_scores: DataFrame, threshold: float) -> DataFrame:
    """The dashboard's figures as percentages."""
    pct = lambda c: F.format_string("%.2f%%", 100 * F.col(c)).alias(c)
    return metrics_at(file_scores, threshold).select(pct("f1"), pct("precision"), pct("recall"))
