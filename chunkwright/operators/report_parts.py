"""A report in parts, for any number of files.

Tasks write the files' entries as scripts, in order of the file names and in parts of bounded size. The page itself holds an
index: the parts with their first and last file, and how many files of each group fall on each step of the threshold, from
which all figures come. A part is loaded when it is asked for.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import POSITIVE
from ..sources.store import list_names, write_text
from .evaluate import grid_bucket
from .report import file_entries

STEPS = 1000


def histogram(file_scores: DataFrame) -> dict[str, list[int]]:
    """By group: how many files' scores fall on each step k / 1000, from 0 to 1000. A few thousand rows at most."""
    rows = file_scores.groupBy("grp", grid_bucket(F.col("max_score"), 0, STEPS).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r.grp or "", [0] * (STEPS + 1))[r.k] = r.n
    return dict(sorted(out.items()))


def figures(counts: dict[str, list[int]], k: int) -> dict[str, float]:
    """What the page shows at the threshold k / 1000."""
    hits = lambda positive: sum(sum(c[k:]) for g, c in counts.items() if (g == POSITIVE) == positive)
    tp, fp = hits(True), hits(False)
    fn = sum(counts.get(POSITIVE, [])) - tp
    precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return {"tp": tp, "fn": fn, "fp": fp, "precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0}


PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="UTF-8"><title>Evaluation</title></head>
<body><h1>Evaluation</h1>
<label>threshold <input id="t" type="range" min="0" max="1000" value="@DEFAULT@"></label> <output id="o"></output><p id="m"></p>
<input id="q" placeholder="file name"> <select id="parts" size="8"></select><table id="files"></table><pre id="text"></pre>
<script id="payload-data" type="text/plain">@PAYLOAD@</script>
<script>
const $ = id => document.getElementById(id);
const index = JSON.parse(new TextDecoder().decode(Uint8Array.from(atob($('payload-data').textContent), c => c.charCodeAt(0))));
let loaded = [];
function add(entry) { loaded.push(entry); }
function show() {
  const k = Number($('t').value), sum = a => a.reduce((x, y) => x + y, 0);
  let tp = 0, fp = 0, all = 0;
  for (const [g, c] of Object.entries(index.histogram)) {
    const hits = sum(c.slice(k));
    if (g === index.positive) { tp += hits; all += sum(c); } else fp += hits;
  }
  const p = tp + fp ? tp / (tp + fp) : 0, r = all ? tp / all : 0, f1 = p + r ? 2 * p * r / (p + r) : 0;
  $('o').textContent = (k / 1000).toFixed(3);
  $('m').textContent = `F1 ${(100 * f1).toFixed(2)}% precision ${(100 * p).toFixed(2)}% recall ${(100 * r).toFixed(2)}%`;
  $('files').replaceChildren(...loaded.map(f => {
    const row = document.createElement('tr');
    for (const v of [f.filename, f.group, f.max_score, f.max_score * 1000 >= k ? 'hit' : '']) row.insertCell().textContent = v;
    row.onclick = () => $('text').textContent = f.chunks.map(c => `#${c.index} ${c.probability}\\n${c.clear_text}`).join('\\n\\n');
    return row;
  }));
}
function open_part(name) {
  loaded = [];
  const script = document.createElement('script');
  script.src = 'parts/' + name;
  script.onload = show;
  document.body.append(script);
}
for (const p of index.parts) $('parts').append(new Option(`${p.first} to ${p.last} (${p.files})`, p.name));
$('parts').onchange = () => open_part($('parts').value);
$('q').onchange = () => { const p = index.parts.find(x => x.first <= $('q').value && $('q').value <= x.last); if (p) { $('parts').value = p.name; open_part(p.name); } };
$('t').oninput = show;
show();
</script></body></html>
"""


def write_report(scores: DataFrame, file_scores: DataFrame, points: dict[str, dict], path: str, threshold: float = 0.95, part_files: int = 200) -> dict:
    """Write index.html and its parts below ``path``; returns the index.

    A task writes its entries one after another and begins a new part every ``part_files`` files, so none holds more than
    one entry at a time. The index has a row for each part and a number for each group and step.
    """
    spark = scores.sparkSession
    lines = file_entries(scores).select("file", F.concat(F.lit("add("), F.to_json("entry"), F.lit(");")).alias("value"))
    lines.repartitionByRange("file").sortWithinPartitions("file").select("value").write.mode("overwrite").option("maxRecordsPerFile", part_files).option("compression", "none").text(f"{path}/parts")
    parts = []
    if any(name.startswith("part-") for name in list_names(spark, f"{path}/parts")):
        named = spark.read.text(f"{path}/parts").select(F.col("_metadata.file_name").alias("name"), F.get_json_object(F.expr("substring(value, 5, length(value) - 6)"), "$.filename").alias("file"))
        parts = [r.asDict() for r in named.groupBy("name").agg(F.min("file").alias("first"), F.max("file").alias("last"), F.count(F.lit(1)).alias("files")).orderBy("first").collect()]
    index = {"parts": parts, "histogram": histogram(file_scores), "positive": POSITIVE, "points": points}
    payload = base64.b64encode(json.dumps(index).encode()).decode()
    write_text(spark, f"{path}/index.html", PAGE.replace("@PAYLOAD@", payload).replace("@DEFAULT@", str(round(threshold * STEPS))))
    return index
