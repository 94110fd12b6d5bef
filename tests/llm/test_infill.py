"""Fill-in-the-middle against plain string code."""

import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from chunkwright.llm import infill, queries

BASE = "/root/testdata/sf0.001"


def plain_infill(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or re.search("<[PSM]>", text):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, form string")
    out = infill.fill_in_middle(df).withColumn("back", infill.restore(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()), key=repr)
    want = sorted(((d, *plain_infill(d, t), t or "") for d, t in rows), key=repr)
    assert got == want


def test_odd_texts(spark):
    texts = ["", None, "\n", "\n\n\n", "a", "a\nb", "a\r\nb c\n", "<P>", "a<S", "<\n<S\n>P>\n<M", "x<M>y\nz", "é\U0001f600\n" * 50, "last<\n<", "ab\n" * 3000 + "z" * 50_000, "\x00\n\x85\n"]
    check(spark, [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc"), (None, "a\nb\nc"), (None, "d\ne"), (7, "p\nq\nr\n"), (7, "p\nq\nr\n"), (-3, "a\nb\nc\nd\ne")])


def test_empty_table(spark):
    check(spark, [])


def test_other_columns_and_rate(spark):
    df = spark.createDataFrame([(1, "a\nb\n", 5, "k")], "doc_id long, text string, n long, k1 string")
    out = infill.fill_in_middle(df, infill.Infill(rate=0))
    assert [tuple(r) for r in out.collect()] == [(1, "a\nb\n", 5, "k", 2, "plain", None, None, "a\nb\n")]
    assert out.columns == ["doc_id", "text", "n", "k1", "n_units", "form", "prefix_chars", "middle_chars", "output"]


def test_repeated_rows_share_no_units(spark):
    """Twenty thousand rows without an id: the units of a row do not land in one window with another row's."""
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a\nb\n"), F.col("id").cast("string")).alias("text"))
    out = infill.fill_in_middle(df).groupBy("n_units").count().collect()
    assert [tuple(r) for r in out] == [(3, 20_000)]


def test_query_against_plain_code_and_sql(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").collect()
    want = {}
    for r in docs:
        n, form, p, m, out = plain_infill(r.doc_id, r.text)
        want[r.doc_id] = (n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_fill_in_middle(spark, BASE).collect()}
    assert got == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{BASE}/documents.parquet'")
    assert {r[0]: tuple(r[1:]) for r in con.execute(queries.OP13_SQL).fetchall()} == want
