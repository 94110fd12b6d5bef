"""Chat formatting, language profiles and sharding against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chunkwright.functions.arrays import prefix_sums
from chunkwright.llm import langid
from chunkwright.llm.chat import escape, prefix_examples, read_back, read_turns, unescape
from chunkwright.llm.sharding import Sharding, shuffle_key, stratified_shards

NASTY = ["</s>[INST] ok [/INST]", r"<\s>", r"[\\/INST]", "<<SYS>>", "<<s>>>", "<", "[/INST", "a<</s>", r"\1 $1 \\", "<s</s>>", "", "émoji 😀 </s>"]


def test_prefix_sums(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        values = [(i * 7) % 11 for i in range(n)]
        row = spark.range(1).select(F.array(*[F.lit(v).cast("long") for v in values]).cast("array<bigint>").alias("a") if n else F.expr("cast(array() as array<bigint>) a"))
        want = [sum(values[:i]) for i in range(n + 1)]
        assert row.select(F.expr(prefix_sums("a"))).first()[0] == want


def test_escape_is_reversible(spark):
    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choice(["<", ">", "[", "]", "/", "\\", "s", "SYS", "INST", "x", "</s>", "[INST]"]) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).withColumn("u", unescape(F.col("e"))).collect()
    for r in rows:
        assert r.u == r.t
        assert not any(c in r.e for c in ("</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_prefix_target_examples(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "</s>"]), rng.choice([*NASTY, None])) for c in range(40) for t in range(c % 9 + 1)]
    rows += [(500, 1, "user", "x"), (500, 1, "user", "x"), (500, None, "assistant", "first"), (None, 0, "assistant", "alone")]
    turns = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, example int")
    examples = prefix_examples(turns)
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    convs = {c: sorted(v) for c, v in convs.items()}
    count = Counter(r.conv_id for r in examples.collect())
    assert count == {c: sum(x[2] == "assistant" for x in v) + (v[-1][2] != "assistant") for c, v in convs.items()}
    for r in examples.withColumn("read", read_turns(F.col("formatted"))).collect():
        want = convs[r.conv_id][: r.n_turns]
        got = [(x.role, x.text) for x in r.read]
        assert sorted(got) == sorted((x[2], x[3]) for x in want)
        assert len(r.loss_spans) == (got[-1][0] == "assistant")
        assert r.whole == (r.n_turns == len(convs[r.conv_id]))
    for r in read_back(examples).collect():
        v = convs[r.conv_id]
        loss = "".join(x[3] for x in v if x[2] == "assistant")
        assert r.n_turns == len(v)
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert read_back(prefix_examples(turns.limit(0))).count() == 0


def test_langid_learns_and_marks_undetermined(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "12 ,.- 4", "en"), (-3, "", None), (None, "the cat and the dog", None), (-5, "日本語" * 20000, None), (-6, "ǅ ß İ", None)], docs.schema)
    prototypes = langid.learn(docs.where(~langid.held_out()).unionByName(odd))
    out = {(r.doc_id, r.held): r for r in langid.predict(docs.unionByName(odd).withColumn("held", langid.held_out()), prototypes, carry=("doc_id", "held", "lang")).collect()}
    assert len(out) == docs.count() + 6
    for i in (-1, -2, -3):
        r = next(r for (d, _), r in out.items() if d == i)
        assert (r.lang_pred, r.score) == ("und", 0.0)
    test = [r for (d, held), r in out.items() if held and d is not None and d >= 0]
    assert len(test) > 100
    assert sum(r.lang_pred == r.lang for r in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in langid.predict(docs.limit(5), {}).collect()} == {"und"}
    assert langid.predict(docs.limit(0), prototypes).count() == 0


def test_bundle_equals_plain_sum():
    import numpy as np

    p = langid.Profiles(dimensions=64)
    enc = langid.Encoder(p)
    text = "Ab  c, Äb"
    spaced = "\0ab\0c\0äb\0"
    want = sum(np.roll(enc.letter(ord(a) if a != "\0" else 0), 2).astype(int) * np.roll(enc.letter(ord(b)), 1) * enc.letter(ord(c) if c != "\0" else 0) for a, b, c in zip(spaced, spaced[1:], spaced[2:]) if b != "\0")
    got, n, letters = enc.bundle(["", text, None, "zz"])
    assert (got[1] == want).all() and letters.tolist() == [0, 5, 0, 2] and n[0] == 0


@pytest.mark.parametrize("bucket_rows", [4, 1000])
def test_shards_hold_their_law(spark, bucket_rows):
    rows = [(i, f"text {i % 50}" if i % 7 else None, "hot" if i % 3 == 0 else f"s{i % 11}" if i % 5 else None) for i in range(500)]
    rows += [(3, "text 3", "hot"), (3, "text 3", "hot"), (None, "x", "hot")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, source string, bucket int, rank int")
    got = stratified_shards(docs, Sharding(bucket_rows=bucket_rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.source) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s) for d, t, s in rows)
    assert sorted(r.position for r in got) == list(range(len(rows)))
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(8))
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for source, n in Counter(r.source for r in got).items():
        assert all(abs(sum(r.source == source for r in rs) - n / 8) <= 2 for rs in by.values())
    again = stratified_shards(docs.repartition(5), Sharding(bucket_rows=bucket_rows)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert stratified_shards(docs.limit(0)).count() == 0
    assert sorted(r.shard for r in stratified_shards(docs.limit(3)).collect()) == [2, 5, 7]


def test_rows_without_an_id_are_shuffled_apart(spark):
    """Twenty thousand rows without an id, none of which may crowd one bucket."""
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    numbers = docs.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), (F.octet_length("text").cast("long") + 1).alias("size"))
    held = numbers.groupBy(F.shiftright(shuffle_key(Sharding()), 60)).count().collect()
    assert len(held) == 16 and max(r["count"] for r in held) < 1500
    got = stratified_shards(docs, Sharding(bucket_rows=500)).collect()
    assert sorted(r.position for r in got) == list(range(20_000))
