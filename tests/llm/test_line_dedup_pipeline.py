"""Line dedup and the pipeline against brute force."""

import random
import re

import xxhash

import corpus_pipeline
from chunkwright.llm import line_dedup
from chunkwright.llm.decontaminate import SpacedSeeds, tokens
from chunkwright.llm.line_dedup import LineDedup, dedup_lines
from chunkwright.llm.simhash import fingerprint

SMALL = LineDedup(rarity_bits=12, member_bits=12)
SCHEMA = "doc_id long, text string, n_lines int, k1 long"


def token_set(line):
    return frozenset(w for w in re.split("[ \t\x0b\x0c\r\n]+", line.lower()) if w)


def plain_dedup(rows):
    """[(doc_id, text)] to their deduped texts, all pairs of lines; rows of one id are ordered by a hash of their texts."""
    least = -(2**63)
    order = lambda r, d, t: (least if d is None else d, xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63 & 2**64 - 1, r)
    places = sorted((*order(r, d, t), i, token_set(x)) for r, (d, t) in enumerate(rows) if t is not None for i, x in enumerate(t.split("\n")))
    first = {}
    for *place, s in places:
        first.setdefault(s, tuple(place))
    sets = list(first.items())
    gone = {s for s, p in sets if any(q < p and len(s & o) * 9 >= 4 * (len(s) + len(o)) for o, q in sets if o != s)}
    out = []
    for r, (d, t) in enumerate(rows):
        if t is None:
            out.append((d, None, 0, 0))
            continue
        lines = t.split("\n")
        stays = lambda i, s: not s or first[s] == (*order(r, d, t), i) and s not in gone
        left = [x for i, x in enumerate(lines) if stays(i, token_set(x))]
        out.append((d, "\n".join(left), len(lines), len(lines) - len(left)))
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", "a"] * 4 + [f"w{i}" for i in range(200)])
    pool = [" ".join(word() for _ in range(rng.choice([0, 2, 5, 6, 12, 30]))) for _ in range(60)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 8)):
            w = rng.choice(pool).split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = word()
            lines.append(rng.choice([" ", "  ", "\t"]).join(w).upper() if rng.random() < 0.2 else " ".join(w))
        rows.append((i, "\n".join(lines)))
    return rows


def test_line_dedup_against_all_pairs(spark):
    rows = corpus(120, 3)
    rows += [(500, None), (501, ""), (None, "a line of its own w1 w2\nsecond w3 w4 w5 w6"), (7, rows[7][1]), (600, "\n".join("same long line again and again" for _ in range(200))), (601, "x\n" * 300 + " ".join(f"u{i}" for i in range(3000)))]
    got = dedup_lines(spark.createDataFrame([(*r, 9, 9) for r in rows], SCHEMA), SMALL)
    assert got.columns == ["doc_id", "text", "k1", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == sorted(plain_dedup(rows), key=str)


def dedup_and_compare(spark, rows):
    got = dedup_lines(spark.createDataFrame([(*r, 9, 9) for r in rows], SCHEMA), SMALL).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=str) == sorted(plain_dedup(rows), key=str)


def test_rows_that_share_an_id_or_have_none(spark):
    a, b, c = "first line of text here\nLes.", "other words that come second\nles.", "a third that is like none of them"
    dedup_and_compare(spark, [(1, a), (5, b), (5, a)])
    dedup_and_compare(spark, [(None, a), (None, b), (None, a), (7, c), (7, c), (7, None), (-(2**63), b), (None, "")])
    dedup_and_compare(spark, [(5, t) for _, t in corpus(40, 5)] + [(5, a), (5, a), (5, a)])


def test_lines_of_few_words(spark):
    dedup_and_compare(spark, [(1, "Les."), (2, "les.\nLes.  \n\nles. a"), (3, "a b c d\na b c d e\na b c"), (4, " \t\n\x0b\x0c\r\n"), (5, "é\nÉ\nx\ty")])


def test_the_letter_f_is_no_white_space_and_a_form_feed_is(spark):
    dedup_and_compare(spark, [(1, "f\nff\nf F"), (2, "f\nff"), (3, "a b c d e"), (4, "a b\x0cc d e\n\x0c\n \x0c"), (5, "A B\x0cC D E")])


def test_texts_are_not_sorted_to_meet_their_lines(spark):
    rows = [(1, "x y z\n \t\r \n\n\x0b\nx y  z\n"), (2, " \nx y z"), (3, "\f"), (4, None)]
    dedup_and_compare(spark, rows)
    plan = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def test_token_sets_are_made_distinct_without_a_sort(spark, monkeypatch):
    plans, stage = {}, line_dedup.stage_table

    def staged(df, tag, **more):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, tag, **more)

    monkeypatch.setattr(line_dedup, "stage_table", staged)
    texts = ["one two three four five", "Other words\n\nfour of them here", "one two three four five six", "words OTHER\tother"]
    dedup_and_compare(spark, list(zip([2**63 - 1, -(2**63), -5, 0], texts)))
    assert "HashAggregate" in plans["lines"] and "Sort" not in plans["lines"]
    assert " div " not in plans["found"]


def test_hashes_and_places_stay_plain(spark, monkeypatch):
    plans, stage = {}, line_dedup.stage_table

    def staged(df, tag, **more):
        plans.setdefault(tag, df._jdf.queryExecution().executedPlan().toString())
        return stage(df, tag, **more)

    monkeypatch.setattr(line_dedup, "stage_table", staged)
    kept = spark.sparkContext._jsc.sc().getPersistentRDDs
    n = kept().size()
    texts = ["one two three four five", "Other words\n\nfour of them here", "one two three four five six", "words OTHER\tother\none two three four five"]
    dedup_and_compare(spark, list(zip([2**31 - 1, -(2**31), -5, 0], texts)))
    # hashes of words do not pass through a table of lists, places are plain numbers, candidates meet without a sort of all sets
    assert "hashes" not in plans and "InMemoryTableScan" in plans["lines"]
    assert "decimal" not in plans["lines"] and "ShuffledHashJoin" in plans["candidates"]
    assert kept().size() <= n  # nothing stays behind
    dedup_and_compare(spark, list(zip([2**31, -(2**31) - 1, -5, 0], texts)))


def test_columns_of_any_name(spark):
    odd = spark.createDataFrame([(1, "one two three\none two three", 1, 2, 3, 4)], "doc_id long, text string, d long, lines long, `kept.x` long, c0 long")
    got = dedup_lines(odd, SMALL)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"]
    assert [tuple(r) for r in got.collect()] == [(1, "one two three", 1, 2, 3, 4, 2, 1)]


def test_line_dedup_of_a_large_group_and_of_nothing(spark):
    words = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join(words[:36] + [f"v{i}", f"z{i}"])) for i in range(300)]
    docs = spark.createDataFrame([(*r, 9, 9) for r in rows], SCHEMA)
    out = dedup_lines(docs, SMALL).collect()
    assert sorted(r.doc_id for r in out if r.text) == [0]
    assert dedup_lines(docs.limit(0), SMALL).count() == 0


def brute_contaminated(text, items, p=SpacedSeeds()):
    """Whether 13 tokens or more lie over an item's with four of five equal; plain exact passages suffice here."""
    a = tokens(text)
    grams = {tuple(a[i : i + 13]) for i in range(len(a) - 12)}
    return any(tuple(b[i : i + 13]) in grams for b in map(tokens, items) for i in range(len(b) - 12))


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    base = str(tmp_path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [tuple(r) for r in docs.collect()]
    rows += [(9000, None, "en", "s", 0), (9001, "", None, "s", 0), (9002, "12 -- 34", "en", "s", 8), (9003, rows[0][1], None, "s", 1), (9004, rows[1][1] + " more", "en", None, None), (9005, "Clean words here that nobody else has said before, none at all.", None, "s", 1)]
    twice = "Only these few words\n\n\nare said again below"
    rows += [(9006, twice, "en", "s", 1), (9007, twice, "en", "s", 1), (9008, "Only these few words\n\t\nare said again below", "en", "s", 1)]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{base}/documents.parquet")
    bench.write.parquet(f"{base}/benchmark.parquet")
    items = [r.text for r in bench.collect()]

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    outs, now = [], spark.read.parquet(f"{base}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, base)
        outs.append(now.collect())
        if len(outs) < 5:
            assert now.columns == docs.columns
        now = spark.createDataFrame(outs[-1], now.schema)
    kept = [{r.doc_id: r.text for r in o} for o in outs[:4]]
    assert kept[0] == {r[0]: r[1] for r in rows if any(c.isalpha() for c in r[1] or "")}
    want = {d: t for d, t, _, gone in plain_dedup(sorted(kept[0].items())) if not (gone and re.fullmatch(r"[ \t\n\x0b\x0c\r]*", t))}
    assert 9006 in want and 9007 not in want and 9008 not in want
    assert kept[1] == want
    ids = sorted(want)
    fps = {d: fingerprint(want[d]) % (1 << 64) for d in ids}
    group = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and group[a] > group[b]:
                    group[a], changed = group[b], True
    assert kept[2] == {d: want[d] for d in ids if group[d] == d}
    assert kept[3] == {d: t for d, t in kept[2].items() if not brute_contaminated(t, items)}
    assert {r.doc_id for r in outs[4]} == set(kept[3])
    for d in kept[3]:
        pieces = sorted((r.start, r.length) for r in outs[4] if r.doc_id == d)
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
    assert 9005 in kept[3]
    again = corpus_pipeline.run(spark, base).collect()
    assert {(r.doc_id, r.doc_tokens) for r in again} == {(r.doc_id, r.doc_tokens) for r in outs[4]}  # where rests are cut depends on the worker


def test_pipeline_on_empty_tables(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for name, d, b in (("no_docs", docs.limit(0), bench), ("no_items", docs, bench.limit(0))):
        base = str(tmp_path / name)
        d.write.parquet(f"{base}/documents.parquet")
        b.write.parquet(f"{base}/benchmark.parquet")
        assert (corpus_pipeline.run(spark, base).count() > 0) == (name == "no_items")
