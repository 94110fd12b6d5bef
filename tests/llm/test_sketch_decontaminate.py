"""Sketches and decontamination against brute force."""

import bisect
import hashlib
import random
from collections import Counter
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from chunkwright.llm import sketch
from chunkwright.llm.decontaminate import SeedIndex, SpacedSeeds, drop_contaminated, find_overlaps, tokens

SCHEMA = "doc_id long, text string, sketch string, bucket int"


def make(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4)))
    return [" ".join(word() for _ in range(rng.choice([0, 1, 3, 5, 8, 60, 400]))) for _ in range(n)]


def shingles(text):
    w = (text or "").split(" ")
    w = [x for y in w for x in y.split("\n") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_neighbours_and_likeness(spark):
    texts = make(300, 1) + ["é😀x" * 50, None, ""]
    ids = random.Random(2).sample(range(-50, 5000), len(texts))
    rows = [(i, t, "c", 1) for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    params = sketch.Sketch(bucket_docs=20)
    got = {r.doc_id: r for r in sketch.neighbour_sketches(docs, params).collect()}
    order = sorted((i, t or "") for i, t, *_ in rows)
    assert len(got) == len(rows)
    for at, (i, text) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = map(shingles, (text, edited, following))
        for value, want, union in ((r.near_edited, jaccard(a, b), a | b), (r.near_next, jaccard(a, c), a | c)):
            assert abs(value - want) <= (1e-9 if len(union) <= params.k else 0.2)
        if len(a) < params.k:
            assert r.n_shingles == len(a)
        else:
            assert abs(r.n_shingles / len(a) - 1) < 0.4
    one = {r.doc_id: r.sketch for r in sketch.neighbour_sketches(docs, sketch.Sketch()).collect()}
    assert one == {i: r.sketch for i, r in got.items()}


def plain_next(rows):
    signed = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], signed(r[1]), r[1]))
    return [(*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order)]


def test_many_rows_without_an_id_or_with_one_take_several_buckets(spark, monkeypatch):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = []
    real = sketch._edges
    monkeypatch.setattr(sketch, "_edges", lambda *a: kept.append(real(*a)) or kept[-1])
    got = sketch.with_next_text(docs, sketch.Sketch(bucket_docs=500)).collect()
    assert Counter((r.doc_id, r.text, r.next_text) for r in got) == Counter(plain_next(rows))
    signed = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63
    held = Counter(bisect.bisect_right(kept[0], (-(2**63) if d is None else d, signed(t))) for d, t in rows)
    assert max(held.values()) < 1500 and len(held) > 30


def test_repeated_null_and_few_ids(spark):
    rows = [(1, "b", "", 0), (1, "a", "", 0), (None, "n", "", 0), (2, "c", "", 0), (2, "c", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.text, r.next_text) for r in sketch.with_next_text(docs, sketch.Sketch(bucket_docs=1)).collect()), key=str)
    assert got == sorted(plain_next([r[:2] for r in rows]), key=str)
    assert sketch.neighbour_sketches(docs.limit(0)).count() == 0
    alone = sketch.with_next_text(docs.limit(1)).first()
    assert alone.next_text == alone.text


def test_merge_and_containment(spark):
    base = make(40, 7)
    docs = spark.createDataFrame([(i, t, "", i % 3) for i, t in enumerate(base)], SCHEMA)
    p = sketch.Sketch(k=64)
    parts = sketch.fingerprint(docs.drop("sketch"), p)
    merged = {r.bucket: r.sketch for r in sketch.merge_groups(parts, "bucket", p=p).collect()}
    hashes = {}
    for r in sketch.fingerprint(docs.drop("sketch"), sketch.Sketch(k=100000)).collect():
        hashes.setdefault(r.bucket, set()).update(r.sketch)
    assert merged == {b: sorted(h)[:64] for b, h in hashes.items()}
    long = " ".join(f"w{i}" for i in range(2000))
    pair = spark.createDataFrame([(long, " ".join(long.split()[:1000]))], "a string, b string")
    pair = pair.select(sketch.word_hashes(F.col("a")).alias("x"), sketch.word_hashes(F.col("b")).alias("y")).select(sketch.bottom_k(sketch.shingle_hashes("x")).alias("x"), sketch.bottom_k(sketch.shingle_hashes("y")).alias("y"))
    r = pair.select(sketch.containment(F.col("x"), F.col("y")).alias("xy"), sketch.containment(F.col("y"), F.col("x")).alias("yx"), sketch.distinct_shingles(F.col("x")).alias("n")).first()
    assert abs(r.xy - 0.5) < 0.15 and r.yx > 0.85 and abs(r.n / 1996 - 1) < 0.25


def test_masks_find_two_substitutions_in_thirteen():
    p = SpacedSeeds()
    for k in range(3):
        for gone in combinations(range(13), k):
            assert any(all(c == "0" or o + j not in gone for j, c in enumerate(m)) for m in p.masks for o in range(14 - len(m)))


def brute(doc, item, p):
    """The longest overlap over all diagonals, from every window that a mask fits."""
    a, b, best = tokens(doc), tokens(item), None
    for d in range(-len(b), len(a)):
        lo, hi = max(0, -d), min(len(b), len(a) - d)
        same = [a[k + d] == b[k] for k in range(lo, hi)]
        for mask in p.masks:
            for s in range(len(same) - len(mask) + 1):
                if all(same[s + j] for j, c in enumerate(mask) if c == "1"):
                    start, stop = s, s + len(mask)

                    def reach(flags):
                        total = top = at = 0
                        for n, f in enumerate(flags, 1):
                            total += 1 if f else -p.mismatch_cost
                            if total > top:
                                top, at = total, n
                        return at

                    stop += reach(same[stop:])
                    start -= reach(same[:start][::-1])
                    m = sum(same[start:stop])
                    if stop - start >= p.min_overlap and m >= p.mismatch_cost * (stop - start - m):
                        found = (stop - start, m, -(lo + d + start), -(lo + start))
                        best = max(best or found, found)
    return best


def test_overlaps_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "a", "in", "to", "x1", "y2", "z3"] + [f"w{i}" for i in range(60)])
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40))), "p") for i in range(12)] + [(50, None, "p"), (51, "", "p"), (None, "no id " + " ".join(word() for _ in range(20)), "p")]
    docs = []
    for i in range(80):
        w = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            passage = rng.choice(items[:12])[1].split()
            passage = passage[rng.randint(0, 4) :]
            for _ in range(rng.randint(0, 4)):
                passage[rng.randrange(len(passage))] = word()
            at = rng.randint(0, len(w))
            w[at:at] = passage
        docs.append((i, (", " if i % 3 else "  ").join(w) if i % 5 else " ".join(w).upper(), "e"))
    docs += [(200, None, "e"), (201, "", "e"), (7, docs[7][1], "e")]
    for p in (SpacedSeeds(), SpacedSeeds(block_tokens=60)):
        D, B = spark.createDataFrame(docs, "doc_id long, text string, tokens string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")
        got = sorted(((r.doc_id, r.item_id, r.tokens, r.matches, r.doc_token, r.item_token) for r in find_overlaps(D, B, p).collect()), key=str)
        want = []
        for doc_id, text, _ in docs:
            for item_id, item, _ in items:
                f = brute(text, item, p)
                if f:
                    want.append((doc_id, item_id, f[0], f[1], -f[2], -f[3]))
        assert got == sorted(want, key=str)
        assert len(want) > 20
        bad = {w[0] for w in want}
        kept = drop_contaminated(D, B, p)
        assert kept.schema == D.schema
        assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, *_ in docs if d not in bad)
    assert find_overlaps(D.limit(0), B).count() == 0
    assert find_overlaps(D, B.limit(0)).count() == 0 and drop_contaminated(D, B.limit(0)).count() == len(docs)


def test_spans_hold_the_passage(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    text = "So: " + item.upper().replace(" ", "\n") + ". End"
    r = find_overlaps(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).first()
    assert text[r.start : r.end].split() == item.upper().split()


def test_equal_hashes_are_checked():
    index = SeedIndex([(1, " ".join(f"t{i}" for i in range(20)))], SpacedSeeds())
    assert index.overlaps([" ".join(f"t{i}" for i in range(20)), "t1 t2 t3", None, " ".join(f"t{i}" for i in range(0, 40, 2))]).keys() == {0}
