"""The hidden Markov language model against plain recursions and counts."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chunkwright.llm import hmm, queries

BASE = "/root/testdata/sf0.001"
SMALL = hmm.Hmm(states=3, own_words=5, buckets=7, iterations=3, block_tokens=40, buffer_tokens=100, counted_words=6)


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def base_scores(texts, held):
    counts = Counter()
    for t, h in zip(texts, held):
        if not h:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for t in texts:
        tokens = [*words(t), None]
        out.append((len(tokens), sum(counts[w] > 0 for w in tokens), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)))
    return counts, n, v, out


def test_forward_is_the_sum_over_all_state_paths():
    rng = np.random.default_rng(2)
    p = hmm.Hmm(states=3, own_words=4, buckets=2)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = hmm.Model(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, p.classes))))
    sequences = [rng.integers(0, p.classes, n).astype(np.uint16) for n in (1, 4, 2, 6, 1, 6, 3)]
    want = [math.log10(sum(m.first[z[0]] * m.emits[z[0], s[0]] * math.prod(m.moves[z[i - 1], z[i]] * m.emits[z[i], s[i]] for i in range(1, len(s))) for z in itertools.product(range(3), repeat=len(s)))) for s in sequences]
    for most in (1, 5, 1000):
        assert np.allclose(hmm.log_likelihoods(sequences, m, most), want)
    # Baum-Welch counts against the posterior of every path.
    e = hmm.Expected.none(p)
    e.add(sequences, m, 7)
    first, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, p.classes))
    for s, total in zip(sequences, want):
        for z in itertools.product(range(3), repeat=len(s)):
            w = m.first[z[0]] * m.emits[z[0], s[0]] * math.prod(m.moves[z[i - 1], z[i]] * m.emits[z[i], s[i]] for i in range(1, len(s))) / 10**total
            first[z[0]] += w
            for i, c in enumerate(s):
                emits[z[i], c] += w
                if i:
                    moves[z[i - 1], z[i]] += w
    assert np.allclose(e.first, first) and np.allclose(e.moves, moves) and np.allclose(e.emits, emits) and math.isclose(e.log10, sum(want))


def test_counts_are_whole_and_rounds_improve(spark):
    texts = [f"The cat {i % 3} sat\x0bon\x1cthe MAT Ä{i % 5} {'x' * (i % 90)}" for i in range(60)] + ["", None, "  \n", "only once", "word " * 5000]
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, id string").repartition(3)
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    scored, lm = hmm.train_and_score(rows, hmm.held_out(rows.doc_id), SMALL, "doc_id")
    counts, n, v, want = base_scores(texts, held)
    assert {None if r.word is None else bytes(r.word).decode(): r.n for r in lm.counts.collect()} == dict(counts)
    assert (lm.classes.n, lm.classes.v, lm.classes.ends) == (n, v, counts[None])
    top = sorted((w for w in counts if w is not None and len(w.encode()) <= 64 and counts[w] >= 3), key=lambda w: (-counts[w], w.encode()))[:5]
    assert [w.decode() for w in lm.classes.own] == top
    assert all(b > a - 1e-6 for a, b in zip(lm.log10, lm.log10[1:])) and len(lm.log10) == 3
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == len(texts)
    for i, (n_tokens, n_known, base) in enumerate(want):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known) == (held[i], n_tokens, n_known) and abs(r.base_score - base) < 1e-6 * max(1, -base)
        # The score: a plain forward recursion over classes, then each word within its class.
        p, alpha, total = SMALL, None, 0.0
        for w in [*words(texts[i]), None]:
            if w is None:
                code, within = p.classes - 1, 1.0
            elif w in top:
                code, within = top.index(w), 1.0
            else:
                of = lambda x: int.from_bytes(x.encode()[-3:], "big") % p.buckets
                mates = [x for x in counts if x is not None and x not in top and of(x) == of(w)]
                code, within = p.own_words + of(w), (counts[w] + 0.5) / (sum(counts[x] for x in mates) + 0.5 * (len(mates) + 1))
            alpha = (lm.model.first if alpha is None else alpha @ lm.model.moves) * lm.model.emits[:, code]
            total += math.log10(alpha.sum()) + math.log10(within)
            alpha = alpha / alpha.sum()
        assert abs(r.score - total) < 1e-6 * max(1, -total)


@pytest.mark.parametrize("rows", [[], [(1, "a b"), (1, None)]])
def test_nothing_to_learn_from(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    scored, lm = hmm.train_and_score(df, F.lit(True), SMALL, "doc_id")
    got = [(r.n_tokens, r.n_known, r.base_score) for r in scored.orderBy("n_tokens").collect()]
    assert got == ([(1, 0, 0.0), (3, 0, 0.0)] if rows else []) and lm.classes.n == 0 and lm.log10 == []


def test_repeated_and_missing_ids_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "d"), (4, "e f"), (4, "e f g")], "doc_id long, text string")
    scored, lm = hmm.train_and_score(df, hmm.held_out(df.doc_id), SMALL, "doc_id")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in scored.collect()) == [(0, 2), (0, 4), (0, 4), (4, 3), (4, 4)]


def test_query_beats_single_words_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op11_hidden_markov_model(spark, BASE).collect()}
    held = [zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in docs]
    _, n, _, want = base_scores([r.text for r in docs], held)
    for d, h, (n_tokens, n_known, base) in zip(docs, held, want):
        r = got[d.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n_tokens, n_known, n) and abs(r.base_score - base) < 1e-6 * max(1, -base)
    kept = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in kept) > sum(r.base_score for r in kept)
