"""The registered queries themselves, against plain code."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chunkwright.llm import langid, pii, queries
from chunkwright.llm.sharding import Sharding
from chunkwright.llm.tokens import tokenizer_path

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "", r.lang, r.source) for r in spark.read.parquet(f"{BASE}/documents.parquet").orderBy("doc_id").collect()]


def plain_bundle(text, p, letters):
    """The sum of a text's trigram vectors and their number, trigram by trigram."""
    codes = [0]
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or codes[-1]:
            codes.append(code)
    if codes[-1]:
        codes.append(0)
    counted = {}
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b:
            counted[a, b, c] = counted.get((a, b, c), 0) + 1
    total = np.zeros(p.dimensions)
    for (a, b, c), n in counted.items():
        total += n * (np.roll(letters.letter(a), 2) * np.roll(letters.letter(b), 1) * letters.letter(c)).astype(np.float64)
    return total, sum(counted.values())


def test_op4_against_plain_vectors(spark, documents):
    p = langid.Profiles()
    letters = langid.Encoder(p)
    bundles = {d: plain_bundle(t, p, letters) for d, t, _, _ in documents}
    out = {r.doc_id: r for r in queries.op4_hyperdimensional_langid(spark, BASE).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in bundles}
    assert {d: r.held_out for d, r in out.items()} == held
    learned = {}
    for d, _, lang, _ in documents:
        v, n = bundles[d]
        if lang is not None and not held[d] and n:
            learned[lang] = learned.get(lang, 0) + v / n
    names = sorted(learned)
    for d, text, _, _ in documents:
        v, n = bundles[d]
        if not any(c.isalpha() for c in text):
            assert (out[d].lang_pred, out[d].score) == ("und", 0.0)
            continue
        cosines = [float(v @ learned[x] / max(1e-12, np.linalg.norm(v) * np.linalg.norm(learned[x]))) for x in names]
        assert abs(out[d].score - max(0, max(cosines))) < 1e-4 and cosines[names.index(out[d].lang_pred)] > max(cosines) - 1e-4


def test_op7_against_plain_ranking(spark, documents):
    hashed = {r.doc_id: r.h for r in spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", F.xxhash64(F.lit(Sharding().seed), "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("h")).collect()}
    by_source = {}
    for d, text, _, source in documents:
        by_source.setdefault(source, []).append((hashed[d], d))
    order = sorted(((2 * rank + 1) / (2 * len(rows)), "" if source is None else "=" + source, d) for source, rows in by_source.items() for rank, (_, d) in enumerate(sorted(rows)))
    n, want = len(order), {}
    for position, (_, _, d) in enumerate(order):
        shard = ((position + 1) * 8 - 1) // n
        want[d] = shard, position - shard * n // 8
    got = queries.op7_stratified_shards(spark, BASE).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want
    text_of = {d: t for d, t, _, _ in documents}
    assert all(r.size == len(text_of[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text_of[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in got)


def test_op2_and_op10_hold_every_id(spark, documents):
    words, octets = (Tokenizer.from_file(tokenizer_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    pieces, sequences = {}, {}
    for r in queries.op2_harmonic_packing(spark, BASE).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    at = 0
    found = {r.doc_id: r for r in queries.op10_arrow_token_files(spark, BASE).collect()}
    for d, text, _, _ in documents:
        ids, start = [*words.encode(text, add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (start, len(ids), crc(ids[start : start + r.length]))
            start += r.length
        assert start == len(ids)
        ids = [*octets.encode(text, add_special_tokens=False).ids, 0]
        assert (found[d].start, found[d].n_tokens, found[d].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    for held in sequences.values():
        held.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and held[0][0] == 0 and sum(held[-1]) <= 2048


def test_op3_edits_and_fingerprints(spark, documents):
    got = {r.doc_id: r for r in queries.op3_bottom_k_fingerprints(spark, BASE).collect()}
    prints = {}
    for (d, text, _, _), (_, after, _, _) in zip(documents, [*documents[1:], documents[0]]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, got[d].fingerprint) == got[d].fingerprint and 0 <= got[d].near_next <= 1


def test_op1_recall_of_planted_spans(spark, documents):
    """Personal data in other shapes than the base rules', planted in the middle of documents."""
    planted = [
        ("phone", "call", "(212) 555-{:04d}"), ("phone", "Telefon", "030 {:06d}"), ("phone", "tel.", "415-555-{:04d}"), ("email", "write to", "ana.b{} [at] mail [dot] org"),
        ("ip", "host", "2001:0db8:85a3:0000:0000:8a2e:0370:{:04x}"), ("national_id", "ssn", "219-09-{:04d}"), ("iban", "iban", "DE89 3704 0044 0532 {:04d} 00"), ("secret", "token =", "9f86d081884c7d659a2feaa0c55a{:04x}"),
    ]
    rows, want = [], []
    for i, (d, text, _, _) in enumerate(documents[:160]):
        kind, hint, shape = planted[i % len(planted)]
        value, head = shape.format(7000 + i), text[: len(text) // 2].rsplit(" ", 1)[0]
        start = len(head) + len(hint) + 2
        rows.append((i, f"{head} {hint} {value} {text[len(text) // 2 :].lstrip()}"))
        want.append((i, kind, start, start + len(value)))
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.explode(F.concat(*[F.transform(c, lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"))) for c in ("base", "added")])).alias("x")).collect()
    spans = {(r.doc_id, pii.KINDS[r.x.kind], r.x.start, r.x.end) for r in found}
    assert sum(w in spans for w in want) >= 0.9 * len(want)


def test_op1_op5_and_op8_as_registered(spark, documents):
    """The registered queries' own columns, against the rules of the contract in plain code."""
    import re

    import xxhash

    got = {r.doc_id: r for r in queries.op1_boosted_pii(spark, BASE).collect()}
    luhn = lambda digits: sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([ -]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][ ().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    for d, text, _, _ in documents:
        spans = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in rules.items()}
        base = [x for found in spans.values() for x in found]
        assert [got[d][f"n_{k}"] for k in rules] == [len(x) for x in spans.values()]
        assert got[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(got[d].spans.split(",")) | {""} - ({""} if base else set())
    prints = {r.doc_id: r for r in queries.op8_simhash_vptree(spark, BASE).collect()}
    want = {}
    for d, text, _, _ in documents:
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
        hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))] if words else []
        want[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert prints[d].fingerprint == f"{want[d]:016x}"
    group = {d: d for d in want}
    for _ in range(8):
        for a in want:
            for b in want:
                if (want[a] ^ want[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    assert {d: r.component_id for d, r in prints.items()} == group
    rows = queries.op5_spaced_seed_decontamination(spark, BASE).collect()
    assert len({r.doc_id for r in rows}) > 0 and {r.doc_id for r in rows} <= set(want)
