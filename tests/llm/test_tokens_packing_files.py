"""Packing and token files against the tokenizers library itself."""

import glob
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chunkwright.llm.packing import Packing, cut, pack_documents
from chunkwright.llm.token_files import TokenFiles, read_token_files, write_token_files
from chunkwright.llm.tokens import encoder, tokenizer_path

SCHEMA = "doc_id long, text string, path string, ids string"
LONG = "Lorem ipsum dolor sit amet, 123 " * 3000
TEXTS = ["", None, "a", "The cat's  hat\n\nsat.", "x" * 5000, LONG, "naïve café É é \x1c\x1d b", "<|endoftext|> hi", " lead and trail  \n"]
ROWS = [(i, t, "p", "q") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None), (None, "no id", None, None)] + [(100 + i, f"word {i} " * (i % 40 + 1), "p", "q") for i in range(300)]


@pytest.fixture(scope="module")
def library():
    return {name: Tokenizer.from_file(tokenizer_path(name)) for name in ("word_bpe_49k.json", "byte_bpe_50k.json")}


UNTOUCHED = {name: Tokenizer.from_file(tokenizer_path(name)) for name in ("word_bpe_49k.json", "byte_bpe_50k.json")}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.sampled_from(["don't", "  ", "\n\n x", "Σας ΟΔΟΣ", "é ́", "\x1c", "　a", "<|endoftext|>", "</w>", "a b", "I'LL 12.5"])), max_size=8))
def test_chunked_ids_equal_the_library(parts):
    text = "".join(parts)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = encoder(name)
        assert e.split is not None and e.kind
        got = [np.frombuffer(b, "<u4").tolist() for b in e.encode([text, *parts, text])]
        assert got == [UNTOUCHED[name].encode(t, add_special_tokens=False).ids for t in (text, *parts, text)]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 682, 1000, 1023, 1024, 1025, 2047, 2048, 2049, 5000, 100_001])
def test_cut_covers_each_id_once(n):
    p = Packing()
    at = 0
    for start, length, k in cut(n, p):
        assert start == at and 0 < length and k * length <= p.capacity
        assert k >= p.exact_classes or length == p.capacity // k
        at += length
    assert at == n


def test_packing_against_brute_force(spark, library):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    rows = pack_documents(docs).collect()
    want = {}
    for doc_id, text, *_ in ROWS:
        want.setdefault(doc_id, []).append([*library["word_bpe_49k.json"].encode(text or "", add_special_tokens=False).ids, 1])
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for doc_id, pieces in by_doc.items():
        ids, copies = want[doc_id][0], len(want[doc_id])
        assert all(p.doc_tokens == len(ids) for p in pieces)
        seen = np.zeros(len(ids), int)
        for p in pieces:
            seen[p.start : p.start + p.length] += 1
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        assert (seen == copies).all()
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.03 * total


def test_packing_ids_and_empty(spark):
    docs = spark.createDataFrame(ROWS[:6], SCHEMA)
    assert all(len(r.ids) == r.length for r in pack_documents(docs, with_ids=True).collect())
    assert pack_documents(docs.limit(0)).count() == 0


def test_token_files_round_trip(spark, library, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    base = str(tmp_path / "out")
    params = TokenFiles(sequence_length=64, rows_per_batch=3)
    manifest = write_token_files(docs, base, params)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_files(manifest).collect()))
    start = 0
    ids_of = lambda t: [*library["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids, 0]
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    for (got_start, doc_id, n, crc), (want_id, text, *_) in zip(got, want, strict=True):
        ids = ids_of(text)
        assert (got_start, doc_id, n, crc) == (start, want_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    total = 0
    for path in [f for f in glob.glob(f"{base}/*.arrow") if ".index." not in f]:
        with pa.memory_map(path) as f:
            t = pa.ipc.open_file(f).read_all()
            assert t.schema.field("ids").type == pa.list_(pa.uint16(), 64)
            total += sum(sum(m) for m in t.column("mask").to_pylist())
    assert total == start
    assert not glob.glob(f"{base}/.*part")


def test_token_files_empty(spark):
    docs = spark.createDataFrame(ROWS[:1], SCHEMA).limit(0)
    manifest = write_token_files(docs)
    assert manifest.count() == 0 and read_token_files(manifest).count() == 0
