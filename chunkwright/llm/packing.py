"""Harmonic packing of tokenized documents into fixed-capacity sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of ``capacity // k`` ids (exact
classes, k up to ``exact_classes``) or, for short pieces, of ``(capacity // (k + 1), capacity // k]``
ids, and a bin of class k takes exactly k pieces. A document is cut greedily at the largest exact class
that still fits, so all but its last, short piece fill their share of a bin without waste. Each worker
fills the bins of its own partition alone. What is left at its end, fewer than k pieces of each class,
is laid end to end and cut at the capacity; the last rest is cut at powers of two, which need no padding.

No shuffle: the operator is one pass over the scan, and a repeated task gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import small_batches
from .tokens import encoder

#: Sequences of one partition have ids from ``partition << SEQUENCE_BITS``.
SEQUENCE_BITS = 36
PIECE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    exact_classes: int = 32
    tokenizer: str = "word_bpe_49k.json"
    end_id: int = 1
    batch_rows: int = 256


def harmonic_class(length: int, capacity: int) -> int:
    """The k with ``capacity // (k + 1) < length <= capacity // k``-like reciprocal fit: pieces a bin takes."""
    return capacity // length


def cut(length: int, p: Packing) -> list[tuple[int, int, int]]:
    """(start, length, class) pieces of a document of ``length`` ids."""
    out, at = [], 0
    while length - at >= p.capacity:
        out.append((at, p.capacity, 1))
        at += p.capacity
    while at < length:
        left = length - at
        k = harmonic_class(left, p.capacity)
        if p.capacity // k != left and k < p.exact_classes:
            k += 1  # the largest exact class below what is left
            left = p.capacity // k
        out.append((at, left, k))
        at += left
    return out


class BinFiller:
    """Fills one worker's bins; ``rows`` collects finished (piece, start, length, sequence, offset), a piece being (doc_id, its document's ids, own ids)."""

    def __init__(self, p: Packing, first_sequence: int):
        self.p, self.next, self.rows = p, first_sequence, []
        self.open: dict[int, list[tuple]] = {}

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc: tuple, start: int, length: int, k: int) -> None:
        bin_ = self.open.setdefault(k, [])
        bin_.append((doc, start, length))
        if len(bin_) == k:
            self._close(self.open.pop(k))

    def _close(self, pieces: list[tuple]) -> None:
        sequence, offset = self._sequence(), 0
        for doc, start, length in pieces:
            self.rows.append((doc, start, length, sequence, offset))
            offset += length

    def finish(self) -> None:
        """Lay the unfilled bins end to end, cut at the capacity, the rest at powers of two."""
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        total = sum(length for _, _, length in rest)
        room: list[int] = [self.p.capacity] * (total // self.p.capacity)
        total %= self.p.capacity
        room += [1 << b for b in range(self.p.capacity.bit_length(), -1, -1) if total >> b & 1]
        bin_: list[tuple] = []
        free = room.pop(0) if room else 0
        for doc, start, length in rest:
            while length:
                take = min(length, free)
                doc_id, n, ids = doc
                bin_.append(((doc_id, n, ids[: 4 * take]), start, take))
                doc = doc_id, n, ids[4 * take :]
                start, length, free = start + take, length - take, free - take
                if not free:
                    self._close(bin_)
                    bin_, free = [], room.pop(0) if room else 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = [[], [], [], [], [], [], []]
    for (doc_id, n, ids), start, length, sequence, offset in rows:
        for col, v in zip(cols, (doc_id, start, length, zlib.crc32(ids), n, sequence, offset)):
            col.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=PIECE_SCHEMA.fieldNames())


def pack_documents(docs: DataFrame, params: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """Pieces of every document and the sequence and offset each lies at.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A null text is an empty one and
    packs as its end id alone; a null doc_id stays null; repeated rows pack once each; an empty table
    gives no rows. Texts of any length are cut, never shortened. ``with_ids`` adds ``ids``, each
    piece's ids as ``array<int>``, for writing the sequences out.
    """
    schema = T.StructType([*PIECE_SCHEMA.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(params.tokenizer)
        end = np.array([params.end_id], dtype="<u4").tobytes()
        filler = BinFiller(params, TaskContext.get().partitionId() << SEQUENCE_BITS)

        def finished() -> Iterator[pa.RecordBatch]:
            if filler.rows:
                rows, filler.rows = filler.rows, []
                batch = _batch(rows)
                if with_ids:
                    flat = [np.frombuffer(ids, "<u4").astype(np.int32) for (_, _, ids), *_ in rows]
                    offsets = np.cumsum([0, *(len(x) for x in flat)])
                    arr = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat)))
                    batch = pa.RecordBatch.from_arrays([*batch.columns, arr], names=schema.fieldNames())
                yield batch

        for batch in batches:
            for at in range(0, batch.num_rows, params.batch_rows):
                part = batch.slice(at, params.batch_rows)
                ids = part.column(0).to_pylist()
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, packed in zip(ids, enc.encode(texts)):
                    packed += end
                    n = len(packed) // 4
                    for start, length, k in cut(n, params):  # an open piece holds its own ids alone
                        filler.add((doc_id, n, packed[4 * start : 4 * (start + length)]), start, length, k)
                yield from finished()
        filler.finish()
        yield from finished()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(fill, schema)
