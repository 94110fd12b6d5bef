"""Benchmark decontamination by spaced seeds.

A mask fixes which positions of a token window count; the others are ignored, so one substituted token
does not hide a passage. Windows of the benchmark are hashed under every mask and joined with the hashes
of the documents' windows; around every hit the two texts are laid over each other, without gaps, and the
overlap is extended both ways to its best score (a match gains 1, a substitution costs 4, so any overlap
kept has at least four of five tokens equal). Overlaps of ``min_overlap`` tokens or more count.

The best score leaves substituted tokens at the ends out, and so may leave less than ``min_overlap``. With
``untrimmed`` any stretch of that length around the hit counts that has four of five tokens equal, so all
passages the masks promise to find are kept. Items shorter than ``min_overlap`` must then be met whole: such
an item is cut into one piece more than it may have substitutions, so one of its pieces is met as it is.

A benchmark of at most ``block_tokens`` tokens goes to the workers, and one pass without a shuffle compares it
with all documents. A larger one is never collected: the window hashes of both sides are joined as narrow rows,
and each pair of texts that shares one meets once for each way to lay them over each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches, stage_table
from . import workers

_TOKEN = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20


@dataclass(frozen=True)
class SpacedSeeds:
    #: 1: the token counts. In any 13 tokens, with 2 of them substituted anywhere, one mask fits somewhere.
    masks: tuple[str, ...] = ("11101011", "11001111")
    min_overlap: int = 13
    mismatch_cost: int = 4
    #: Judge the stretch around a hit before its ends are trimmed, and look up short items whole.
    untrimmed: bool = False
    #: Most benchmark tokens, reckoned as four characters each, that are sent to the workers; beyond it windows are joined.
    block_tokens: int = 400_000
    batch_rows: int = 256


#: The whole job: what the query and the pipeline use.
EVERY = SpacedSeeds(untrimmed=True)


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """One hash for each window of ``mask`` over ``ids``; wraps."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for at, c in enumerate(mask):
        if c == "1":
            out = (out + ids[at : at + n]) * _STEP
            out ^= out >> np.uint64(29)
    return out


class Judge:
    """How texts laid over each other are judged."""

    def __init__(self, p: SpacedSeeds):
        self.p = p

    def _pieces(self, n: int) -> list[tuple[int, str]]:
        """(place, mask) of the pieces of a short item of n tokens, one more than the substitutions it may have."""
        cuts = n // (self.p.mismatch_cost + 1) + 1
        ends = [n * k // cuts for k in range(cuts + 1)]
        return [(a, "1" * (b - a)) for a, b in zip(ends, ends[1:]) if b > a]

    def _longest(self, same: np.ndarray, start: int, stop: int) -> tuple[int, int] | None:
        """The longest stretch around the hit at [start, stop) with enough equal tokens, the first of equal length."""
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -self.p.mismatch_cost))])
        beyond = np.maximum.accumulate(total[stop:][::-1])  # the best total at an end or after it, from the last end back
        last = len(same) - np.searchsorted(beyond, total[: start + 1], "left")  # the last end that reaches each start's total
        length = np.where(last >= stop, last - np.arange(start + 1), -1)
        first = int(length.argmax())
        return (first, int(last[first])) if length[first] > 0 else None

    def _extend(self, same: np.ndarray, start: int, stop: int) -> tuple[int, int]:
        """The best-scoring overlap around the hit at [start, stop)."""
        gain = np.where(same, 1, -self.p.mismatch_cost)
        right = np.cumsum(gain[stop:])
        left = np.cumsum(gain[:start][::-1])
        if len(right) and right.max() > 0:
            stop += int(right.argmax()) + 1
        if len(left) and left.max() > 0:
            start -= int(left.argmax()) + 1
        return start, stop

    def _enough(self, same: np.ndarray, start: int, stop: int, least: int | None = None) -> bool:
        """Whether [start, stop) is ``least`` tokens (``min_overlap``) or more, enough of them equal."""
        matches = int(same[start:stop].sum())
        return stop - start >= (least or self.p.min_overlap) and matches >= self.p.mismatch_cost * (stop - start - matches)

    def _short(self, n: int) -> bool:
        """Whether an item of n tokens must be met whole."""
        return self.p.untrimmed and n < self.p.min_overlap

    def stretch(self, same: np.ndarray, hit: int, end: int, n: int) -> tuple[int, int] | None:
        """The stretch to judge around the hit at [hit, end) of an item of n tokens; none if the document ends within a short item."""
        if self._short(n):
            return (0, len(same)) if len(same) == n else None
        start, stop = self._extend(same, hit, end)
        if self.p.untrimmed and not self._enough(same, start, stop):
            return self._longest(same, hit, end) or (start, stop)
        return start, stop

    def best_of(self, doc: np.ndarray, item: np.ndarray, diagonal: int, hits: list[tuple[int, int]]) -> tuple | None:
        """The best (length, matches, -document token, -item token) overlap of two texts' token hashes laid over each other at ``diagonal``, from the windows (item token, length) they share."""
        a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        same, best = doc[a + diagonal : b + diagonal] == item[a:b], None
        for at, length in hits:
            stretch = self.stretch(same, at - a, at - a + length, len(item))
            if stretch and self._enough(same, *stretch, len(item) if self._short(len(item)) else None):
                start, stop = stretch
                found = (stop - start, int(same[start:stop].sum()), -(a + diagonal + start), -(a + start))
                best = max(found, best or found)
        return best


class SeedIndex(Judge):
    """The windows of one block of benchmark items. Token ids start at 1; 0 is any other token."""

    def __init__(self, items: list[tuple], p: SpacedSeeds):
        super().__init__(p)
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple] = []
        seeds: dict[str, list[tuple[np.ndarray, np.ndarray, int]]] = {mask: [] for mask in p.masks}
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)], np.int64)
            wide = ids.astype(np.uint64)
            if p.untrimmed and len(ids) < p.min_overlap:
                for at, mask in self._pieces(len(ids)):
                    seeds.setdefault(mask, []).append((_hashes(wide[at : at + len(mask)], mask), np.array([at]), len(self.items)))
            else:
                for mask in p.masks:
                    h = _hashes(wide, mask)
                    seeds[mask].append((h, np.arange(len(h)), len(self.items)))
            self.items.append((item_id, ids))
        self.masks = []
        for mask, found in seeds.items():
            key = np.concatenate([h for h, _, _ in found] or [np.empty(0, np.uint64)])
            item = np.concatenate([np.full(len(h), i) for h, _, i in found] or [np.empty(0, int)])
            at = np.concatenate([places for _, places, _ in found] or [np.empty(0, int)])
            order = np.argsort(key, kind="stable")
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[key >> np.uint64(64 - _FILTER_BITS)] = True
            self.masks.append((mask, key[order], item[order], at[order], maybe))

    def overlaps(self, texts: list[str | None]) -> dict[int, dict[int, tuple]]:
        """By row and item position, the best (length, matches, -document token, -item token) overlap."""
        get, gap = self.vocabulary.get, max(len(mask) for mask, *_ in self.masks)
        ids, begins = [], []
        at = 0
        for text in texts:
            words = [get(w, 0) for w in tokens(text)]
            begins.append(at)
            ids.append(np.array(words, np.int64))
            ids.append(np.zeros(gap, np.int64))  # no window spans two texts and hits
            at += len(words) + gap
        flat = np.concatenate([*ids, np.zeros(0, np.int64)])
        begins = np.array(begins)
        wide = flat.astype(np.uint64)
        seen: set[tuple[int, int, int, int, int]] = set()
        best: dict[int, dict[int, tuple]] = {}
        for mask, key, item, where, maybe in self.masks:
            if not len(key):
                continue
            h = _hashes(wide, mask)
            near = np.flatnonzero(maybe[h >> np.uint64(64 - _FILTER_BITS)])
            low, high = np.searchsorted(key, h[near], "left"), np.searchsorted(key, h[near], "right")
            for position, lo, hi in zip(near[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                row = int(np.searchsorted(begins, position, "right")) - 1
                first, size = int(begins[row]), len(ids[2 * row])
                for j in range(lo, hi):
                    diagonal = position - first - int(where[j])
                    item_ids = self.items[item[j]][1]
                    a, b = max(0, -diagonal), min(len(item_ids), size - diagonal)
                    hit, end = int(where[j]) - a, int(where[j]) + len(mask) - a
                    if end > b - a or hit < 0:
                        continue
                    same = ids[2 * row][a + diagonal : b + diagonal] == item_ids[a:b]
                    chosen = [hit + k for k, c in enumerate(mask) if c == "1"]
                    if not same[chosen].all():
                        continue  # equal hashes of other tokens
                    stretch = self.stretch(same, hit, end, len(item_ids))
                    if stretch is None:
                        continue
                    start, stop = stretch
                    if (row, item[j], diagonal, start, stop) in seen:
                        continue
                    seen.add((row, item[j], diagonal, start, stop))
                    if self._enough(same, start, stop, len(item_ids) if self._short(len(item_ids)) else None):
                        found = (stop - start, int(same[start:stop].sum()), -(a + diagonal + start), -(a + start))
                        rows = best.setdefault(row, {})
                        rows[int(item[j])] = max(found, rows.get(int(item[j]), found))
        return best


def _fits(rows: DataFrame, p: SpacedSeeds) -> bool:
    """Whether a benchmark is small enough to be sent to the workers."""
    return (rows.agg(F.sum(F.char_length("text"))).first()[0] or 0) // 4 <= p.block_tokens


def _indexes(rows: DataFrame, p: SpacedSeeds) -> Iterator[SeedIndex]:
    """The index of a benchmark that fits; none without items."""
    items = sorted(((r.item_id, r.text) for r in rows.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    if items:
        yield SeedIndex(items, p)


def _token_hashes(text: str | None) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in tokens(text)], np.uint64)


def _windows(rows: DataFrame, key: str, masks: tuple[str, ...], p: SpacedSeeds, items: bool) -> DataFrame:
    """(seed, size, key, at): the windows of every text under ``masks``; of short items their pieces instead."""
    judge = Judge(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("decontaminate")
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = _token_hashes(text)
                if items and judge._short(len(ids)):
                    found = [(mask, _hashes(ids[at : at + len(mask)], mask), np.array([at])) for at, mask in judge._pieces(len(ids))]
                else:
                    found = [(mask, h, np.arange(len(h))) for mask in masks for h in [_hashes(ids, mask)]]
                for mask, h, at in found:
                    if len(h):
                        seed = h ^ np.uint64(xxhash.xxh64_intdigest(mask.encode()))  # a seed belongs to its mask
                        columns = [seed.view(np.int64), np.full(len(h), len(mask), np.int32), np.full(len(h), number, np.int64), at.astype(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "size", key, "at"])

    return rows.select(key, "text").mapInArrow(run, f"seed long, size int, {key} long, at long")


def _joined(docs: DataFrame, items: DataFrame, p: SpacedSeeds) -> DataFrame:
    """(row, item_id, item, length, matches, doc_token, item_token, start, end): the best overlap of each document and item, by joins.

    ``docs`` is (row, text), ``items`` (item, item_id, text), with unique numbers. Windows meet by their hash in plain
    exchanges, which adaptive execution splits at frequent seeds; the hits of a pair at one diagonal are no more
    than the item has windows.
    """
    # the masks of a short item's pieces, of which there is one for each length a piece may have
    judge = Judge(p)
    pieces = {mask for n in range(1, p.min_overlap) for _, mask in judge._pieces(n)} if p.untrimmed else set()
    inside = _windows(items, "item", p.masks, p, True).withColumnRenamed("at", "item_at")
    around = _windows(docs, "row", tuple(sorted(pieces.union(p.masks))), p, False)
    met = around.join(inside, ["seed", "size"]).select("row", "item", (F.col("at") - F.col("item_at")).alias("diagonal"), F.struct(F.col("item_at").alias("at"), "size").alias("hit"))
    hits = stage_table(met.groupBy("row", "item", "diagonal").agg(F.sort_array(F.collect_set("hit")).alias("hits")), "hits")
    laid = hits.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").join(docs.select("row", "text"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("decontaminate")
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = judge.best_of(_token_hashes(r["text"]), _token_hashes(r["item_text"]), r["diagonal"], [(h["at"], h["size"]) for h in r["hits"]])
                if found:
                    spans = [m.span() for m in _TOKEN.finditer(r["text"].lower())]
                    length, matches, doc_token, item_token = found
                    rows.append((r["row"], r["item"], r["item_id"], *found, spans[-doc_token][0], spans[-doc_token + length - 1][1]))
            if rows:
                names = ["row", "item", "item_id", "length", "matches", "doc_token", "item_token", "start", "end"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    seen = laid.mapInArrow(run, "row long, item long, item_id long, length long, matches long, doc_token long, item_token long, start long, end long")
    best = F.max(F.struct("length", "matches", "doc_token", "item_token", "item_id", "start", "end")).alias("best")
    return seen.groupBy("row", "item").agg(best).select("row", "best.*").withColumns({"doc_token": -F.col("doc_token"), "item_token": -F.col("item_token")})


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with a number of their own, written, so that a row keeps it."""
    return stage_table(rows.withColumn(name, F.monotonically_increasing_id()), name)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, params: SpacedSeeds = SpacedSeeds()) -> DataFrame:
    """(doc_id, item_id, tokens, matches, doc_token, item_token, start, end): the longest overlap of each pair that has one.

    Token places count from 0; ``start`` and ``end`` are code points of the document's text, end exclusive
    (of its lower-cased form where lower-casing changes its length). Of a passage whose trimmed overlap is too
    short the longest sufficient stretch around a hit is given. Null and empty texts and items overlap nothing,
    nor do items and texts of less than ``min_overlap`` tokens, but with ``untrimmed`` a shorter item is found
    where it is met whole; an item's repeated rows or id are looked up one by one and give a row each if they
    differ in text; repeated documents give repeated rows; empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, tokens long, matches long, doc_token long, item_token long, start long, end long"
    spark, out = docs.sparkSession, None
    source = docs.select(F.col("doc_id").cast("long"), "text")
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").distinct()
    if not _fits(items, params):
        rows = _numbered(source, "row")
        found = _joined(rows, _numbered(items, "item"), params).join(rows.select("row", "doc_id"), "row")
        return found.select("doc_id", "item_id", F.col("length").alias("tokens"), "matches", "doc_token", "item_token", "start", "end")
    for index in _indexes(items, params):
        shared = spark.sparkContext.broadcast(index)  # at most block_tokens tokens

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            workers.enter("decontaminate")
            for batch in batches:
                for at in range(0, batch.num_rows, params.batch_rows):
                    part = batch.slice(at, params.batch_rows)
                    texts, doc_ids = part.column(1).to_pylist(), part.column(0).to_pylist()
                    rows = []
                    for row, items in sorted(shared.value.overlaps(texts).items()):
                        spans = [m.span() for m in _TOKEN.finditer(texts[row].lower())]
                        for i, (length, matches, doc_token, item_token) in sorted(items.items()):
                            rows.append((doc_ids[row], shared.value.items[i][0], length, matches, -doc_token, -item_token, spans[-doc_token][0], spans[-doc_token + length - 1][1]))
                    if rows:
                        names = ["doc_id", "item_id", "tokens", "matches", "doc_token", "item_token", "start", "end"]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: SpacedSeeds = SpacedSeeds()) -> DataFrame:
    """``docs`` without the rows whose text overlaps a benchmark item; all columns and other rows stay as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").distinct()
    if not _fits(items, params):
        inner = [f"c{i}" for i in range(len(docs.columns))]
        rows = _numbered(docs.toDF(*inner), "row")
        hit = _joined(rows.select("row", F.col(f"c{at}").alias("text")), _numbered(items, "item"), params).select("row").distinct()
        return rows.join(hit, "row", "left_anti").select(*[F.col(n).alias(c) for n, c in zip(inner, docs.columns)])
    for index in _indexes(items, params):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most block_tokens tokens

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            workers.enter("decontaminate")
            for batch in batches:
                for first in range(0, batch.num_rows, params.batch_rows):
                    part = batch.slice(first, params.batch_rows)
                    hit = shared.value.overlaps(part.column(at).to_pylist())
                    yield part.filter(pa.array([i not in hit for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
