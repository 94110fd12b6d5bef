"""SimHash near-duplicates by vantage-point trees over Hamming space.

Each distinct fingerprint is a point. The top of a vantage-point tree, built from a bounded sample of
fingerprints, deals the points into shards: a node sends a point inside when its distance to the vantage
point is at most the node's radius. As a query a point also visits every other shard that the triangle
bound cannot rule out, in one direction only, since links are symmetric. Each shard goes on with an own
tree below and links exactly; it reports a spanning forest, never all pairs. A distributed star
contraction then joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches, stage_table
from . import workers
from .components import star_forest


@dataclass(frozen=True)
class SimHash:
    shingle_words: int = 3
    seed: int = 42
    max_distance: int = 3
    #: Distinct fingerprints a shard should hold.
    shard_points: int = 64_000
    #: Sampled fingerprints per shard from which the driver builds the top tree, and their upper bound.
    sample_per_shard: int = 64
    max_sample: int = 200_000
    leaf_points: int = 192
    candidates: int = 6


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMNS = (256 * np.arange(8)).astype(np.int64)
_BLOCK = 1 << 16


def fingerprint(text: str | None, p: SimHash = SimHash()) -> int:
    """The 64-bit fingerprint of a whole text, as a signed integer; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    k = min(p.shingle_words, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest, seed = xxhash.xxh64_digest, p.seed
    hashes = b"".join([digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[k - 1 :])])
    octets = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    n, set_bits = len(octets), np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        seen = np.bincount((octets[at : at + _BLOCK] + _COLUMNS).ravel(), minlength=2048).reshape(8, 256)
        set_bits += (seen @ _BITS).ravel()
    return int(np.packbits(2 * set_bits > n).view(">i8")[0])


def fingerprints(docs: DataFrame, params: SimHash = SimHash()) -> DataFrame:
    """(doc_id, fp): one row per document, repeated rows included. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("simhash")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fps = [fingerprint(t, params) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _choose(points: np.ndarray, p: SimHash, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that cut the points in two, with as few of them near the cut as can be."""
    sample = points if len(points) <= 2048 else rng.choice(points, 2048, replace=False)
    best = None
    for vantage in rng.choice(points, min(p.candidates, len(points)), replace=False):
        within = np.cumsum(np.bincount(distance(sample, vantage), minlength=65)) / len(sample)
        padded = np.concatenate([np.zeros(64), within, np.ones(64)])
        for radius in range(64):
            if 0.25 <= within[radius] <= 0.75:
                inner, outer = padded[64 + radius + p.max_distance], 1 - padded[64 + radius - p.max_distance]
                cost = max(within[radius], 1 - within[radius]) * (inner + outer)
                if best is None or cost < best[0]:
                    best = cost, vantage, radius
    return best and (np.uint64(best[1]), int(best[2]))


def build_top(points: np.ndarray, leaves: int, p: SimHash, rng: np.random.Generator | None = None) -> tuple | None:
    """Nested (vantage, radius, inner, outer) with about ``leaves`` leaves; None is a leaf."""
    rng = rng or np.random.default_rng(p.seed)
    if leaves <= 1 or len(points) < 2 or (cut := _choose(points, p, rng)) is None:
        return None
    vantage, radius = cut
    inside = distance(points, vantage) <= radius
    share = max(1, min(leaves - 1, round(leaves * inside.mean())))
    return vantage, radius, build_top(points[inside], share, p, rng), build_top(points[~inside], leaves - share, p, rng)


def count_leaves(node: tuple | None) -> int:
    return 1 if node is None else count_leaves(node[2]) + count_leaves(node[3])


def route(node: tuple | None, points: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, point index, home): each point's own shard and the later ones its links may lie in."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def walk(node: tuple | None, first: int, index: np.ndarray, home: np.ndarray) -> None:
        if not len(index):
            return
        if node is None:
            found.append((np.full(len(index), first), index, home))
            return
        vantage, radius, inner, outer = node
        d = distance(points[index], vantage).astype(np.int64)
        inside = d <= radius
        go_in, go_out = d <= radius + max_distance, d > radius - max_distance
        walk(inner, first, index[go_in], (home & inside)[go_in])
        walk(outer, first + count_leaves(inner), index[go_out], (home & ~inside)[go_out])

    walk(node, 0, np.arange(len(points)), np.ones(len(points), bool))
    shard, index, home = (np.concatenate([f[i] for f in found] or [np.empty(0, int)]) for i in range(3))
    own = np.empty(len(points), np.int64)
    own[index[home]] = shard[home]
    keep = shard >= own[index]
    return shard[keep], index[keep], home[keep].astype(bool)


class Links:
    """Union-find over array positions that takes whole arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                jumped = self.root[self.root]
                if (jumped == self.root).all():
                    break
                self.root = jumped


def link_shard(points: np.ndarray, home: np.ndarray, p: SimHash) -> np.ndarray:
    """The root position of every point, linking each query with each home point at most ``max_distance`` away."""
    links, rng = Links(len(points)), np.random.default_rng(p.seed)

    def compare(queries: np.ndarray, data: np.ndarray) -> None:
        step = max(1, (1 << 21) // max(1, len(data)))
        for at in range(0, len(queries), step):
            part = queries[at : at + step]
            i, j = np.nonzero(distance(points[part][:, None], points[data][None, :]) <= p.max_distance)
            links.add(part[i], data[j])

    todo = [(np.arange(len(points)), np.flatnonzero(home))]
    while todo:
        queries, data = todo.pop()
        if not len(queries) or not len(data):
            continue
        cut = _choose(points[data], p, rng) if len(data) > p.leaf_points else None
        if cut is None:
            for at in range(0, len(data), 4096):
                compare(queries, data[at : at + 4096])
            continue
        vantage, radius = cut
        dq, dd = (distance(points[x], vantage).astype(np.int64) for x in (queries, data))
        todo.append((queries[dq <= radius + p.max_distance], data[dd <= radius]))
        todo.append((queries[dq > radius - p.max_distance], data[dd > radius]))
    return links.root


def fingerprint_links(points: DataFrame, params: SimHash = SimHash()) -> DataFrame:
    """Edges (u, v) of a spanning forest per shard over the distinct fingerprints ``points(fp)``.

    The driver sees a count and the bounded sample the top tree is built from.
    """
    n = points.count()
    shards = max(1, -(-n // params.shard_points))
    size = min(params.max_sample, shards * params.sample_per_shard)
    sample = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(size).collect() if shards > 1 else []
    top = build_top(np.array([r.fp for r in sample], np.int64).view(np.uint64), shards, params)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            shard, index, home = route(top, fps.view(np.uint64), params.max_distance)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(fps[index]), pa.array(home)], names=["shard", "fp", "home"])

    def link(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy()
        root = link_shard(fps.view(np.uint64), table.column("home").to_numpy(), params)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": fps[moved], "v": fps[root[moved]]})

    dealt = points.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(link, "u long, v long")


def near_duplicates(docs: DataFrame, params: SimHash = SimHash()) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the least doc_id reachable over links of near fingerprints.

    Null and empty texts have fingerprint 0 and link like any other. A null doc_id is never the least one
    unless a component has no other; repeated rows give repeated results; an empty table gives no rows.
    Only ``doc_id`` and ``text`` are read, so other columns may have any name.
    """
    rows = stage_table(fingerprints(docs, params), "fingerprints")
    points = stage_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    stars = star_forest(fingerprint_links(points, params))
    roots = stars.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    roots = roots.unionByName(stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    linked = roots.join(points, "fp")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    known = points.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    known = stage_table(known, "known")  # so that the join below has plain exchanges, which can be split at hot fingerprints
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, params: SimHash = SimHash()) -> DataFrame:
    """``docs`` with one row left of each component: the one with the least doc_id.

    Rows that share a doc_id are documents of their own; of these the one with the least hash of its text
    counts as first, then any. Rows with a null doc_id come after all others of their component. An empty
    table gives no rows. Columns pass as they are, under any name. Texts meet the rows that go, which are the
    fewer: where those are few enough to be sent to all tasks, no text is shuffled.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    seen = ids.groupBy("doc_id").count().agg(F.max("count").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if (seen.most or 0) <= 1 and not seen.nulls:
        gone = stage_table(near_duplicates(docs, params).where("doc_id <> component_id").select("doc_id"), "gone")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    inner = [f"c{at}" for at in range(len(docs.columns))]
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    rows = stage_table(docs.toDF(*inner).withColumn("row", F.monotonically_increasing_id()), "rows")  # written, so a row keeps its number
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), text.alias("text")), params).select(F.col("doc_id").alias("row"), "component_id")
    found = stage_table(found, "found")
    order = F.struct(doc_id.isNull().alias("a"), doc_id.cast("long").alias("b"), F.xxhash64(text).alias("c"), "row")
    first = found.join(rows.select("row", order.alias("at")), "row").groupBy("component_id").agg(F.min("at").alias("at"))
    gone = stage_table(found.select("row").join(first.select("at.row"), "row", "left_anti"), "gone")
    return rows.join(gone, "row", "left_anti").select(*[F.col(n).alias(c) for n, c in zip(inner, docs.columns)])
