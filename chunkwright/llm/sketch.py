"""Bottom-k sketches of word-shingle hashes, in built-in expressions.

A text's shingles (five words; all words if there are fewer) are hashed, and its sketch is the k least
distinct hashes. Sketches of parts merge by keeping the k least of their union, the sketch of the whole.
While a sketch holds fewer than k hashes it is the whole set and every estimate is exact; then the k-th
least hash tells the number of distinct shingles, and the share of common hashes among the k least of a
union tells resemblance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table


@dataclass(frozen=True)
class Sketch:
    shingle_words: int = 5
    k: int = 128
    #: Documents a neighbour bucket should hold, and the most buckets.
    bucket_docs: int = 2_000
    max_buckets: int = 32_768


_SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Runs of characters between ASCII white space."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _SPACE, " " * len(_SPACE))
    return F.array_remove(F.split(spaced, " "), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_hashes(column: str, p: Sketch = Sketch()) -> Column:
    """Hashes of all shingles of an array column of word hashes. Hashing the words' hashes builds no strings."""
    h, n = F.col(column), p.shingle_words
    many = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
    few = F.array(F.aggregate(h, F.size(h).cast("long"), lambda a, x: F.xxhash64(a, x)))
    return F.when(F.size(h) >= n, many).when(F.size(h) > 0, few).otherwise(F.array().cast("array<bigint>"))


def bottom_k(hashes: Column, p: Sketch = Sketch()) -> Column:
    """The sketch of an array of hashes: the k least distinct ones, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, p.k)


def merge(a: Column, b: Column, p: Sketch = Sketch()) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, p.k)


def distinct_shingles(sketch: Column, p: Sketch = Sketch()) -> Column:
    """Estimated number of distinct shingles: exact below k, then (k - 1) over the k-th least hash's place in its range."""
    place = (F.element_at(sketch, p.k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < p.k, F.size(sketch).cast("double")).otherwise((p.k - 1) / place)


def resemblance(a: Column, b: Column, p: Sketch = Sketch()) -> Column:
    """Estimated Jaccard likeness of two sketched sets; 1 if both are empty."""
    union = merge(a, b, p)
    common = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union).cast("double"))


def containment(a: Column, b: Column, p: Sketch = Sketch()) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    union = merge(a, b, p)
    total = distinct_shingles(union, p) * resemblance(a, b, p)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total / distinct_shingles(a, p)))


def as_text(sketch: Column) -> Column:
    """A sketch as 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def fingerprint(docs: DataFrame, p: Sketch = Sketch()) -> DataFrame:
    """``docs`` with ``sketch``, one row per row. A null or white text has an empty sketch; repeated rows repeat."""
    hashed = docs.withColumn("__words", word_hashes(F.col("text")))
    return hashed.withColumn("sketch", bottom_k(shingle_hashes("__words", p), p)).drop("__words")


def merge_groups(sketches: DataFrame, *keys: str, p: Sketch = Sketch()) -> DataFrame:
    """The sketch of each group from its members' sketches: hashes are made distinct before the shuffle, then ranked."""
    hashes = sketches.select(*keys, F.explode("sketch").alias("h")).distinct()
    salted = hashes.withColumn("__salt", F.pmod("h", F.lit(64)))
    least = salted.groupBy(*keys, "__salt").agg(F.slice(F.sort_array(F.collect_list("h")), 1, p.k).alias("part"))
    return least.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("part"))), 1, p.k).alias("sketch"))


def _literal(values: list[int]) -> Column:
    """An array literal: a foldable expression, which the optimizer evaluates once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


_LEAST = -(2**63)


def _edges(ids: list[int], nulls: int, p: Sketch) -> list[tuple[int, int]]:
    """Where buckets begin, as (id, hash of the text), from quantiles of the ids: an id that several quantiles hit, or null, is cut by hash into as many buckets."""
    times = {_LEAST: max(1, nulls // p.bucket_docs)}
    for i in ids:
        times[i] = times.get(i, 0) + 1
    cuts = {(i, _LEAST + (j << 64) // m) for i, m in times.items() for j in range(m)} - {(_LEAST, _LEAST)}
    return sorted(cuts)


def with_next_text(docs: DataFrame, p: Sketch = Sketch()) -> DataFrame:
    """(doc_id, text, next_text): the text of the next document by doc_id, the first one's after the last.

    Quantiles of the ids deal the documents into range buckets; a bucket's first document is also sent to the
    bucket before, so each bucket finds all its neighbours alone and every text is shuffled once. Null doc_ids
    come first, as if they were the least id there is; documents of one id, or without any, are ordered by the hash of
    their texts, so many of them take several buckets. Null texts count as empty. A text of any length is one row.
    An empty table gives no rows; other columns are left out, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"id": F.coalesce("doc_id", F.lit(_LEAST)), "h": F.xxhash64("text")})
    n, nulls = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    buckets, ids = max(1, min(p.max_buckets, (n - nulls) // p.bucket_docs)), []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        ids = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, max(10_000, 8 * buckets))).first()[0] or []
    edges = _edges(ids, nulls, p)
    find = F.lit(0)
    if edges:
        first, second = (_literal([e[i] for e in edges]) for i in (0, 1))
        # binary search: the number of edges at or below a row
        steps = [1 << b for b in reversed(range(len(edges).bit_length()))]

        def below(at: Column) -> Column:
            edge = F.try_element_at(first, at)
            return F.coalesce((edge < F.col("id")) | ((edge == F.col("id")) & (F.try_element_at(second, at) <= F.col("h"))), F.lit(False))

        find = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(below(at + s), at + s).otherwise(at))
    dealt = rows.withColumn("bucket", find)
    # the first row of each bucket that has any, from ids and hashes alone; bounded by the number of buckets
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("least")).orderBy("bucket").collect()
    if not firsts:
        return rows.select("doc_id", "text", F.lit(None).cast("string").alias("next_text"))
    heads, previous = [(0, 0)] * (len(edges) + 1), [0] * (len(edges) + 1)
    for i, r in enumerate(firsts):
        heads[r.bucket], previous[r.bucket] = tuple(r.least), firsts[i - 1].bucket
    is_head = (F.col("id") == F.get(_literal([x[0] for x in heads]), F.col("bucket"))) & (F.col("h") == F.get(_literal([x[1] for x in heads]), F.col("bucket")))
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(_literal(previous), F.col("bucket")).cast("int").alias("bucket"), F.lit(True).alias("guest"))
    placed = dealt.select("doc_id", "id", "h", "text", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
    order = Window.partitionBy("bucket").orderBy("guest", "id", "h", "text")
    placed = placed.select("doc_id", "id", "h", "text", "at.bucket", "at.guest").withColumn("next_text", F.lead("text").over(order))
    return placed.where(~F.col("guest")).select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter, in code points rounded down, replaced by as many first ones of ``following``."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - cut), F.substr(following, F.lit(1), cut))


def neighbour_sketches(docs: DataFrame, p: Sketch = Sketch()) -> DataFrame:
    """Each document's sketch, that of its edited text, and the likeness to it and to the next document.

    (doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next, n_shingles). A table
    of one document is its own next. An empty table gives no rows.
    """
    pairs = with_next_text(docs, p).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    hashed = pairs.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        word_hashes(F.col("text")).alias("w"),
        word_hashes(F.col("edited")).alias("e"),
        word_hashes(F.col("next_text")).alias("x"),
    )
    made = hashed.select("doc_id", "n_chars", "edited_sha256", *[bottom_k(shingle_hashes(c, p), p).alias(name) for c, name in (("w", "sketch"), ("e", "edited_sketch"), ("x", "next_sketch"))])
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return made.select("doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", resemblance(a, b, p).alias("near_edited"), resemblance(a, c, p).alias("near_next"), distinct_shingles(a, p).alias("n_shingles"))
