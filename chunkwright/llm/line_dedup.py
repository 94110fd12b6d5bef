"""Line deduplication by an exact set-similarity join, in built-in expressions.

A line's tokens are its distinct lower-cased words, ordered by rarity: by the size class of the number of
lines it is in, then by hash. Two lines are near when the Jaccard likeness of their token sets is at least
the threshold; a line is removed when any line before it, in document and line order, is near.

Lines of equal token sets meet by a hash of the set, so only distinct sets are joined. Two near sets share a
token among their rarest few (prefix filter), have like sizes (length filter), can still reach the needed
overlap from the place of that token on (positional filter), and differ in few enough bits of a parity
signature, a bound on their difference. A semi join of narrow rows on these keeps the candidates. Each
candidate is verified first against the earliest lines it shares a prefix token with, which settles most; those
left are verified against all candidates that share one. Semi joins stop at the first match, so a large group
of like lines makes no pairs. Words are read again for candidates alone, and only met where sizes and
signatures allow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import collect_garbage, drop_table, stage_table

_FIRST = -(2**63)


@dataclass(frozen=True)
class LineDedup:
    #: Jaccard threshold, as a fraction of integers so that bounds are exact.
    near: tuple[int, int] = (4, 5)
    #: Counters of the rarity table, a power of two. The table goes to every task.
    rarity_bits: int = 18
    #: Bits of the table that tells which lines' words are read again.
    member_bits: int = 22
    #: Lines of more tokens have a longer signature.
    long_line: int = 64


def _odd(text: str) -> str:
    """SQL: whether a text has white space other than spaces and line ends."""
    return "(" + " OR ".join(f"contains({text}, '{c}')" for c in ("\\t", "\\u000B", "\\u000C", "\\r")) + ")"  # \\f would be the letter


def _words(line: str) -> str:
    """SQL for the lower-cased words of a line between ASCII white space, with empty ones. Lines of texts that are not ``odd`` split at spaces alone, which is faster."""
    return f"if(odd, split(lower({line}), '[ \\\\x09-\\\\x0D]+'), split(lower({line}), ' '))"


def _blank(text: str) -> str:
    """SQL: whether a text has no word."""
    return f"trim(BOTH ' \\t\\n\\u000B\\u000C\\r' FROM {text}) = ''"


def without_words(text: Column) -> Column:
    """Whether a text is white space alone."""
    return F.trim(text, F.lit(" \t\n\x0b\f\r")) == ""


def _literal(values: list[int], kind: str) -> str:
    """SQL for a constant array."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"


def _rarity_table(hashed: DataFrame, p: LineDedup) -> str:
    """For each counter the size class of the number of lines' words ``hashed`` (t) that fell to it."""
    size = 1 << p.rarity_bits
    words = hashed.select(F.explode("t").alias("w"))
    # A row holds several counters, so that there are no more rows than the fast map of a compiled aggregate takes.
    low = min(size, 1 << 16)
    several = [F.struct((F.col("slot") + at).alias("slot"), F.col(f"n{at}").alias("n")) for at in range(0, size, low)]
    counted = words.groupBy(F.expr(f"cast(w & {low - 1} as int)").alias("slot")).agg(*[F.expr(f"count_if((w & {size - low}) = {at})").alias(f"n{at}") for at in range(0, size, low)])
    counts = counted.select(F.inline(F.array(*several))).where("n > 0")
    # Two size classes for each doubling.
    classed = counts.select("slot", F.least(F.lit(63), F.floor(2 * F.log2("n"))).cast("int").alias("c"))
    rows = classed.groupBy(F.expr("slot div 4096").alias("block")).agg(F.collect_list(F.struct("slot", "c")).alias("s"))
    packed = rows.select("block", F.expr("array_join(transform(s, x -> concat(x.slot % 4096, ':', x.c)), ',')").alias("s"))
    classes = [0] * size
    for r in packed.collect():  # at most `size` small numbers
        for item in r.s.split(","):
            slot, c = item.split(":")
            classes[r.block * 4096 + int(slot)] = int(c)
    return _literal(classes, "tinyint")


def _member_test(keys: DataFrame, key: str, p: LineDedup) -> str:
    """SQL that is true for every ``key`` in ``keys`` and for few others: a bit table of fixed size."""
    bits = 1 << p.member_bits
    words = keys.groupBy(F.expr(f"cast(({key} & {bits - 1}) div 64 as int)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({key} & 63 as int)))").alias("b"))
    packed = words.groupBy(F.expr("w div 1024").alias("block")).agg(F.expr("array_join(transform(collect_list(struct(w, b)), x -> concat(x.w, ':', x.b)), ',')").alias("s"))
    member = [0] * (bits // 64)
    for r in packed.collect():  # at most member_bits / 64 numbers
        for item in r.s.split(","):
            w, b = item.split(":")
            member[int(w)] = int(b)
    return f"shiftright({_literal(member, 'bigint')}[cast(({key} & {bits - 1}) div 64 as int)], cast({key} & 63 as int)) & 1 = 1"


def _hashed(line: str) -> str:
    """SQL for the hashes of a line's distinct words."""
    return f"array_except(transform({_words(line)}, w -> xxhash64(w)), array(xxhash64('')))"


def _tokens(hashes: str, p: LineDedup, table: str) -> str:
    """SQL for a line's distinct word hashes by rarity: the class, which is below 64, in place of the top bits of the hash."""
    ranked = f"{_literal([c << 56 for c in range(64)], 'bigint')}[{table}[x & {(1 << p.rarity_bits) - 1}]] | x & {(1 << 56) - 1}"
    # never null; said so, since arrays that cannot hold nulls are sorted as plain numbers
    return f"sort_array(transform({hashes}, x -> coalesce({ranked}, 0L)))"


def _need(a: str, b: str, p: LineDedup) -> str:
    """The least overlap of near sets of sizes a and b."""
    num, den = p.near
    return f"(({num} * ({a} + {b}) + {num + den - 1}) div {num + den})"


def _maybe_near(ln: str, rn: str, p: LineDedup) -> str:
    """SQL of the length filter and of the signatures' bound on the difference, for sets l and r of sizes ln and rn."""
    num, den = p.near
    # As many bits differ as ln + rn says, odd or even, so ln + rn - 2 * need bounds them just where this does, without a division.
    few = lambda bits: f"({bits}) * {num + den} <= ({ln} + {rn}) * {den - num}"
    # The whole signatures tell most pairs apart, so they are asked first; they differ in no more bits than their parts.
    parts = f"{ln} <= {p.long_line} OR {rn} <= {p.long_line} OR {few('bit_count(l.sig ^ l.part ^ r.sig ^ r.part) + bit_count(l.part ^ r.part)')}"
    return f"{few('bit_count(l.sig ^ r.sig)')} AND {ln} * {den} >= {rn} * {num} AND {rn} * {den} >= {ln} * {num} AND ({parts})"


def _place(docs: DataFrame) -> Column:
    """Of a line the place (d, i), in order: one number where ``d`` is one, since numbers have their least in a hash aggregate, without a sort."""
    kind = docs.schema["d"].dataType.simpleString()
    if kind == "int":
        return F.expr("shiftleft(cast(d as bigint), 32) + i")
    return F.struct("d", "i") if kind != "bigint" else F.expr("cast(cast(d as decimal(19)) * 4294967296 + i as decimal(30))")


def _placed(docs: DataFrame) -> list[Column]:
    """``d`` and ``i`` of a place."""
    kind = docs.schema["d"].dataType.simpleString()
    if kind == "int":
        return [F.expr("cast(shiftright(place, 32) as int)").alias("d"), F.expr("cast(place & 4294967295 as int)").alias("i")]
    if kind != "bigint":
        return [F.col("place.d").alias("d"), F.col("place.i").alias("i")]
    i = "pmod(place, 4294967296)"
    return [F.expr(f"cast((place - {i}) / 4294967296 as bigint)").alias("d"), F.expr(f"cast({i} as int)").alias("i")]


def near_lines(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """Of ``docs`` (d, text), with ``d`` unique and not null, the places (d, i) of the lines that stay.

    Lines without a word are not among them; of the lines of one token set only the first can be.
    """
    num, den = p.near
    docs = docs.where("text IS NOT NULL").withColumn("odd", F.expr(_odd("text")))
    lines = docs.select("d", "odd", F.posexplode(F.split("text", "\n")).alias("i", "line"))

    # Texts are split once for both the counts and the sets; a hash takes up to 8 bytes until the sets are made.
    # Lines without a word are told by their empty sets, which is cheaper than to look at the lines.
    # They are read twice and soon dropped: Spark keeps arrays as they lie in memory, where Parquet would take them apart.
    hashed = lines.select("d", "i", F.expr(_hashed("line")).alias("t")).persist(StorageLevel.DISK_ONLY)
    tokens = hashed.where("size(t) > 0").select("d", "i", F.expr(_tokens("t", p, _rarity_table(hashed, p))).alias("t"))
    bits = [*(1 << b for b in range(63)), _FIRST]
    short = f"slice(t, 1, n - (({num} * n + {den - 1}) div {den}) + 1)"
    keyed = tokens.select("d", "i", "t", F.size("t").alias("n")).select(
        F.xxhash64("t").alias("k"),
        F.expr(f"aggregate(t, 0L, (a, x) -> a ^ {_literal(bits, 'bigint')}[x & 63])").alias("sig"),
        _place(docs).alias("place"),
        "n",
        # the part of the signature that half of the tokens make: a long line is told by both parts
        F.expr(f"if(n > {p.long_line}, aggregate(t, 0L, (a, x) -> a ^ {_literal([0] * 64 + bits, 'bigint')}[x & 127]), 0L)").alias("part"),
        F.expr(f"transform({short}, x -> cast((x & 4294967295) - 2147483648 as int))").alias("prefix"),
    )
    # Every token set once, at its first place; k and sig together name it, and the rest of the key follows from it.
    first = keyed.groupBy("k", "sig", "n", "part", "prefix").agg(F.min("place").alias("place"))
    sets = stage_table(first.select("k", "sig", *_placed(docs), "n", "part", "prefix"), "lines", repeats=False)
    hashed.unpersist(blocking=True)

    # One row for each prefix token: (token, half of k), signature and part, (size, place).
    spread = sets.select("k", "sig", "n", "part", F.posexplode("prefix").alias("pos", "token")).select(
        F.expr("shiftleft(cast(token as bigint), 32) | (k & 4294967295)").alias("a"),
        "sig",
        "part",
        F.expr("shiftleft(cast(n as bigint), 16) | least(pos, 65535)").alias("c"),
    )
    left, right = spread.alias("l"), spread.alias("r")
    ln, rn, lp, rp = "shiftright(l.c, 16)", "shiftright(r.c, 16)", "(l.c & 65535)", "(r.c & 65535)"
    alike = f"""shiftright(l.a, 32) = shiftright(r.a, 32) AND {_maybe_near(ln, rn, p)}
        AND (l.a <> r.a OR l.sig <> r.sig) AND least({ln} - {lp}, {rn} - {rp}) * {num + den} >= ({ln} + {rn}) * {num}"""
    found = stage_table(left.join(right, F.expr(alike), "left_semi").select("a", "sig"), "found", repeats=False)

    collect_garbage(docs.sparkSession)

    # The candidates' places, and from the texts their words.
    spark, half = docs.sparkSession, F.expr("k & 4294967295").alias("half")
    # Distinct narrow rows are met in hash joins, so that the many rows beside them need not be sorted.
    which = found.select(F.expr("a & 4294967295").alias("half"), "sig").distinct().hint("shuffle_hash")
    chosen = sets.select("k", "sig", "part", "n", "d", "i", half).join(which, ["half", "sig"], "left_semi").drop("half")
    candidates = stage_table(chosen, "candidates", repeats=False)
    inside = lambda key: F.expr(_member_test(candidates.select(F.xxhash64(*key).alias("h")), "h", p))
    here = docs.withColumn("h", F.xxhash64("d")).where(inside(["d"])).select("d", "odd", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    texts = here.withColumn("h", F.xxhash64("d", "i")).where(inside(["d", "i"])).select("d", "i", F.expr(_hashed("line")).alias("t"))  # met as sets, in any order
    whole = stage_table(texts.join(candidates.select("k", "sig", "d", "i"), ["d", "i"]).select("k", "sig", "t"), "whole", repeats=False)

    # (set, prefix token) rows of the candidates, narrow still.
    at = _place(docs) if docs.schema["d"].dataType.simpleString() == "int" else F.struct("d", "i")
    named = candidates.select("k", "sig", "part", "n", at.alias("at"), half)
    rows = found.select(F.expr("shiftright(a, 32)").alias("token"), F.expr("a & 4294967295").alias("half"), "sig").join(named.hint("shuffle_hash"), ["half", "sig"]).drop("half")
    rows = stage_table(rows, "tokens", repeats=False)
    drop_table(spark, found)
    drop_table(spark, candidates)
    before = f"l.token = r.token AND r.at < l.at AND {_maybe_near('l.n', 'r.n', p)}"
    near = lambda a, b: f"size(array_intersect({a}, {b})) >= {_need(f'size({a})', f'size({b})', p)}"

    # Against the earliest set of each token.
    earliest = rows.groupBy("token").agg(F.min("at").alias("at"), *[F.min_by(c, "at").alias(c) for c in ("k", "sig", "part", "n")])
    pairs = rows.alias("l").join(earliest.alias("r"), F.expr(before)).select("l.k", "l.sig", F.col("r.k").alias("wk"), F.col("r.sig").alias("wsig")).distinct()
    other = whole.select(F.col("k").alias("wk"), F.col("sig").alias("wsig"), F.col("t").alias("wt"))
    checked = pairs.join(whole, ["k", "sig"]).join(other, ["wk", "wsig"])
    settled = stage_table(checked.where(F.expr(near("t", "wt"))).select("k", "sig").distinct(), "settled")

    # The rest that may have an earlier neighbour, against all that may be one.
    left = rows.join(settled, ["k", "sig"], "left_anti").alias("l")
    open_ = stage_table(left.join(rows.alias("r"), F.expr(before), "left_semi"), "open", repeats=False)
    others = rows.alias("r").join(open_.alias("l"), F.expr(before), "left_semi")
    left, right = open_.join(whole, ["k", "sig"]).alias("l"), others.join(whole, ["k", "sig"]).alias("r")
    more = stage_table(left.join(right, F.expr(f"{before} AND {near('l.t', 'r.t')}"), "left_semi").select("k", "sig").distinct(), "more")
    for used in (whole, rows, open_):
        drop_table(docs.sparkSession, used)
    collect_garbage(docs.sparkSession)  # before the texts are shuffled
    removed = settled.unionByName(more)
    return sets.select("k", "sig", "d", "i").join(removed.hint("shuffle_hash"), ["k", "sig"], "left_anti").select("d", "i")


def _with_places(docs: DataFrame) -> DataFrame:
    """``docs`` (c0, c1, ..., id, text) with ``d``, unique and in order: the id, an int where all are, or with repeated ids (id, hash of the text, row)."""
    least = F.coalesce(F.col("id").cast("long"), F.lit(_FIRST))
    most, low, high = docs.groupBy(least.alias("d")).count().agg(F.max("count"), F.min("d"), F.max("d")).first()
    if (most or 0) <= 1:
        return docs.withColumn("d", least.cast("int") if most and -(2**31) <= low and high < 2**31 else least)
    rows = stage_table(docs.withColumn("row", F.monotonically_increasing_id()), "rows")  # written, so a row keeps its number
    return rows.withColumn("d", F.struct(least.alias("id"), F.xxhash64("text").alias("h"), "row")).drop("row")


def dedup_lines(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """``docs`` with near repeats of earlier lines taken out of ``text``, and ``n_lines`` and ``n_removed``.

    All lines of all documents are compared, those of one document too, whatever their length. Lines without
    a word always stay. A null text stays null and has 0 lines; a document may end with an empty text. Null
    doc_ids come first; rows that share a doc_id (or have none) are ordered by a hash of their texts and are
    documents of their own, so a repeated row loses all lines with words. An empty table gives no rows. Very
    long texts and lines are read whole. Other columns pass under any name; ``n_lines`` and ``n_removed`` of
    ``docs`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{at}") for at, c in enumerate(names)], F.col("doc_id").alias("id"), "text")
    own = _with_places(own)
    kept = near_lines(own.select("d", "text"), p)
    words = kept.groupBy("d", F.expr("i div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, i % 64))").alias("b"))
    bits = words.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("bits"))
    # A row of `bits` is small and there is one for each document, so texts need not be sorted to meet them.
    joined = own.join(bits.hint("shuffle_hash"), "d", "left").withColumn("lines", F.split("text", "\n"))
    dense = "transform(sequence(0, (size(lines) - 1) div 64), w -> coalesce(try_element_at(bits, w), 0L))"
    joined = joined.withColumn("kept", F.expr(f"if(lines IS NULL, NULL, {dense})"))
    stays = f"shiftright(kept[shiftright(i, 6)], i) & 1 = 1 OR {_blank('l')}"  # a shift takes i modulo 64
    joined = joined.withColumn("left", F.expr(f"filter(lines, (l, i) -> {stays})"))
    # made once in a generator, which no later filter or projection is pushed through to make it again
    made = F.struct(F.array_join("left", "\n").alias("text"), F.expr("if(lines IS NULL, 0, size(lines))").alias("n_lines"), F.expr("if(lines IS NULL, 0, size(lines) - size(left))").alias("n_removed"))
    out = joined.select(*[f"c{at}" for at, c in enumerate(names) if c != "text"], F.inline(F.array(made)).alias("text", "n_lines", "n_removed"))
    return out.select(*[F.col("text" if c == "text" else f"c{at}").alias(c) for at, c in enumerate(names)], "n_lines", "n_removed")
