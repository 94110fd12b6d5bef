"""Conversation structure repair by lazy weighted determinisation.

A conversation is repaired to the role pattern ``(s?(ua)+)?`` by the cheapest edits. The edits are a weighted automaton
of four states, read over one symbol for each row: the initial of its role and its fault. Its subsets are weighted:
what it costs at least to be in each state, less the least of these costs. Such a vector is a state of a deterministic
automaton, and its moves are filled into a table when a symbol is first met there. Scanning the table over the symbols
gives the cost. Going back over the scanned states, the arcs on which a least cost is really reached (tight arcs) are
told from others, and the least letters along these give the audit.

Spark finds faults, orders and counts; a conversation reaches the automaton as a string of symbols, one for each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What edits cost.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Characters that make a blank text, and those that end a whole one.
BLANKS, ENDS = r"[\x20\x09-\x0D]", ".!?"

# States: nothing said, a system row said, a user's turn open, a pair whole. By state: the role said next, and where it leads.
START, SYSTEM, OPEN, WHOLE = range(4)
SAYS = {START: "u", SYSTEM: "u", OPEN: "a", WHOLE: "u"}
LEADS = {START: OPEN, SYSTEM: OPEN, OPEN: WHOLE, WHOLE: OPEN}
ACCEPTING = (START, WHOLE)
INFINITE = 1 << 40
#: No state's future is dearer than another's by more: two insertions (u, a) reach ``WHOLE`` from anywhere, and from there
#: all but a system row can follow. A vector's entry beyond its least by more than this is on no cheapest way and counts as
#: infinite, so that only a bounded number of vectors exists.
BOUND = 2 * INSERT

#: A row's symbol: its role's initial, in capitals if the text is cut off, ``-`` if the row must go, ``o``/``O`` for other roles.
ROLES = {"s": "system", "u": "user", "a": "assistant"}


def row_arcs(state: int, symbol: str) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits of one row, letters in ASCII order."""
    yield "D", DELETE, state
    if symbol == "-":
        return
    extra, initial = (CUT_OFF if symbol.isupper() else 0), symbol.lower()
    if initial == SAYS[state]:
        yield "K", extra, LEADS[state]
    elif initial == "s" and state == START:
        yield "K", extra, SYSTEM
    yield "R", REROLE + extra, LEADS[state]


@dataclass
class Determinised:
    """The deterministic automaton, as far as it has been needed."""

    ids: dict[tuple[int, ...], int] = field(default_factory=dict)
    vectors: list[tuple[int, ...]] = field(default_factory=list)
    #: (state, symbol) to (state after, cost).
    moves: dict[tuple[int, str], tuple[int, int]] = field(default_factory=dict)
    #: (state, symbol, mask of live states after) to (mask before, what each live state does next).
    backs: dict[tuple[int, str, int], tuple[int, dict[int, tuple[str, int]]]] = field(default_factory=dict)

    def state(self, costs: list[int]) -> tuple[int, int]:
        """(id, least cost) of a vector after any insertions."""
        costs = list(costs)
        for _ in range(3):
            for p, q in LEADS.items():
                costs[q] = min(costs[q], costs[p] + INSERT)
        least = min(costs)
        vector = tuple(c - least if c - least <= BOUND else INFINITE for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector], least

    def start(self) -> int:
        return self.state([0, INFINITE, INFINITE, INFINITE])[0]

    def move(self, at: int, symbol: str) -> tuple[int, int]:
        found = self.moves.get((at, symbol))
        if found is None:
            costs = [INFINITE] * 4
            for p, c in enumerate(self.vectors[at]):
                for _, w, q in row_arcs(p, symbol) if c < INFINITE else ():
                    costs[q] = min(costs[q], c + w)
            found = self.moves[at, symbol] = self.state(costs)
        return found

    def insertions(self, at: int, live: dict[int, tuple[str, int]]) -> dict[int, tuple[str, int]]:
        """``live`` with the states that reach one of them by a tight insertion; an insertion comes before K and R, after D."""
        vector, out = self.vectors[at], dict(live)
        for _ in range(3):
            for p, q in LEADS.items():
                if q in out and vector[p] < INFINITE and vector[p] + INSERT == vector[q] and (p not in out or out[p][0] > "I"):
                    out[p] = ("I", q)
        return out

    def final(self, at: int) -> tuple[int, dict[int, tuple[str, int]], int]:
        """(mask of live states, what each does, cost) at the end of a conversation."""
        vector = self.vectors[at]
        cost = min(vector[p] for p in ACCEPTING)
        live = self.insertions(at, {p: ("", p) for p in ACCEPTING if vector[p] == cost})
        return sum(1 << p for p in live), live, cost

    def back(self, at: int, symbol: str, mask: int) -> tuple[int, dict[int, tuple[str, int]]]:
        found = self.backs.get((at, symbol, mask))
        if found is None:
            after, spent = self.move(at, symbol)
            before, reached, live = self.vectors[at], self.vectors[after], {}
            for p, c in enumerate(before):
                for letter, w, q in row_arcs(p, symbol) if c < INFINITE else ():
                    if mask >> q & 1 and c + w == reached[q] + spent:
                        live[p] = (letter, q)
                        break  # letters come in order
            live = self.insertions(at, live)
            found = self.backs[at, symbol, mask] = sum(1 << p for p in live), live
        return found

    def repair(self, symbols: str) -> tuple[int, str, list[int], str]:
        """(cost, audit, row of each turn said or -1, its role's initial or k if kept) of a conversation."""
        states, cost = [self.start()], 0
        for x in symbols:
            at, w = self.move(states[-1], x)
            states.append(at)
            cost += w
        mask, live, last = self.final(states[-1])
        steps = [live]
        for i in range(len(symbols) - 1, -1, -1):
            mask, live = self.back(states[i], symbols[i], mask)
            steps.append(live)
        steps.reverse()
        audit, rows, said, p = [], [], [], START
        for i, live in enumerate(steps):
            letter, q = live[p]
            while letter == "I":
                audit.append(letter)
                rows.append(-1)
                said.append(SAYS[p])
                p = q
                letter, q = live[p]
            audit.append(letter)
            if letter in ("K", "R"):
                rows.append(i)
                said.append("k" if letter == "K" else SAYS[p])
            p = q
        return cost + last, "".join(audit), rows, "".join(said)


_AUTOMATON = Determinised()


def cheapest_edits(conversations: DataFrame) -> DataFrame:
    """``conversations``, with a column symbols, and cost, audit, source (rows from 0, -1 for insertions) and said (initials) of each."""
    added = T.StructType().add("cost", "long").add("audit", "string").add("source", T.ArrayType(T.IntegerType())).add("said", "string")
    schema = T.StructType([*conversations.schema.fields, *added.fields])
    at = conversations.columns.index("symbols")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_AUTOMATON.repair(s) for s in batch.column(at).to_pylist()]
            made = [pa.array(x, kind) for x, kind in zip(zip(*done) if done else [()] * 4, (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "cost", "audit", "source", "said"])

    return conversations.mapInArrow(run, schema)


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by a hash of conversation and turn; null roles and texts are one space.

    Of twenty hashes 0 drops a row (copies 0), 1 empties its text, 2 takes its sentence ends away, 3 repeats it (copies 2)
    and 4 makes it the user's. A null conv_id or turn counts as one space in the hash.
    """
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", None, "turn")])
    way = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        "conv_id",
        "turn",
        F.when(way == 4, "user").otherwise(role).alias("role"),
        F.when(way == 1, "").when(way == 2, F.regexp_replace(text, f"[{ENDS}]", "")).otherwise(text).alias("text"),
        F.when(way == 0, 0).when(way == 3, 2).otherwise(1).alias("copies"),
    )


def gather(turns: DataFrame) -> DataFrame:
    """(conv_id, rows): each conversation's rows (turn, role, text, fault, initial) in order, from (conv_id, turn, role, text, copies).

    fault is the first of blank, duplicate and truncated, or empty. One shuffle: repeated rows are summed before it, and the
    window that finds rows said before deals rows out as the grouping does.
    """
    same = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    gone = F.col("copies") == 0
    order = Window.partitionBy("conv_id").orderBy(gone, "role", "text", F.asc_nulls_first("turn"))
    here = F.struct(gone, "role", "text")
    marked = same.withColumn("seen", F.coalesce(F.lag(here).over(order) == here, F.lit(False)))
    grouped = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("copies") > 0, F.struct("turn", "role", "text", "seen", "copies")))).alias("r"))
    blanks_out = lambda x: F.regexp_replace(x, BLANKS, "")

    def fault(x: Column, again: Column) -> Column:
        last = F.right(F.rtrim(F.translate(x.text, "\t\n\x0b\x0c\r", "     ")), F.lit(1))
        return F.when(blanks_out(x.text) == "", "blank").when(again, "duplicate").when(~last.isin(*ENDS), "truncated").otherwise("")

    def row(x: Column, again: Column) -> Column:
        return F.struct(x.turn.alias("turn"), x.role.alias("role"), x.text.alias("text"), fault(x, again).alias("fault"), F.left(x.role, F.lit(1)).alias("initial"))

    several = F.flatten(F.transform("r", lambda x: F.concat(F.array(row(x, x.seen)), F.array_repeat(row(x, F.lit(True)), (x.copies - 1).cast("int")))))
    return grouped.select("conv_id", several.alias("rows"))


def symbols(rows: Column) -> Column:
    """One character for each row, for the automaton."""

    def symbol(x: Column) -> Column:
        known = F.when(x.initial.isin(*ROLES), x.initial).otherwise("o")
        return F.when(x.fault.isin("blank", "duplicate"), "-").when(x.fault == "truncated", F.upper(known)).otherwise(known)

    return F.array_join(F.transform(rows, symbol), "")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, rows, cost, audit, repaired) from rows (conv_id, turn, role, text) or with ``copies``, how often each counts.

    ``rows`` are the rows as they were, with their faults; ``repaired`` is an array of (role, text). Rows of a conversation
    follow each other by turn, nulls first, then by role and text. Null roles and texts are one space, and so blank; any
    initial but s, u and a, and an empty role, is no role and must be changed or deleted. Repeated rows are duplicates, and rows with a null
    conv_id form one conversation. A conversation without rows has nothing to repair: cost 0, empty audit. An empty table
    gives no rows; other columns are left out. A conversation is held as one row, so its texts must fit one; texts are
    taken whole.
    """
    if "copies" not in turns.columns:
        turns = turns.withColumn("copies", F.lit(1))
    spaced = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.col("copies").cast("long").alias("copies"))
    gathered = gather(spaced)
    edited = cheapest_edits(gathered.select("conv_id", "rows", symbols(F.col("rows")).alias("symbols")))

    def turn(source: Column, at: Column) -> Column:
        was = F.get("rows", source)
        who = F.substr("said", at + 1, F.lit(1))
        name = F.when(who == "k", was.role).when(who == "u", ROLES["u"]).otherwise(ROLES["a"])
        return F.struct(name.alias("role"), F.when(source < 0, "").otherwise(was.text).alias("text"))

    return edited.select("conv_id", "rows", "cost", "audit", F.transform("source", turn).alias("repaired"))


def summary(repaired: DataFrame) -> DataFrame:
    """What was wrong with each conversation, in numbers, and a digest of the repaired one."""
    turns = F.filter(F.transform("rows", lambda x: x.turn), lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0))
    n = lambda fault: F.size(F.filter("rows", lambda x: x.fault == fault)).cast("long").alias(fault)
    pairs = F.zip_with(F.slice("rows", 1, F.greatest(F.size("rows") - 1, F.lit(0))), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), lambda x, y: F.concat(x.initial, F.lit("|"), y.initial))
    illegal = F.size(F.filter(pairs, lambda x: ~x.isin("s|u", "u|a", "a|u")))
    said = F.array_join(F.transform("repaired", lambda x: F.concat(x.role, F.lit(":"), x.text)), "\n")
    return repaired.select("conv_id", gaps.cast("long").alias("gaps"), n("blank"), n("duplicate"), n("truncated"), illegal.cast("long").alias("illegal"), "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"))
