"""Conversation repair against a search over all edit strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from chunkwright.llm import queries, repair

BASE = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def least(rows):
    """(cost, audit, repaired) of rows (role, text, fault): every way to edit them, by a table of all prefixes' best (cost, audit) for each role string's end."""
    start = {"": (0, "", ())}  # by shape: "", s, open, whole

    def follow(shape, initial):
        if initial == "s":
            return "s" if shape == "" else None
        if initial == "u":
            return "open" if shape in ("", "s", "whole") else None
        return "whole" if initial == "a" and shape == "open" else None

    def offer(table, shape, entry):
        if shape is not None and (shape not in table or entry[:2] < table[shape][:2]):
            table[shape] = entry

    def insert(table):
        for _ in range(4):
            for shape, (c, audit, said) in list(table.items()):
                for role in ("user", "assistant"):
                    offer(table, follow(shape, role[0]), (c + 5, audit + "I", (*said, f"{role}:")))
        return table

    table = insert(dict(start))
    for role, text, fault in rows:
        after = {}
        for shape, (c, audit, said) in table.items():
            offer(after, shape, (c + 2, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            cut = 5 * (fault == "truncated")
            offer(after, follow(shape, role[:1]), (c + cut, audit + "K", (*said, f"{role}:{text}")))
            for to in ("user", "assistant"):
                offer(after, follow(shape, to[0]), (c + cut + 1, audit + "R", (*said, f"{to}:{text}")))
        table = insert(after)
    return min((table[s] for s in ("", "whole") if s in table), key=lambda e: e[:2])


def search(rows, bound):
    """(cost, audit) by trying edit strings themselves, up to ``bound`` insertions."""
    best = None

    def go(i, initials, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if i < len(rows):
            role, _, fault = rows[i]
            go(i + 1, initials, cost + 2, audit + "D", inserted)
            if fault not in ("blank", "duplicate"):
                cut = 5 * (fault == "truncated")
                go(i + 1, initials + (role[:1] if role[:1] in ("s", "u", "a") else "?"), cost + cut, audit + "K", inserted)
                for to in "ua":
                    go(i + 1, initials + to, cost + cut + 1, audit + "R", inserted)
        if inserted < bound:
            for to in "ua":
                go(i, initials + to, cost + 5, audit + "I", inserted + 1)

    go(0, "", 0, "", 0)
    return best


def plain(table, damaged=True):
    by_conv = {}
    for conv, turn, role, text in table:
        role, text = role if role is not None else " ", text if text is not None else " "
        kept = by_conv.setdefault(conv, [])
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 19
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        kept += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    out = {}
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for turn, role, text in rows:
            bare = text.strip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n = lambda f: sum(x[2] == f for x in judged)
        illegal = sum((a[0][:1], b[0][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(judged, judged[1:]))
        cost, audit, said = least(judged)
        out[conv] = (gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_least_itself_against_all_edit_strings():
    rng = random.Random(1)
    for _ in range(250):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), "x", rng.choice(["", "", "", "blank", "truncated"])) for _ in range(rng.randrange(5))]
        assert least(rows)[:2] == search(rows, 3)


def test_automaton_on_all_short_strings():
    automaton, roles = repair.Determinised(), {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in range(5):
        for symbols in itertools.product("suaoSUAO-", repeat=n):
            rows = [(roles.get(x.lower(), "user"), "x", "blank" if x == "-" else "truncated" if x.isupper() else "") for x in symbols]
            assert automaton.repair("".join(symbols))[:2] == least(rows)[:2], symbols
    assert len(automaton.vectors) < 500


@pytest.mark.parametrize("seed", range(3))
def test_automaton_on_long_strings(seed):
    rng, automaton = random.Random(seed), repair.Determinised()
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(300):
        symbols = rng.choices("suaoSUAO-", weights=rng.choice([(1,) * 9, (1, 5, 5, 1, 0, 1, 1, 0, 1), (9, 1, 1, 1, 9, 1, 1, 1, 1)]), k=rng.randrange(5, 40))
        rows = [(roles.get(x.lower(), "user"), f"t{i}", "blank" if x == "-" else "truncated" if x.isupper() else "") for i, x in enumerate(symbols)]
        cost, audit, source, said = automaton.repair("".join(symbols))
        names = {"u": "user", "a": "assistant"}
        made = tuple(f"{rows[i][0] if w == 'k' else names[w]}:{rows[i][1] if i >= 0 else ''}" for i, w in zip(source, said))
        assert (cost, audit, made) == least(rows)
    before = len(automaton.vectors)
    automaton.repair("u" * 100_000 + "s" * 1000)
    assert len(automaton.vectors) < before + 50


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_odd_conversations(spark):
    rng = random.Random(5)
    texts = ["a.", "b", "", None, " \t\n", "c! ", "d?\r\n", ". x", "é.", "a.\x0b"]
    rows = [(rng.choice([*range(60), None]), rng.choice([None, 0, 1, 2, 3, 5, 9, -4]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for _ in range(600)]
    rows += [(900, 1, "user", "same.")] * 40 + [(901, None, "user", "x."), (901, None, "assistant", "y.")]
    rows += [(902, i, "user" if i % 2 else "assistant", f"word {i}." * (3000 if i == 7 else 1)) for i in range(400)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], f"{SCHEMA}, rows long, symbols string")
    assert got(repair.summary(repair.repair_conversations(repair.damage(df)))) == plain(rows)
    assert got(repair.summary(repair.repair_conversations(df))) == plain(rows, damaged=False)


def test_empty_table_and_general_output(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair_conversations(repair.damage(empty)).count() == 0
    df = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "bot", "b.")], SCHEMA)
    r = repair.repair_conversations(df).select("audit", "cost", F.to_json("repaired").alias("r")).first()
    assert (r.audit, r.cost) == ("KRR", 2) and r.r == '[{"role":"system","text":"s."},{"role":"user","text":"a."},{"role":"assistant","text":"b."}]'


def test_query_against_plain_code(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{BASE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_determinised_repair(spark, BASE)) == plain(rows)
