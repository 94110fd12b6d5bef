"""Personal data by candidate gradient boosting, in built-in expressions.

Base rules find plainly formatted e-mail addresses, IP addresses, card and phone numbers. Beyond these,
high-recall generators propose spans that may overlap: loosely written phone numbers, spelled-out e-mail
addresses, IPv6 addresses, identity numbers, bank accounts, keys. Boosted trees judge each candidate by its
format and the words around it; a threshold for each kind, calibrated on rows kept from the fit, selects
redactions; the most probable come first, and one that overlaps a span kept before it goes. Base spans always stay.

The trees are fitted on ``training_rows`` made-up sentences with known answers, since no table labels
personal data; the fit happens on the driver, the trees run as a SQL expression where the texts lie.
No shuffle: every document is judged in its own row.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import prefix_sums
from .boosting import BoostedTrees

#: Kinds in the order of results; the first four have base rules.
KINDS = ("email", "ip", "card", "phone", "national_id", "iban", "secret")

# Fixed patterns of the base rules, written so that no text makes them backtrack at length: a match can only
# begin where a longer one to its left cannot, and runs are taken whole.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"

# Where a phone number of fixed grouping may begin and end: beside another number, but not within one. The first
# look ahead spares most places the looks behind.
_BEGIN, _END = r"(?=[0-9(])(?<![0-9A-Za-z+,:])(?<![0-9][.-])(?<!(?:^|[^0-9])[./-])", r"(?![0-9A-Za-z])(?![.-][0-9])"

# Spelled-out e-mail addresses: marks in brackets, bare words, or an @ among spaces.
_AT, _DOT, _NAME = r" ?[\[({<] ?(?:at|AT) ?[\])}>] ?", r"(?:\.| ?[\[({<] ?(?:dot|DOT) ?[\])}>] ?)", "[A-Za-z0-9-]{1,63}+"
_SPELLED = rf"(?:{_AT}{_NAME}(?:{_DOT}{_NAME}){{1,4}}| (?:at|AT) {_NAME}(?: (?:dot|DOT) {_NAME}){{1,4}}|(?: @ ?|@ ){_NAME}(?:\.{_NAME}){{1,4}})"
_HEX, _KEY = "[0-9A-Fa-f]{1,4}", "[A-Za-z0-9+/_-]"

#: (kind, pattern) of the generators.
GENERATORS = (
    ("phone", r"(?<![0-9A-Za-z+.,:/-])(?:1[ .-])?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,8}\)?){1,5}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+.,:/-])0[0-9]{8,11}(?![0-9A-Za-z])"),
    ("email", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+{_SPELLED}"),
    ("ip", rf"(?<![0-9A-Za-z:])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])"),
    ("national_id", r"(?<![0-9A-Za-z-])(?:[0-9]{3}[ .-][0-9]{2}[ .-][0-9]{4}|[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]|[0-9]{8}-?[A-Z])(?![0-9A-Za-z-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("secret", rf"(?<=[=:] {{0,2}}[\"']?|[Bb]earer )(?<!{_KEY}){_KEY}{{16,}}+(?:\.{_KEY}{{8,}}+){{0,2}}={{0,2}}"),
    # Fixed groupings, which may lie within a longer run of digit groups.
    ("phone", rf"{_BEGIN}(?:\([0-9]{{3}}\)[ ./-]{{0,2}}|[0-9]{{3}}[ ./-]{{1,2}})[0-9]{{3}}[ ./-][0-9]{{4}}{_END}"),
    ("phone", rf"{_BEGIN}[0-9]{{3}}[ ./-][0-9]{{3}}[ ./-][0-9]{{3}}{_END}"),
    ("phone", rf"{_BEGIN}0[0-9](?:[ ./-][0-9]{{2}}){{4}}{_END}"),
    ("phone", rf"{_BEGIN}\(?0[0-9]{{1,4}}\)?[ /-]{{1,2}}[0-9]{{5,8}}{_END}"),
    ("phone", rf"{_BEGIN}\(?0[0-9]{{1,4}}\)?[ /-]{{1,2}}[0-9]{{3,4}}[ -][0-9]{{3,5}}{_END}"),
)

#: Words near a candidate, by what they speak for.
HINTS = {
    "near_phone": "phone|tel|call|mobile|fax|whatsapp|telefon|anruf|appel|portable|llam|m.vil",
    "near_id": "ssn|social|national id|passport|dni|nif|insurance|ausweis|s.cu",
    "near_bank": "iban|bank|account|konto|compte|cuenta|transfer",
    "near_key": "token|key|secret|passw|pwd|auth|credential|bearer",
    "near_mail": "mail|contact|write|reach|address|schreib|.crire|correo",
    "near_other": "order|invoice|item|isbn|version|ref|page|serial|date|time|score|total|price|hash|sha|md5|commit|id:|digest|bestell|facture|pedido",
}
FEATURES = ("generator", "n_chars", "n_digits", "n_letters", "n_groups", "n_kinds", "bracket", "dashes", "dots", "datelike", "zero_first", "repeats", "sign_before", *HINTS)


@dataclass(frozen=True)
class Pii:
    #: Made-up sentences for the fit, a quarter of them kept for calibration.
    training_rows: int = 4_000
    seed: int = 11
    context_chars: int = 40
    #: Share of right redactions that a kind's threshold must reach on the calibration rows.
    precision: float = 0.97


def _spans(text: str, pattern: str, kind: str, context: int | None = None) -> Column:
    """Spans of all leftmost non-overlapping matches in column ``text``: kind, start, end, value (and context)."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    return F.when(F.size(found) > 0, F.struct(found.alias("m"), F.split(F.col(text), pattern, -1).alias("p"))).alias(kind)


def _free(docs: DataFrame) -> str:
    """A beginning that no column of ``docs`` has."""
    own = "__"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    return own


def _located(name: str, kind: int, context: int) -> str:
    """SQL for the spans of a struct column (m, p): matches and the pieces around them."""
    sizes = f"zip_with({name}.m, slice({name}.p, 1, size({name}.m)), (a, b) -> cast(char_length(a) + char_length(b) as bigint))"
    ends = f"slice({prefix_sums('__sizes')}, 2, size(__sizes))"
    return f"""coalesce(flatten(transform(array({sizes}), __sizes -> transform(zip_with({name}.m, {ends}, (v, e) -> named_struct('v', v, 'e', e)), (x, i) -> named_struct(
        'kind', {kind}, 'start', x.e - char_length(x.v), 'end', x.e, 'value', x.v,
        'before', right({name}.p[i], {context}), 'after', left({name}.p[i + 1], 8))))),
        cast(array() as array<struct<kind:int,start:bigint,end:bigint,value:string,before:string,after:string>>))"""


_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_LUHN = f"""aggregate(split(reverse({_DIGITS}), ''), named_struct('i', 0, 's', 0), (a, c) -> if(c = '', a, named_struct('i', a.i + 1,
    's', a.s + if(a.i % 2 = 0, cast(c as int), if(cast(c as int) > 4, 2 * cast(c as int) - 9, 2 * cast(c as int))))), a -> a.s % 10 = 0)"""
_VALID = {
    "email": "true",
    "ip": f"x.value rlike '{_OCTETS.replace(chr(92), chr(92) * 2)}'",
    "card": _LUHN,
    "phone": f"length({_DIGITS}) between 9 and 15",
}


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``: spans (kind, start, end, value, before, after) of the base rules, by kind, then start."""
    own = _free(docs)
    found = docs.withColumn(f"{own}text", F.coalesce("text", F.lit("")))
    found = found.select("*", *[_spans(f"{own}text", pattern, f"{own}{kind}") for kind, pattern in BASE.items()])
    parts = [f"filter({_located(f'{own}{kind}', k, 0)}, x -> {_VALID[kind]})" for k, kind in enumerate(BASE)]
    return found.withColumn("base", F.expr(f"concat({', '.join(parts)})")).drop(f"{own}text", *[f"{own}{k}" for k in BASE])


def _feature_sql(p: Pii) -> dict[str, str]:
    v, near = "x.value", "lower(x.before)"
    out = {
        "generator": "x.generator",
        "n_chars": f"char_length({v})",
        "n_digits": f"length({_DIGITS})",
        "n_letters": f"length(regexp_replace({v}, '[^A-Za-z]', ''))",
        "n_groups": f"size(split({v}, '[^0-9A-Za-z]+'))",
        "n_kinds": f"size(array_distinct(split(lower({v}), '')))",
        "bracket": f"if(instr({v}, '(') > 0, 1, 0)",
        "dashes": f"length({v}) - length(replace({v}, '-', ''))",
        "dots": f"length({v}) - length(replace({v}, '.', ''))",
        "datelike": f"if({v} rlike '(19|20)[0-9]{{2}}[-/. ][01]?[0-9][-/. ]|[0-3]?[0-9][-/. ][01]?[0-9][-/. ](19|20)[0-9]{{2}}|^(19|20)[0-9]{{2}} ?- ?(19|20)[0-9]{{2}}$', 1, 0)",
        "zero_first": f"if({v} rlike '^[(]?0', 1, 0)",
        "repeats": f"if({v} rlike '([0-9])[^0-9]?\\\\1[^0-9]?\\\\1[^0-9]?\\\\1', 1, 0)",
        "sign_before": "if(x.before rlike '[#$%*&@_=]$' or x.after rlike '^[#$%*&@_=]', 1, 0)",
    }
    out |= {name: f"if({near} rlike '{words}', 1, 0)" for name, words in HINTS.items()}
    return out


def candidates(docs: DataFrame, p: Pii = Pii()) -> DataFrame:
    """``docs`` with ``candidates``: the generators' spans, each with its features ``f`` (array<int>)."""
    own = _free(docs)
    found = docs.withColumn(f"{own}text", F.coalesce("text", F.lit("")))
    found = found.select("*", *[_spans(f"{own}text", pattern, f"{own}g{g}") for g, (_, pattern) in enumerate(GENERATORS)])
    sql = _feature_sql(p)
    features = ", ".join(f"cast({sql[name]} as int)" for name in FEATURES)
    parts = []
    for g, (kind, _) in enumerate(GENERATORS):
        spans = _located(f"{own}g{g}", KINDS.index(kind), p.context_chars)
        if kind == "phone":
            spans = f"filter({spans}, x -> length({_DIGITS}) between 7 and 15)"
        parts.append(f"transform({spans}, x -> struct(x.kind, x.start, x.end, x.value, x.before, x.after, {g} as generator))")
    gathered = found.withColumn("candidates", F.expr(f"concat({', '.join(parts)})"))
    made = f"transform(candidates, x -> struct(x.kind, x.start, x.end, x.value, x.generator, array({features}) as f))"
    return gathered.withColumn("candidates", F.expr(made)).drop(f"{own}text", *[f"{own}g{g}" for g in range(len(GENERATORS))])


def training_sentences(p: Pii) -> list[tuple[int, str, str | None, str]]:
    """(id, text, kind of the one planted span or None, its value): half personal data, half look-alikes."""
    r = random.Random(p.seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    b64 = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    caps = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTWXYZ") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(r.choice(["an", "er", "in", "on", "te", "la", "re", "mo", "ki", "su"]) for _ in range(r.randint(1, 4)))
    say = lambda: " ".join(word() for _ in range(r.randint(0, 8)))
    pick = r.choice
    tld = lambda: pick(["com", "org", "net", "de"])
    yes = {
        "phone": (lambda: pick([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(6)}", f"0{d(2)}/{d(7)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(9)}", f"{d(3)} {d(3)} {d(3)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}-{d(4)}", f"{d(2)} {d(3)} {d(2)} {d(2)}", f"00{d(2)} {d(2)} {d(7)}"]), ["phone", "tel.", "call", "mobile:", "Telefon", "fax", "appel", ""]),
        "email": (lambda: pick([f"{word()}{pick(['', '.' + word()])} {pick(['[at]', '(at)', '[ at ]'])} {word()}{pick([' [dot] ', '.', ' (dot) '])}{tld()}", f"{word()}{pick(['', d(2)])} at {word()} dot {tld()}", f"{word()} @ {word()}.{tld()}"]), ["mail", "contact", "write to", ""]),
        "ip": (lambda: pick([":".join(hexa(4) for _ in range(8)), f"fd{hexa(2)}:{hexa(4)}::{hexa(r.randint(1, 4))}", f"{r.randint(1, 9)}a{hexa(2)}::{hexa(4)}:{hexa(2)}"]), ["address", "host", "from", ""]),
        "national_id": (lambda: pick([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{caps(2)}{d(6)}{pick('ABCD')}", f"{d(8)}{caps(1)}"]), ["ssn", "social security", "national id", "dni", "insurance number"]),
        "iban": (lambda: f"{pick(['DE', 'FR', 'ES', 'GB'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", ["iban", "account", "Konto", "bank", ""]),
        "secret": (lambda: pick([hexa(32), hexa(40), "sk_" + hexa(24), "AKIA" + hexa(16).upper(), b64(r.randint(28, 64)), "pk_live_" + b64(20), b64(43) + "=", f"{b64(18)}.{b64(30)}"]), ['token = "', "api_key: ", "secret=", 'password = "', "auth: ", "bearer "]),
    }
    no = [
        (lambda: f"{r.randint(1950, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", ["date", "on", ""]),
        (lambda: f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1950, 2030)}", ["date", "am", ""]),
        (lambda: f"{r.randint(1950, 2030)}-{r.randint(1950, 2030)}", ["years", "copyright", ""]),
        (lambda: f"{d(4)}-{d(4)}-{d(4)}", ["order", "invoice", "serial", "item"]),
        (lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", ["isbn", "ref", ""]),
        (lambda: " ".join(d(2) for _ in range(r.randint(4, 7))), ["score", "total", "page", ""]),
        (lambda: f"{d(2)}.{d(3)}.{d(3)}", ["price", "total", ""]),
        (lambda: f"0{d(9)}", ["order", "item", "ref", "serial"]),
        (lambda: f"{d(3)}-{d(2)}-{d(4)}", ["item", "order", "ref", "version"]),
        (lambda: hexa(40), ["commit: ", "sha: ", "hash = ", "md5=", "digest: "]),
        (lambda: "/".join(word() + word() for _ in range(4)), ["path: ", "see: ", "url="]),
        (lambda: f"AB{d(2)} {d(4)} {d(4)} {d(4)}", ["serial", "item", "order"]),
        (lambda: pick([b64(40), f"{b64(18)}.{b64(30)}", f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}"]), ["digest: ", "hash = ", "id: ", "commit: "]),
        (lambda: pick([f"{d(3)} {d(2)} {d(4)}", f"{caps(2)}{d(6)}A", f"{d(8)}{caps(1)}"]), ["item", "order", "serial", "total"]),
        (lambda: f"{d(3)}{pick(['-', ' '])}{d(4)}", ["order", "item", "page", "total", "score", ""]),
        (lambda: f"{d(1)} @ {d(2)}.{d(2)}", ["item", "price", "total", ""]),
        (lambda: f"{pick(['add', 'bad', 'face', 'dec'])}::{pick(['add', 'bad', 'cafe', 'dead'])}", ["ref", "see", ""]),
        (lambda: d(r.randint(8, 24)), ["order", "total", ""]),
    ]
    rows = []
    for i in range(p.training_rows):
        kind = pick(list(yes)) if i % 2 else None
        make, hints = yes[kind] if kind else pick(no)
        value, hint = make(), pick(hints)
        glue = "" if hint.endswith(('"', "=", " ")) else " "
        end = '"' if '"' in hint else pick([".", " ", ",", ""])
        rows.append((i, f"{say()} {hint}{glue}{value}{end} {say()}", kind, value))
    return rows


_FITTED: dict[Pii, tuple[BoostedTrees, dict[str, float]]] = {}


def fit(spark: SparkSession, p: Pii = Pii()) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees and each kind's threshold; fitted once in a driver process."""
    if p not in _FITTED:
        rows = training_sentences(p)
        frame = spark.createDataFrame(rows, "id long, text string, kind string, value string")
        made = candidates(frame, p).select("id", "kind", "value", F.explode("candidates").alias("c")).select("id", "kind", "value", F.col("c.kind").alias("guess"), F.col("c.value").alias("found"), F.col("c.f").alias("f"))
        got = sorted(made.collect(), key=lambda r: (r.id, r.guess, r.found))  # at most a few for each sentence
        x = np.array([r.f for r in got])
        y = np.array([float(r.kind == KINDS[r.guess] and r.value.strip() == r.found.strip()) for r in got])
        held = np.array([r.id // 2 % 4 == 0 for r in got])
        trees = BoostedTrees().fit(x[~held], y[~held]).calibrate(x[held], y[held])
        probability, kinds = trees.probability(x), np.array([r.guess for r in got])
        thresholds = {}
        for k, kind in enumerate(KINDS):
            own = held & (kinds == k)
            order = np.argsort(-probability[own], kind="stable")
            right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            good = np.flatnonzero(right >= p.precision)
            at = float(probability[own][order][good[-1]]) if len(good) else 1.0
            thresholds[kind] = round(min(0.999, max(0.5, at)), 4)
        _FITTED[p] = trees, thresholds
    return _FITTED[p]


def find_pii(docs: DataFrame, p: Pii = Pii()) -> DataFrame:
    """``docs`` with ``base`` (spans of the base rules) and ``added`` (kind, start, end, value, probability).

    Offsets are code points, end exclusive. A null or empty text has no spans; texts of any length are read
    whole; repeated rows repeat; equal probabilities favour the earlier, then the longer candidate.
    Columns of ``docs`` named ``base``, ``added`` or ``candidates`` are replaced.
    """
    trees, thresholds = fit(docs.sparkSession, p)
    scored = f"transform(candidates, x -> struct(x.kind, x.start, x.end, x.value, {trees.sql([f'x.f[{i}]' for i in range(len(FEATURES))])} as probability))"
    limit = "CASE x.kind " + " ".join(f"WHEN {k} THEN {thresholds[kind]!r}D" for k, kind in enumerate(KINDS)) + " END"
    clear = "NOT exists(base, b -> b.start < x.end AND x.start < b.end)"
    order = "struct(-x.probability as a, x.start as b, -x.end as c, x.kind as d, x as x)"
    best = f"""aggregate(array_sort(transform(array_distinct(added), x -> {order})), filter(added, x -> false),
        (kept, y) -> if(exists(kept, o -> o.start < y.x.end AND y.x.start < o.end), kept, concat(kept, array(y.x))))"""
    out = candidates(base_spans(docs), p)
    out = out.withColumn("added", F.expr(f"filter({scored}, x -> x.probability >= {limit} AND {clear})"))
    return out.withColumn("added", F.expr(f"array_sort({best})")).drop("candidates")


def redact(docs: DataFrame, p: Pii = Pii()) -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by its kind in brackets; overlapping spans by the first's."""
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    every = "array_sort(concat(transform(base, x -> struct(x.start, x.end, x.kind)), transform(added, x -> struct(x.start, x.end, x.kind))))"
    fold = f"""aggregate({every}, named_struct('at', 0L, 'out', ''), (a, x) -> if(x.start < a.at, named_struct('at', greatest(a.at, x.end), 'out', a.out),
        named_struct('at', x.end, 'out', concat(a.out, substring(text, cast(a.at + 1 as int), cast(x.start - a.at as int)), {names}[x.kind]))),
        a -> concat(a.out, substring(text, cast(a.at + 1 as int))))"""
    return find_pii(docs, p).withColumn("text", F.expr(f"if(size(base) + size(added) = 0, text, {fold})")).drop("base", "added")


def spans_text(*columns: str) -> Column:
    """kind:start:end of all spans, by kind, then start, comma-joined."""
    each = ", ".join(f"transform({c}, x -> struct(x.kind, x.start, x.end))" for c in columns)
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform(array_sort(concat({each})), x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")
