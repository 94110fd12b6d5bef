"""Source text to anonymised data-flow text, as one column expression.

The regular-expression representation: user identifiers become placeholders in sorted order, loop lines
become depth markers, and arithmetic, assignment and numeric lines stay with their identifiers replaced.
A parser-based representation can be plugged in as any function from (code, lang) columns to a column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import identifiers, strip_comments

# Words that are never renamed.
KEPT_WORDS = (
    "int char float double short long void unsigned signed struct union enum typedef sizeof const static extern "
    "if else for while do switch case default break continue return goto register volatile inline restrict "
    "true false NULL include define ifdef ifndef endif memcpy memset malloc free printf scanf"
).split()
# Type words that a line loses.
DROPPED_TYPES = "int|char|float|double|short|long|unsigned|signed|void|const|static"

#: White space at the ends of lines, as a pattern's class.
WHITE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
Representation = Callable[[Column, Column], Column]


def user_identifiers(code: Column) -> Column:
    """Identifiers that are not kept words, sorted."""
    return F.array_sort(F.array_except(identifiers(code), F.array(*map(F.lit, KEPT_WORDS))))


def is_macro(name: Column) -> Column:
    return (F.upper(name) == name) & name.rlike("[A-Z]") & (F.length(name) > 4)


def symbol_map(code: Column) -> Column:
    """identifier -> placeholder: CONST_<name> for long upper-case names, else v0, v1, ... in sorted order."""
    names = user_identifiers(code)
    plain = F.filter(names, lambda n: ~is_macro(n))
    return F.map_from_entries(
        F.concat(
            F.transform(plain, lambda n, i: F.struct(n.alias("k"), F.concat(F.lit("v"), i.cast("string")).alias("v"))),
            F.transform(F.filter(names, is_macro), lambda n: F.struct(n.alias("k"), F.concat(F.lit("CONST_"), n).alias("v"))),
        )
    )


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, f"^[{WHITE}]+|[{WHITE}]+$", "")


def code_lines(code: Column) -> Column:
    return F.filter(F.transform(F.split(code, "\r\n|[\n\r\f\x0b\x1c-\x1e\x85\u2028\u2029]"), trimmed), lambda x: x != "")


def opens_loop(line: Column) -> Column:
    return (line.contains("for") | line.contains("while")) & (line.contains("{") | line.endswith(")"))


def clean_line(line: Column, names: Column) -> Column:
    """A line with placeholders, without type words and closing semicolon."""
    parts = F.regexp_extract_all(line, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    renamed = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(names, p), p)), "")
    return F.regexp_replace(F.regexp_replace(trimmed(renamed), rf"(?<![A-Za-z0-9_])({DROPPED_TYPES})\s+", ""), r"\s*;\s*$", "")


def data_flow_text(code: Column, lang: Column) -> Column:
    """The regular-expression representation of a file; comments go first."""
    bare = strip_comments(code, lang)
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def parts(names: Column) -> Column:
        def step(acc: Column, line: Column) -> Column:
            opened = opens_loop(line)
            closed = ~opened & line.contains("}") & (acc.depth > 0)
            depth = acc.depth + F.when(opened, 1).when(closed, -1).otherwise(0)
            marker = F.when(opened, F.array(F.concat(F.lit("LOOP_START_DEPTH_"), depth.cast("string")))).when(closed, F.array(F.concat(F.lit("LOOP_END_DEPTH_"), acc.depth.cast("string")))).otherwise(F.array().cast("array<string>"))
            kept = F.filter(F.array(F.when(line.rlike(r"[=+\-*/%&|^<>]|(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])"), clean_line(line, names))), lambda x: F.coalesce(x != "", F.lit(False)))
            return F.struct(depth.alias("depth"), F.concat(acc.out, marker, kept).alias("out"))

        return F.aggregate(code_lines(bare), start, step, lambda acc: F.array_join(acc.out, "\n"))

    # a one-element array binds the map once for all lines
    return F.transform(F.array(symbol_map(bare)), parts)[0]


def represent(kind: str, code: Column, lang: Column, graph: Representation = data_flow_text) -> Column:
    return graph(code, lang) if kind == "graph" else code
