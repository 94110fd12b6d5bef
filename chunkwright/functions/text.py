"""Scalar text expressions. Patterns name their character classes, so every engine reads them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = "[^ \t\r\n\f]+"


def language(path: Column) -> Column:
    """c, cpp, or null by suffix."""
    return F.when(path.rlike(r"\.(c|h)$"), "c").when(path.rlike(r"\.(cpp|hpp|hh|cc)$"), "cpp")


def wide_language(path: Column) -> Column:
    """The wider map of suffixes: also py, java and cxx."""
    return F.when(path.rlike(r"\.(c|h)$"), "c").when(path.rlike(r"\.(cpp|hpp|hh|cc|cxx)$"), "cpp").when(path.rlike(r"\.py$"), "python").when(path.rlike(r"\.java$"), "java")


def path_tail(path: Column) -> Column:
    """The last two components; the whole path if it has fewer."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, path).otherwise(F.array_join(F.slice(parts, -2, 2), "/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def strip_comments(code: Column, lang: Column) -> Column:
    """Line comments, then block comments, of c and cpp; string literals are not looked at."""
    bare = F.regexp_replace(F.regexp_replace(code, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    return F.when(lang.isin("c", "cpp"), bare).otherwise(code)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))


def identifiers(code: Column) -> Column:
    """Words of ASCII letters, digits and underscores that begin with no digit; a word with other letters is none."""
    words = F.regexp_extract_all(code, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(F.array_distinct(words), lambda w: w.rlike("^[A-Za-z_][A-Za-z0-9_]*$"))


def is_number(text: Column) -> Column:
    """Whether a text is a whole decimal or hexadecimal literal."""
    return text.rlike("^(0x[0-9a-fA-F]+|[0-9]+)$")


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``; a path elsewhere is returned as it is."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def detokenize(tokens: Column, *special: str) -> Column:
    """The text of tokens, without the special ones."""
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(*special)) if special else tokens, " ")


def model_tag(model: Column) -> Column:
    return F.translate(basename(model), "-.", "__")


def overlap_tag(proportion: Column) -> Column:
    return F.when(proportion > 0, F.concat(F.lit("overlap_1_"), F.floor(F.try_divide(F.lit(1.0), proportion)).cast("string"))).otherwise("overlap_none")


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def base64_plain(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.translate(F.base64(data), "\r\n", "")


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))
