"""Chat formatting by prefix-target expansion.

A turn is written ``[INST]role[/INST]text</s>``. Every assistant turn becomes an example of its own: all
turns before it as context and only its reply under the loss mask. A conversation that does not end with
an assistant turn gets one more example, whole and without a trainable part, so no turn is lost. Control
strings inside a role or text gain a backslash behind their opening bracket; those that have backslashes
there gain one more, so taking one away always gives back the text.

All of it is built-in expressions. The examples of a conversation of n turns hold some n squared / 4 turns,
which is the format's own size; they are made one row at a time from the ordered turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import prefix_sums

OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[]<?)(\\*)(/?(?:s|SYS|INST)[>\]]>?)"
_ESCAPED = r"([<\[]<?)\\(\\*)(/?(?:s|SYS|INST)[>\]]>?)"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def prefix_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, whole, formatted, loss_spans) from rows (conv_id, turn, role, text).

    ``example`` counts from 0 within a conversation in turn order; ``loss_spans`` are (start, end) code
    points of ``formatted``, end exclusive: one span, or none in the closing example; ``whole`` marks the
    example that holds every turn. Null roles and texts are empty; null turns come first; equal turn
    numbers are ordered by role and text; repeated rows are turns too; rows with a null conv_id form one
    conversation; an empty table gives no rows. A conversation is held as one row, so its texts must fit one.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE), escape(text), F.lit(CLOSE)).alias("seg"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "seg"))).alias("t"))
    measured = grouped.select("conv_id", F.expr("transform(t, x -> x.seg)").alias("segs"), F.expr("transform(t, x -> x.role)").alias("roles"), F.expr("transform(t, x -> cast(char_length(x.seg) as bigint))").alias("sizes"))
    targets = f"filter(sequence(1, size(roles)), i -> roles[i - 1] = '{TRAINED_ROLE}' OR i = size(roles))"
    cut = measured.select("conv_id", "segs", "roles", F.expr(prefix_sums("sizes")).alias("ends"), F.expr(targets).alias("targets"))
    shown = cut.select("conv_id", "segs", "roles", "ends", F.posexplode("targets").alias("example", "upto"))
    head = len(OPEN) + len(TRAINED_ROLE) + len(MIDDLE)
    span = f"named_struct('start', ends[upto - 1] + {head}L, 'end', ends[upto] - {len(CLOSE)}L)"
    return shown.select(
        "conv_id",
        "example",
        F.col("upto").alias("n_turns"),
        F.expr("upto = size(segs)").alias("whole"),
        F.expr("array_join(slice(segs, 1, upto), '')").alias("formatted"),
        F.expr(f"filter(array({span}), s -> roles[upto - 1] = '{TRAINED_ROLE}')").alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        parts = F.split(piece, r"\[/INST\]", 2)
        return F.struct(unescape(F.substr(parts[0], F.lit(len(OPEN) + 1))).alias("role"), unescape(parts[1]).alias("text"))

    return F.transform(pieces, turn)


def trained_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: turn count and digests of turns and trained text."""
    nl = F.lit("\n")
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t.role, nl, t.text, nl)), "")
    rows = examples.select(
        "conv_id",
        "example",
        F.char_length("formatted").cast("long").alias("chars"),
        trained_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.when(F.col("whole"), F.size(turns).cast("long")).alias("n_turns"),
        F.when(F.col("whole"), F.sha2(said, 256)).alias("turns_sha256"),
    )
    gathered = rows.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    gathered = gathered.withColumn("loss", F.array_join(F.transform("losses", lambda x: x.loss), ""))
    return gathered.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
