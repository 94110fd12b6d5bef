"""Fill-in-the-middle transformation with relational units.

Every line of a text is a row of (document, ordinal, length); running sums of the lengths by window give the place
where each line ends; two cut requests of each document are joined with the lines by ordinal, and one aggregate for
each document turns what they found into offsets. Only then is the text itself touched again, by ``substring``. The
rows that are dealt and sorted are numbers; a text is shuffled once, to meet its offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A line with its end, or the rest of the text.
LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Infill:
    seed: int = 7
    #: Of a hundred documents, how many are transformed, and how many of these put the suffix first.
    rate: int = 100
    suffix_first: int = 50
    units: str = LINES


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the seed and a document's id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def plain(text: Column, h3: Column, p: Infill) -> Column:
    """Whether a text stays as it is: it is empty, holds a mark, or was not drawn."""
    return (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h3 % 100 >= p.rate)


def cut_offsets(docs: DataFrame, p: Infill = Infill()) -> DataFrame:
    """(k1, k2, n, prefix_chars, middle_chars) of rows (k1, k2, h1, h2, text); rows of equal keys must be equal and count once."""
    sizes = F.transform(F.regexp_extract_all("text", F.lit(p.units), F.lit(0)), lambda unit: F.char_length(unit))
    known = docs.select("k1", "k2", "h1", "h2", sizes.alias("sizes")).groupBy("k1", "k2").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("sizes").alias("sizes"))
    known = known.withColumn("n", F.size("sizes").cast("long"))
    running = Window.partitionBy("k1", "k2").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = known.select("k1", "k2", F.posexplode("sizes").alias("at", "size")).select("k1", "k2", (F.col("at") + 1).cast("long").alias("ordinal"), F.col("size").cast("long").alias("size"))
    ends = units.select("k1", "k2", "ordinal", F.sum("size").over(running).alias("end"))
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cuts = F.array(F.struct(F.lit("prefix").alias("part"), F.least(first, second).alias("ordinal")), F.struct(F.lit("middle").alias("part"), F.greatest(first, second).alias("ordinal")))
    requests = known.select("k1", "k2", "n", F.inline(cuts))
    met = requests.join(ends, ["k1", "k2", "ordinal"], "left")
    place = lambda part: F.coalesce(F.max(F.when(F.col("part") == part, F.col("end"))), F.lit(0).cast("long"))  # noqa: E731  a cut at unit 0 meets no unit
    found = met.groupBy("k1", "k2").agg(F.first("n").alias("n"), place("prefix").alias("prefix_chars"), place("middle").alias("upto"))
    return found.select("k1", "k2", "n", "prefix_chars", (F.col("upto") - F.col("prefix_chars")).alias("middle_chars"))


def fill_in_middle(docs: DataFrame, p: Infill = Infill()) -> DataFrame:
    """``docs`` with n_units, form, prefix_chars, middle_chars and output; columns of these names are replaced.

    A null text is empty; empty texts and those that hold a mark are ``plain``: output is the text, and the two
    lengths are null. Rows that share an id are documents of their own, cut at the same drawn numbers; equal rows give
    equal rows. A document is one row and so are its lengths, so a text of any length that fits a row is cut whole.
    An empty table gives no rows. All other columns pass as they are, under any name.
    """
    made = ("n_units", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in docs.columns if c not in made]
    inner = {c: f"c{i}" for i, c in enumerate(kept)}
    rows = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in kept])
    doc_id, text = F.col(inner["doc_id"]), F.coalesce(F.col(inner["text"]), F.lit(""))
    # Rows meet their offsets by a hash of id and text, 128 bits wide: ids alone may repeat or be null.
    keyed = rows.withColumns({"k1": F.xxhash64(F.lit(1), doc_id, text), "k2": F.xxhash64(F.lit(2), text, doc_id)})
    h = draws(doc_id, p.seed)
    offsets = cut_offsets(keyed.select("k1", "k2", h[0].alias("h1"), h[1].alias("h2"), text.alias("text")), p)
    joined = keyed.join(offsets, ["k1", "k2"], "left")
    form = F.when(plain(text, h[2], p), "plain").when(h[3] % 100 < p.suffix_first, "spm").otherwise("psm")
    cut = joined.select(*inner.values(), text.alias("text"), "n", form.alias("form"), F.col("prefix_chars").cast("int").alias("p"), F.col("middle_chars").cast("int").alias("m"))
    whole = F.col("text")
    prefix, middle, suffix = F.substring(whole, F.lit(1), F.col("p")), F.substring(whole, F.col("p") + 1, F.col("m")), F.substring(whole, F.col("p") + F.col("m") + 1, F.char_length(whole))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(whole)
    )
    moved = F.col("form") != "plain"
    out = [F.col("n").alias("n_units"), "form", F.when(moved, F.col("p").cast("long")).alias("prefix_chars"), F.when(moved, F.col("m").cast("long")).alias("middle_chars"), output.alias("output")]
    return cut.select(*[F.col(inner[c]).alias(c) for c in kept], *out)


def restore(output: Column, form: Column) -> Column:
    """The text again, from a transformed one and its form alone: no part holds a mark, so the marks tell the parts."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
