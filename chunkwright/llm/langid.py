"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and its code point alone. A letter
n-gram is the product of its letters' vectors, each rotated by its place (binding); a text is the sum of
its n-grams' vectors (bundling); a language's prototype is the sum over its training texts, each at equal
weight. A text gets the language whose prototype has the greatest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches
from . import workers

UNDETERMINED = "und"
#: n-grams multiplied at once.
GRAM_BLOCK = 2048


@dataclass(frozen=True)
class Profiles:
    dimensions: int = 1024
    seed: int = 7
    #: Languages one may learn; more are an error, since the driver and each worker hold a prototype of each.
    max_languages: int = 4096
    batch_rows: int = 128
    batch_chars: int = 600_000
    #: n-gram vectors kept per process, one byte a dimension.
    cached_grams: int = 16_384


_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


@dataclass
class Encoder:
    """Counts letter trigrams of texts and knows each trigram's vector. Words are set off by code point 0."""

    p: Profiles
    letter_vectors: dict[int, np.ndarray] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def letter(self, code: int) -> np.ndarray:
        v = self.letter_vectors.get(code)
        if v is None:
            v = np.random.default_rng([self.p.seed, code]).integers(0, 2, self.p.dimensions, dtype=np.int8) * 2 - 1
            self.letter_vectors[code] = v = v.astype(np.int8)
        return v

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """One row for each gram ``a << 42 | b << 21 | c``."""
        if self.table is None or len(self.rows) + len(grams) > len(self.table):
            self.rows, self.table = {}, np.empty((max(self.p.cached_grams, 2 * len(grams)), self.p.dimensions), np.int8)
        at = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            row = self.rows.get(g)
            if row is None:
                row = self.rows[g] = len(self.rows)
                a, b, c = g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF
                self.table[row] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            at[i] = row
        return self.table[at].astype(np.float32)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(grams, documents x grams counts, letters per document) of a batch."""
        codes, which = [], []
        for i, text in enumerate(texts):
            if text:
                code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
                code = np.where(letters()[code], code, 0)
                code = np.concatenate([[0], code, [0]])
                code = code[np.append(True, (code[1:] != 0) | (code[:-1] != 0))]  # one space for a run
                codes.append(code)
                which.append(np.full(len(code), i))
        flat = np.concatenate([*codes, np.zeros(0, np.int64)]).astype(np.int64)
        doc = np.concatenate([*which, np.zeros(0, np.int64)]).astype(np.int64)
        n_letters = np.bincount(doc[flat != 0], minlength=len(texts))
        used = np.flatnonzero(np.bincount(flat, minlength=1))
        dense = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
        dense[used] = np.arange(len(used))
        local, v = dense[flat], max(1, len(used))
        gram = (local[:-2] * v + local[1:-1]) * v + local[2:]
        keep = (doc[:-2] == doc[2:]) & (flat[1:-1] != 0)
        gram, doc = gram[keep], doc[:-2][keep]
        if v**3 <= 1 << 21:
            seen = np.zeros(v**3, bool)
            seen[gram] = True
            kinds = np.flatnonzero(seen)
            place = np.zeros(v**3, np.int64)
            place[kinds] = np.arange(len(kinds))
            gram = place[gram]
        else:
            kinds, gram = np.unique(gram, return_inverse=True)
        table = np.bincount(doc * len(kinds) + gram, minlength=len(texts) * len(kinds)).reshape(len(texts), len(kinds))
        if not len(used):
            return np.zeros(0, np.int64), table, n_letters
        a, b, c = used[kinds // (v * v)], used[kinds // v % v], used[kinds % v]
        return a << 42 | b << 21 | c, table, n_letters


    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents x dimensions sums of n-gram vectors, n-grams, letters) of a batch, in bounded memory."""
        if len(texts) > 1 and sum(len(t or "") for t in texts) > self.p.batch_chars:
            half = len(texts) // 2
            return tuple(np.concatenate(x) for x in zip(self.bundle(texts[:half]), self.bundle(texts[half:])))
        grams, table, n_letters = self.counts(texts)
        if len(texts) > 1 and len(grams) > 16 * GRAM_BLOCK:
            half = len(texts) // 2
            return tuple(np.concatenate(x) for x in zip(self.bundle(texts[:half]), self.bundle(texts[half:])))
        out = np.zeros((len(texts), self.p.dimensions), np.float32)
        for at in range(0, len(grams), GRAM_BLOCK):
            out += table[:, at : at + GRAM_BLOCK].astype(np.float32) @ self.vectors(grams[at : at + GRAM_BLOCK])
        return out, table.sum(axis=1), n_letters


_ENCODERS: dict[Profiles, Encoder] = {}


def encoder(p: Profiles) -> Encoder:
    workers.enter("langid", _ENCODERS.clear)
    return _ENCODERS.setdefault(p, Encoder(p))


def learn(docs: DataFrame, params: Profiles = Profiles()) -> dict[str, list[float]]:
    """A prototype of every non-null ``lang`` of ``docs``, from all their texts.

    Each task sums its own texts and passes on one vector per language; vectors are summed before and
    after the shuffle. Texts that are null or have no letter teach nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sums = encoder(params), {}
        for batch in batches:
            for at in range(0, batch.num_rows, params.batch_rows):
                part = batch.slice(at, params.batch_rows)
                langs = part.column(0).to_pylist()
                bundle, n_grams, _ = enc.bundle(part.column(1).to_pylist())
                share = bundle / np.maximum(1, n_grams)[:, None]
                names = sorted(set(langs))
                pick = np.array([[float(x == name) for x in langs] for name in names])
                for name, v in zip(names, pick @ share):
                    sums[name] = sums.get(name, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    small_batches(docs.sparkSession)
    known = docs.select(F.col("lang").cast("string"), "text").where("lang IS NOT NULL AND text IS NOT NULL")
    parts = known.mapInArrow(run, "lang string, v array<double>")
    sums = parts.groupBy("lang").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("lang", vector_to_array("v").alias("v"))
    rows = sums.limit(params.max_languages + 1).collect()
    if len(rows) > params.max_languages:
        raise ValueError(f"more than {params.max_languages} languages to learn")
    return {r.lang: [round(x, 6) for x in r.v] for r in sorted(rows, key=lambda r: r.lang) if any(r.v)}


def predict(docs: DataFrame, prototypes: dict[str, list[float]], params: Profiles = Profiles(), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns with lang_pred and score, the cosine with that prototype, at least 0.

    ``und`` with score 0 if the text is null, has no letter, or there is nothing learned. Equal cosines go
    to the first language by name. Only ``text`` decides; every row gives one row.
    """
    small_batches(docs.sparkSession)
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), params.dimensions)
    matrix /= np.maximum(1e-12, np.linalg.norm(matrix, axis=1, keepdims=True))
    schema = docs.select(*carry).schema.add("lang_pred", "string").add("score", "double")
    at_text = carry.index("text") if "text" in carry else len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(params)
        for batch in batches:
            for at in range(0, batch.num_rows, params.batch_rows):
                part = batch.slice(at, params.batch_rows)
                bundle, _, n_letters = enc.bundle(part.column(at_text).to_pylist())
                best, score = np.zeros(part.num_rows, int), np.zeros(part.num_rows)
                known = (n_letters > 0) & bool(names)
                if names:
                    cosine = bundle @ matrix.T / np.maximum(1e-12, np.linalg.norm(bundle, axis=1, keepdims=True))
                    cosine = np.round(cosine.astype(np.float64), 5)  # so sums in another order change nothing
                    best = cosine.argmax(axis=1)
                    score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                said = [names[b] if k else UNDETERMINED for b, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array(said, pa.string()), pa.array(np.where(known, score, 0.0))], schema=pa.schema([*list(part.schema)[: len(carry)], pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]))

    return docs.select(*carry, *([] if "text" in carry else ["text"])).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text is a multiple of 5; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def keep_identified(docs: DataFrame, params: Profiles = Profiles()) -> DataFrame:
    """``docs`` without the rows whose language cannot be told: null texts and texts without a letter.

    Languages are learned from the labelled rows that ``held_out`` leaves; a null ``lang`` is filled with the
    prediction. If no row is labelled, nothing is learned and only the presence of a letter counts. An empty
    table gives no rows. Columns pass as they are, under any name.
    """
    prototypes = learn(docs.where(~held_out()), params)
    inner = {c: c if c == "text" else f"c{at}" for at, c in enumerate(docs.columns)}
    said = predict(docs.toDF(*inner.values()), prototypes, params, tuple(inner.values()))
    told = F.col("lang_pred") != UNDETERMINED if prototypes else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    guess = F.when(F.col("lang_pred") != UNDETERMINED, F.col("lang_pred"))
    return said.where(told).select(*[(F.coalesce(n, guess) if c == "lang" else F.col(n)).alias(c) for c, n in inner.items()])
