"""Hidden Markov language model: counting, encoding, Baum-Welch and exact likelihoods as Spark jobs.

A token is emitted in two steps: the hidden state chooses a class, the class a word. Frequent words and the end of a text
are classes of their own; any other word belongs to the class of its last letters. So what states must learn has a fixed
size and may be sent to every task, while the words within classes are counted exactly, all of them, in a table that grows
with the corpus. The second step does not depend on the state: the likelihood of a text is the forward recursion over its
classes times a product over its words, whatever their order, which a join with the counts gives.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table


@dataclass(frozen=True)
class Hmm:
    states: int = 8
    #: Most frequent words of at most ``own_bytes`` bytes and no less than ``own_count`` times, each a class of its own; the others
    #: share ``buckets`` by their last bytes, unknown words among them.
    own_words: int = 49_152
    own_count: int = 3
    own_bytes: int = 64
    buckets: int = 16_381
    suffix: int = 3
    iterations: int = 6
    seed: int = 11
    #: At first: how likely a state follows itself, and how far emissions are from the overall ones.
    stay: float = 0.98
    spread: float = 1.0
    #: Tokens of the overall distribution that each state is taken to have emitted besides those that it has.
    smoothing: float = 3000.0
    #: Distinct words counted in a worker before it passes them on, and tokens worked on together.
    counted_words: int = 400_000
    block_tokens: int = 800_000
    buffer_tokens: int = 6_000_000
    #: Tokens that a task of a round works through, where there are more than the cores need: each passes on as many numbers as the model has.
    task_tokens: int = 32_000_000

    @property
    def classes(self) -> int:
        """Own words, buckets, and last the end of a text."""
        return self.own_words + self.buckets + 1


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z in lower case; words end at space and \\x09-\\x0D. Both are what byte strings do by themselves."""
    return (text or b"").lower().split()


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def count_words(texts: DataFrame, p: Hmm) -> DataFrame:
    """(word binary, n) of a table with the one column text binary; the null word is the end, once for each text. Summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ends = Counter(), 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.binary()), pa.array([*counts.values(), ends], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                ends += 1
                if len(counts) > p.counted_words:
                    yield block()
                    counts, ends = Counter(), 0
        yield block()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


@dataclass
class Classes:
    """What the driver and all tasks know of the words: the own ones and totals, of a size that parameters bound."""

    own: list[bytes]
    own_counts: list[int]
    #: Of each bucket: tokens and distinct words.
    tokens: np.ndarray
    types: np.ndarray
    ends: int
    n: int
    v: int


def bucket(word: Column, p: Hmm) -> Column:
    return F.conv(F.hex(F.substring(word, -p.suffix, p.suffix)), 16, 10).cast("long") % p.buckets


def classes_of(counts: DataFrame, p: Hmm) -> Classes:
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("ends")).first()
    short = (F.octet_length("word") <= p.own_bytes) & (F.col("n") >= p.own_count)
    own = counts.where(short).orderBy(F.desc("n"), "word").limit(p.own_words).collect()
    rest = counts.where("word IS NOT NULL")
    if own:
        last = own[-1]
        first = (F.col("n") > last.n) | ((F.col("n") == last.n) & (F.col("word") <= F.lit(bytes(last.word))))
        rest = rest.where(~(short & first))
    tokens, types = np.zeros(p.buckets), np.zeros(p.buckets)
    for r in rest.groupBy(bucket(F.col("word"), p).alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r.b], types[r.b] = r.n, r.v
    return Classes([bytes(r.word) for r in own], [r.n for r in own], tokens, types, total.ends or 0, total.n or 0, total.v or 0)


def encode(docs: DataFrame, known: Classes, p: Hmm) -> DataFrame:
    """``docs`` (columns before a last one, text binary) with id, codes (16 bits a token, the end included) and rare, (word, n) of words without an own class.

    ``id`` tells rows apart once the table is written: partition and place.
    """
    carried = docs.columns[:-1]
    own, own_words, buckets, suffix, end, most = known.own, p.own_words, p.buckets, p.suffix, p.classes - 1, p.counted_words
    schema = docs.drop("text").schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {w: i for i, w in enumerate(own)}
        seen = dict(of)
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                codes, rare, times, upto = [], [], [], [0]
                for text in part.column(len(carried)):
                    words = words_of(text.as_py())
                    try:
                        code = [seen[w] for w in words]
                    except KeyError:
                        for w in words:
                            if w not in seen:
                                seen[w] = own_words + int.from_bytes(w[-suffix:], "big") % buckets
                        code = [seen[w] for w in words]
                    code.append(end)
                    code = np.array(code, "<u2")
                    few = Counter([words[i] for i in np.flatnonzero(code[:-1] >= own_words).tolist()])
                    codes.append(code.tobytes())
                    rare += few
                    times += few.values()
                    upto.append(len(rare))
                    if len(seen) > len(of) + most:
                        seen = dict(of)
                pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int32())], names=["word", "n"])
                made = [pa.array(range(at, at + part.num_rows), pa.int64()), pa.array(codes, pa.binary()), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pairs)]
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carried)], *made], names=[*carried, "id", "codes", "rare"])

    return docs.mapInArrow(run, f"{schema}, id long, codes binary, rare array<struct<word: binary, n: int>>")


@dataclass
class Model:
    """Probabilities of the first state, of the next by the last, and of classes by state."""

    first: np.ndarray
    moves: np.ndarray
    emits: np.ndarray

    def __post_init__(self) -> None:
        self.by_class = np.ascontiguousarray(self.emits.T)  # a token's emissions lie side by side

    def single(self) -> Model:
        """The same in single precision, which is enough to count with."""
        return Model(*(x.astype(np.float32) for x in (self.first, self.moves, self.emits)))


def overall(known: Classes, p: Hmm) -> np.ndarray:
    """How likely each class is, of all tokens; those never seen get a little."""
    counts = np.zeros(p.classes)
    counts[: len(known.own)] = known.own_counts
    counts[p.own_words : -1] = known.tokens
    counts[-1] = known.ends
    return (counts + 0.01) / (counts + 0.01).sum()


def begin(known: Classes, p: Hmm) -> Model:
    rng, prior = np.random.default_rng(p.seed), overall(known, p)
    emits = prior * np.exp(p.spread * rng.standard_normal((p.states, p.classes)))
    moves = np.full((p.states, p.states), (1 - p.stay) / max(1, p.states - 1))
    np.fill_diagonal(moves, p.stay if p.states > 1 else 1.0)
    return Model(np.full(p.states, 1 / p.states), moves, emits / emits.sum(axis=1, keepdims=True))


@dataclass
class Block:
    """Some sequences, longest first, laid out step by step: all first tokens, then all second ones of those that have any."""

    codes: np.ndarray
    #: Where each step begins, and where the last ends.
    starts: np.ndarray
    #: The sequences' places in what was given.
    order: np.ndarray


def blocks(sequences: list[np.ndarray], most: int) -> Iterator[Block]:
    """All sequences in blocks of like lengths, of at most ``most`` tokens unless one alone is longer."""
    lengths = np.array([len(s) for s in sequences])
    order, at = np.argsort(-lengths, kind="stable"), 0
    while at < len(order):
        upto = at + max(1, int(np.searchsorted(np.cumsum(lengths[order[at:]]), most, side="right")))
        taken = order[at:upto]
        size = lengths[taken]
        flat = np.concatenate([sequences[i] for i in taken])
        step = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        by_step = np.argsort(step, kind="stable")  # longest first within each step, as taken is
        starts = np.concatenate([[0], np.cumsum(np.bincount(step))])
        yield Block(flat[by_step], starts, taken)
        at = upto


def forward(block: Block, m: Model, keep: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scaled forward vectors, emissions, scales) by place in the block; without ``keep`` the first two are not filled."""
    emitted = m.by_class[block.codes]
    scales = np.empty(len(block.codes), emitted.dtype)
    alphas, last, ones = np.empty_like(emitted) if keep else emitted, None, np.ones(emitted.shape[1], emitted.dtype)
    for a, b in zip(block.starts[:-1], block.starts[1:]):
        v = (m.first if last is None else last[: b - a] @ m.moves) * emitted[a:b]
        scale = v @ ones
        scales[a:b] = scale
        v *= (1 / scale)[:, None]
        last = v
        if keep:
            alphas[a:b] = last
    return alphas, emitted, scales


def log_likelihoods(sequences: list[np.ndarray], m: Model, most: int) -> np.ndarray:
    """log10 of each class sequence's probability: the sum of the logs of its scales."""
    out = np.zeros(len(sequences))
    for block in blocks(sequences, most):
        _, _, scales = forward(block, m, keep=False)
        rank = np.arange(len(scales)) - np.repeat(block.starts[:-1], np.diff(block.starts))
        out[block.order] = np.bincount(rank, weights=np.log10(scales), minlength=len(block.order))
    return out


@dataclass
class Expected:
    """What Baum-Welch counts: first states, moves, emissions, and the log likelihood."""

    first: np.ndarray
    moves: np.ndarray
    emits: np.ndarray
    log10: float = 0.0

    @classmethod
    def none(cls, p: Hmm) -> Expected:
        return cls(np.zeros(p.states), np.zeros((p.states, p.states)), np.zeros((p.states, p.classes)))

    def add(self, sequences: list[np.ndarray], m: Model, most: int) -> None:
        for block in blocks(sequences, most):
            alphas, weights, scales = forward(block, m)
            self.log10 += float(np.log10(scales).sum(dtype=np.float64))
            starts, beta, moved, back = block.starts, None, np.zeros(m.moves.shape), np.ascontiguousarray(m.moves.T)
            for a, b in zip(starts[-2::-1], starts[:0:-1]):
                here = np.ones((b - a, alphas.shape[1]), alphas.dtype)
                if beta is not None:
                    here[: len(beta)] = beta @ back
                    moved += alphas[a : a + len(beta)].T @ beta
                beta = weights[a:b]  # emission, future and scale of this place
                beta *= here
                beta *= (1 / scales[a:b])[:, None]
                # A place's share of each state: its forward vector times its future.
                alphas[a:b] *= here
                if not a:
                    self.first += alphas[:b].sum(axis=0)
            self.moves += moved * m.moves
            for k in range(alphas.shape[1]):
                self.emits[k] += np.bincount(block.codes, weights=alphas[:, k], minlength=self.emits.shape[1])

    def model(self, prior: np.ndarray, p: Hmm) -> Model:
        norm = lambda x: x / x.sum(axis=-1, keepdims=True)
        return Model(norm(self.first + 1e-3), norm(self.moves + 1e-3), norm(self.emits + p.smoothing * prior))


def sequences_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<u2") for x in column]


#: Numbers of a row that carries part of what was counted.
PIECE = 4096


def expected(encoded: DataFrame, m: Model, p: Hmm, tokens: int = 0) -> Expected:
    """What Baum-Welch counts over all rows of ``encoded`` (codes) under ``m``: each task sums its own, in pieces that are summed again before and after the shuffle."""

    single = m.single()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = Expected.none(p), [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                more = sequences_of(batch.column(0).slice(first, 256))
                held += more
                n += sum(map(len, more))
                if n > p.buffer_tokens:
                    total.add(held, single, p.block_tokens)
                    held, n = [], 0
        if held:
            total.add(held, single, p.block_tokens)
        flat = np.concatenate([total.first, total.moves.ravel(), [total.log10], total.emits.ravel()])
        for at in range(0, len(flat), PIECE):
            part = flat[at : at + PIECE]
            if part.any():
                part = np.pad(part, (0, PIECE - len(part)))
                yield pa.RecordBatch.from_arrays([pa.array([at // PIECE], pa.int32()), pa.array([part], pa.list_(pa.float64()))], names=["piece", "v"])

    tasks = max(encoded.sparkSession.sparkContext.defaultParallelism, -(-tokens // p.task_tokens))
    parts = encoded.select("codes").coalesce(tasks).mapInArrow(run, "piece int, v array<double>")
    sums = parts.groupBy("piece").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("piece", vector_to_array("v").alias("v"))
    head = p.states + p.states**2 + 1
    size = head + p.states * p.classes
    flat = np.zeros(-(-size // PIECE) * PIECE)
    for r in sums.collect():  # as many numbers as the model has
        flat[r.piece * PIECE : (r.piece + 1) * PIECE] = r.v
    k = p.states
    return Expected(flat[:k], flat[k : k + k * k].reshape(k, k), flat[head:size].reshape(k, p.classes), float(flat[head - 1]))


def learn(encoded: DataFrame, known: Classes, p: Hmm) -> tuple[Model, list[float]]:
    """A model of all rows of ``encoded`` after ``p.iterations`` rounds of Baum-Welch, and the log10 likelihood found in each round."""
    m, prior, found = begin(known, p), overall(known, p), []
    for _ in range(p.iterations if known.n else 0):
        e = expected(encoded, m, p, known.n)
        found.append(e.log10)
        m = e.model(prior, p)
    return m, found


def score(encoded: DataFrame, counts: DataFrame, known: Classes, m: Model, p: Hmm) -> DataFrame:
    """The columns of ``encoded`` before id, with n_tokens, n_known, base_score and score of each row."""
    carried = encoded.columns[: encoded.columns.index("id")]
    own = np.zeros(p.classes)
    own[: len(known.own)] = np.log10(np.array(known.own_counts, float) + 0.5)
    own[-1] = math.log10(known.ends + 0.5)
    is_known = np.zeros(p.classes)
    is_known[: len(known.own)], is_known[-1] = 1, known.ends > 0
    within = np.zeros(p.classes)  # of a word in its bucket: log10 of all that is there, an unknown word included
    within[p.own_words : -1] = np.log10(known.tokens + 0.5 * (known.types + 1))
    schema = encoded.select(*carried).schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            sequences = [s for _, some in held for s in some]
            found, at = log_likelihoods(sequences, m, p.block_tokens), 0
            for part, some in held:
                logs = found[at : at + len(some)]
                at += len(some)
                columns = [
                    pa.array([len(s) for s in some], pa.int64()),
                    pa.array([int(is_known[s].sum()) for s in some], pa.int64()),
                    pa.array([float(own[s].sum()) for s in some], pa.float64()),
                    pa.array([float(x - within[s].sum()) for x, s in zip(logs, some)], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "n", "own_known", "own_log", "by_class"])

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                some = sequences_of(part.column(len(carried) + 1))
                held.append((part.select(list(range(len(carried) + 1))), some))
                n += sum(map(len, some))
                if n > p.buffer_tokens:
                    yield from done()
                    held, n = [], 0
        yield from done()

    rows = encoded.select(*carried, "id", "codes").mapInArrow(run, f"{schema}, id long, n long, own_known long, own_log double, by_class double")
    words = encoded.select("id", F.inline("rare")).withColumnRenamed("n", "times")
    met = words.join(counts.where("word IS NOT NULL"), "word", "left")
    log = F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5)))
    sums = met.groupBy("id").agg(log.alias("word_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("word_known"))
    together = math.log10(known.n + 0.5 * (known.v + 1))
    word_log = F.coalesce("word_log", F.lit(0.0))
    return rows.join(sums, "id", "left").select(
        *carried,
        F.col("n").alias("n_tokens"),
        (F.col("own_known") + F.coalesce("word_known", F.lit(0))).alias("n_known"),
        (F.col("own_log") + word_log - F.col("n") * together).alias("base_score"),
        (F.col("by_class") + word_log).alias("score"),
    )


@dataclass
class LanguageModel:
    counts: DataFrame
    classes: Classes
    model: Model
    #: log10 likelihood of the training texts in each round.
    log10: list[float]


def train_and_score(docs: DataFrame, held: Column, p: Hmm = Hmm(), *carry: str) -> tuple[DataFrame, LanguageModel]:
    """Rows of ``carry`` columns with held_out, n_tokens, n_known, base_score and score, and the model that gave them.

    Learns from the rows for which ``held`` is false, scores all. ``base_score`` is that of single words with half a
    count added, ``score`` the model's log10 probability of all tokens, the end included. A null text is empty and has the end alone.
    Rows that share an id, or have none, are rows of their own; repeated rows teach as often as they come. Without
    training rows every token is equally unknown and base_score is 0. A text of any length is one sequence, and worked
    on as a whole; words of any length are counted, those over ``own_bytes`` by their last bytes' class. Equally
    frequent words rank by their bytes. An empty table gives no rows. Other columns may have any name but those of ``carry``
    must differ from the added ones. Three passes read texts or codes once each and every round reads the codes; words
    outside the own classes are dealt by word to meet their counts, which no word dominates, as the frequent ones are not among them.
    """
    texts = docs.select(*carry, held.alias("held_out"), F.col("text").cast("binary").alias("text"))
    counts = stage_table(count_words(texts.where("NOT held_out").select("text"), p), "words")
    known = classes_of(counts, p)
    encoded = stage_table(encode(texts, known, p), "codes")
    model, found = learn(encoded.where("NOT held_out"), known, p)
    return score(encoded, counts, known, model, p), LanguageModel(counts, known, model, found)
