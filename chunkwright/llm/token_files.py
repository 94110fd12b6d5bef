"""Token ids as Arrow stream files (IPC file format) of fixed-size lists.

Documents are dealt into doc_id ranges, and each range is tokenized and written as one Arrow file: column ``ids`` is a fixed-size list of ``sequence_length`` ids, ``mask`` a fixed-size list
of booleans that is false only on the padding of the range's last sequence. Uncompressed, so a reader
maps the file and takes any row in place. A side file holds the range's documents and their lengths.
Files are written under a name of their own attempt and renamed when whole, so a lost executor or a
speculative twin leaves no half file under a final name.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_shared_path, small_batches
from .tokens import encoder


@dataclass(frozen=True)
class TokenFiles:
    tokenizer: str = "byte_bpe_50k.json"
    end_id: int = 0
    sequence_length: int = 2048
    rows_per_batch: int = 256
    batch_rows: int = 256
    docs_per_file: int = 50_000


MANIFEST_SCHEMA = "shard int, lo long, hi long, n_docs long, n_ids long, path string"


def filesystem(uri: str):
    """(filesystem, path) of a URI or a local path."""
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri  # the name that Hadoop uses
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def id_type(vocab_size: int) -> np.dtype:
    return np.dtype("<u2") if vocab_size <= 1 << 16 else np.dtype("<u4")


class RangeWriter:
    """Writes one range: sequences as they fill, then the document index."""

    def __init__(self, params: TokenFiles, kind: np.dtype, base: str):
        self.p, self.kind = params, kind
        self.fs, self.base = filesystem(base)
        self.fs.create_dir(self.base, recursive=True)
        self.name = uuid.uuid4().hex
        n = params.sequence_length
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), n)), ("mask", pa.list_(pa.bool_(), n))])
        self.out = self.fs.open_output_stream(f"{self.base}/.{self.name}.part")
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.tail: list[np.ndarray] = []
        self.held = 0
        self.docs: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.tail.append(ids)
        self.held += len(ids)
        if self.held >= self.p.sequence_length * self.p.rows_per_batch:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        n, flat = self.p.sequence_length, np.concatenate([*self.tail, np.empty(0, self.kind)])
        whole = -(-len(flat) // n) if last else len(flat) // n
        used = min(len(flat), whole * n)
        ids, mask = np.zeros(whole * n, self.kind), np.zeros(whole * n, bool)
        ids[:used], mask[:used] = flat[:used], True
        for at in range(0, whole, self.p.rows_per_batch):
            part = slice(at * n, min(whole, at + self.p.rows_per_batch) * n)
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x[part]), n) for x in (ids, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.tail, self.held = [flat[used:]], len(flat) - used

    def close(self, shard: int) -> tuple:
        self._flush(last=True)
        self.file.close()
        self.out.close()
        final = f"{self.base}/{self.name}.arrow"
        index = pa.table({"doc_id": pa.array([d for d, _ in self.docs], pa.int64()), "n_tokens": pa.array([n for _, n in self.docs], pa.int64())})
        with self.fs.open_output_stream(f"{self.base}/.{self.name}.index.part") as out, pa.ipc.new_file(out, index.schema) as file:
            file.write_table(index)
        self.fs.move(f"{self.base}/.{self.name}.index.part", f"{self.base}/{self.name}.index.arrow")
        self.fs.move(f"{self.base}/.{self.name}.part", final)
        real = [d for d, _ in self.docs if d is not None]
        return shard, min(real, default=None), max(real, default=None), len(self.docs), sum(n for _, n in self.docs), final


def write_token_files(docs: DataFrame, base: str | None = None, params: TokenFiles = TokenFiles()) -> DataFrame:
    """Write the files below ``base`` (a new folder in the shared one by default) and return the manifest.

    One row per range: ``shard`` (ascending with doc_id), ``path``, counts, ``first``: ids of all ranges
    before it. Null texts are empty (their end id alone); rows with a null doc_id sort first; repeated
    doc_ids are ordered by a hash of their texts and may lie in several ranges; an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    base = base or new_shared_path(spark, "tokens")
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // params.docs_per_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, shard = None, TaskContext.get().partitionId()
        enc = encoder(params.tokenizer)
        kind = id_type(enc.vocab_size)
        for batch in batches:
            for at in range(0, batch.num_rows, params.batch_rows):
                part = batch.slice(at, params.batch_rows)
                writer = writer or RangeWriter(params, kind, base)
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode([t or "" for t in part.column(1).to_pylist()])):
                    writer.add(doc_id, np.append(np.frombuffer(ids, "<u4"), np.uint32(params.end_id)).astype(kind))
        if writer:
            row = writer.close(shard)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["shard", "lo", "hi", "n_docs", "n_ids", "path"])

    order = F.col("doc_id").asc_nulls_first()
    # Rows that share an id are dealt by a hash of their texts, equal rows by their place in the scan: no key is hot.
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    ranged = keys.repartitionByRange(n_parts, order, "h", "row").sortWithinPartitions(order, "h", "row").select("doc_id", "text")
    small_batches(spark)
    # The manifest is written, so later reads see one set of files and never write them again.
    manifest_path = new_shared_path(spark, "manifest")
    ranged.mapInArrow(run, MANIFEST_SCHEMA).write.parquet(manifest_path)
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(manifest_path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, read from the mapped files: doc_id, start, n_tokens, ids_crc32."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = filesystem(path)
                local = store.type_name == "local"
                open_ = (lambda p: pa.memory_map(p)) if local else store.open_input_file
                with open_(path.removesuffix(".arrow") + ".index.arrow") as f:
                    index = pa.ipc.open_file(f).read_all()
                with open_(path) as f:
                    reader = pa.ipc.open_file(f)
                    sizes, at, batch_no, held = index.column("n_tokens").to_numpy(), 0, 0, np.empty(0, "<u2")
                    crcs = []
                    for size in sizes:
                        crc, left = 0, int(size)
                        while left:
                            if not len(held):
                                rows = reader.get_batch(batch_no)
                                ids, mask = (rows.column(i).flatten() for i in (0, 1))
                                held = ids.to_numpy()[: mask.true_count]
                                batch_no += 1
                            crc = zlib.crc32(held[:left].astype("<u4").tobytes(), crc)
                            left, held = left - min(left, len(held)), held[left:]
                        crcs.append(crc)
                starts = first + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays([index.column("doc_id").combine_chunks(), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=schema.fieldNames())

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path", "first").repartition(n, "path").mapInArrow(run, schema)
