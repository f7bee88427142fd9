"""Token ids as Arrow files of fixed-size lists.

Documents are dealt over the tasks by ranges of their id and written in that order. A file holds sequences of equal
length in record batches: ``ids`` (fixed-size list), ``mask`` (fixed-size list, false where the last sequence is padded)
and, for every sequence, the documents that end in it (``doc_ids``) and where (``doc_ends``). Nothing is compressed, so
a reader maps a file and finds any sequence by its number without copying. A file ends with a document, once it has
``file_tokens`` ids, so files are read independently and stay small unless one document is larger.

The names of files order them. A task that runs again writes the same files again, under a temporary name first.

Defined results: NULL and empty texts have the end id only; rows that repeat are documents of their own; NULL ids come
first; an empty table gives no file and an empty result; further columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.tokens import batches, encoder
from sightline.session import cut, new_path

_BATCH = 256  # sequences in a record batch


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([
        ("ids", pa.list_(pa.from_numpy_dtype(dtype), length)),
        ("mask", pa.list_(pa.bool_(), length)),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_ends", pa.list_(pa.int32())),
    ])


class _File:
    """One file in the making; ids are gathered until a record batch is full."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, length: int):
        self.store, base = fs.FileSystem.from_uri(folder)
        self.path, self.temporary = f"{base}/{name}", f"{base}/_{name}.{uuid.uuid4().hex}"
        self.dtype, self.length, self.schema = dtype, length, _schema(dtype, length)
        self.sink = self.store.open_output_stream(self.temporary)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[bytes] = []
        self.held = self.tokens = self.sequence = 0
        self.ends: list[tuple[int | None, int]] = []  # document, ids of the file up to its end

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.waiting.append(ids)
        n = len(ids) // self.dtype.itemsize
        self.held += n
        self.tokens += n
        self.ends.append((doc_id, self.tokens))
        if self.held >= _BATCH * self.length:
            self._flush(self.held // self.length)

    def _flush(self, sequences: int, pad: int = 0) -> None:
        flat = np.frombuffer(b"".join(self.waiting), self.dtype)
        take = sequences * self.length - pad
        self.waiting, self.held = [flat[take:].tobytes()], self.held - take
        ids = np.concatenate([flat[:take], np.zeros(pad, self.dtype)])
        mask = np.ones(len(ids), bool)
        mask[take:] = False
        done = (self.sequence + sequences) * self.length
        docs: list[list] = [[] for _ in range(sequences)]
        at: list[list] = [[] for _ in range(sequences)]
        k = 0
        for doc_id, end in self.ends:
            if end > done:
                break
            s = (end - 1) // self.length - self.sequence
            docs[s].append(doc_id)
            at[s].append((end - 1) % self.length + 1)
            k += 1
        self.ends, self.sequence = self.ends[k:], self.sequence + sequences
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
            pa.array(docs, self.schema.field("doc_ids").type), pa.array(at, self.schema.field("doc_ends").type),
        ]
        for a in range(0, sequences, _BATCH):
            self.writer.write_batch(pa.RecordBatch.from_arrays([c.slice(a, _BATCH) for c in columns], schema=self.schema))

    def close(self) -> int:
        if self.held:
            sequences = -(-self.held // self.length)
            self._flush(sequences, sequences * self.length - self.held)
        self.writer.close()
        self.sink.close()
        self.store.move(self.temporary, self.path)
        return self.tokens


def write(docs: DataFrame, tokenizer: str, folder: str, length: int = 2048, end_id: int = 2, file_tokens: int = 4_000_000) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) below ``folder``; (part, file, tokens) of every file."""
    def of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, k, out, rows = encoder(tokenizer), TaskContext.get().partitionId(), 0, None, []
        end = np.array([end_id], enc.dtype).tobytes()
        for b in stream:
            doc_ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for some in batches(texts):
                for doc_id, ids in zip(doc_ids[some], enc.encode(texts[some]), strict=True):
                    out = out or _File(folder, f"part-{part:06d}-{k:06d}.arrow", enc.dtype, length)
                    out.add(doc_id, ids + end)
                    if out.tokens >= file_tokens:
                        rows.append((part, k, out.close()))
                        out, k = None, k + 1
        if out:
            rows.append((part, k, out.close()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["part", "file", "tokens"])

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ranged.mapInArrow(of, "part long, file long, tokens long"))


def sequences(content: bytes) -> pa.ipc.RecordBatchFileReader:
    """A file's reader; its arrays are views of ``content``."""
    return pa.ipc.open_file(pa.py_buffer(content))


def documents(content: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids) of all documents of a file."""
    file, begun, gathered, at = sequences(content), 0, [], 0
    for k in range(file.num_record_batches):
        b = file.get_batch(k)
        ids, length = b.column(0).values.to_numpy(), b.schema.field("ids").type.list_size
        doc_ids, ends = b.column(2).to_pylist(), b.column(3).to_pylist()
        for s, (owners, stops) in enumerate(zip(doc_ids, ends, strict=True)):
            last = 0
            for doc_id, stop in zip(owners, stops, strict=True):
                gathered.append(ids[s * length + last : s * length + stop])
                yield doc_id, begun, np.concatenate(gathered)
                at += stop - last
                begun, gathered, last = at, [], stop
            gathered.append(ids[s * length + last : (s + 1) * length])
            at += length - last


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files below ``folder``.

    ``files`` counts the ids of each file; their running total gives a document its place among all ids.
    """
    def of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part, k = map(int, path.rpartition("part-")[2].removesuffix(".arrow").split("-"))
                rows = [(part, k, d, start, len(ids), crc32(ids.astype("<u4").tobytes())) for d, start, ids in documents(content.as_buffer())]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "file", "doc_id", "at", "n_tokens", "ids_crc32"])

    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.arrow").load(folder).select("path", "content")
    found = content.mapInArrow(of, "part long, file long, doc_id long, at long, n_tokens long, ids_crc32 long")
    parts = files.groupBy("part").agg(F.sum("tokens").alias("total"))
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("file")) - F.col("tokens")
    starts = files.withColumn("within", within).join(parts, "part").select("part", "file", (F.col("before") + F.col("within")).alias("base"))
    return found.join(starts, ["part", "file"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes ``docs`` to a new folder of the shared one and reads the files back."""
    folder = new_path(docs.sparkSession, "tokens")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    files = write(docs, tokenizer, folder, **options)
    if files.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(docs.sparkSession, folder, files)
