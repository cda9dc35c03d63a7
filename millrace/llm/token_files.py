"""Token ids in files of bit or byte planes.

A file holds the ids of whole documents, end to end. Every `block_ids` ids are one chunk: the block is transposed, so
that plane k holds byte (or bit) k of all its ids, and each plane is compressed by itself with zstandard. Planes that
are all zero cost a few bytes. After the chunks come the document index (ids and lengths, planes as well) and the
chunk index (ids and plane sizes of each chunk), then their sizes; a reader that wants some documents reads the end of
the file and the chunks it needs.

    8 bytes mark | chunks, each its planes | documents | chunk index | 3 x 8 bytes: sizes of both, ids | 8 bytes mark

Documents are written in ascending order of id over all files, nulls first, equal ids in any order, which the range
partitions of the sort give; each task writes one file, under a name of its own until it is whole. Null and empty
texts are an end id alone. A text is encoded whole; its ids fill as many chunks as they need. Empty tables give no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, open_folder, packed, query, rows_of, table, unpacked
from millrace.llm.tokens import default_tokenizer, encoder

MARK = {"byte": b"IDPLANE8", "bit": b"IDPLANE1"}
NULL_ID = np.iinfo(np.int64).min


def to_planes(ids: np.ndarray, kind: str) -> list[np.ndarray]:
    """Planes of a block, the lowest first."""
    rows = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(rows[:, k]) for k in range(4)]
    return list(np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little"))


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


class Writer:
    def __init__(self, out, kind: str = "byte", block_ids: int = 1 << 16, level: int = 3):
        self.out, self.kind, self.block_ids = out, kind, block_ids
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.chunks: list[int] = []
        self.doc_ids: list[int] = []
        self.lengths: list[int] = []
        self.left: list[np.ndarray] = []
        self.n_left = self.n = 0
        out.write(MARK[kind])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids))
        self.left.append(ids)
        self.n_left += len(ids)
        if self.n_left >= self.block_ids:
            ids = np.concatenate(self.left)
            whole = len(ids) // self.block_ids * self.block_ids
            for at in range(0, whole, self.block_ids):
                self._chunk(ids[at : at + self.block_ids])
            self.left, self.n_left = [ids[whole:]], len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.pack(p.tobytes()) for p in to_planes(ids, self.kind)]
        self.chunks += [len(ids), *map(len, planes)]
        self.out.write(b"".join(planes))
        self.n += len(ids)

    def close(self) -> None:
        if self.n_left:
            self._chunk(np.concatenate(self.left))
        documents = [packed(np.array(self.doc_ids, np.int64)), packed(np.array(self.lengths, np.int64))]
        documents = struct.pack("<q", len(documents[0])) + b"".join(documents)
        chunks = np.array(self.chunks, "<i8").tobytes()
        self.out.write(documents + chunks + struct.pack("<3q", len(documents), len(chunks), self.n) + MARK[self.kind])


class Reader:
    """Documents of a file in their order; `chunk` reads one chunk by the index."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 32)
        n_documents, n_chunks, self.n = struct.unpack("<3q", file.read(24))
        self.kind = {mark: kind for kind, mark in MARK.items()}[bytes(file.read(8))]
        file.seek(size - 32 - n_chunks - n_documents)
        documents, chunks = file.read(n_documents), file.read(n_chunks)
        first = struct.unpack("<q", documents[:8])[0]
        self.doc_ids, self.lengths = unpacked(documents[8 : 8 + first], np.int64), unpacked(documents[8 + first :], np.int64)
        self.chunks = np.frombuffer(chunks, "<i8").reshape(-1, 5 if self.kind == "byte" else 33)
        self.offsets = 8 + np.r_[0, np.cumsum(self.chunks[:, 1:].sum(1))]
        self.unpack = zstandard.ZstdDecompressor().decompress

    def chunk(self, k: int) -> np.ndarray:
        self.file.seek(int(self.offsets[k]))
        data, planes, at = self.file.read(int(self.offsets[k + 1] - self.offsets[k])), [], 0
        for size in self.chunks[k, 1:].tolist():
            planes.append(self.unpack(data[at : at + size]))
            at += size
        return from_planes(planes, int(self.chunks[k, 0]), self.kind)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, ids of the file before it, ids), chunk by chunk."""
        have, k, start = np.empty(0, "<u4"), 0, 0
        for i, n in zip(self.doc_ids.tolist(), self.lengths.tolist(), strict=True):
            parts, size = [have], len(have)
            while size < n:
                parts.append(self.chunk(k))
                size, k = size + len(parts[-1]), k + 1
            ids = np.concatenate(parts) if len(parts) > 1 else have
            yield (None if i == NULL_ID else i), start, ids[:n]
            have, start = ids[n:], start + n


FILES = "shard int, path string, n_documents long, n_ids long"


def _write(folder: str, tokenizer: str, end_id: int, kind: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        shard, writer = TaskContext.get().partitionId(), None
        name, own = f"{path}/ids-{shard:06d}.bin", f"{path}/.ids-{shard:06d}-{uuid.uuid4().hex}"
        encode = encoder(tokenizer).encode
        for batch in rows_of(batches):
            if writer is None:
                files.create_dir(path, recursive=True)
                out = files.open_output_stream(own)
                writer = Writer(out, kind, block_ids)
            for i, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                writer.add(i, np.r_[ids, np.uint32(end_id)])
        if writer is not None:
            writer.close()
            out.close()
            files.move(own, name)
            row = (shard, f"{folder}/ids-{shard:06d}.bin", len(writer.doc_ids), writer.n)
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds, strict=True)], names=["shard", "path", "n_documents", "n_ids"])

    return run


def write_ids(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tokenizer: str | None = None, kind: str = "byte", block_ids: int = 1 << 16) -> DataFrame:
    """Writes the files into the shared folder and returns one row for each: shard, path, n_documents, n_ids."""
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"), F.monotonically_increasing_id().alias("uid"))
    # the row's number lets equal ids, too, spread over several files
    ordered = rows.repartitionByRange("id", "uid").sortWithinPartitions("id", "uid").select("id", "text")
    return scratch.write(ordered.mapInArrow(_write(scratch.path("ids"), tokenizer or default_tokenizer(), end_id, kind, block_ids), FILES), "files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            files, path = open_folder(row["path"])
            with files.open_input_file(path) as file:
                rows, size = [], 0
                for i, start, ids in Reader(file).documents():
                    rows.append((i, row["base"] + start, ids.astype("<u4").tobytes()))
                    size += 4 * len(ids)
                    if size > 4 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "start", "ids"])


def read_ids(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids) of all documents: ids before it over all files in order, ids as little-endian unsigned 32-bit."""
    listed, base = [], 0
    for row in files.orderBy("shard").toLocalIterator():  # one row a file
        listed.append((row["shard"], row["path"], base))
        base += row["n_ids"]
    spark = files.sparkSession
    paths = spark.createDataFrame(listed, "shard int, path string, base long").repartition(max(1, len(listed)), "shard")
    return paths.mapInArrow(_read, "id long, start long, ids binary").withColumnRenamed("id", id_col)


@query("op9_token_id_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    read = read_ids(write_ids(table(spark, sf_dir, "documents"), scratch))
    return read.select("doc_id", "start", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
