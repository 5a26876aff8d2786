"""Token-id output: independent zstandard frames with a trailing seek table and per-frame checksums.

A file is a sequence of parts, each closed by MAGIC: frames first, then the seek table, then a part of eight
bytes that holds the table's size. A frame is one zstandard frame (with its content checksum) over the ids of
whole documents as little-endian unsigned 32-bit integers. The table is a zstandard frame over two Arrow
streams: frames (offset, size, crc32, documents) and documents (doc_id, n_tokens). A reader takes the table from the
file's end and decompresses the frames of the documents asked for, and no others.

Documents are dealt by ranges of doc_id (and of the text's hash, so that very many rows of one id, or of none, are
divided) and sorted there, so files and rows ascend by doc_id; a task streams through its range and holds one frame and the table. After FILE_FRAMES frames a file ends with its table and the task
goes on in a new one, so no file and no reader's memory grows with a range (one document is never divided: its frame
is as long as it is). Files are written by Spark's own sink (parts are rows, MAGIC its row separator, a file's rows
limited to those of one table), so they reach any file system that Spark writes to, and a lost task is written anew.
They are read through Spark too, each file's bytes at once: what is spared is decompressing, not reading.

Nulls: a null text is empty and has the end id alone; rows with a null doc_id come first. Rows of equal doc_id
are all written, ordered by a hash of the text. A doc_id that is no integer counts as null. An empty table gives no
files' rows. Extra columns are not used, whatever their names.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, shared_path, small_batches, stage
from .encoding import encoder

MAGIC = b"LZS1"
FRAME_BYTES = 1 << 18
#: Frames of one file.
FILE_FRAMES = 256


def _stream(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue()


class FrameWriter:
    """Parts of one file after the other, in order: add(doc_id, ids) and close() yield them when they are full."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, file_frames: int = FILE_FRAMES, level: int = 3):
        self.limit, self.most, self.pack = frame_bytes, file_frames, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._begin()

    def _begin(self) -> None:
        self.raw, self.size, self.at = [], 0, 0
        self.frames, self.docs = [], []

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[bytes]:
        self.raw.append(ids)
        self.size += len(ids)
        self.docs.append((doc_id, len(ids) // 4))
        if self.size >= self.limit:
            yield self._frame()
            if len(self.frames) == self.most:
                yield from self.close()

    def _frame(self) -> bytes:
        raw = b"".join(self.raw)
        part = self.pack.compress(raw)
        self.frames.append((self.at, len(part), zlib.crc32(raw), len(self.raw)))
        self.at += len(part) + len(MAGIC)
        self.raw, self.size = [], 0
        return part

    def close(self) -> Iterator[bytes]:
        """The end of a file that holds documents; the next document begins another."""
        if not self.docs:
            return
        if self.raw:
            yield self._frame()
        frames = pa.table({k: pa.array([f[i] for f in self.frames], pa.int64()) for i, k in enumerate(("offset", "size", "crc32", "documents"))})
        docs = pa.table({"doc_id": pa.array([d for d, _ in self.docs], pa.int64()), "n_tokens": pa.array([n for _, n in self.docs], pa.int64())})
        first = _stream(frames)
        table = self.pack.compress(struct.pack("<Q", len(first)) + first + _stream(docs))
        yield table
        yield struct.pack("<Q", len(table))
        self._begin()


class FrameFile:
    """Random access over one file's bytes: a slice function is all it needs."""

    def __init__(self, size: int, slice_of):
        self.slice, self.unpack = slice_of, zstandard.ZstdDecompressor()
        tail = 8 + len(MAGIC)
        end = slice_of(size - tail, tail)
        if end[8:] != MAGIC:
            raise ValueError("no seek table at the end")
        (n,) = struct.unpack("<Q", end[:8])
        raw = self.unpack.decompress(slice_of(size - tail - len(MAGIC) - n, n))
        (k,) = struct.unpack("<Q", raw[:8])
        self.frames = pa.ipc.open_stream(raw[8 : 8 + k]).read_all().to_pylist()
        self.docs = pa.ipc.open_stream(raw[8 + k :]).read_all()
        self.first = np.cumsum([0] + [f["documents"] for f in self.frames])  # number of each frame's first document

    @classmethod
    def of(cls, data: bytes) -> FrameFile:
        return cls(len(data), lambda at, n: data[at : at + n])

    def frame(self, k: int) -> bytes:
        f = self.frames[k]
        raw = self.unpack.decompress(self.slice(f["offset"], f["size"]))
        if zlib.crc32(raw) != f["crc32"]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) in file order; only frames that hold a wanted document are decompressed."""
        ids, sizes = self.docs["doc_id"].to_pylist(), self.docs["n_tokens"].to_numpy()
        for k in range(len(self.frames)):
            a, b = int(self.first[k]), int(self.first[k + 1])
            if wanted is not None and not wanted.intersection(ids[a:b]):
                continue
            raw, at = self.frame(k), 0
            for j in range(a, b):
                n = 4 * int(sizes[j])
                if wanted is None or ids[j] in wanted:
                    yield ids[j], raw[at : at + n]
                at += n


def write_tokens(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int) -> None:
    """Encode every text and write the files under path."""
    small_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out = encoder(tokenizer, kind), FrameWriter(FRAME_BYTES, FILE_FRAMES)
        rows = lambda parts: pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["part"])
        for b in batches:
            ids = coder.ids_bytes(t or "" for t in b.column(1).to_pylist())
            for doc_id, x in zip(b.column(0).to_pylist(), ids):
                for part in out.add(doc_id, x + end):
                    yield rows([part])
        for part in out.close():
            yield rows([part])

    order = ["doc_id", "h", "text"]  # the hash divides what has one id, or none
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions(*order)
    parts = dealt.select("doc_id", "text").mapInArrow(work, "part binary")
    sink = parts.select(F.col("part").cast("string").alias("value")).write.option("lineSep", MAGIC.decode()).option("compression", "none")
    sink.option("maxRecordsPerFile", FILE_FRAMES + 2).text(path)  # the frames, the table and its size


def read_tokens(spark: SparkSession, path: str, wanted: set[int] | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each document in the files: file, at (its number in the file), doc_id, before (ids before it in
    the file), n_tokens, ids_crc32, and the ids themselves if asked for."""
    small_batches(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1)):
                data = data.as_py()
                if not data:
                    continue
                file, before, found = FrameFile.of(data), 0, []
                starts = {}
                if wanted is not None:
                    for d, n in zip(file.docs["doc_id"].to_pylist(), file.docs["n_tokens"].to_pylist()):
                        starts.setdefault(d, []).append(before)
                        before += n
                    before = 0
                for at, (doc_id, ids) in enumerate(file.documents(wanted)):
                    n = len(ids) // 4
                    begin = before if wanted is None else starts[doc_id].pop(0)
                    found.append((name.as_py(), at, doc_id, begin, n, zlib.crc32(ids)) + ((ids,) if with_ids else ()))
                    before += n
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
                for k in range(0, len(found), 2000):
                    cols = list(zip(*found[k : k + 2000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=NAMES + ["ids"] * with_ids)

    NAMES = ["file", "at", "doc_id", "before", "n_tokens", "ids_crc32"]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(work, "file string, at long, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_output(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """Write the files, read them back, and give each document its place in the whole sequence of ids."""
    write_tokens(docs, path, tokenizer, kind, end_id)
    rows = stage(read_tokens(docs.sparkSession, path), "token-rows")
    # one row a file; files ascend by the numbers in their names (task, then file of the task) as by doc_id
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumns({"task": number(r"/part-(\d+)-[^/]*$"), "of_task": number(r"-c(\d+)\.[^/]*$")})
    base = sums.select("file", (F.sum("n").over(W.orderBy("task", "of_task")) - F.col("n")).alias("base"))
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(read(spark, sf_dir, "documents"), shared_path(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"), "byte", 2)
