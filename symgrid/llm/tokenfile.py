"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

Layout of a file (all numbers little-endian):

* data frames, each with the ids (unsigned 32 bits) of whole consecutive documents and zstandard's own content checksum;
* a skippable frame (magic 0x184D2A50) with the document index: count u64, then per document
  the arrays doc_id i64, known u8 (0: the doc_id is null), frame u32, start u64 (ids before it in its frame), length u64;
* a skippable frame (magic 0x184D2A5E) in the public seekable format: per data frame compressed
  size, decompressed size and the low 32 bits of the XXH64 of the content, then the number of
  frames, a descriptor (0x80: with checksums) and the magic 0x8F92EAB1.

Any zstandard decoder reads the ids in order; a reader that wants some documents reads the two
tails and decompresses only the frames that hold them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.llm.common import map_arrow, open_file, put, slices, table, work_dir
from symgrid.llm.tokens import VOCABULARY, encoder

FRAME_BYTES = 1 << 18
#: Text bytes of a file, about: as many as a task takes well, fewer where that leaves tasks of the session idle.
FILE_BYTES, LEAST_BYTES = 256 << 20, 4 << 20
INDEX_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class Shape:
    """What :func:`encoded` has written so far."""

    documents = 0
    tokens = 0


def encoded(documents: Iterable[tuple[int | None, bytes]], shape: Shape, frame_bytes: int = FRAME_BYTES, level: int = 3) -> Iterator[bytes]:
    """The bytes of a file of (doc_id, ids) in the given order; one frame is in memory at a time."""
    compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    seek: list[bytes] = []
    index: list[tuple[int, int, int, int, int]] = []
    waiting: list[bytes] = []
    held = 0

    def frame() -> bytes:
        content = b"".join(waiting)
        data = compressor.compress(content)
        seek.append(struct.pack("<III", len(data), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        return data

    for doc_id, ids in documents:
        if waiting and held + len(ids) > frame_bytes:
            yield frame()
            waiting, held = [], 0
        index.append((doc_id or 0, doc_id is not None, len(seek), held // 4, len(ids) // 4))
        waiting.append(ids)
        held += len(ids)
        shape.documents += 1
        shape.tokens += len(ids) // 4
    if waiting:
        yield frame()
    columns = list(zip(*index)) or [()] * 5
    body = struct.pack("<Q", len(index)) + b"".join(np.asarray(c, t).tobytes() for c, t in zip(columns, ("<i8", "u1", "<u4", "<u8", "<u8")))
    yield struct.pack("<II", INDEX_MAGIC, len(body)) + body
    table = b"".join(seek) + struct.pack("<IBI", len(seek), 0x80, SEEK_END)
    yield struct.pack("<II", SEEK_MAGIC, len(table)) + table


class TokenFile:
    """A reader that decompresses only the frames asked for and checks each."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source = source
        size = source.size()
        frames, descriptor, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_END or not descriptor & 0x80:
            raise ValueError("no seek table with checksums")
        entries = np.frombuffer(self._read(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3)
        self.sizes, self.lengths, self.sums = entries[:, 0].astype(np.int64), entries[:, 1].astype(np.int64), entries[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        magic, length = struct.unpack("<II", self._read(int(self.starts[-1]), 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index")
        body = self._read(int(self.starts[-1]) + 8, length)
        n = struct.unpack_from("<Q", body)[0]
        at = 8
        self.columns: list[np.ndarray] = []
        for kind in ("<i8", "u1", "<u4", "<u8", "<u8"):
            self.columns.append(np.frombuffer(body, kind, n, at))
            at += n * np.dtype(kind).itemsize

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("the file is cut short")
        return data

    def frame(self, k: int) -> bytes:
        """The content of a frame, checked against the seek table."""
        content = zstandard.ZstdDecompressor().decompress(self._read(int(self.starts[k]), int(self.sizes[k])), max_output_size=int(self.lengths[k]))
        if len(content) != self.lengths[k] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return content

    def documents(self, ids: set[int | None] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) in file order; ids: only these documents."""
        doc_ids, known, frames, starts, lengths = self.columns
        now, content = -1, b""
        for doc_id, there, k, start, length in zip(doc_ids.tolist(), known.tolist(), frames.tolist(), starts.tolist(), lengths.tolist()):
            key = doc_id if there else None
            if ids is not None and key not in ids:
                continue
            if k != now:
                now, content = k, self.frame(k)
            yield key, content[4 * start : 4 * (start + length)]


def write_tokens(docs: DataFrame, path: str, files: int, vocabulary: str = VOCABULARY, text: str = "text", id: str = "doc_id") -> list[tuple[str, int, int]]:
    """Write ``docs`` as token files in ascending doc_id order; (path, documents, tokens) of each file.

    Texts move once, range-partitioned by doc_id (equal ids spread by a hash of their text);
    each task encodes its sorted rows as a stream into one file, which appears only when whole,
    so a lost or doubled task does no harm. Null doc_ids come first, null texts are empty,
    repeated rows are kept and an empty table gives files without documents. Only one row a
    file comes to the driver.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        number = TaskContext.get().partitionId()

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for part in slices(batches):
                yield from zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()))

        shape = Shape()
        name = f"{path}/tokens-{number:06d}.zst"
        put(name, encoded(documents(), shape))
        yield pa.RecordBatch.from_pydict({"number": [number], "path": [name], "documents": [shape.documents], "tokens": [shape.tokens]}, schema=pa.schema([("number", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    written = map_arrow(ordered, run, "number long, path string, documents long, tokens long").collect()
    return [(r.path, r.documents, r.tokens) for r in sorted(written, key=lambda r: r.number)]


def read_tokens(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files, in file order within a file."""
    listed, before = [], 0
    for path, documents, tokens in files:
        if documents:
            listed.append((path, before))
        before += tokens
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_file(path) as source:
                    rows: list[tuple] = []
                    held = 0
                    for doc_id, ids in TokenFile(source).documents():
                        rows.append((doc_id, start, len(ids) // 4, ids))
                        start += len(ids) // 4
                        held += len(ids)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    paths = spark.createDataFrame(listed, "path string, start long").repartition(max(1, len(listed)))
    return map_arrow(paths, run, "doc_id long, start long, n_tokens long, ids binary")


def files_for(docs: DataFrame, text: str = "text") -> int:
    """How many files to write: by the bytes of the texts, so that a file and its task don't grow with the corpus."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(1, -(-total // FILE_BYTES), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // LEAST_BYTES))


def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum as read back from the files just written."""
    path = work_dir(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    files = write_tokens(docs, path, files_for(docs))
    return read_tokens(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc(ids: bytes) -> int:
    """Unsigned crc32 of ids as the contract counts it."""
    return zlib.crc32(ids)
