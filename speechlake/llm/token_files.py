"""Token ids in files of fixed-width packed blocks, written and read by Spark tasks."""

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechlake.llm.token_ids import coder
from speechlake.sources.shared import new_path, written

# A file: packed blocks, each of BLOCK ids but the last; then the offset of each block, the id and the
# number of tokens of each document, and the trailer. All numbers are little-endian.
MAGIC, BLOCK = b"FWTB", 65_536
_TRAILER = struct.Struct("<4sIQQQQ")  # magic, bits, tokens, documents, blocks, start of the offsets
NO_ID = -(2**63)


def _places(bits: int) -> list[tuple[int, int, int]]:
    """(id, first byte, shift) of each of 8 packed ids, which fill `bits` bytes."""
    return [(i, *divmod(i * bits, 8)) for i in range(8)]


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Each id in `bits` bits (32 at most), lowest first; the last byte is filled with zeros."""
    rows = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    rows.ravel()[: len(ids)] = ids
    out = np.zeros((len(rows), bits), np.uint8)
    for i, at, shift in _places(bits):
        value = rows[:, i] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, at + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    """The n ids that pack_bits() packed."""
    rows = np.zeros((-(-n // 8), bits), np.uint8)
    rows.ravel()[: -(-n * bits // 8)] = np.frombuffer(data, np.uint8, -(-n * bits // 8))
    out = np.zeros((len(rows), 8), np.uint64)
    for i, at, shift in _places(bits):
        for k in range(-(-(shift + bits) // 8)):
            out[:, i] |= rows[:, at + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, i] >>= np.uint64(shift)
    return (out.ravel()[:n] & np.uint64((1 << bits) - 1)).astype(np.uint32)


class TokenFileWriter:
    """Appends documents to a file; the index goes to its end, so that the stream is written once."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.rest, self.waiting = [], 0
        self.offsets, self.ids, self.sizes = array("q"), array("q"), array("q")

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids))
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            every = np.concatenate(self.rest)
            full = len(every) // BLOCK * BLOCK
            for i in range(0, full, BLOCK):
                self._block(every[i : i + BLOCK])
            self.rest, self.waiting = [every[full:]], len(every) - full

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.stream.tell())
        self.stream.write(pack_bits(ids, self.bits))

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.rest))
        at = self.stream.tell()
        for x in (self.offsets, self.ids, self.sizes):
            self.stream.write(np.array(x, "<i8").tobytes())
        self.stream.write(_TRAILER.pack(MAGIC, self.bits, sum(self.sizes), len(self.ids), len(self.offsets), at))


class TokenFile:
    """Random access to a file of TokenFileWriter."""

    def __init__(self, stream, size: int):
        self.stream = stream
        magic, self.bits, self.n_tokens, n, blocks, self.at = _TRAILER.unpack(self._read(size - _TRAILER.size, size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        index = np.frombuffer(self._read(self.at, self.at + 8 * (blocks + 2 * n)), "<i8")
        self.offsets, self.doc_ids, self.sizes = np.split(index, [blocks, blocks + n])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _read(self, start: int, stop: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(stop - start)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, from the blocks that hold them, in one read."""
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        end = self.offsets[last + 1] if last + 1 < len(self.offsets) else self.at
        data = self._read(int(self.offsets[first]), int(end))
        n = min((last + 1) * BLOCK, self.n_tokens) - first * BLOCK
        return unpack_bits(data, n, self.bits)[start - first * BLOCK : stop - first * BLOCK]

    def documents(self, at_once: int = 4 * BLOCK) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of each document, reading about at_once tokens at a time."""
        i = 0
        while i < len(self.sizes):
            j = max(i + 1, int(np.searchsorted(self.starts + self.sizes, self.starts[i] + at_once, "right")))
            low = int(self.starts[i])
            ids = self.tokens(low, int(self.starts[j - 1] + self.sizes[j - 1]))
            for k in range(i, j):
                at = int(self.starts[k]) - low
                doc = int(self.doc_ids[k])
                yield None if doc == NO_ID else doc, int(self.starts[k]), ids[at : at + int(self.sizes[k])]
            i = j


def write_token_files(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, spaced: bool = True, files: int | None = None, file_bytes: int = 268_435_456, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; return the manifest, a row per file.

    The texts are range-partitioned and sorted by doc_id, so each task encodes and writes one file under
    a name of its own attempt in the shared folder; only attempts that Spark commits reach the manifest
    (path, size, first_id, n_docs, n_tokens, start = ids in all files before it). Unless `files` says
    otherwise there are as many as shuffle partitions, more where one would hold over `file_bytes` of text. Null texts
    give the end id alone, null ids come first, repeated ids stand side by side, an empty table writes no
    file.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if files is None:
        total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    folder, bits = new_path(spark, "tokens"), max(1, int(vocabulary - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    store, root = fs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    path, encode, first = f"{root}/{uuid.uuid4().hex}.tok", coder(tokenizer, spaced).encode, doc
                    stream = store.open_output_stream(path)
                    writer = TokenFileWriter(stream, bits)
                writer.add(doc, np.append(np.frombuffer(encode(t.as_py()), "<u4"), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            size = stream.tell()
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "first_id": pa.array([first], pa.int64()), "n_docs": [len(writer.ids)], "n_tokens": [sum(writer.sizes)]})

    ranged = slim.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = written(ranged.mapInArrow(run, "path string, size bigint, first_id bigint, n_docs bigint, n_tokens bigint"), "manifest")
    before = W.orderBy(F.col("first_id").asc_nulls_first(), "path").rowsBetween(W.unboundedPreceding, -1)
    return made.withColumns({"start": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)), "folder": F.lit(folder)})


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """A row per document of the files in a manifest: doc_id, start, n_tokens, ids_crc32 and, if asked, ids.

    start counts the ids of all documents before it over all files. Each task reads whole files, a
    bounded number of tokens at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(row["folder"])
                with store.open_input_file(row["path"]) as stream:
                    rows = []
                    for doc, start, ids in TokenFile(stream, row["size"]).documents():
                        rows.append((doc, row["start"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int32)] * with_ids)))
                        if len(rows) >= 2000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "folder", "size", "start").repartition(n).mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(x, pa.int64()) for x in zip(*[r[:4] for r in rows], strict=True)]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if len(rows[0]) > 4:
        columns, names = [*columns, pa.array([r[4] for r in rows], pa.list_(pa.int32()))], [*names, "ids"]
    return pa.RecordBatch.from_arrays(columns, names)
