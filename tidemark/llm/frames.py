"""Operator 7: token files of independent zstandard frames with a trailing seek table, read frame by frame.

One file per range of document ids. Each document is one frame; one more frame holds the directory (ids of the documents and their
validity); then follows the seek table in the public seekable zstandard layout: a skippable frame with the compressed size, the plain
size and the checksum (low 32 bits of XXH64 of the plain bytes) of every frame. A reader loads the table and the directory and then
only the byte ranges of the documents asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, only, scratch_dir, text_slices, total_bytes
from .encode import encoder

# Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
SHARD_BYTES = 48 << 20


def checksum(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class Writer:
    """Writes one file. Nothing is visible under ``path`` before ``close``, so a repeated or lost task cannot leave half a file."""

    def __init__(self, path: str, width: int, level: int = 3):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.part = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.width, self.table, self.ids, self.tokens = width, [], [], 0

    def frame(self, plain: bytes) -> None:
        packed = self.zip.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain), checksum(plain)))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian 32-bit identifiers of one document."""
        self.frame(np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.width == 2 else ids)
        self.ids.append(doc_id)
        self.tokens += len(ids) // 4

    def close(self) -> None:
        values = np.array([0 if i is None else i for i in self.ids], "<i8").tobytes()
        valid = np.array([i is not None for i in self.ids], np.uint8).tobytes()
        self.frame(struct.pack("<BQ", self.width, len(self.ids)) + values + valid)
        rows = np.array(self.table, "<u4").tobytes() + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(rows)) + rows)
        self.out.close()
        self.fs.move(self.part, self.path)


class Reader:
    """Opens one file by its seek table; documents are decompressed one at a time and checked."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        self.file.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError(f"{path} has no seek table with checksums")
        self.file.seek(size - 9 - 12 * frames)
        self.table = np.frombuffer(self.file.read(12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        self.zip = zstandard.ZstdDecompressor()
        head = self.frame(frames - 1)
        self.width, n = struct.unpack("<BQ", head[:9])
        self.valid = np.frombuffer(head, np.uint8, n, 9 + 8 * n).astype(bool)
        self.ids = np.frombuffer(head, "<i8", n, 9)

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.at[k]))
        plain = self.zip.decompress(self.file.read(int(self.table[k, 0])), max_output_size=max(1, int(self.table[k, 1])))
        if len(plain) != self.table[k, 1] or checksum(plain) != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return plain

    def tokens(self, k: int) -> np.ndarray:
        """Identifiers of the k-th document as 32-bit integers."""
        return np.frombuffer(self.frame(k), f"<u{self.width}").astype("<u4")

    def lengths(self) -> np.ndarray:
        return self.table[:-1, 1] // self.width

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents in ascending id order into files below ``folder`` (a URI that every executor can write).

    Returns the manifest: shard, path, n_docs, n_tokens, start (tokens of all earlier files). Texts go through one range exchange on the
    id. A null or empty text is the end identifier alone, a null id comes first, repeated rows are written each time; an empty table
    gives no files; further columns are ignored. A file is about ``shard_bytes`` of text, more if one document is.
    """
    rows = only(docs, id_col, text_col)
    shards = max(1, -(-total_bytes(rows) // shard_bytes))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1], recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = 2 if max(encode.vocabulary, end_id + 1) <= 1 << 16 else 4
        end, shard, writer = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), None
        path = f"{folder}/tokens-{shard:06d}.zst"
        for b in text_slices(batches):
            writer = writer or Writer(path, width)
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode.encode(b.column("text").to_pylist())):
                writer.add(doc, ids + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(writer.ids)], "n_tokens": [writer.tokens]})

    manifest = materialize(ordered.mapInArrow(work, "shard int, path string, n_docs long, n_tokens long"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0).cast("long")))


def read_token_files(manifest: DataFrame, wanted: Iterable[int] | None = None) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids (array of int) - of the ``wanted`` ids only, or of all.

    Frames of other documents are neither read nor decompressed.
    """
    return _read(manifest, "doc_id long, start long, n_tokens long, ids array<int>", lambda ids: ids.astype(np.int32), wanted)


def token_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and CRC-32 of every document, read back from the files."""
    return _read(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()), None)


def _read(manifest: DataFrame, schema: str, value, wanted: Iterable[int] | None) -> DataFrame:
    keep = None if wanted is None else np.unique(np.array(list(wanted), np.int64))
    last = schema.split(", ")[-1].split(" ")[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32()) if last == "ids" else pa.int64()
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                reader = Reader(path)
                lengths = reader.lengths()
                start = base + np.concatenate(([0], np.cumsum(lengths)))
                chosen = np.arange(len(lengths)) if keep is None else np.flatnonzero(reader.valid & np.isin(reader.ids, keep))
                for some in np.array_split(chosen, max(1, -(-len(chosen) // 1000))):
                    ids = pa.array(reader.ids[some], pa.int64(), mask=~reader.valid[some])
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(start[some]), pa.array(lengths[some]), pa.array([value(reader.tokens(k)) for k in some.tolist()], kind)],
                        ["doc_id", "start", "n_tokens", last])
                reader.close()

    files = manifest.select("path", "start", "shard")
    return files.repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(work, schema)


def token_file_folder(docs: DataFrame) -> str:
    """A fresh folder for token files below the shared folder."""
    return f"{scratch_dir(docs.sparkSession)}/tokens"
