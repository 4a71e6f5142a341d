"""Helpers that several operators share: shared intermediate tables, bounded slices of Arrow text columns, word hashes in numpy."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.io import materialize, scratch_dir

__all__ = ["materialize", "scratch_dir", "table", "only", "text_slices", "hash_words", "mix", "window_hashes", "Words", "total_bytes", "spaces"]

SLICE_BYTES = 2 << 20
KEPT_POWERS = 1 << 19
U = np.uint64
_INVERSE = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every operator reads, under fixed names; other columns, whatever their names, are left behind."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def total_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one number, used to choose how many pieces a job is cut into."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``limit`` bytes of text (a longer text comes alone), null texts as empty ones, text as ``large_string``."""
    for batch in batches:
        text = pc.fill_null(pc.cast(batch.column("text"), pa.large_string()), "")
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", text)
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@functools.cache
def _lane(lane: int) -> tuple[np.ndarray, np.uint64, np.uint64]:
    """Random odd value per byte, and an odd base with its inverse modulo 2**64."""
    rng = np.random.default_rng(97 + lane)
    per_byte = rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
    base = int(rng.integers(2**61, 2**62)) * 2 + 1
    return per_byte, U(base), U(pow(base, -1, 2**64))


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(lane: int, n: int, inverse: bool = False) -> np.ndarray:
    """First ``n`` powers; kept between calls as long as they are of the usual size."""
    have = _POWERS.get((lane, inverse))
    if have is None or len(have) < n:
        base = _lane(lane)[2 if inverse else 1]
        have = np.concatenate(([U(1)], np.cumprod(np.full(n - 1, base, np.uint64)))) if n > 1 else np.ones(1, np.uint64)
        if n <= KEPT_POWERS:
            _POWERS[(lane, inverse)] = have
    return have[:n]


def spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes are the six ASCII white-space characters."""
    return (data == 32) | ((data >= 9) & (data <= 13))


class Words:
    """Words of a slice of texts: byte bounds in ``data``, document number (in the slice) and position in the document."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        """Words are maximal runs of bytes other than ASCII white space; ``lower`` folds A-Z."""
        n_docs = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n_docs + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data = data
        edge = np.zeros(len(data) + 1, bool)  # a document border also parts words
        edge[self.offsets] = True
        space = spaces(data)
        before = np.concatenate(([True], space[:-1])) if len(data) else space
        after = np.concatenate((space[1:], [True])) if len(data) else space
        self.start = np.flatnonzero(~space & (before | edge[:-1]))
        self.end = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        bounds = np.searchsorted(self.doc, np.arange(n_docs + 1))
        self.first, self.n_words = bounds[:-1], np.diff(bounds)
        self.pos = np.arange(len(self.start)) - self.first[self.doc]

    def hashes(self, lane: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, lane)


LONG_SPAN = 1024
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes of all spans at a time; spans over 1024 bytes by one running sum."""
    base = _lane(lane)[1]
    size = end - start
    out = mix(size.astype(np.uint64) * base + U(lane + 1))
    words = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), 0, (1,))
    left, at, rest = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0, None
    while len(left):
        rest = size[left] - at
        out[left] = mix((out[left] ^ (words[start[left] + at] & _MASKS[np.minimum(rest, 8)])) * base)
        at += 8
        left = left[rest > 8]
    far = np.flatnonzero(size > LONG_SPAN)
    if len(far):
        out[far] = _long_hashes(data, start[far], end[far], lane)
    return out


def _long_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
    """Polynomial hash of each span, from one running sum over the bytes."""
    per_byte = _lane(lane)[0]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(per_byte[data] * _powers(lane, len(data)), out=total[1:])
    inverse = _powers(lane, len(data) + 1, inverse=True)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def hash_words(words: Words, lane: int = 0) -> np.ndarray:
    return words.hashes(lane)


def window_hashes(h: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Hash of ``size`` consecutive word hashes, for every position; windows that cross documents are for the caller to leave out."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(lane, len(h)), out=total[1:])
    return mix((total[size:] - total[:-size]) * _powers(lane, n, inverse=True))
