"""Operator 2: removal of repeated passages by difference-cover anchors.

A passage is a window of ``size`` consecutive words. Word positions modulo 7 are covered by the set {0, 1, 3}: for any two positions
there is a shift below 7 that brings both onto the set. So two equal windows always hold an equal anchor - the 7 words from such a
position - at the same place, and only anchors (3 of 7 positions) have to be compared across the corpus; windows are hashed in full only
where an anchor was found in more than one document.

The texts are dealt into chunks of bounded size by a hash of the document id, compressed, and kept on disk like that. Per chunk and hash range the
distinct anchors travel as one packed array; a reducer answers each chunk with those that other chunks have too, whatever their number of
occurrences. The chunk extends them to windows, and the same exchange with 96-bit window hashes brings back the smallest document that
holds each window. A hash that a third of all documents share is one entry per chunk, and no pairs are formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from .common import U, Words, materialize, mix, only, text_slices, total_bytes, window_hashes

PERIOD, COVER = 7, (0, 1, 3)
CHUNK_BYTES = 6 << 20
RANGE_ANCHORS = 2_000_000
ANCHOR_BITS = U((1 << 48) - 1)  # of an anchor's hash travel these; the range it is sent to stands for the others
MESSAGE = "bucket long, chunk long, keys binary, docs binary"


def anchor_size(size: int) -> int:
    """Words of an anchor, so that a window that starts up to PERIOD - 1 words earlier still holds it."""
    return size - PERIOD + 1


def runs_of(order_keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of the rows and where groups of equal rows begin in it."""
    order = np.lexsort(order_keys[::-1])
    differs = np.zeros(len(order), bool)
    for k in order_keys:
        s = k[order]
        differs[1:] |= s[1:] != s[:-1]
    differs[:1] = True
    return order, np.flatnonzero(differs)


class Chunk:
    """Word hashes of the documents of one chunk, as one sequence."""

    def __init__(self, table: pa.Table, size: int):
        self.size = size
        self.ids, self.words, hashes = [], [], []
        for packed in table["docs"].to_pylist():
            for b in text_slices(unpacked(packed)):
                w = Words(b.column("text"))
                self.ids.append(b.column("doc_id").to_numpy(zero_copy_only=False))
                self.words.append(w)
                hashes.append(w.hashes())
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.h = [h, mix(h + U(0x9E3779B97F4A7C15))]
        self.doc_ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        self.n_words = np.concatenate([w.n_words for w in self.words]) if self.words else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n_words)))
        self.doc = np.repeat(np.arange(len(self.doc_ids)), self.n_words)
        self.pos = np.arange(len(self.doc)) - self.first[self.doc]

    def starts(self, length: int) -> np.ndarray:
        """Whether ``length`` words of one document begin at each word."""
        return self.pos + length <= self.n_words[self.doc]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the anchors at cover positions; a document shorter than a window has none."""
        n = anchor_size(self.size)
        ok = self.starts(n) & np.isin(self.pos % PERIOD, COVER) & (self.n_words[self.doc] >= self.size)
        at = np.flatnonzero(ok)
        return at, window_hashes(self.h[0], n)[at] if len(at) else np.zeros(0, np.uint64)

    def windows(self, at: np.ndarray) -> np.ndarray:
        """96-bit hashes, as two columns, of the windows that start at these places."""
        out = np.zeros((len(at), 2), np.uint64)
        for lane in (0, 1):
            if len(at):
                out[:, lane] = window_hashes(self.h[lane], self.size, lane)[at]
        out[:, 1] &= U(0xFFFFFFFF)
        return out

    def inside_shared(self, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of these anchors or one that two documents of this chunk have."""
        at, h = self.anchors()
        if not len(at):
            return at
        order, begin = runs_of([h])
        doc = self.doc[at][order]
        here = np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin)
        known = np.zeros(len(at), bool)
        known[order] = np.repeat(here, np.diff(np.append(begin, len(order))))
        known |= np.isin(h & ANCHOR_BITS, shared)
        # a window holds the anchor if it starts up to PERIOD - 1 words before it
        mark = np.zeros(len(self.doc) + 1, np.int64)
        hit = at[known]
        np.add.at(mark, np.maximum(hit - (PERIOD - 1), self.first[self.doc[hit]]), 1)
        np.add.at(mark, hit + 1, -1)
        return np.flatnonzero((np.cumsum(mark[:-1]) > 0) & self.starts(self.size))

    def smallest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows at these places and the smallest document of the chunk that has each."""
        keys = self.windows(at)
        if not len(at):
            return keys, np.zeros(0, np.int64)
        order, begin = runs_of([keys[:, 0], keys[:, 1]])
        return keys[order][begin], np.minimum.reduceat(self.doc_ids[self.doc[at]][order], begin)


def packed_keys(keys: np.ndarray) -> bytes:
    """Anchors (one column) as 6 bytes each, window hashes (two columns) as 12."""
    if keys.ndim == 1:
        return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return np.concatenate((np.ascontiguousarray(keys[:, :1], "<u8").view(np.uint8), np.ascontiguousarray(keys[:, 1].astype("<u4"))[:, None].view(np.uint8)), 1).tobytes()


def plain_keys(packed: bytes, width: int) -> np.ndarray:
    size = (6, 12)[width - 1]
    raw = np.frombuffer(packed, np.uint8).reshape(-1, size)
    out = np.zeros((len(raw), 8 * width), np.uint8)
    out[:, :min(size, 8)] = raw[:, :8]
    out[:, 8:12] = raw[:, 8:]
    return out.view("<u8")


def packed_docs(docs: np.ndarray) -> bytes:
    """Document ids of window hashes: each distinct id once, and its number per hash."""
    ids, number = np.unique(docs, return_inverse=True)
    kind = np.uint16 if len(ids) <= 1 << 16 else np.uint32
    return np.array([len(ids), np.dtype(kind).itemsize], "<i8").tobytes() + ids.astype("<i8").tobytes() + number.astype(kind).tobytes()


def plain_docs(packed: bytes) -> np.ndarray:
    n, width = np.frombuffer(packed, "<i8", 2)
    return np.frombuffer(packed, "<i8", n, 16)[np.frombuffer(packed, f"<u{width}", offset=16 + 8 * n)]


def messages(chunk: int, keys: np.ndarray, docs: np.ndarray | None, buckets: int) -> Iterator[dict]:
    """One row per hash range that has entries; ``keys`` are distinct and the first column decides the range."""
    lead = keys if keys.ndim == 1 else keys[:, 0]
    bucket = ((lead >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        yield {"bucket": int(bucket[part[0]]), "chunk": chunk, "keys": packed_keys(keys[part]), "docs": packed_docs(docs[part]) if docs is not None else b""}


def packed_batch(ids: list, texts: list) -> bytes:
    """Documents as one compressed Arrow stream: what is kept on disk and moved between machines."""
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unpacked(packed: bytes) -> list[pa.RecordBatch]:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)).read_all().to_batches()


def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, docs): the documents of a task's slices by chunk, compressed; flushed when 64 MB of text have gathered."""
    schema = pa.schema([("chunk", pa.int64()), ("docs", pa.binary())])

    def flush(slices: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(slices)
        chunk = table["chunk"].to_numpy()
        order = np.argsort(chunk, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
            some = table.take(pa.array(part))
            yield pa.RecordBatch.from_arrays([pa.array(chunk[part[:1]]), pa.array([packed_batch(some["doc_id"].to_pylist(), some["text"].to_pylist())], pa.binary())], schema=schema)

    held, size = [], 0
    for b in text_slices(batches):
        held.append(b)
        size += b.nbytes
        if size >= 64 << 20:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def arrow(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


MESSAGE_ARROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])


def answers(width: int, with_docs: bool):
    """Reducer of one hash range: tells each chunk which of its keys another chunk has too, and with ``with_docs`` the smallest document."""
    def reduce(table: pa.Table) -> pa.Table:
        chunks = table["chunk"].to_numpy()
        keys = [plain_keys(k, width) for k in table["keys"].to_pylist()]
        sizes = np.array([len(k) for k in keys])
        every, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), sizes)
        order, begin = runs_of([every[:, i] for i in range(width)])
        count = np.diff(np.append(begin, len(order)))
        several = np.repeat(count > 1, count)
        best = np.zeros(len(order), np.int64)
        if with_docs:
            docs = np.concatenate([plain_docs(d) for d in table["docs"].to_pylist()])
            best = np.repeat(np.minimum.reduceat(docs[order], begin), count)
        picked, best = order[several], best[several]
        if with_docs:  # who has the smallest document itself needs no answer
            beaten = docs[picked] > best
            picked, best = picked[beaten], best[beaten]
        to = owner[picked]
        by = np.argsort(to, kind="stable")
        picked, best, to = picked[by], best[by], to[by]
        rows = []
        for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1) if len(to) else []:
            rows.append({"bucket": int(table["bucket"][0].as_py()), "chunk": int(chunks[to[part[0]]]), "keys": packed_keys(every[picked[part]] if width > 1 else every[picked[part], 0]),
                         "docs": packed_docs(best[part]) if with_docs else b""})
        return arrow(rows, MESSAGE_ARROW)
    return reduce


def gathered(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    keys = [plain_keys(k, width) for k in table["keys"].to_pylist()]
    docs = [plain_docs(d) for d in table["docs"].to_pylist() if d]
    return np.concatenate(keys) if keys else np.zeros((0, width), np.uint64), np.concatenate(docs) if docs else np.zeros(0, np.int64)


def chunk_id(table: pa.Table) -> int:
    return table["chunk"][0].as_py()


def remove_repeats(docs: DataFrame, size: int = 13, chunk_bytes: int = CHUNK_BYTES, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept text (NULL without ``keep_text``) and its SHA-256, with every word removed that a repeated window covers.

    A window of ``size`` words is repeated when its words, in order, also start somewhere in a document with a smaller id; all windows are
    judged on the input. Words are parted by ASCII white space and kept words joined by one blank. A null or empty text has no words;
    a row without id comes back whole and nothing is removed because of it; rows with the same id count as one document as to "smaller";
    an empty table gives no rows; further columns are ignored. Memory is bounded by a chunk of texts and by a range of hashes.
    """
    if size < PERIOD + 1:
        raise ValueError(f"windows need at least {PERIOD + 1} words")
    rows = only(docs, id_col, text_col)
    volume = total_bytes(rows)
    chunks, buckets = max(1, -(-volume // chunk_bytes)), max(1, volume // 7 * 3 // 7 // RANGE_ANCHORS + 1)
    nameless = rows.where(F.col("doc_id").isNull())
    numbered = rows.where(F.col("doc_id").isNotNull()).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    dealt = numbered.mapInArrow(deal, "chunk long, docs binary").repartition(int(chunks), "chunk").persist(StorageLevel.DISK_ONLY)

    def send_anchors(table: pa.Table) -> pa.Table:
        return arrow(list(messages(chunk_id(table), np.unique(Chunk(table, size).anchors()[1]), None, buckets)), MESSAGE_ARROW)

    def send_windows(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows:
            return arrow([], MESSAGE_ARROW)
        c = Chunk(table, size)
        keys, smallest = c.smallest(c.inside_shared(gathered(shared, 1)[0][:, 0]))
        return arrow(list(messages(chunk_id(table), keys, smallest, buckets)), MESSAGE_ARROW)

    def rewrite(table: pa.Table, elsewhere: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT.empty_table()
        c = Chunk(table, size)
        keys, smallest = gathered(elsewhere, 2)
        at = np.flatnonzero(c.starts(size))
        h = window_hashes(c.h[0], size)[at] if len(at) else np.zeros(0, np.uint64)
        # only windows whose first hash half occurs twice here or is in an answer can be repeated
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        maybe = np.isin(h, keys[:, 0])
        maybe[order[1:][same]] = maybe[order[:-1][same]] = True
        at = at[maybe]
        own, own_smallest = c.smallest(at)
        every, every_doc = np.concatenate((own, keys)), np.concatenate((own_smallest, smallest))
        return c_result(c, at, every, every_doc, keep_text)

    by_chunk = dealt.groupBy("chunk")
    shared = by_chunk.applyInArrow(send_anchors, MESSAGE).groupBy("bucket").applyInArrow(answers(1, False), MESSAGE)
    sent = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(send_windows, MESSAGE)
    elsewhere = sent.groupBy("bucket").applyInArrow(answers(2, True), MESSAGE)
    named = by_chunk.cogroup(elsewhere.groupBy("chunk")).applyInArrow(rewrite, RESULT_DDL)
    whole = nameless.mapInArrow(untouched, RESULT_DDL)
    done = materialize(named.unionByName(whole))
    dealt.unpersist()
    return done


RESULT_DDL = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])


def c_result(c: Chunk, at: np.ndarray, keys: np.ndarray, docs: np.ndarray, keep_text: bool) -> pa.Table:
    """Rows of a chunk; ``keys`` and ``docs`` name a document for windows, perhaps several times."""
    removed = np.zeros(len(c.doc), bool)
    if len(at):
        order, begin = runs_of([keys[:, 0], keys[:, 1]])
        best = np.repeat(np.minimum.reduceat(docs[order], begin), np.diff(np.append(begin, len(order))))
        sorted_keys = np.ascontiguousarray(keys[order])
        mine = c.windows(at)
        pair = [("a", "<u8"), ("b", "<u8")]
        place = np.searchsorted(sorted_keys[:, 0], mine[:, 0])
        if not (sorted_keys[place, 1] == mine[:, 1]).all():  # equal first halves: look for the whole key
            place = np.searchsorted(sorted_keys.view(pair)[:, 0], np.ascontiguousarray(mine).view(pair)[:, 0])
        hit = at[best[place] < c.doc_ids[c.doc[at]]]
        mark = np.zeros(len(c.doc) + 1, np.int64)
        np.add.at(mark, hit, 1)
        np.add.at(mark, hit + c.size, -1)
        removed = np.cumsum(mark[:-1]) > 0
    n_removed = np.add.reduceat(np.append(removed, False).astype(np.int64), c.first[:-1]) if len(c.doc_ids) else np.zeros(0, np.int64)
    n_removed[c.n_words == 0] = 0
    kept, digest, k = [], [], 0
    for w in c.words:
        data, base = w.data.tobytes(), c.first[k]
        for i in range(len(w.n_words)):
            a, n = int(w.first[i]), int(w.n_words[i])
            text = data[w.offsets[i]:w.offsets[i + 1]]
            words = text.split()
            if n_removed[k + i]:
                gone = removed[base + a:base + a + n]
                words = [words[j] for j in np.flatnonzero(~gone).tolist()]
            left = b" ".join(words)
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode("utf-8") if keep_text else None)
        k += len(w.n_words)
    return pa.Table.from_arrays(
        [pa.array(c.doc_ids, pa.int64()), pa.array(c.n_words, pa.int64()), pa.array(n_removed, pa.int64()),
         pa.array(kept, pa.string()), pa.array(digest, pa.string())], schema=RESULT)


def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without an id: all their words."""
    for b in text_slices(batches):
        words = [t.encode("utf-8").split() for t in b.column("text").to_pylist()]
        kept = [b" ".join(w) for w in words]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(kept), pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array([0] * len(kept), pa.int64()),
             pa.array([x.decode("utf-8") for x in kept]), pa.array([hashlib.sha256(x).hexdigest() for x in kept])], schema=RESULT)
