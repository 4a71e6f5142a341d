"""Operator 10: line deduplication by winnowing over line hashes.

Winnowing windows are counted in words: a window is the shortest run of lines with at least ``min_words`` words, once from each line
onwards and once from each line backwards. The line with the smallest hash in a window is its fingerprint, so two documents that share a
run of that many words share a fingerprint, without exception. Fingerprints that occur at one place only drop out first. The
windows of the others are compared by 128-bit hashes of all their lines, not extended line by line or word by word; every later
occurrence of a window is deleted. The windows of both directions together cover exactly the repeated runs of ``min_words`` words or
more: a line goes if it lies in some run of that size which an earlier document, or an earlier part of the same one, has as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U, Words, _powers, materialize, mix, span_hashes, text_slices

MIN_WORDS = 50
OCCURRENCE = "fp long, doc_id long, key long, a int, b int, place int, h1 long, h2 long"


class Lines:
    """Lines with at least one word of a slice of texts, and the winnowing windows over them."""

    def __init__(self, texts: pa.Array, min_words: int):
        words = Words(texts)
        data, offsets = words.data, words.offsets
        inner = np.flatnonzero(data == 10)
        start = np.unique(np.concatenate((offsets[:-1], inner + 1)))
        start = start[start < len(data)]
        doc = np.searchsorted(offsets, start, side="right") - 1
        # a line ends before the next line break or with its document
        end = np.append(inner, len(data))[np.searchsorted(inner, start)] if len(start) else start
        end = np.minimum(end, offsets[doc + 1])
        # a line break that ends a document opens an empty line of that document, not one of the next; it has no word
        number = np.arange(len(start)) - np.searchsorted(doc, doc)
        n = np.searchsorted(words.start, end) - np.searchsorted(words.start, start)
        has = n > 0
        self.doc, self.number, self.n = doc[has], number[has], n[has]
        self.h = [span_hashes(data, start[has], end[has], lane) for lane in (0, 1)]
        self.min_words = min_words

    def windows(self) -> dict[str, np.ndarray]:
        """Document, first and last line, fingerprint with its line, and both halves of the content hash of each window."""
        m = len(self.doc)
        if not m:
            return {k: np.zeros(0, np.int64) for k in ("doc", "a", "b", "fp", "place", "h1", "h2")}
        upto = np.concatenate(([0], np.cumsum(self.n)))
        every = np.arange(m)
        forward = np.searchsorted(upto, upto[:-1] + self.min_words) - 1
        backward = np.searchsorted(upto, upto[1:] - self.min_words, side="right") - 1
        a, b = np.concatenate((every, backward)), np.concatenate((forward, every))
        ok = (a >= 0) & (b < m)
        a, b = a[ok], b[ok]
        same = self.doc[a] == self.doc[b]
        both = np.unique(np.stack((a[same], b[same]), 1), axis=0)
        a, b = both[:, 0], both[:, 1]
        order = np.argsort(self.h[0], kind="stable")
        rank = np.empty(m + 1, np.int64)
        rank[order], rank[m] = np.arange(m), m
        bounds = np.stack((a, b + 1), 1).ravel()
        place = order[np.minimum.reduceat(rank, bounds)[::2]] if len(a) else a
        out = {"doc": self.doc[a], "a": self.number[a], "b": self.number[b], "fp": self.h[0][place], "place": self.number[place]}
        for lane in (0, 1):
            total = np.zeros(m + 1, np.uint64)
            np.cumsum(self.h[lane] * _powers(lane, m), out=total[1:])
            out[f"h{lane + 1}"] = mix((total[b + 1] - total[a]) * _powers(lane, m + 1, inverse=True)[a] + (b - a).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        return out


def occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """All winnowing windows of rows (doc_id, key, text)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            w = Lines(b.column("text"), min_words).windows()
            take = pa.array(w["doc"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(w["fp"].view(np.int64)), b.column("doc_id").take(take), b.column("key").take(take), pa.array(w["a"].astype(np.int32)), pa.array(w["b"].astype(np.int32)),
                 pa.array(w["place"].astype(np.int32)), pa.array(w["h1"].view(np.int64)), pa.array(w["h2"].view(np.int64))],
                ["fp", "doc_id", "key", "a", "b", "place", "h1", "h2"])

    return docs.mapInArrow(work, OCCURRENCE)


def later_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, key, gone): numbers of the lines to delete in rows (doc_id, key, text); rows that lose nothing are absent."""
    seen = materialize(occurrences(docs, min_words))
    spot = F.struct("doc_id", "key", "place")
    shared = materialize(seen.groupBy("fp").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).where(F.col("lo") != F.col("hi")).select("fp"))
    matched = materialize(seen.join(shared, "fp"))
    where = F.struct("doc_id", "key", "a", "b")
    first = materialize(matched.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.max(where).alias("last")).where(F.col("first") != F.col("last")).drop("last"))
    f = F.col("first")
    later = (F.struct("doc_id", "key") > F.struct(f["doc_id"], f["key"])) | ((F.col("doc_id") == f["doc_id"]) & (F.col("key") == f["key"]) & (F.col("a") > f["b"]))
    lines = matched.join(first, ["h1", "h2"]).where(later).select("doc_id", "key", F.explode(F.sequence("a", "b")).alias("line"))
    return lines.groupBy("doc_id", "key").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` as (row), the text without later repeated runs, n_lines and n_removed.

    Documents are ordered by id, rows with equal ids by a hash of their text. The first occurrence of a run stays; an occurrence in the
    same document counts as later only if it begins after the first has ended. Blank lines inside a deleted run go with it. A null text
    stays null with 0 lines, an empty one has one line; rows without id neither lose lines nor make others lose any; exact repeated rows
    (same id, same text) are one document and get the same result; texts of any length are compared whole; an empty table gives no rows. Columns of ``docs`` may have any names:
    they travel inside ``row``.
    """
    source = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    keyed = source.withColumn("key", F.xxhash64("text"))
    gone = later_lines(keyed.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "key", "text"), min_words)
    joined = keyed.join(gone, ["doc_id", "key"], "left")
    parted = joined.select("row", "doc_id", "text", "gone", F.explode(F.array(F.split("text", "\n", -1))).alias("lines"))
    n = F.coalesce(F.size("lines"), F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda i: F.element_at("lines", i + 1)), "\n")
    return parted.select(
        "row", "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.greatest(n, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
