"""Operator 13: exact ranked lexical search with ball trees over sparse document vectors.

A document's vector has one integer per term, the term's weight times its saturated frequency; an item's vector holds how often it has each
term, so the score is their inner product. Documents are taken in blocks of ``BLOCK`` rows wherever they lie. Each block becomes a ball tree: a
node keeps the centroid of its documents and the largest distance from it. No document of a node scores more than

    <item, centroid> + |item| * radius

computed in doubles and widened by more than the sums can have lost in rounding. An item visits the nodes of a tree best first, drops those whose
bound is under its tenth best score so far, and scores the documents of the leaves that remain in 64-bit integers; so the ranking is exact. A
task keeps the best of each item over all its blocks; those of all tasks are ranked at the end.

Items are taken in blocks of about ``ITEM_BYTES`` bytes of text, the only part of a table that reaches the driver at once; each block costs one pass over the
documents, which leaves a table of the block's terms in each document (``bags``), from which the frequencies in the corpus, N and L follow.

Defined results: null or empty texts, on either side, have no terms; an item without terms or hits has no rows; texts of any length are read whole, in
pieces that end between words; equal scores rank by doc_id, null ids last; repeated documents each rank; rows of items that agree in id and text are
one item, such with one id and different texts are ranked apart; empty tables give no rows; other columns, whatever their names, are left behind.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, text_slices

ITEM_BYTES = 256 << 10
BLOCK, LEAF = 4096, 32
PIECE = 1 << 20
SATURATION, LENGTH_SHARE = 8, 75
# Letters and digits of ASCII, and every byte of other characters, make up terms; only A-Z is lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or bytes([b]).isalnum() else 32 for b in range(256))
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
HIT = "item int, doc_id bigint, score bigint"


def count_terms(text: bytes) -> tuple[int, Counter]:
    """Number of terms of a text, and how often it has each."""
    if len(text) <= PIECE:
        terms = text.translate(_FOLD).split()
        return len(terms), Counter(terms)
    n, counts, at = 0, Counter(), 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        stop = gap.start() if gap else len(text)
        terms = text[at:stop].translate(_FOLD).split()
        counts.update(terms)
        n, at = n + len(terms), stop
    return n, counts


def _cells(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (s.as_buffer().to_pybytes() for s in batch.column("text"))


def item_terms(items: DataFrame) -> DataFrame:
    """``items`` (item_id, text) with ``terms``, ``counts`` and ``size``, the bytes of the text; items without terms go."""

    def scan(batches):
        for batch in text_slices(batches):
            bags = [count_terms(t)[1] for t in _cells(batch)]
            yield pa.record_batch({
                "item_id": batch.column("item_id"), "terms": pa.array([list(b) for b in bags], pa.list_(pa.binary())),
                "counts": pa.array([list(b.values()) for b in bags], pa.list_(pa.int64())), "size": pa.array([sum(map(len, b)) for b in bags], pa.int64())})

    return items.mapInArrow(scan, "item_id bigint, terms array<binary>, counts array<bigint>, size bigint").where("size > 0")


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms and counts (those of the vocabulary, as 32-bit numbers) per document with a term."""

    def scan(batches):
        for batch in text_slices(batches):
            sizes, terms, counts = [], [], []
            for text in _cells(batch):
                n, bag = count_terms(text)
                own = [(vocabulary[t], c) for t, c in bag.items() if t in vocabulary]
                sizes.append(n)
                both = np.array(sorted(own), np.int32).reshape(-1, 2)
                terms.append(both[:, 0].tobytes())
                counts.append(both[:, 1].tobytes())
            out = pa.record_batch({"doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()), "terms": pa.array(terms, pa.binary()), "counts": pa.array(counts, pa.binary())})
            yield out.filter(pa.compute.greater(out.column("n"), 0))

    return docs.mapInArrow(scan, "doc_id bigint, n bigint, terms binary, counts binary")


def document_frequencies(bag_table: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of the ``size`` terms of a vocabulary is: summed in each task, then by term."""

    def scan(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for cell in batch.column("terms"):
                total[np.frombuffer(cell.as_buffer(), np.int32)] += 1
        held = np.flatnonzero(total)
        yield pa.record_batch({"term": pa.array(held, pa.int32()), "n": pa.array(total[held], pa.int64())})

    out = np.zeros(size, np.int64)
    for term, n in bag_table.select("terms").mapInArrow(scan, "term int, n bigint").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


class Rows:
    """Sparse rows of integers: row k has ``term`` and ``value`` between ``ptr[k]`` and ``ptr[k + 1]``, at least one each."""

    def __init__(self, ptr: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.ptr, self.term, self.value = ptr, term, value

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def dot(self, dense: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Product of the rows from ``lo`` to ``hi`` with a dense vector, in the latter's type."""
        hi = len(self) if hi is None else hi
        a, b = self.ptr[lo], self.ptr[hi]
        return np.add.reduceat(self.value[a:b].astype(dense.dtype, copy=False) * dense[self.term[a:b]], self.ptr[lo:hi] - a)

    def take(self, lo: int, hi: int, order: np.ndarray) -> None:
        """Put the rows from ``lo`` to ``hi`` in another order, in place."""
        size = np.diff(self.ptr[lo:hi + 1])[order]
        start = self.ptr[lo:hi][order]
        a, b = self.ptr[lo], self.ptr[hi]
        ends = np.cumsum(size)
        at = np.arange(b - a) - np.repeat(ends - size, size) + np.repeat(start, size)
        self.term[a:b], self.value[a:b] = self.term[at], self.value[at]
        self.ptr[lo + 1:hi + 1] = a + ends


class BallTree:
    """Nodes over ``rows``, which are put into the order of the leaves; ``order`` says where each came from."""

    def __init__(self, rows: Rows, size: int):
        self.rows, self.size, self.order = rows, size, np.arange(len(rows))
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, last row + 1, children (-1: none)
        self.centroids: list[tuple[np.ndarray, np.ndarray]] = []
        self.radii: list[float] = []
        self._build(0, len(rows))

    def _distance(self, lo: int, hi: int, center: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, float]:
        """Squared distances of rows from a dense vector, and how far off they may be."""
        own = float(center @ center)
        slack = 2.0**-48 * (len(center) + 16) * (own + float(squares.max()))
        return np.maximum(squares - 2 * self.rows.dot(center, lo, hi) + own, 0), slack

    def _build(self, lo: int, hi: int) -> int:
        a, b = self.rows.ptr[lo], self.rows.ptr[hi]
        term, local = np.unique(self.rows.term[a:b], return_inverse=True)
        value = self.rows.value[a:b].astype(np.float64)
        mean = np.bincount(local, value, len(term)) / (hi - lo)
        center = np.zeros(self.size)
        center[term] = mean
        squares = np.add.reduceat(value * value, self.rows.ptr[lo:hi] - a)
        far, slack = self._distance(lo, hi, center, squares)
        here = len(self.nodes)
        self.nodes.append((lo, hi, -1, -1))
        self.centroids.append((term, mean))
        self.radii.append(math.sqrt(float(far.max()) + slack))
        if hi - lo > LEAF:
            one, _ = self._distance(lo, hi, self._dense(lo + int(far.argmax())), squares)
            other, _ = self._distance(lo, hi, self._dense(lo + int(one.argmax())), squares)
            middle = (hi - lo) // 2
            order = np.argpartition(one - other, middle)  # halves, also where all rows are copies
            self.order[lo:hi] = self.order[lo:hi][order]
            self.rows.take(lo, hi, order)
            left = self._build(lo, lo + middle)
            self.nodes[here] = (lo, hi, left, self._build(lo + middle, hi))
        return here

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.size)
        a, b = self.rows.ptr[row:row + 2]
        out[self.rows.term[a:b]] = self.rows.value[a:b]
        return out

    def bounds(self, node: int, items: Rows, lengths: np.ndarray) -> np.ndarray:
        """What no document of a node can exceed, for every item."""
        center = np.zeros(self.size)
        term, mean = self.centroids[node]
        center[term] = mean
        return (items.dot(center) + lengths * self.radii[node]) * (1 + 2.0**-40) + 1


class Best:
    """The ``k`` highest scores of each item so far; equal ones by id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64) for _ in range(items)]
        self.doc = [np.zeros(0, np.int64) for _ in range(items)]
        self.null = [np.zeros(0, bool) for _ in range(items)]
        self.floor = [1] * items  # lower scores cannot enter

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(x) for x in ((self.score[item], score), (self.doc[item], doc), (self.null[item], null)))
        first = np.lexsort((doc, null, -score))[:self.k]
        self.score[item], self.doc[item], self.null[item] = score[first], doc[first], null[first]
        if len(first) == self.k:
            self.floor[item] = int(self.score[item][-1])

    def batch(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.score)), [len(s) for s in self.score])
        doc, null, score = (np.concatenate(x) if x else np.zeros(0) for x in (self.doc, self.null, self.score))
        return pa.record_batch({"item": pa.array(item, pa.int32()), "doc_id": pa.array(doc, pa.int64(), mask=null.astype(bool)), "score": pa.array(score, pa.int64())})


def search_tree(tree: BallTree, doc: np.ndarray, null: np.ndarray, items: Rows, best: Best) -> int:
    """Let every item search one tree; returns how many documents were scored."""
    lengths = np.sqrt(np.add.reduceat(items.value.astype(np.float64) ** 2, items.ptr[:-1]))
    doc, null, scored = doc[tree.order], null[tree.order], 0
    known: dict[int, np.ndarray] = {}

    def bound(node: int) -> np.ndarray:
        if node not in known:
            known[node] = tree.bounds(node, items, lengths)
        return known[node]

    dense = np.zeros(tree.size, np.int64)
    for item in range(len(items)):
        a, b = items.ptr[item:item + 2]
        dense[items.term[a:b]] = items.value[a:b]
        waiting = [(-bound(0)[item], 0)]
        while waiting:
            limit, node = heapq.heappop(waiting)
            if -limit < best.floor[item]:
                break
            lo, hi, left, right = tree.nodes[node]
            if left < 0:
                score = tree.rows.dot(dense, lo, hi)
                scored += hi - lo
                good = np.flatnonzero(score >= best.floor[item])
                if len(good):
                    best.add(item, score[good], doc[lo:hi][good], null[lo:hi][good])
            else:
                heapq.heappush(waiting, (-bound(left)[item], left))
                heapq.heappush(waiting, (-bound(right)[item], right))
        dense[items.term[a:b]] = 0
    return scored


def _blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Batches put together to tables of ``least`` rows; the last may have fewer."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= least:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, least)
            held, n = whole.slice(least).to_batches(), n - least
    if n:
        yield pa.Table.from_batches(held)


def weigh(block: pa.Table, weights: np.ndarray, documents: int, total: int) -> tuple[Rows, np.ndarray]:
    """Vectors of the rows of a block that have a term of the vocabulary with a weight, and the numbers of these rows."""
    term = np.frombuffer(b"".join(block.column("terms").to_pylist()), np.int32)
    count = np.frombuffer(b"".join(block.column("counts").to_pylist()), np.int32).astype(np.int64)
    size = np.array([len(t.as_buffer()) // 4 for t in block.column("terms")], np.int64)
    longer = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * documents // total for n in block.column("n").to_pylist()], np.int64)
    row = np.repeat(np.arange(len(size)), size)
    value = weights[term] * (1_000_000_000 * count // (1000 * count + SATURATION * longer[row]))
    term, row, value = term[value > 0], row[value > 0], value[value > 0]
    here, at = np.unique(row, return_index=True)
    return Rows(np.append(at, len(row)).astype(np.int64), term.copy(), value), here


def _search_block(docs: DataFrame, chosen: list, k: int) -> DataFrame:
    """item, doc_id, score: the best of each task and item; ``chosen`` has (item_id, terms, counts)."""
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for _, terms, _ in chosen for t in terms}))}
    bag_table = materialize(bags(docs, vocabulary))
    documents, total = bag_table.agg(F.count("*"), F.sum("n")).first()
    frequency = document_frequencies(bag_table, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * f + 1))) for f in frequency.tolist()], np.int64)
    ends = np.cumsum([0] + [len(terms) for _, terms, _ in chosen])
    term = np.array([vocabulary[bytes(t)] for _, terms, _ in chosen for t in terms], np.int32)
    count = np.array([c for _, _, counts in chosen for c in counts], np.int64)

    def scan(batches):
        items, best = Rows(ends, term, count), Best(len(ends) - 1, k)
        for block in _blocks(batches, BLOCK):
            rows, here = weigh(block, weights, documents, total)
            if len(here):
                ids = block.column("doc_id")
                null = ids.is_null().to_numpy()[here]
                search_tree(BallTree(rows, len(weights)), ids.fill_null(0).to_numpy()[here], null, items, best)
        yield best.batch()

    return bag_table.mapInArrow(scan, HIT)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents with a score above 0 for each item."""
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    items = items.select(items["item_id"].cast("bigint").alias("item_id"), items["text"].cast("string").alias("text")).distinct()
    known = materialize(item_terms(items))
    parts = max(1, -(-(known.agg(F.sum("size")).first()[0] or 0) // ITEM_BYTES))
    found = []
    for part in range(parts):
        chosen = known.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(parts)) == part).select("item_id", "terms", "counts").orderBy("item_id", "terms").collect()
        if not chosen:
            continue
        names = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(chosen)], "item int, item_id bigint")
        hits = materialize(_search_block(docs, chosen, k))
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        some = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
        few = hits.withColumn("r", F.row_number().over(some)).where(F.col("r") <= k)
        ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        found.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    while len(found) > 1:
        found = [a.unionByName(b) for a, b in zip(found[::2], found[1::2])] + found[len(found) & ~1:]
    return found[0]


SEARCH_SQL = r"""
WITH dt AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
it AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM it GROUP BY ALL),
len AS (SELECT doc_id, count(*)::BIGINT AS n FROM dt GROUP BY doc_id),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM len),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM dt WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY term, docs),
part AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))) AS part
    FROM tf JOIN len USING (doc_id) JOIN w USING (term), corpus),
total AS (SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM asked JOIN part USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM total WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
