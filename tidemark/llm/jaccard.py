"""Operator 5: exact n-gram Jaccard join in metric space.

Jaccard distance is a metric, so the work is divided by distances to pivots.

1. Documents with equal shingle sets collapse to the one with the smallest id. A table of shingle counts orders all shingles from rare to
   frequent. Single shingles are the first, coarsest pivots: two documents that link share at least l of the rarest n - ceil(t n) + l
   shingles of each, so every document is placed in the regions of exactly these. Placements travel as packed arrays; regions with one
   document vanish, so do documents left in fewer than l regions, and regions of the same documents become one.
2. In each region documents are drawn as pivots, more each round, and every member's distance to them is computed exactly. With the threshold
   as a distance e, the triangle inequality says: of two linked documents either both lie within 3 e of a pivot, or neither within 2 e. The
   members within 3 e of a pivot form its ball, those beyond 2 e of every pivot of their region form the region of the next round; a
   document on a border is in both. No pair that could link is separated, and pivots themselves are finished.
3. Balls around one pivot are one ball, whatever region they were met in. Members linked to the pivot are in one component without a
   test. In balls with several components left, members are held by their differences to the pivot: two of them are as far
   apart as their differences are, so short arrays decide all remaining pairs exactly, block by block and never as rows.

Pivots are minima, members meet pivots in joins that may be split, and a large ball is dealt out in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U, Words, materialize, mix, only, text_slices, total_bytes, window_hashes
from .graph import components

MOST_COUNT_BITS = 25  # the table of counts has at most so many classes, whatever the input; a coarser order costs time only
GAP = 128  # classes between two that are always listed, so that gaps fit a byte
SPARE = 32  # one more placement, and one more region asked for, for so many shingles
BUCKET_BYTES = 8 << 20  # of text, for each bucket of placements
PLACEMENT = np.dtype([("key", "<u4"), ("doc", "<i8")])
MEMBER = np.dtype([("key", "<u4"), ("home", "<u4"), ("doc", "<i8")])  # home: the bucket of the region
NEED = np.dtype([("doc", "<i8"), ("need", "<i8")])  # regions that a document must share
BLOCK = 2048  # members of a ball in a block, if their differences take no more than
BLOCK_BYTES = 16 << 20
BROADCAST_IDS = 500_000  # eight bytes each
INFO = "doc_id long, n long, f1 long, f2 long, slot int, counts binary"


def class_of(values: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` classes, a power of two, a shingle is counted in."""
    return (values >> U(65 - n.bit_length())).astype(np.int64)


class Shingles:
    """Distinct shingle hashes of every document of a slice, ordered by document and hash."""

    def __init__(self, texts: pa.Array, size: int):
        w = Words(texts, lower=True)
        h = w.hashes()
        windows = window_hashes(h, size)
        ok = np.flatnonzero(w.pos[:len(windows)] + size <= w.n_words[w.doc[:len(windows)]])
        doc, value = w.doc[ok], windows[ok]
        for n in range(1, size):  # shorter documents are one shingle
            short = np.flatnonzero(w.n_words == n)
            if len(short):
                doc = np.concatenate((doc, short))
                value = np.concatenate((value, window_hashes(h, n)[w.first[short]]))
        order = np.argsort(value)
        doc, value = doc[order], value[order]
        order = np.argsort(doc.astype(np.int32), kind="stable")
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        self.doc, self.value = doc[new], value[new]
        bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.first, self.n = bounds[:-1], np.diff(bounds)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of each document, modulo 2**64."""
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
        return total[self.first + self.n] - total[self.first]

    def rarest(self, classes: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, shingles): the first ``take`` of each document from rare to frequent."""
        rank = (classes[class_of(self.value, len(classes))].astype(np.uint64) << U(56)) | (self.value >> U(8))
        order = np.argsort(rank, kind="stable")
        order = order[np.argsort(self.doc[order].astype(np.int32), kind="stable")]
        place = np.arange(len(order)) - self.first[self.doc[order]]
        chosen = order[place < take[self.doc[order]]]
        return self.doc[chosen], self.value[chosen]


def describe(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """Per document the size and fingerprint of its set; and, as rows without these, parts of the shingle counts of each task."""
    slots = min(256, 1 << bits)

    def listed(counts: np.ndarray) -> bytes:
        """Gaps between the classes that occur, a byte each, then their counts, 255 at most."""
        some = counts > 0
        some[::GAP] = True
        at = np.flatnonzero(some)
        return np.diff(at, prepend=0).astype(np.uint8).tobytes() + counts[at].tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8)
        for b in text_slices(batches):
            s = Shingles(b.column("text"), size)
            seen, times = np.unique(class_of(s.value, len(counts)), return_counts=True)
            counts[seen] = np.minimum(counts[seen] + times, 255)
            f1, f2 = s.sums(s.value * U(0xD1342543DE82EF95) ^ (s.value >> U(29))), s.sums((s.value ^ (s.value >> U(31))) * U(0xAF251AF3B0F025B5))
            n = len(s.n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s.n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                ["doc_id", "n", "f1", "f2", "slot", "counts"])
        parts = [listed(p) for p in np.split(counts, slots)]
        empty = pa.nulls(slots, pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.array(np.arange(slots, dtype=np.int32)), pa.array(parts, pa.binary())], ["doc_id", "n", "f1", "f2", "slot", "counts"])

    return docs.mapInArrow(work, INFO)


def rarity(info: DataFrame, bits: int) -> np.ndarray:
    """One byte for each of 2**bits hash classes: how often its shingles occur, in coarser steps above 128. The driver gets 32 MB at most."""
    slots = min(256, 1 << bits)
    width = (1 << bits) // slots

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for c in table["counts"]:
            data = c.as_buffer()
            n = len(data) // 2
            at = np.cumsum(np.frombuffer(data, np.uint8, n), dtype=np.int64)
            total[at] += np.frombuffer(data, np.uint8, n, n)
        steps = np.where(total <= 128, total, 128 + 4 * np.log2(np.maximum(total, 1) / 128)).astype(np.uint8)
        return pa.table({"slot": table["slot"].slice(0, 1), "counts": pa.array([steps.tobytes()], pa.binary())})

    added = info.where("slot IS NOT NULL").select("slot", "counts").groupBy("slot").applyInArrow(add, "slot int, counts binary")
    out = np.zeros((slots, width), np.uint8)
    for r in added.toLocalIterator():
        out[r["slot"]] = np.frombuffer(r["counts"], np.uint8)
    return out.ravel()


def starts(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def dealt(rows: np.ndarray, bucket: np.ndarray, name: str = "rows") -> pa.Table:
    """(bucket, rows): the rows of each bucket as one packed array."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    first = starts(bucket)
    ends = np.append(first[1:], len(rows))
    return pa.table({"bucket": pa.array(bucket[first].astype(np.int32)), name: pa.array([rows[i:j].tobytes() for i, j in zip(first, ends)], pa.binary())})


def unpacked(column: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(r.as_buffer(), dtype) for r in column if r.is_valid)])


def home_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    return mix(doc.astype(np.int64).view(np.uint64)) % U(buckets)


def in_company(rows: np.ndarray) -> np.ndarray:
    """The placements of one bucket in regions of several documents, ordered by region and document."""
    rows = rows[np.lexsort((rows["doc"], rows["key"]))]
    key, doc = rows["key"], rows["doc"]
    first = starts(key)
    last = np.append(first[1:], len(rows)) - 1
    return rows[np.repeat(doc[first] != doc[last], last - first + 1)]


def placements(docs: DataFrame, size: int, num: int, den: int, classes: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, rows): every document under each of its rarest shingles."""
    known = docs.sparkSession.sparkContext.broadcast(classes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, at, held = [], [], 0
        for b in text_slices(batches):
            s = Shingles(b.column("text"), size)
            doc, value = s.rarest(known.value, np.where(s.n > 0, s.n - -(-num * s.n // den) + 1 + s.n // SPARE, 0))
            rows = np.empty(len(doc), PLACEMENT)
            rows["key"], rows["doc"] = value & U(0xFFFFFFFF), b.column("doc_id").to_numpy()[doc]
            parts.append(rows)
            at.append(((value >> U(32)) % U(buckets)).astype(np.int32))
            held += len(rows)
            if held > 1 << 18:
                yield from dealt(np.concatenate(parts), np.concatenate(at)).to_batches()
                parts, at, held = [], [], 0
        if held:
            yield from dealt(np.concatenate(parts), np.concatenate(at)).to_batches()

    return docs.mapInArrow(place, "bucket int, rows binary")


def first_regions(docs: DataFrame, reps: DataFrame, size: int, num: int, den: int, classes: np.ndarray, buckets: int) -> DataFrame:
    """(region, doc_id): representatives under their rarest shingles, without those that meet others in too few regions to link.

    Placements go as packed arrays between buckets of regions, which leave out regions of one document, and buckets of documents, which leave
    out documents in too few regions. Two shingles of a document that fall on one key are two placements, so none is counted too low.
    Regions of the same documents are one region, named by a fingerprint of them; should two fingerprints agree, their regions are joined.
    """
    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.empty(len(b), NEED)
            rows["doc"] = b.column("doc_id").to_numpy()
            rows["need"] = 1 + -(-num * b.column("n").to_numpy() // den) // SPARE
            yield from dealt(rows, home_of(rows["doc"], buckets), "needs").to_batches()

    def by_document(table: pa.Table) -> pa.Table:
        kept = in_company(unpacked(table["rows"], PLACEMENT))
        rows = np.empty(len(kept), MEMBER)
        rows["key"], rows["doc"], rows["home"] = kept["key"], kept["doc"], table["bucket"][0].as_py()
        return dealt(rows, home_of(rows["doc"], buckets))

    def by_region(table: pa.Table) -> pa.Table:
        rows, need = unpacked(table["rows"], MEMBER), unpacked(table["needs"], NEED)
        need = need[np.argsort(need["doc"])]
        if not len(need):
            rows = rows[:0]
        at = np.minimum(np.searchsorted(need["doc"], rows["doc"]), len(need) - 1)
        known = need["doc"][at] == rows["doc"]
        count = np.bincount(at[known], minlength=len(need))
        rows = rows[known & (count[at] >= need["need"][at])]
        kept = np.empty(len(rows), PLACEMENT)
        kept["key"], kept["doc"] = rows["key"], rows["doc"]
        return dealt(kept, rows["home"])

    def named(table: pa.Table) -> pa.Table:
        rows = np.unique(in_company(unpacked(table["rows"], PLACEMENT)))  # by key, then document
        key, doc = rows["key"], rows["doc"]
        first = starts(key)
        sums = np.add.reduceat(mix(doc.view(np.uint64) + U(1)), first) if len(rows) else np.zeros(0, np.uint64)
        members = np.empty(len(rows), [("region", "<i8"), ("doc", "<i8")])
        members["region"], members["doc"] = np.repeat(mix(sums).view(np.int64), np.diff(np.append(first, len(rows)))), doc
        members = np.unique(members)
        return pa.table({"region": pa.array(members["region"].copy()), "doc_id": pa.array(members["doc"].copy())})

    wanted = reps.mapInArrow(needs, "bucket int, needs binary")
    placed = placements(docs, size, num, den, classes, buckets)
    for _ in range(2):
        met = placed.groupBy("bucket").applyInArrow(by_document, "bucket int, rows binary")
        placed = met.unionByName(wanted, allowMissingColumns=True).groupBy("bucket").applyInArrow(by_region, "bucket int, rows binary")
    return materialize(placed.groupBy("bucket").applyInArrow(named, "region long, doc_id long").distinct())


def texts_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of these documents; of several texts under one id the smallest. Ids are broadcast if there are few enough."""
    wanted = materialize(ids.distinct())
    few = wanted.count() <= BROADCAST_IDS
    return materialize(rows.join(F.broadcast(wanted) if few else wanted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))


def sets_of(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, shingles) of these documents, shingles as packed sorted hashes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            s = Shingles(b.column("text"), size)
            packed = [s.value[f:f + n].tobytes() for f, n in zip(s.first, s.n)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s.n.astype(np.int64)), pa.array(packed, pa.binary())], ["doc_id", "n", "shingles"])

    return materialize(texts_of(rows, ids).mapInArrow(work, "doc_id long, n long, shingles binary"))


def differences(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(x, q, nx, d, linked, diff) for distinct pairs (x, q): distance, and for those within three times the threshold the shingles that only one of them has."""
    mine = sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("sx"))
    theirs = sets.select(F.col("doc_id").alias("q"), F.col("shingles").alias("sq"))
    # each join has a set on one side that is unique on the key, so a hot pivot can be split
    full = pairs.join(mine, "x").join(theirs, "q").select("x", "q", "sx", "sq")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nx, d, linked, diff = [], [], [], []
            for sx, sq in zip(b.column("sx"), b.column("sq")):
                x, q = np.frombuffer(sx.as_buffer(), np.uint64), np.frombuffer(sq.as_buffer(), np.uint64)
                apart = np.setxor1d(x, q, assume_unique=True)
                both = (len(x) + len(q) - len(apart)) // 2
                union = both + len(apart)
                nx.append(len(x))
                d.append(len(apart) / union)
                linked.append(den * both >= num * union)
                diff.append(apart.tobytes() if d[-1] <= 3 * reach(num, den) else None)
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("q"), pa.array(nx, pa.int64()), pa.array(d, pa.float64()), pa.array(linked, pa.bool_()), pa.array(diff, pa.binary())],
                                             ["x", "q", "nx", "d", "linked", "diff"])

    return materialize(full.mapInArrow(work, "x long, q long, nx long, d double, linked boolean, diff binary"))


def reach(num: int, den: int) -> float:
    return (den - num) / den + 1e-9


def pivots_of(members: DataFrame, round_no: int) -> DataFrame:
    """(region, q): pivots of each region, one in the first round, then up to 4, 16, 64 and so on, drawn by hash classes."""
    draw = F.xxhash64("doc_id", F.lit(round_no))
    drawn = members.groupBy("region", F.pmod(draw, F.lit(1 << (2 * round_no))).alias("lot")).agg(F.min("doc_id").alias("q"))
    return drawn.select("region", "q")


def linked_in_balls(balls: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links between the components that the members of a ball are in, of all links as many as connect them.

    ``balls`` has q, x, nx, component and diff. Each member meets each block of its ball in one task.
    """
    blocks = balls.groupBy("q").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("diff")) / BLOCK_BYTES)).alias("blocks"))
    dealt = balls.join(blocks, "q").withColumn("own", F.pmod(F.xxhash64("x"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("q", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "x", "nx", "component", "diff")

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("x")
        n, comp, home = table["nx"].to_numpy(), table["component"].to_numpy(), table["x"].to_numpy()
        sets = [np.frombuffer(d.as_buffer(), np.uint64) for d in table["diff"]]
        size = np.array([len(d) for d in sets])
        member = np.repeat(np.arange(len(sets)), size)
        _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = times[element] > 1
        member, element = member[common], np.unique(element[common], return_inverse=True)[1]
        order = np.argsort(element, kind="stable")
        member, element = member[order], element[order]
        names, local = np.unique(comp, return_inverse=True)
        label = np.arange(len(names))
        both = np.zeros((len(sets), len(sets)), np.float32)
        for k in range(0, int(element[-1]) + 1 if len(element) else 0, 1024):
            a, b = np.searchsorted(element, (k, k + 1024))
            has = np.zeros((len(sets), 1024), np.float32)
            has[member[a:b], element[a:b] - k] = 1
            both += has @ has.T
        for k in range(len(sets)):  # differences of differences
            apart = size[k] + size - 2 * both[k].astype(np.int64)
            shared = (n[k] + n - apart) // 2
            near = np.unique(local[den * shared >= num * (shared + apart)])
            if len(near) > 1:
                old = np.unique(label[near])
                label[np.isin(label, old)] = old[0]
        moved = names != names[label]
        return pa.table({"a": pa.array(names[label][moved]), "b": pa.array(names[moved])}) if len(home) else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return materialize(met.groupBy("q", "i", "j").applyInArrow(work, "a long, b long"))


def links(members: DataFrame, rows: DataFrame, size: int, num: int, den: int) -> DataFrame | None:
    """(node, component) of everything that links connect, found by joining the regions (region, doc_id) recursively; None if nothing is linked."""
    if members.isEmpty():
        return None
    near = reach(num, den)
    sets = sets_of(rows, members.select("doc_id"), size)
    found: DataFrame | None = None
    balls: DataFrame | None = None
    round_no = 0
    while not members.isEmpty():
        pivots = materialize(pivots_of(members, round_no))
        met = members.join(pivots, "region").withColumnRenamed("doc_id", "x").where("x <> q")
        known = differences(materialize(met.select("x", "q").distinct()), sets, num, den)
        new = known.where("linked").select(F.col("x").alias("a"), F.col("q").alias("b"))
        ball = known.where(F.col("d") <= 3 * near)
        found, balls = (new, ball) if found is None else (found.unionByName(new), balls.unionByName(ball))
        rest = met.join(pivots.select("region", F.col("q").alias("x")), ["region", "x"], "left_anti").join(known.select("x", "q", "d"), ["x", "q"])
        far = rest.groupBy("region", "x").agg(F.min("d").alias("d")).where(F.col("d") > 2 * near).select("region", F.col("x").alias("doc_id"))
        far = materialize(far)
        alone = far.groupBy("region").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("region")
        members, round_no = materialize(far.join(alone, "region")), round_no + 1
    names = components(found)
    placed = balls.select("q", "x", "nx", "diff").join(names.select(F.col("node").alias("x"), "component"), "x", "left").withColumn("component", F.coalesce("component", "x"))
    several = placed.groupBy("q").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("q")
    more = linked_in_balls(placed.join(materialize(several), "q"), num, den)
    return names if more.isEmpty() else components(found.unionByName(more))


def jaccard_groups(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id that links of Jaccard similarity >= num / den lead to.

    Words are parted by ASCII white space with A-Z in lower case; a set holds the distinct shingles of ``size`` words, of a shorter
    document its words as one shingle. A null or empty text has no shingles and links with nothing. A row without id gets its
    size and no component; rows with the same id are one document; very long texts enter whole; exact copies are in one component; an empty table gives no rows;
    further columns are ignored.
    """
    rows = only(docs, id_col, text_col)
    total = total_bytes(rows)
    bits = min(MOST_COUNT_BITS, max(10, (total // 4).bit_length()))
    info = materialize(describe(rows, size, bits))
    described = info.where("slot IS NULL").select("doc_id", "n", "f1", "f2")
    full = described.where("doc_id IS NOT NULL AND n > 0")
    classes = materialize(full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")))
    reps = materialize(classes.groupBy(F.col("rep").alias("doc_id")).agg(F.min("n").alias("n")))
    members = first_regions(rows.where("doc_id IS NOT NULL"), reps, size, num, den, rarity(info, bits), 1 + total // BUCKET_BYTES)
    names = links(members, rows, size, num, den)
    groups = classes.withColumn("component_id", F.col("rep"))
    if names is not None:
        groups = classes.join(names.withColumnRenamed("node", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    out = described.join(groups.select("n", "f1", "f2", "component_id"), ["n", "f1", "f2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
