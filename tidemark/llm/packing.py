"""Operator 9: best-fit packing of token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so everything that decides the packing is a histogram of bounded size. The plan is made
from it alone: large lengths are put in groups of equal cardinality and rounded up to the longest of their group; configurations of the
few rounded sizes are chosen to fill sequences; the actual documents take the places of the rounded ones; what room that leaves, and
new sequences where none is left, go to the small lengths, best fit first. The plan says for each (length, range of ranks) where those
pieces go. Ranks come from counts per task, so no step sees more than one task's rows and nothing is sorted globally.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, only, text_slices
from .encode import encoder

GROUPS = 128
SMALL = 8  # lengths up to capacity / SMALL are small


@dataclass
class Bins:
    """``count`` alike sequences. Each content is (length, first rank, offset): sequence i holds the piece of rank first + i there."""

    count: int
    room: int
    contents: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, n: int) -> tuple[Bins, Bins]:
        return Bins(n, self.room, list(self.contents)), Bins(self.count - n, self.room, [(size, rank + n, at) for size, rank, at in self.contents])

    def add(self, size: int, rank: int, capacity: int) -> None:
        self.contents.append((size, rank, capacity - self.room))
        self.room -= size


def group_sizes(counts: np.ndarray, low: int, groups: int) -> list[tuple[int, int]]:
    """Equal-cardinality groups of the lengths above ``low``, longest first: (rounded size, items). ``counts[x]``: items of length x."""
    lengths = np.arange(len(counts) - 1, low, -1)
    upto = np.cumsum(counts[lengths])
    total = int(upto[-1]) if len(upto) else 0
    out, done = [], 0
    for g in range(1, min(groups, total) + 1):
        end = total * g // min(groups, total)
        out.append((int(lengths[np.searchsorted(upto, done, side="right")]), end - done))
        done = end
    return out


def best_configuration(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """The largest remaining size together with those others that fill the sequence best; {group: how many}."""
    first = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[first]
    reach = [1]  # bit t: total t can be made of the groups so far
    for i, size in enumerate(sizes):
        bits = more = reach[-1]
        for _ in range(min(left[i] - (i == first), room // size)):
            more <<= size
            bits |= more
        reach.append(bits & ((1 << (room + 1)) - 1))
    total = reach[-1].bit_length() - 1
    chosen = {first: 1}
    for i in range(len(sizes) - 1, -1, -1):
        n = 0
        while not reach[i] >> total & 1:
            total -= sizes[i]
            n += 1
        if n:
            chosen[i] = chosen.get(i, 0) + n
    return chosen


def configurations(groups: list[tuple[int, int]], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, configuration) until every rounded item is used."""
    sizes, left, out = [g[0] for g in groups], [g[1] for g in groups], []
    while any(left):
        use = best_configuration(sizes, left, capacity)
        times = min(left[i] // n for i, n in use.items())
        for i, n in use.items():
            left[i] -= times * n
        out.append((times, use))
    return out


def pack_histogram(counts: np.ndarray, capacity: int, groups: int = GROUPS, small: int = SMALL) -> list[Bins]:
    """All sequences needed for ``counts[x]`` pieces of each length x <= capacity."""
    low = capacity // small
    bins: list[Bins] = []
    if counts[capacity]:
        bins.append(Bins(int(counts[capacity]), 0, [(capacity, 0, 0)]))
    large = counts.copy()
    large[capacity] = 0
    grouped = group_sizes(large, low, groups)
    order = np.arange(capacity, low, -1)
    upto = np.concatenate(([0], np.cumsum(large[order])))  # place in the descending order at which each length begins
    cursor = np.concatenate(([0], np.cumsum([n for _, n in grouped]))).astype(np.int64)
    rooms: list[list[Bins]] = [[] for _ in range(capacity + 1)]
    for times, use in configurations(grouped, capacity):
        slots = []
        for g, n in use.items():
            for _ in range(n):
                slots.append(int(cursor[g]))
                cursor[g] += times
        # actual lengths are constant between the places where one of the slots moves on to the next length
        cuts = {0, times}
        for s in slots:
            inside = upto[np.searchsorted(upto, s, side="right"):np.searchsorted(upto, s + times, side="left")]
            cuts.update((inside - s).tolist())
        edges = sorted(cuts)
        for a, b in zip(edges, edges[1:]):
            alike = Bins(b - a, capacity)
            for s in slots:
                k = int(np.searchsorted(upto, s + a, side="right")) - 1
                alike.add(int(order[k]), int(s + a - upto[k]), capacity)
            rooms[alike.room].append(alike)
    for size in range(low, 0, -1):
        left, rank, room = int(counts[size]), 0, size
        while left:
            while room <= capacity and not rooms[room]:
                room += 1
            if room > capacity:
                per = min(capacity // size, left)
                fresh = Bins(left // per, capacity)
                for j in range(per):
                    fresh.add(size, rank + j * fresh.count, capacity)
                rank, left = rank + per * fresh.count, left - per * fresh.count
                rooms[fresh.room].append(fresh)
                room = size
                continue
            target = rooms[room].pop()
            n = min(left, target.count)
            if n < target.count:
                target, rest = target.split(n)
                rooms[room].append(rest)
            target.add(size, rank, capacity)
            rooms[target.room].append(target)
            rank, left = rank + n, left - n
            room = min(room, max(size, target.room)) if target.room >= size else room
    return bins + [b for group in rooms for b in group]


@dataclass
class Plan:
    """Rows sorted by (length, first rank): where the pieces of those ranks go."""

    keys: np.ndarray
    first_rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    @classmethod
    def of(cls, bins: list[Bins]) -> Plan:
        rows, base = [], 0
        for b in bins:
            rows += [(size, rank, base, at) for size, rank, at in b.contents]
            base += b.count
        data = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return cls(data[:, 0] << 48 | data[:, 1], data[:, 1], data[:, 2], data[:, 3], base)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.keys, length << 48 | rank, side="right") - 1
        return self.sequence[row] + rank - self.first_rank[row], self.offset[row]


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of every document with the task that made them and their rank among that task's pieces of equal length."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for b in text_slices(batches):
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist())):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                at, size = 0, (n - 1) % capacity + 1
                piece = 0
                while at < n:
                    rows.append((doc, piece, at, size, zlib.crc32(ids[4 * at:4 * (at + size)])))
                    at, size, piece = at + size, capacity, piece + 1
            cols = list(zip(*rows)) if rows else [[]] * 5
            length = np.array(cols[3], np.int64)
            order = np.argsort(length, kind="stable")
            sized = length[order]
            begin = np.searchsorted(sized, sized)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - begin + seen[sized]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(length), pa.array(cols[4], pa.int64()),
                 pa.array(np.full(len(length), part, np.int32)), pa.array(rank)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, groups: int = GROUPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document is its identifiers and ``end_id``; a
    longer one than the capacity is cut, its first piece taking the remainder. A null or empty text is the end identifier alone; a
    null id stays null; repeated rows are packed each time (and not told apart by id); an empty table gives no rows; further columns
    are ignored. ``tokenizer`` is a path that every worker can read.

    Texts are encoded one time into a table of pieces in the shared folder. The driver gets ``capacity`` counts at most.
    """
    pieces = materialize(cut_pieces(only(docs, id_col, text_col), tokenizer, end_id, capacity))
    per_task = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["length"]] = r["n"]
    plan = Plan.of(pack_histogram(counts, capacity, groups))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = plan.place(length, rank)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
