"""Operator 11: periodic runs of words, found with longest-common-extension queries on a difference-cover sample.

A run of period q and length 4 * q or more holds, at a grid point i within its first q words, words that agree with those q places on for
2 * q + 1 places at least. So for each period only the grid points 0, q, 2 * q, ... are asked for the longest common extension of i and
i + q, which makes n * ln(n) questions for n words; the run's left end follows from a binary search with further questions.

The extension index sorts only the suffixes that start at places whose number modulo 31 is in a difference cover (6 of 31): windows of 31
words first, then ranks of doubled length, of those groups only that are still tied. A question compares at most 30 words until both places
are in the sample, then takes the minimum of the common prefixes of sorted neighbours between the two, from a sparse table. Texts of a slice are
indexed together, each closed by a word of its own.

Defined results: a null or empty text, or one of white space, has no words and no run; a text of any length is searched whole, in a slice of its own
beyond ``SLICE_BYTES`` (about 170 bytes of memory per word); repeated rows and null ids each come back; an empty table gives no rows; other
columns, whatever their names, are left behind. Work is per document: no shuffle, nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, mix, only, text_slices

# A perfect difference set, every difference modulo 31 occurs among its members.
COVER, MODULUS = (1, 5, 11, 24, 25, 27), 31
SLICE_BYTES = 1 << 20
PAIRS = 1 << 20
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _shifts() -> np.ndarray:
    """Least shift that takes both residues into the cover."""
    inside = np.isin(np.arange(MODULUS), COVER)
    i, j, s = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    return (inside[(i + s) % MODULUS] & inside[(j + s) % MODULUS]).argmax(axis=2).astype(np.int32)


SHIFT = _shifts()
_SLOT = np.full(MODULUS, -1)
_SLOT[list(COVER)] = np.arange(len(COVER))


class Extensions:
    """Longest common extensions of places in ``ids``, in which no two equal stretches may reach the end."""

    def __init__(self, ids: np.ndarray):
        top = int(ids.max(initial=0)) + 1
        self.ids = np.concatenate((ids, np.arange(top, top + 2 * MODULUS))).astype(np.int64)
        blocks = -(-len(ids) // MODULUS)
        place = (np.arange(blocks)[:, None] * MODULUS + np.array(COVER)).ravel()
        self.place = place[:np.searchsorted(place, len(ids))]
        self._sort(top + 2 * MODULUS)
        self._neighbours()

    def _sort(self, top: int) -> None:
        m, per_key = len(self.place), max(1, 63 // int(top).bit_length())
        keys = []
        for at in range(0, MODULUS, per_key):
            key = np.zeros(m, np.int64)
            for k in range(at, min(at + per_key, MODULUS)):
                key = key * top + self.ids[self.place + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, bool)
        new[:1] = True
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        head = np.maximum.accumulate(np.where(new, np.arange(m), 0))
        rank = np.empty(m, np.int64)
        rank[order] = head
        self.levels, step = [rank], len(COVER)
        while not new.all():
            tied = ~new
            tied[:-1] |= ~new[1:]
            at = np.flatnonzero(tied)
            group, member = head[at], order[at]
            follow = self._rank(rank, member + step)
            by = np.lexsort((follow, group))
            group, follow = group[by], follow[by]
            order[at] = member[by]
            cut = np.ones(len(at), bool)
            cut[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
            new[at] = cut
            head = np.maximum.accumulate(np.where(new, np.arange(m), 0))
            rank = rank.copy()
            rank[order[at]] = head[at]
            self.levels.append(rank)
            step *= 2
        self.order, self.rank = order, rank

    @staticmethod
    def _rank(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of samples; behind the last one all differ."""
        return np.where(at < len(rank), rank[np.minimum(at, len(rank) - 1)], -1 - at)

    def _neighbours(self) -> None:
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        common = np.zeros(len(self.order), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[k], len(COVER) << k
            same = self._rank(rank, a) == self._rank(rank, b)
            a[same] += step
            b[same] += step
            common[1:][same] += MODULUS << k
        if len(a):
            start = self.place[self.order]
            common[1:] += self._compare(start[:-1] + common[1:], start[1:] + common[1:], np.full(len(a), MODULUS))
        self.table = [common]
        while 2 << (len(self.table) - 1) <= len(common):
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))
        # rows of one length, so that one gather serves all lengths
        self.table = np.stack([np.pad(t, (0, len(common) - len(t))) for t in self.table])

    def _compare(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Number of equal words from ``i`` and ``j`` on, up to ``limit``."""
        got, left = np.zeros(len(i), np.int64), np.flatnonzero(limit > 0)
        while len(left):
            n = got[left]
            left = left[self.ids[i[left] + n] == self.ids[j[left] + n]]
            got[left] += 1
            left = left[got[left] < limit[left]]
        return got

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of each pair of different places."""
        shift = SHIFT[i % MODULUS, j % MODULUS].astype(np.int64)
        got = self._compare(i, j, shift)
        far = np.flatnonzero(got == shift)
        if len(far):
            ranks = [self.rank[self._sample(p[far] + shift[far])] for p in (i, j)]
            low, high = np.minimum(*ranks) + 1, np.maximum(*ranks)
            k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
            got[far] += np.minimum(self.table[k, low], self.table[k, high - (1 << k) + 1])
        return got

    @staticmethod
    def _sample(place: np.ndarray) -> np.ndarray:
        return place // MODULUS * len(COVER) + _SLOT[place % MODULUS]


def word_numbers(words: Words) -> np.ndarray:
    """A number per different word of a slice. Hashes of two lanes must agree; should they not, the words themselves decide."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    h, check = words.hashes(0), words.hashes(1)
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    if (check[first][ids] != check).any():
        known: dict[bytes, int] = {}
        raw = words.data.tobytes()
        return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(words.start, words.end)], np.int64)
    return ids.astype(np.int64)


def find_runs(ids: np.ndarray, sizes: np.ndarray, least: int = 6, powers: int = 4) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of ``least`` words and ``powers`` periods or more, in that order.

    ``ids`` are the words of all texts, one after the other, ``sizes`` the number of words of each. ``powers`` is 4 at least.
    """
    none = np.zeros((0, 4), np.int64)
    if len(ids) == 0 or sizes.max() < least:
        return none
    # each text is closed by a word of its own
    text = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes + 1) - sizes - 1
    joined = np.empty(len(ids) + len(sizes), np.int64)
    joined[np.arange(len(ids)) + text] = ids
    joined[begin + sizes] = int(ids.max()) + 1 + np.arange(len(sizes))
    padded = np.concatenate((joined, np.arange(2) - 2)).astype(np.uint64)
    three = mix(mix(mix(padded[:-2]) + padded[1:-1]) + padded[2:])

    able = np.where(sizes >= least, sizes // powers, 0)
    which = np.repeat(np.arange(len(sizes)), able)
    period = np.arange(len(which)) - np.repeat(np.cumsum(able) - able, able) + 1
    points = (sizes[which] - 3 * period - 1) // period + 1
    points = np.maximum(points, 0)
    total = np.cumsum(points)
    extend, found, at = None, [], 0
    while at < len(which):
        stop = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")), at + 1)
        n = points[at:stop]
        combo = np.repeat(np.arange(at, stop), n)
        q = period[combo]
        grid = np.arange(len(combo)) - np.repeat(np.cumsum(n) - n, n)
        i = begin[which[combo]] + grid * q
        hit = np.flatnonzero(three[i] == three[i + q])
        at = stop
        if not len(hit):
            continue
        extend = extend or Extensions(joined)
        i, q, combo, grid = i[hit], q[hit], combo[hit], grid[hit]
        ahead = extend(i, i + q)
        good = ahead >= 2 * q + 1
        i, q, combo, grid, ahead = (x[good] for x in (i, q, combo, grid, ahead))
        first = np.ones(len(i), bool)  # the grid point before is not in the same run
        first[1:] = (combo[1:] != combo[:-1]) | (grid[1:] != grid[:-1] + 1)
        i, q, combo, ahead = (x[first] for x in (i, q, combo, ahead))
        back = _back(extend, i, q, np.minimum(q - 1, i - begin[which[combo]]))
        start, size = i - back, back + ahead + q
        long = size >= np.maximum(least, powers * q)
        t = which[combo][long]
        found.append(np.stack((t, start[long] - begin[t], size[long], q[long]), 1))
    if not found:
        return none
    rows = np.concatenate(found)
    # a stretch found with a multiple of its period keeps the smallest
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[keep]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _back(extend: Extensions, i: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words before ``i`` agree with those ``q`` places on, ``most`` at most."""
    low, high = np.zeros(len(i), np.int64), most.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) // 2
        start = i[open_] - mid
        ok = extend(start, start + q[open_]) >= mid
        low[open_[ok]] = mid[ok]
        high[open_[~ok]] = mid[~ok] - 1


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, int], tuple[int, int] | None] | None = None, least: int = 6, powers: int = 4) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period), collapsed (text in which of every run only the first period is left) per row.

    ``rewrite`` may say for an id and a number of words from which word on (first number) the text repeats that many words (second).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, SLICE_BYTES):
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            words = Words(texts)
            sizes = words.n_words.astype(np.int64)
            ids, source = word_numbers(words), {}
            for d, (doc_id, n) in enumerate(zip(doc_ids, sizes.tolist())):
                turned = rewrite(doc_id, n) if rewrite and n else None
                if turned:
                    a, p = turned
                    i = np.arange(n)
                    source[d] = np.where(i < a, i, a + (i - a) % p)
                    lo = words.first[d]
                    ids[lo:lo + n] = ids[lo + source[d]]
            rows = find_runs(ids, sizes, least, powers)
            bounds = np.searchsorted(rows[:, 0], np.arange(len(sizes) + 1))
            collapsed = []
            for d in range(len(sizes)):
                parts = texts[d].as_buffer().to_pybytes().split() if sizes[d] else []
                mine = rows[bounds[d]:bounds[d + 1]]
                at = source.get(d)
                if len(mine):
                    change = np.zeros(len(parts) + 1, np.int64)
                    np.add.at(change, mine[:, 1] + mine[:, 3], 1)
                    np.add.at(change, mine[:, 1] + mine[:, 2], -1)
                    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                    at = kept if at is None else at[kept]
                collapsed.append(b" ".join(parts if at is None else [parts[k] for k in at.tolist()]))
            spans = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "runs": runs, "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())})

    return only(docs).mapInArrow(scan, f"doc_id bigint, runs {RUN}, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the one of the greatest exact length / period (ties: smallest start, then period), and digests of runs and text."""
    more = "r.length * b.period > b.length * r.period"
    best = F.expr(f"aggregate(runs, element_at(runs, 1), (b, r) -> IF({more}, r, b))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    done = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("b"),
                        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return done.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
