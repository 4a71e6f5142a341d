"""Operator 1: token counts by heap-and-linked-list byte-pair merging, without producing identifiers."""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunks import ChunkMemo
from .common import only, text_slices

SLICE = 4 << 20
PIECE_ENTRIES = 300_000
# Fixed value: the pattern by which byte-level tokenizers of this family cut text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself where printable, else the next one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class PairMerger:
    """Merges many pieces side by side and counts what is left of each.

    All symbols stand in one doubly linked list (arrays of the next and the previous place), parted between pieces. A heap holds the
    ranks for which pairs wait; the lowest is popped, every pair of that rank is merged, and the pairs that arise are queued under
    their ranks. Pieces do not influence each other and a merged symbol only takes part in later ranks (checked when the file is
    read), so each piece sees exactly its own lowest pair first.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        first = [vocab[s] for s in _byte_symbols()]
        made = {}
        for rank, (a, b) in enumerate(merges):
            if (len(a) > 1 and made.get(a, rank) >= rank) or (len(b) > 1 and made.get(b, rank) >= rank):
                raise ValueError(f"merge {rank} uses a symbol that no earlier merge has made")
            made.setdefault(a + b, rank)
        self.first = np.array(first, np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)

    @classmethod
    def from_file(cls, path: str) -> PairMerger:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        pair = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank_of[at], -1)

    def count(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece: its bytes minus the merges made in it."""
        raw = [p.encode("utf-8") for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        n = int(sizes.sum())
        piece = np.repeat(np.arange(len(raw)), sizes)
        symbol = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        # a place past the end parts the pieces; it never pairs
        same = np.concatenate((piece[1:] == piece[:-1], [False])) if n else np.zeros(0, bool)
        after = np.append(np.where(same, np.arange(1, n + 1), n), n)
        before = np.append(np.concatenate(([n], np.where(same[:-1], np.arange(n - 1), n))) if n else np.zeros(0, np.int64), n)
        symbol = np.append(symbol, -1)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def queue(places: np.ndarray) -> None:
            """Put the pairs that start at these places under their ranks."""
            places = places[after[places] < n]
            if not len(places):
                return
            rank = self.ranks(symbol[places], symbol[after[places]])
            places, rank = places[rank >= 0], rank[rank >= 0]
            if not len(places):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, group in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts) if len(cuts) else [places]):
                if r in waiting:
                    waiting[r].append(group)
                else:
                    waiting[r] = [group]
                    heapq.heappush(heap, r)

        queue(np.arange(n))
        left = sizes.copy()
        while heap:
            rank = heapq.heappop(heap)
            groups = waiting.pop(rank)
            at = np.unique(np.concatenate(groups)) if len(groups) > 1 else groups[0]
            nxt = after[at]
            live = (symbol[at] >= 0) & (nxt < n)
            at, nxt = at[live], nxt[live]
            live = self.ranks(symbol[at], symbol[nxt]) == rank  # else one of the two was merged meanwhile
            at, nxt = at[live], nxt[live]
            if len(at) > 1 and (chained := np.concatenate(([False], nxt[:-1] == at[1:]))).any():
                # equal symbols in a row: the first two merge, then the next two
                run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                take = (np.arange(len(at)) - run) % 2 == 0
                at, nxt = at[take], nxt[take]
            if not len(at):
                continue
            symbol[at], symbol[nxt] = self.merged[rank], -1
            follow = after[at] = after[nxt]
            inner = follow < n
            before[follow[inner]] = at[inner]
            np.subtract.at(left, piece[at], 1)
            back = before[at]
            queue(np.unique(np.concatenate((at, back[back < n]))))
        return left


class Counter:
    """Counts of whole texts. Recurring chunks and pieces are looked up; a special string counts as one token and parts what stands
    around it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.merger = PairMerger.from_file(path)
        self.pieces = regex.compile(PIECES)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marker = os.path.commonprefix(special)
        self.known: dict[str, int] = {}
        self.memo = ChunkMemo(self.of_chunks)

    def of_chunks(self, chunks: list[str]) -> list[int]:
        parts = [self.special.split(c) if self.special and self.marker in c else [c] for c in chunks]
        cut = [[p for part in ps for p in self.pieces.findall(part)] for ps in parts]
        if len(self.known) >= PIECE_ENTRIES:
            self.known.clear()
        new = list(set().union(*cut) - self.known.keys())
        if new:
            self.known.update(zip(new, self.merger.count(new).tolist()))
        counts = [len(ps) - 1 + sum(map(self.known.__getitem__, c)) for ps, c in zip(parts, cut)]
        for p in new:
            if len(p) > 48:
                del self.known[p]
        return counts

    def __call__(self, texts: list[str]) -> list[int]:
        return list(map(sum, self.memo.lookup(texts)))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per worker process, kept between tasks."""
    if path not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, tokens and ``over_limit`` (more than ``limit`` tokens) of every document.

    A narrow map: no shuffle, memory bounded by the memos and one slice of texts. ``tokenizer`` is the path of a byte-level BPE
    vocabulary file that every worker can read. A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows are
    counted each time; an empty table gives no rows; further columns are ignored.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for b in text_slices(batches, SLICE):
            texts = b.column("text").to_pylist()
            tokens = count(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return only(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
