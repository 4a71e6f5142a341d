"""Operator 8: benchmark decontamination by template canonicalisation.

Words lose the punctuation around them and their case; numbers, names and units become typed placeholders. What is left is the template
of a text, so a benchmark question with other numbers or names has the same template. Windows of the templates are hash-joined; a
bitmap of fixed size, filled from the benchmark's windows, keeps almost all other windows of the documents out of the join. Per document,
item and alignment the values in the placeholders must then map one to one: the same value in the question stays the same value in the
document, and different ones stay different.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import U, Words, materialize, mix, span_hashes, text_slices, window_hashes

WINDOW = 8
LITERALS = 4  # a window with fewer ordinary words says too little
SHARE = 0.5
RUN = 13  # words that say enough when they stand in a document as they are
SHORT, SHORT_LITERALS = 5, 3  # windows between edits; they must cover SHARE of an item and WINDOW words of it
CELL = 8  # edits may move an item's words by up to half of this
BITMAP_BITS = 24
SLICE = 1 << 19  # bytes of text whose template is held at once, which takes about 90 times as much
NUMBER, UNIT, NAME = 1, 2, 3
# Fixed value: measuring words that a changed question may exchange.
UNITS = ("mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg lb lbs oz ounce ounces pound pounds ton tons ml cl l litre litres liter liters gallon gallons "
         "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur gbp percent "
         "degree degrees celsius fahrenheit meter meters metre metres gram grams kilogram kilograms kilometer kilometers kilometre kilometres hz khz mhz w kw watt watts "
         "j kj joule joules n newton newtons v volt volts").split()
ORDINALS = ["st", "nd", "rd", "th"]
FOUND = "h long, doc_id long, pos int, slots array<long>, loose boolean, rule int, n int"
PLACEHOLDER = np.array([0x51, 0x6E756D, 0x756E6974, 0x6E616D65], np.uint64) * U(0x9E3779B97F4A7C15)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the upper-case letters of the second UTF-8 block (À-Þ)."""
    out = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    accented = np.concatenate(([False], data[:-1] == 0xC3)) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97) if len(data) else np.zeros(0, bool)
    out[accented] += 32
    return out


def money(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a currency sign: U+00A2-00A5 or U+20A0-20BF."""
    out = np.zeros(len(data), bool)
    two = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] >= 0xA2) & (data[1:] <= 0xA5))
    three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x82) & (data[2:] >= 0xA0) & (data[2:] <= 0xBF))
    for places, size in ((two, 2), (three, 3)):
        for k in range(size):
            out[places + k] = True
    return out


def split_numbers(data: np.ndarray, digit: np.ndarray, letter: np.ndarray, digits: np.ndarray, figures: np.ndarray, words: tuple) -> tuple:
    """``words`` (lo, hi, start, end, doc) with what is glued to the end of a number as a word of its own; endings of ordinals go."""
    lo, hi, start, end, doc = words
    letters, figure = np.append(np.flatnonzero(letter), len(data)), np.flatnonzero(digit)
    if not len(figure):
        return words
    cut = letters[np.searchsorted(letters, lo)]
    last = figure[np.maximum(np.searchsorted(figure, cut) - 1, 0)] + 1
    here = np.minimum(cut, hi)
    split = digit[lo] & (cut < hi) & (digits[hi] == digits[here]) & (figures[last] - figures[lo] == last - lo) if len(lo) else np.zeros(0, bool)
    ordinal = np.zeros(len(lo), bool)
    ordinal[split] = (last[split] == cut[split]) & np.isin(span_hashes(data, cut[split], hi[split]), ORDINAL_HASHES)
    count = np.where(split & ~ordinal, 2, 1)
    tail = np.concatenate((np.zeros(1, bool), np.repeat(np.arange(len(lo)), count)[1:] == np.repeat(np.arange(len(lo)), count)[:-1])) if len(lo) else split
    lo, hi, start, end, doc, cut, last, split = (np.repeat(x, count) for x in (lo, hi, start, end, doc, cut, last, split))
    head = split & ~tail
    return np.where(tail, cut, lo), np.where(head, last, hi), np.where(tail, cut, start), np.where(head & np.append(tail[1:], False), last, end), doc


class Template:
    """Template tokens of a slice of texts: document, hash, kind (0 for an ordinary word) and hash of the value."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        data = words.data
        digit = (data >= 48) & (data <= 57)
        letter = (((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)) & ~money(data)
        solid = np.flatnonzero(digit | letter)
        low, high = np.searchsorted(solid, words.start), np.searchsorted(solid, words.end)
        some = high > low
        lo, hi = solid[low[some]], solid[high[some] - 1] + 1
        digits, figures = np.concatenate(([0], np.cumsum(digit))), np.concatenate(([0], np.cumsum(digit | np.isin(data, np.frombuffer(b".,:/-", np.uint8)))))
        lo, hi, start, end, self.doc = split_numbers(fold(data), digit, letter, digits, figures, (lo, hi, words.start[some], words.end[some], words.doc[some]))
        self.value = span_hashes(fold(data), lo, hi)
        number = (digits[hi] > digits[lo]) & (figures[hi] - figures[lo] == hi - lo)
        unit = np.isin(self.value, UNIT_HASHES)
        # a name begins with a capital and goes on in lower case; what opens a sentence or a line may be one, and is looked up both ways
        nxt = np.minimum(lo + 1, len(data) - 1)
        lower = (data[nxt] >= 97) & (data[nxt] <= 122) | (data[nxt] >= 128)
        capital = (data[lo] >= 65) & (data[lo] <= 90) & (hi - lo > 1) & lower
        stops = np.isin(data[end - 1], np.frombuffer(b".!?:\"", np.uint8))
        breaks = np.concatenate(([0], np.cumsum(data == 10)))
        opens = np.ones(len(lo), bool)
        opens[1:] = (self.doc[1:] != self.doc[:-1]) | stops[:-1] | (breaks[start[1:]] > breaks[end[:-1]])
        after_number = np.concatenate(([False], number[:-1] & (self.doc[1:] == self.doc[:-1]))) if len(lo) else number
        self.kind = np.select([number, unit & after_number, capital & ~opens], [NUMBER, UNIT, NAME], 0).astype(np.int8)
        self.loose_kind = np.where((self.kind == 0) & capital, NAME, self.kind)
        self.h, self.loose_h = (np.where(k > 0, PLACEHOLDER[k], self.value) for k in (self.kind, self.loose_kind))
        bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.first, self.n = bounds[:-1], np.diff(bounds)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, hashes, whether capitalised openers are read as names) of the windows with enough ordinary words, openers among them."""
        if len(self.h) < WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        h = window_hashes(self.h, WINDOW)
        plain, opener = (np.concatenate(([0], np.cumsum(x))) for x in (self.kind == 0, self.kind != self.loose_kind))
        ok = (self.doc[WINDOW - 1:] == self.doc[:len(h)]) & (plain[WINDOW:] - plain[:-WINDOW] >= LITERALS)
        at, twice = np.flatnonzero(ok), np.flatnonzero(ok & (opener[WINDOW:] > opener[:-WINDOW]))
        return np.concatenate((at, twice)), np.concatenate((h[at], window_hashes(self.loose_h, WINDOW)[twice])), np.arange(len(at) + len(twice)) >= len(at)

    def spans(self, size: int, h: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of all runs of ``size`` words inside a text; ``salt`` keeps the hashes of different rules apart."""
        h = mix(window_hashes(h, size) + U(salt * 1000 + size))
        at = np.flatnonzero(self.doc[size - 1:] == self.doc[:len(h)]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]

    def passages(self, lengths: list[int] | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(rule, size, starts, hashes) besides the windows: rule 1 settles a match alone, 2 counts by the words it covers; size 0 has no slots.

        With ``lengths`` also runs of these sizes, for documents. Without, for a benchmark: whole items that have no window. Under LITERALS
        words only a whole document counts.
        """
        yield 1, 0, *self.spans(RUN, self.value, 1)
        plain = np.concatenate(([0], np.cumsum(self.kind == 0)))
        at, h = self.spans(SHORT, self.loose_h, 2)
        enough = plain[at + SHORT] - plain[at] >= SHORT_LITERALS
        yield 2, SHORT, at[enough], h[enough]
        alone = np.bincount(self.doc[self.windows()[0]], minlength=len(self.n)) == 0
        for size in lengths if lengths is not None else np.unique(self.n[alone & (self.n > 0) & (self.n < RUN)]).tolist():
            for salt, source in ((3, self.value), (4, self.loose_h)):
                at, h = self.spans(size, source, salt)
                ok = np.ones(len(at), bool) if lengths is not None else alone[self.doc[at]]
                if lengths is None or size < LITERALS:
                    ok &= self.n[self.doc[at]] == size
                if salt == 4:
                    ok &= plain[at + size] - plain[at] >= LITERALS
                yield 1, 0 if salt == 3 else size, at[ok], h[ok]

    def slots(self, at: np.ndarray, loose: bool, size: int = WINDOW) -> list[list[int]]:
        """Values in the placeholders of each window, in the order of the text."""
        kind = self.loose_kind if loose else self.kind
        values = self.value.view(np.int64)
        filled = np.concatenate(([0], np.cumsum(kind > 0)))
        slots = np.flatnonzero(kind > 0)
        return [values[slots[filled[i]:filled[i + size]]].tolist() for i in at.tolist()]


def _hashes_of(words: list[str]) -> np.ndarray:
    w = Words(pa.array([" ".join(words)], pa.large_string()))
    return w.hashes()


UNIT_HASHES = _hashes_of(UNITS)
ORDINAL_HASHES = _hashes_of(ORDINALS)


def template_windows(texts: DataFrame, bitmap: np.ndarray | None = None, passages: bool = False, lengths: list[int] | None = None) -> DataFrame:
    """Windows of rows (doc_id, text), as rule 0, and ``passages``; with a bitmap only those that may be in the benchmark."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, SLICE):
            t = Template(b.column("text"))
            at, h, loose = t.windows()
            parts = [(0, WINDOW, at[loose == x], h[loose == x], x) for x in (False, True)]
            parts += [(*p, True) for p in t.passages(lengths)] if passages else []
            for rule, size, at, h, loose in parts:
                if bitmap is not None:
                    bit = h >> U(64 - BITMAP_BITS)
                    maybe = (bitmap[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) == 1
                    at, h = at[maybe], h[maybe]
                doc, n = t.doc[at], len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), b.column("doc_id").take(pa.array(doc)), pa.array((at - t.first[doc]).astype(np.int32)),
                     pa.array(t.slots(at, loose, size) if size else [[]] * n, pa.list_(pa.int64())), pa.array(np.full(n, loose)), pa.array(np.full(n, rule, np.int32)), pa.array(t.n[doc].astype(np.int32))],
                    ["h", "doc_id", "pos", "slots", "loose", "rule", "n"])

    return texts.mapInArrow(work, FOUND)


def bitmap_of(windows: DataFrame) -> np.ndarray:
    """2**24 bits: which leading bits of window hashes occur. The driver gets 2**18 words at most, however large the benchmark."""
    bit = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    words = windows.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITMAP_BITS}) & 63 AS int))")).alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["bits"]
    return out.view(np.uint64)


def one_to_one(values: str) -> Column:
    """Whether an array of (asked, slots) maps values one to one."""
    both = F.size(F.array_distinct(values))
    return (both == F.size(F.array_distinct(F.transform(values, lambda v: v["asked"])))) & (both == F.size(F.array_distinct(F.transform(values, lambda v: v["slots"]))))


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, per_window: bool = False, passages: bool = False) -> DataFrame:
    """(doc_id, item_id, n_matched) for every document and item of which at least ``share`` of the windows match with consistent slots.

    Slots are judged over all windows of an alignment, or with ``per_window`` in each window by itself: then a window counts whatever the
    others hold, and one with the item's own values always does. ``passages`` adds what is found by other rules, perhaps with no window.
    """
    every = materialize(template_windows(benchmark, None, passages))
    item = every.select("h", F.col("doc_id").alias("item_id"), F.col("pos").alias("at"), F.col("slots").alias("asked"), F.col("loose").alias("loose_item"), F.col("rule").alias("item_rule"), F.col("n").alias("n_words"))
    size = item.where("item_rule = 0").groupBy("item_id").agg(F.count_distinct("at").alias("n_windows"))
    # fewer than RUN numbers
    lengths = sorted(r["n"] for r in every.where((F.col("rule") == 1) & (F.col("n") < RUN)).select("n").distinct().collect())
    found = template_windows(docs, bitmap_of(every), passages, lengths)
    pairs = found.join(item, "h").where((F.size("slots") == F.size("asked")) & (F.col("rule") == F.col("item_rule")))
    if passages:
        pairs = materialize(pairs)
    by_windows = window_matches(pairs.where("rule = 0"), per_window).join(size, "item_id").where(F.col("n_matched") >= share * F.col("n_windows")).select("doc_id", "item_id", "n_matched")
    if not passages:
        return by_windows
    sound = pairs.withColumn("values", F.arrays_zip("asked", "slots")).where(one_to_one("values"))
    whole = sound.where("rule = 1").select("doc_id", "item_id")
    shift = F.col("pos") - F.col("at")
    cells = F.explode(F.array(F.floor(shift / CELL) * 2, F.floor((shift + CELL // 2) / CELL) * 2 + 1))
    cover = sound.where("rule = 2").select("doc_id", "item_id", "at", "n_words", cells.alias("cell")).groupBy("doc_id", "item_id", "n_words", "cell").agg(F.collect_set("at").alias("ats"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + SHORT - 1)))))
    edited = cover.where((covered >= share * F.col("n_words")) & (covered >= WINDOW)).select("doc_id", "item_id")
    others = whole.unionByName(edited).withColumn("n_matched", F.lit(0))
    return by_windows.unionByName(others).groupBy("doc_id", "item_id").agg(F.max("n_matched").alias("n_matched"))


def window_matches(pairs: DataFrame, per_window: bool) -> DataFrame:
    """(doc_id, item_id, n_matched) from pairs of windows in common: different windows of the item with consistent slots."""
    if per_window:
        return pairs.withColumn("values", F.arrays_zip("asked", "slots")).where(one_to_one("values")).groupBy("doc_id", "item_id").agg(F.count_distinct("at").cast("int").alias("n_matched"))
    # an opener read as a name may add a window, but no contradiction to the others
    plain = ~(F.col("loose") | F.col("loose_item"))
    pair = F.arrays_zip("asked", "slots")
    aligned = pairs.groupBy("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("shift")).agg(
        F.collect_set("at").alias("places"), F.flatten(F.collect_set(pair)).alias("values"),
        F.collect_set(F.when(plain, F.col("at"))).alias("plain_places"), F.flatten(F.collect_set(F.when(plain, pair))).alias("plain_values"))
    kept = aligned.withColumn("places", F.when(one_to_one("values"), F.col("places")).when(one_to_one("plain_values"), F.col("plain_places")))
    return kept.where("places IS NOT NULL").groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", per_window: bool = False, passages: bool = False) -> DataFrame:
    """Every row of ``docs`` as (row), with doc_id, contaminated, n_items, item_id (the best matched, smallest on ties) and n_matched.

    A document is contaminated by an item when at least ``share`` of the item's template windows of 8 words stand in it with
    consistent slots, over the whole alignment or ``per_window``. Items whose template is shorter than a window cannot be
    found that way. With ``passages`` a document also counts if 13 words of an item stand in it as they are, if windows of 5 words close
    together cover ``share`` of an item and 8 words at least, or if it holds the whole of an item that has no window: with the same values,
    or with other ones if it has 4 ordinary words; an item of under 4 words must be the whole document. ``n_matched`` counts windows of 8
    words and is 0 where another rule found the item and they fall short of ``share``. Texts of any length are read whole. Null and empty texts are clean; rows with the same
    id (or all without one) are judged together; an empty benchmark leaves everything clean; an empty table gives no rows. Columns of
    ``docs`` may have any names: they travel inside ``row``.
    """
    source = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    items = benchmark.select(benchmark[item_col].cast("bigint").alias("doc_id"), benchmark[item_text_col].cast("string").alias("text")).where("doc_id IS NOT NULL")
    hits = matches(source.select("doc_id", "text"), items, share, per_window, passages)
    best = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.max(F.struct("n_matched", -F.col("item_id"))).alias("best"))
    best = materialize(best.select(F.col("doc_id").alias("hit_id"), "n_items", (-F.col("best.col2")).alias("item_id"), F.col("best.n_matched").cast("long").alias("n_matched")))
    joined = source.join(best, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    return joined.select("row", "doc_id", "text", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "item_id",
                         F.coalesce("n_matched", F.lit(0).cast("long")).alias("n_matched"))
