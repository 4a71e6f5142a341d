"""Operator 3: quality rules. A table of thresholds becomes one Spark projection; no user functions anywhere."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Fixed value: frequent function words of the four languages the documents are written in.
STOP_WORDS = ["a", "and", "be", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
              "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
              "au", "aux", "dans", "de", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "sur", "un", "une",
              "con", "del", "el", "las", "lo", "los", "no", "por", "para", "se", "su", "una", "y"]


@dataclass(frozen=True)
class Rule:
    """A document fails when ``numerator`` / ``denominator`` lies outside [least, most]; a denominator of 0 never fails."""

    name: str
    numerator: str
    denominator: str | None = None
    least: float | None = None
    most: float | None = None

    def fails(self) -> Column:
        value = F.col(self.numerator).cast("double")
        if self.denominator:
            value = F.try_divide(value, F.col(self.denominator).cast("double"))
        bad = F.lit(False)
        if self.least is not None:
            bad = bad | (value < self.least)
        if self.most is not None:
            bad = bad | (value > self.most)
        return F.coalesce(bad, F.lit(False))


RULES = (
    Rule("too_long_words", "word_chars", "n_words", least=1.5, most=25.0),
    Rule("symbols", "n_symbols", "n_words", most=0.3),
    Rule("few_stop_words", "n_stop_words", "n_words", least=0.01),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("upper_case", "n_upper_words", "n_words", most=0.6),
)


def measures(text: Column) -> list[Column]:
    """Everything that only needs characters and lines. ``text`` is not null."""
    stripped = F.regexp_replace(text, SPACE, "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return [
        F.length(stripped).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, SPACE + "+"), lambda w: w != "").alias("_words"),
        lines.alias("_lines"),
    ]


def sorted_windows(hashes: Column) -> Column:
    """(hash, place) pairs in order, so that equal windows are neighbours; NULL where no hash occurs twice."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs)


def twin_places(pairs: Column) -> Column:
    """Places of the windows that have an equal neighbour, in text order. ``pairs`` must be a column, not an expression."""
    last = F.size(pairs) - 1
    marked = F.transform(pairs, lambda p, k: F.when(
        ((k > 0) & (F.get(pairs, k - 1)["h"] == p["h"])) | ((k < last) & (F.get(pairs, k + 1)["h"] == p["h"])), p["i"]))
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def covered_words(places: Column) -> Column:
    """How many words windows at these places cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(
        (a["n"] + WINDOW - F.greatest(F.lit(0), a["upto"] - p)).cast("long").alias("n"), (p + WINDOW).alias("upto")))
    return F.coalesce(covered["n"], F.lit(0).cast("long"))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict per document.

    ``base_failed``: fewer than 20 words, or more than 30 of 100 words in repeated 8-word windows. ``failed_rules`` names the rules of
    the table that a document breaks; ``kept`` is true when neither applies. A null text counts as an empty one and so fails; a null
    id stays null; repeated rows are judged each time; an empty table gives no rows; further columns are ignored. One projection over
    the scan: no shuffle, and arrays only as long as the document itself.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.inline(F.array(F.struct(*measures(text)))))
    n = F.size("_words")
    window = F.transform(
        F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
    hashed = base.select(
        "doc_id", F.inline(F.array(F.struct(
            n.cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter("_words", lambda w: w.rlike(r"^[\p{Lu}]{2,}[^\p{Ll}]*$"))).cast("long").alias("n_upper_words"),
            F.when(n >= WINDOW, window).alias("_h")))))
    facts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_upper_words"]
    # each step is a column of a generator's output, which Catalyst never copies into the places that use it
    paired = hashed.select(*facts, F.explode(F.array(sorted_windows(F.col("_h")))).alias("_pairs"))
    placed = paired.select(*facts, F.explode(F.array(twin_places(F.col("_pairs")))).alias("_places"))
    measured = placed.select(*facts, F.explode(F.array(covered_words(F.col("_places")))).alias("n_repeat_words"))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in rules]), lambda r: r.isNotNull())
    return measured.select("*", base_failed.alias("base_failed"), failed.alias("failed_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
