"""The registered queries of this subpackage: each operator over its whole table, and SQL that must give the same rows where SQL can."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ball_search, bpe_count, decontam, frames, jaccard, langid, lines, packing, reputation, rules, runs, substring, toxicity
from .common import table

WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeats(table(spark, folder, "documents"), size=13, keep_text=False).drop("kept")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.quality(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _stops() -> str:
    return ", ".join(f"'{w}'" for w in rules.STOP_WORDS)


def _broken(rule: rules.Rule) -> str:
    value = f"{rule.numerator} * 1.0::DOUBLE" + (f" / nullif({rule.denominator}, 0)" if rule.denominator else "")
    sides = [f"{value} < {rule.least}"] * (rule.least is not None) + [f"{value} > {rule.most}"] * (rule.most is not None)
    return "coalesce(" + " OR ".join(sides) + ", false)"


QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM d WHERE len(words) >= 8),
named AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS w FROM win),
twins AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM named) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twins, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
    len(text) - len(translate(text, '{rules.SYMBOLS}', '')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(words, lambda w: w IN ({_stops()}))) AS n_stop_words,
    len(list_filter(words, lambda w: regexp_matches(w, '^\\p{{Lu}}{{2,}}[^\\p{{Ll}}]*$'))) AS n_upper_words
    FROM d LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(map(_broken, rules.RULES))}) AS kept FROM b
"""

def fold_of(parts: int, column: str = "doc_id"):
    """CRC-32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), held_out=fold_of(3) == 1, threshold=0.7)


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, folder, "documents"), size=4, num=85, den=100)


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    said = langid.identify(table(spark, folder, "documents"), learn=fold_of(4) != 2)
    return said.select("doc_id", F.coalesce(fold_of(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    manifest = frames.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), 2, frames.token_file_folder(docs))
    return frames.token_digests(manifest)


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    checked = decontam.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"), per_window=True, passages=True)
    return checked.select("doc_id", "contaminated", "n_items", "item_id", "n_matched")


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def turned(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where the contract of operator 11 lets a text repeat: in one id of ten, from word ``a`` on with period ``p``."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_digests(runs.periodic_runs(table(spark, folder, "documents"), rewrite=turned))


def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return reputation.filter_urls(table(spark, folder, "pages"))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ball_search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_token_files": op7_token_files,
    "op8_decontamination": op8_decontamination,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_url_filter": op12_url_filter,
    "op13_ranked_search": op13_ranked_search,
}
REPEATS_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM d WHERE len(words) >= 13),
win AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS w FROM starts),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, (SELECT unnest(range(0, 13)) AS k)),
word AS (SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS w FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# A window is the shortest run of lines with 50 words or more, forwards from its first or backwards from its last line.
LINES_SQL = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
every AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM split),
line AS (SELECT doc_id, i, line, len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS n FROM every),
run AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM line WHERE n > 0),
fwd AS (SELECT a.doc_id, a.i AS a, min(b.i) AS b FROM run a JOIN run b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= {lines.MIN_WORDS} GROUP BY 1, 2),
bwd AS (SELECT b.doc_id, max(a.i) AS a, b.i AS b FROM run a JOIN run b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= {lines.MIN_WORDS} GROUP BY b.doc_id, b.i),
win AS (SELECT * FROM fwd UNION SELECT * FROM bwd),
text AS (SELECT w.doc_id, w.a, w.b, string_agg(r.line, chr(10) ORDER BY r.i) AS t FROM win w JOIN run r ON r.doc_id = w.doc_id AND r.i BETWEEN w.a AND w.b GROUP BY 1, 2, 3),
ranked AS (SELECT *, first_value(doc_id) OVER f AS first_doc, first_value(b) OVER f AS first_b FROM text WINDOW f AS (PARTITION BY t ORDER BY doc_id, a, b)),
later AS (SELECT doc_id, unnest(range(a, b + 1)) AS i FROM ranked WHERE doc_id > first_doc OR a > first_b),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM every ANTI JOIN later USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN split USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE = {
    "op2_substring_dedup": REPEATS_SQL,
    "op10_line_dedup": LINES_SQL,
    "op3_quality_rules": QUALITY_SQL,
    "op12_url_filter": reputation.url_sql(),
    "op13_ranked_search": ball_search.SEARCH_SQL,
}
