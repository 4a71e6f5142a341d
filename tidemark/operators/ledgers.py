"""Reconciliation by bags: two tables agree when every row occurs as often in one as in the other.

Totals can agree by accident, a lost row hiding behind a doubled one. Here both sides are counted per distinct row, in one grouping that combines
before the shuffle, and the first row with different counts is the evidence. NULLs are values like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.checks import union_all
from ..functions.exprs import count_rows
from .replies import FIELDS, SHORTEST_DESCRIPTION, repeat_after_success


def bag_difference(left: DataFrame, right: DataFrame, keys: Sequence[str], contained: bool = False) -> DataFrame:
    """Rows over ``keys`` with ``in_left`` and ``in_right`` where these differ; with ``contained`` only where the left side has more."""
    side = lambda df, a, b: df.select(*keys, F.lit(a).alias("_l"), F.lit(b).alias("_r"))
    both = union_all([side(left, 1, 0), side(right, 0, 1)]).groupBy(*keys).agg(F.sum("_l").alias("in_left"), F.sum("_r").alias("in_right"))
    return both.where(F.col("in_left") > F.col("in_right") if contained else F.col("in_left") != F.col("in_right"))


def bag_check(name: str, left: DataFrame, right: DataFrame, keys: Sequence[str], contained: bool = False) -> DataFrame:
    """One row: how many rows differ, and the first of them as ``key|key|... left/right``."""
    rows = bag_difference(left, right, keys, contained)
    text = F.concat(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys]), F.lit(" "), F.col("in_left").cast("string"), F.lit("/"), F.col("in_right").cast("string"))
    return _judged(rows, name, text)


def _judged(bad: DataFrame, name: str, evidence: Column) -> DataFrame:
    one = bad.agg(count_rows().alias("n"), F.min(evidence).alias("e"))
    return one.select(F.lit(name).alias("check_name"), F.col("n").alias("differing"), F.when(F.col("n") == 0, "OK").otherwise("DIFF").alias("ok"), F.col("e").alias("evidence"))


LEDGER_KEYS = ("run_id", "model", "item_id", "prompt_tokens", "output_tokens", "status")


def calls_of(log: DataFrame, item: str = "creative_id") -> DataFrame:
    """A log in the columns of the ledger; thinking tokens are billed as output."""
    thoughts = F.coalesce("thoughts_tokens", F.lit(0)) if "thoughts_tokens" in log.columns else F.lit(0)
    return log.select("run_id", "model", F.col(item).alias("item_id"), "prompt_tokens", (F.col("output_tokens") + thoughts).alias("output_tokens"), "status")


def ledger_check(name: str, log: DataFrame, ledger: DataFrame, job: str, item: str = "creative_id") -> DataFrame:
    """Every call of the log stands in the ledger once, with its tokens, and nothing else does."""
    return bag_check(name, calls_of(log, item), ledger.where(F.col("job") == job), LEDGER_KEYS)


def reconcile_bench(bench: DataFrame, earlier: DataFrame, ledger: DataFrame, job: str, cells: DataFrame, table: DataFrame, answers_now: DataFrame, answers_then: DataFrame, listed: DataFrame,
                    kinds: Sequence[str], reused: tuple[str, str], new: str) -> DataFrame:
    """B-07, the checks that compare whole tables: reused rows, ledger, cells and answers as bags; cut replies, kinds and repeated calls by key.

    ``reused`` is the label and model of rows taken over from ``earlier``, ``new`` the label of new calls. ``table`` is the feature table those rows
    led to, ``listed`` has the ``gap_type`` of each gap in a reply.
    """
    c, keys = F.col, ["task", "model", "creative_id"]
    label, model = reused
    same = ["model", "creative_id", "created_us", "prompt_tokens", "output_tokens"]
    done = bench.where("ok").select(*keys).distinct()
    cut = bench.where("finish_reason = 'MAX_TOKENS'").select(*keys).distinct().join(done, keys, "left_anti")
    again = repeat_after_success(bench, c("ok"), keys).where(c("source") == new)
    said = table.select("creative_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), c(f).cast("string").alias("said")) for f in FIELDS if f != "headline"])))
    mine = cells.where((c("model") == model) & (c("field") != "headline")).select("creative_id", "field", "said").join(table.select("creative_id"), "creative_id", "left_semi")
    text = lambda *x: F.concat_ws("|", *[F.coalesce(c(k).cast("string"), F.lit("~")) for k in x])
    return union_all([
        bag_check("04 reused rows stand in the earlier log", bench.where(c("source") == label).select(*same), earlier.select(*same), same, contained=True),
        ledger_check("07 new calls and ledger rows", bench.where(c("source") == new), ledger, job),
        _judged(cut, "08 cut by output cap and never fixed", text(*keys)),
        _judged(listed.where(~F.coalesce(c("gap_type").isin(list(kinds)), F.lit(False))).groupBy("gap_type").agg(count_rows().alias("n")), "09 kinds of gap outside the options", text("gap_type", "n")),
        bag_check("14 answers as they were when scored", answers_now, answers_then.select(*answers_now.columns), answers_now.columns),
        _judged(again, "15 no repeat call after success", text(*keys, "run_id", "created_us")),
        bag_check("17 cells of the reused model as in the earlier table", mine, said, ["creative_id", "field", "said"], contained=True),
    ])


def check_descriptions(log: DataFrame, files: DataFrame, demo: DataFrame, rounds: int, per_round: int, images: int) -> DataFrame:
    """R-17, free descriptions: pictures listed, rounds complete, replies without errors, long enough and with token counts, low resolution cheaper."""
    c = F.col
    one = log.agg(F.struct(
        count_rows().alias("n"), F.count_distinct("model", "resolution", "run_no").alias("rounds"), F.count_if(c("status") != "").alias("err"),
        F.count_if(c("description").isNull() | (F.char_length("description") < SHORTEST_DESCRIPTION)).alias("short"), F.count_if(c("prompt_tokens").isNull()).alias("nou"))).scalar()
    per = log.groupBy("model", "resolution", "run_no").agg(F.count_distinct("creative_id").alias("images")).agg(F.count_if(c("images") != per_round)).scalar()
    f = files.agg(F.struct(count_rows().alias("n"), F.count_if(c("uri").endswith(".jpg")).alias("jpg"))).scalar()
    d = demo.agg(F.struct(count_rows().alias("n"), F.count_distinct("uri").alias("uris"))).scalar()
    # the dearest default call is the one to beat; no pairs of calls are formed
    price = log.groupBy("creative_id", "model").agg(F.max(F.when(c("resolution") == "low", c("prompt_tokens"))).alias("low"), F.min(F.when((c("resolution") == "default") & (c("run_no") == 1), c("prompt_tokens"))).alias("high"))
    pairs = price.where("low IS NOT NULL AND high IS NOT NULL").agg(F.struct(count_rows().alias("n"), F.count_if(c("low") < c("high")).alias("cheaper"))).scalar()
    facts = log.sparkSession.range(1).select(one.alias("m"), per.alias("bad"), f.alias("f"), d.alias("d"), pairs.alias("p"))
    rows: Mapping[str, tuple] = {
        "01 pictures listed": (F.lit(images), c("f.n")), "02 all of them jpg": (c("f.n"), c("f.jpg")), "03 pictures of the trial are different": (c("d.n"), c("d.uris")),
        "04 calls": (F.lit(rounds * per_round), c("m.n")), "05 rounds": (F.lit(rounds), c("m.rounds")), "06 rounds without all pictures": (F.lit(0), c("bad")), "07 errors": (F.lit(0), c("m.err")),
        "08 empty or short descriptions": (F.lit(0), c("m.short")), "09 calls without token counts": (F.lit(0), c("m.nou")), "10 low resolution is cheaper": (c("p.n"), c("p.cheaper"))}
    return facts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_name"), e.cast("string").alias("expected"), a.cast("string").alias("actual"), F.when(e == a, "OK").otherwise("DIFF").alias("ok"))
                                           for n, (e, a) in rows.items()])))


# ---- what the logs were made from ---------------------------------------------------------------------------------------------

DESIGN = ("has_person", "cta_position", "dominant_color", "text_density")


def _count(df: DataFrame, c: Column | None = None) -> Column:
    return df.agg(count_rows() if c is None else c).scalar()


def _compared(like: DataFrame, rows: Mapping[str, tuple[object, Column]]) -> DataFrame:
    """check_name, expected, actual, ok from named pairs of one-row values."""
    def row(name: str, expected: object, actual: Column) -> Column:
        e = (expected if isinstance(expected, Column) else F.lit(expected)).cast("string")
        return F.struct(F.lit(name).alias("check_name"), e.alias("expected"), actual.cast("string").alias("actual"), F.when(e == actual.cast("string"), "OK").otherwise("DIFF").alias("ok"))

    one = like.sparkSession.range(1).select(*[a.alias(f"a{i}") for i, (_, a) in enumerate(rows.values())], *[(e if isinstance(e, Column) else F.lit(e)).alias(f"e{i}") for i, (e, _) in enumerate(rows.values())])
    return one.select(F.inline(F.array(*[row(n, F.col(f"e{i}"), F.col(f"a{i}")) for i, n in enumerate(rows)])))


def _per(df: DataFrame, column: str, values: Sequence[str]) -> Column:
    """Counts per value as ``n/n/...``."""
    return _count(df, F.concat_ws("/", *[F.count_if(F.col(column) == v).cast("string") for v in values]))


def check_picture_inputs(creatives: DataFrame, files: DataFrame, sample: DataFrame, rounds: DataFrame, images: int, sampled: int, per_image: int) -> DataFrame:
    """R-17, what the feature and structured logs were made from: no design column left to look up, pictures listed, sample and rounds whole."""
    left = [c for c in DESIGN if c in creatives.columns]
    per = rounds.groupBy("creative_id").agg(F.count_distinct("round").alias("n")).where(F.col("n") != per_image)
    return _compared(creatives, {
        "01 design columns left": (0, F.lit(len(left))), "02 pictures listed": (images, _count(files)), "03 pictures listed once": (_count(files), _count(files, F.count_distinct("uri"))),
        "04 sampled pictures": (sampled, _count(sample, F.count_distinct("creative_id"))), "05 sampled pictures in the log": (0, _count(sample.join(rounds, "creative_id", "left_anti"))),
        "06 pictures without all rounds": (0, _count(per))})


def check_gap_inputs(pages: DataFrame, shots: DataFrame, mapped: DataFrame, answers: DataFrame, done: DataFrame, expected_pages: int, parts: int, modes: Sequence[str]) -> DataFrame:
    """K-11, what the gap log was made from and how complete it is: pages, screenshots, mapping, answers, calls per mode."""
    known = mapped.join(pages.select("page_id"), "page_id", "left_semi")
    combos = done.select("creative_id", "mode").distinct()
    return _compared(pages, {
        "01 landing pages with a text": (expected_pages, _count(pages, F.count_if(F.length("page_text") > 0))), "02 screenshots": (expected_pages * parts, _count(shots, F.count_distinct("uri"))),
        "03 images mapped to a page": (_count(mapped), _count(known)), "04 answers scored/disputed": (_count(answers), _count(answers, F.count_if(~F.col("disputed")) + F.count_if("disputed"))),
        "06 successes per mode": (_count(mapped, F.concat_ws("/", *[count_rows().cast("string") for _ in modes])), _per(combos, "mode", modes))})


def check_answer_counts(answers: DataFrame, scores: DataFrame, runs: DataFrame, cases: int, modes: Sequence[str], run_modes: Sequence[str], graders: int) -> DataFrame:
    """E-09, completeness of the question and guard logs: every case answered in every mode, scored by every grader, run with every guard setting."""
    good = answers.where("status = ''").select("case_id", "mode").distinct()
    scored = scores.where("status = ''").select("case_id", "mode", "grader").distinct()
    each = runs.where("status = ''").select("case_id", "mode").distinct()
    return _compared(answers, {
        "01 cases answered per mode": ("/".join([str(cases)] * len(modes)), _per(good, "mode", modes)),
        "02 score rows": (cases * len(modes) * graders, _count(scored)), "03 answers without any score": (0, _count(good.join(scored, ["case_id", "mode"], "left_anti"))),
        "04 scores of no answer": (0, _count(scored.join(good, ["case_id", "mode"], "left_anti"))),
        "05 cases run per guard setting": ("/".join([str(cases)] * len(run_modes)), _per(each, "mode", run_modes))})
