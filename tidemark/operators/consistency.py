"""Do adverts promise what their landing pages say: scoring of listed gaps against an answer table, and comparison of models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.checks import check_rows, fingerprint, one_row, union_all
from ..functions.paging import PAGE, list_pages, page_text
from ..functions.exprs import count_rows, newest, ratio
from .replies import FIELDS, OPTIONS, TWD, price_columns

# The kinds of gap a reply may list; two of them never occur in the answers.
GAP_TYPES = ("limited_offer", "special_price", "free_shipping", "gift", "warranty", "product_name", "product_option", "other")
DECOYS = ("gift", "warranty")
GAPS_JSON = "ad_texts array<string>, gaps array<struct<gap_type:string,ad_text:string,page_evidence:string>>"


def page_map(creatives: DataFrame, pages: Mapping[str, str], default: str) -> DataFrame:
    """K-01: which page each image leads to, by campaign."""
    page = F.lit(default)
    for campaign, p in pages.items():
        page = F.when(F.col("utm_campaign") == campaign, p).otherwise(page)
    return creatives.where("format = 'image'").select("creative_id", "channel", "utm_campaign", "product_focus", page.alias("page_id"))


def landing_pages(pages: DataFrame) -> DataFrame:
    """K-12, first half: page text without markup; the whole text is kept."""
    inner = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(inner, r"<[^>]*>", " "), r"\s+", " "))
    return pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)?", 1).alias("path"),
                        F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), text.alias("page_text"))


INTRO = "客人在 %s 看到附上的廣告圖，點下去之後會到官網的「%s」。"  # fixed value


def render_gap_request(mapped: DataFrame, pages: DataFrame, modes: Sequence[str] = ("image", "text")) -> DataFrame:
    """K-12, second half: one request per image and mode; the text mode carries the page text."""
    j = mapped.join(pages.select("page_id", "title", "page_text"), "page_id").withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    intro = F.format_string(INTRO, "channel", "title")
    return j.select("creative_id", "page_id", "mode", F.when(F.col("mode") == "text", F.concat(intro, F.lit("\n"), "page_text")).otherwise(intro).alias("request"))


def page_summary(mapped: DataFrame, pages: DataFrame, shots: DataFrame, pattern: str = r"/([^/]+)-[123][.]jpg$") -> DataFrame:
    """K-02: images, text length, screenshots and their size per page."""
    files = shots.withColumn("page_id", F.regexp_extract("uri", pattern, 1)).where("page_id <> ''").groupBy("page_id").agg(
        count_rows().alias("screenshots"), F.sum("size").alias("screenshot_bytes"))
    ads = mapped.groupBy("page_id").agg(count_rows().alias("creatives"))
    return pages.join(ads, "page_id", "left").join(files, "page_id", "left").select("page_id", "title", "creatives", F.char_length("page_text").alias("text_chars"), "screenshots", "screenshot_bytes")


def answer_overview(answers: DataFrame, page: int = 1, size: int = PAGE) -> DataFrame:
    """K-03: answers per kind and keyword, with the images concerned on one page of the list (``answer_pages`` has them all)."""
    keys = ["gap_type", "ad_keyword"]
    counts = answers.groupBy(*keys).agg(F.count_if(~F.col("disputed")).alias("scored"), F.count_if("disputed").alias("disputed"))
    return counts.join(page_text(answer_pages(answers, size), keys, "creative_id", page, name="creatives"), keys, "left")


def answer_pages(answers: DataFrame, size: int = PAGE) -> DataFrame:
    """K-03: the images of each kind and keyword as numbered rows."""
    return list_pages(answers, ["gap_type", "ad_keyword"], "creative_id", size)


def readable() -> Column:
    gaps = F.from_json("result", "gaps array<string>")["gaps"]
    return F.coalesce((F.col("status") == "") & (F.coalesce("finish_reason", F.lit("")) != "MAX_TOKENS") & gaps.isNotNull(), F.lit(False))


def latest_readable(log: DataFrame, key: str = "mode", success: Column | None = None) -> DataFrame:
    ok = log.where(readable() if success is None else success)
    return ok.groupBy(key, "creative_id").agg(newest(["result"], "created_us", "event_id").alias("b")).select(key, "creative_id", F.from_json("b.result", GAPS_JSON).alias("j"))


def explode_gaps(latest: DataFrame, key: str = "mode") -> DataFrame:
    """K-04: listed gaps with their position."""
    z = lambda c: F.coalesce(c, F.lit(""))
    return latest.select(key, "creative_id", F.posexplode("j.gaps").alias("pos", "g")).select(
        key, "creative_id", "pos", F.col("g.gap_type").alias("gap_type"), z("g.ad_text").alias("ad_text"), z("g.page_evidence").alias("page_evidence"))


def answer_grid(answers: DataFrame, values: Column, key: str = "mode") -> DataFrame:
    """Every answer for every mode (or model); ``values`` is a short array."""
    return answers.withColumn(key, F.explode(values))


def match_gaps(grid: DataFrame, found: DataFrame, key: str = "mode") -> DataFrame:
    """K-05: same image, mode and kind, and the keyword stands in the quoted text. At most a few gaps per reply."""
    f = found.select(key, "creative_id", "gap_type", "pos", "ad_text", "page_evidence")
    return grid.select(key, "creative_id", "gap_type", "ad_keyword").join(f, [key, "creative_id", "gap_type"]).where(F.contains("ad_text", "ad_keyword"))


def _joined(c: str) -> Column:
    items = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("t")))))
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: x["t"]), " ／ "))


def gap_verdicts(answers: DataFrame, latest: DataFrame, mapped: DataFrame, values: Column, key: str = "mode") -> DataFrame:
    """K-06: hit / miss / disputed / no_call per answer and mode; listed gaps that match no answer are extra (or other)."""
    c = F.col
    grid, found = answer_grid(answers, values, key), explode_gaps(latest, key)
    matched = match_gaps(grid, found, key)
    per = matched.groupBy(key, "creative_id", "gap_type", "ad_keyword").agg(count_rows().alias("n"), _joined("ad_text").alias("ad_text"), _joined("page_evidence").alias("page_evidence"))
    called = latest.select(key, "creative_id", F.lit(True).alias("called"), F.array_join("j.ad_texts", " ｜ ").alias("ad_texts"))
    listed = F.coalesce(c("n"), F.lit(0)) > 0
    answer_side = grid.join(per, [key, "creative_id", "gap_type", "ad_keyword"], "left").join(called.select(key, "creative_id", "called"), [key, "creative_id"], "left").select(
        key, "creative_id", "gap_type",
        F.when(c("called").isNull(), "no_call").when(c("disputed"), "disputed").when(listed, "hit").otherwise("miss").alias("verdict"),
        listed.alias("listed"), "ad_keyword", "page_fact", "ad_text", "page_evidence")
    used = matched.select(key, "creative_id", "pos").distinct()
    rest = found.join(used, [key, "creative_id", "pos"], "left_anti").groupBy(key, "creative_id", "gap_type").agg(_joined("ad_text").alias("ad_text"), _joined("page_evidence").alias("page_evidence"))
    extra_side = rest.select(key, "creative_id", "gap_type", F.when(c("gap_type") == "other", "other").otherwise("extra").alias("verdict"), F.lit(True).alias("listed"),
                             F.lit(None).cast("string").alias("ad_keyword"), F.lit(None).cast("string").alias("page_fact"), "ad_text", "page_evidence")
    texts = called.select(key, "creative_id", "ad_texts")
    return answer_side.unionByName(extra_side).join(mapped.select("creative_id", "page_id", "utm_campaign", "product_focus"), "creative_id").join(texts, [key, "creative_id"], "left").select(
        key, "creative_id", "page_id", "utm_campaign", "product_focus", "gap_type", "verdict", "listed", "ad_keyword", "page_fact",
        F.when(c("ad_keyword").isNotNull(), F.contains(F.coalesce("ad_texts", F.lit("")), c("ad_keyword"))).alias("ad_read"), "ad_text", "page_evidence", "ad_texts")


def recall_precision(verdicts: DataFrame, answers: DataFrame, key: str = "mode") -> DataFrame:
    """K-07."""
    c, v = F.col, F.col("verdict")
    scored = answers.where(~c("disputed")).select("creative_id").distinct().withColumn("scored", F.lit(True))
    hit, judged = F.count_if(v == "hit"), F.count_if(v.isin("hit", "miss"))
    return verdicts.join(scored, "creative_id", "left").groupBy(key).agg(
        judged.alias("answers"), hit.alias("hit"), F.count_if(v == "miss").alias("miss"), F.count_if(v == "extra").alias("extra"),
        F.round(ratio(hit, judged), 3).alias("recall"), F.round(ratio(hit, F.count_if(v.isin("hit", "extra"))), 3).alias("precision"),
        F.count_distinct(F.when((v == "extra") & c("scored").isNull(), c("creative_id"))).alias("clean_flagged"),
        F.count_if((v == "extra") & c("gap_type").isin(list(DECOYS))).alias("decoy"), F.count_if((v == "disputed") & c("listed")).alias("disputed_listed"), F.count_if(v == "other").alias("other_rows"))


def by_gap_type(verdicts: DataFrame, key: str = "mode") -> DataFrame:
    """K-08."""
    v = F.col("verdict")
    n = lambda p: F.count_if(F.coalesce(p, F.lit(False)))
    return verdicts.where(v.isin("hit", "miss", "extra")).groupBy("gap_type", key).agg(
        n(v.isin("hit", "miss")).alias("answers"), n(v == "hit").alias("hit"), n(v == "miss").alias("miss"), n(v == "extra").alias("extra"),
        n((v == "miss") & F.col("ad_read")).alias("miss_but_read"), n((v == "miss") & ~F.col("ad_read")).alias("miss_not_read"))


def verdict_rows(verdicts: DataFrame, wanted: Sequence[str], key: str = "mode") -> DataFrame:
    return verdicts.where(F.col("verdict").isin(list(wanted))).select(key, "verdict", "creative_id", "page_id", "gap_type", "ad_keyword", "ad_read", "listed", "ad_text", "page_evidence", "page_fact")


def verdict_counts(verdicts: DataFrame, key: str = "mode") -> DataFrame:
    return verdicts.groupBy(key, "verdict").agg(count_rows().alias("n"))


def agreement_matrix(verdicts: DataFrame, first: str = "image", second: str = "text") -> DataFrame:
    """K-09: hit by both, one or none, per kind and in total."""
    keys = ["creative_id", "gap_type", "ad_keyword"]
    side = lambda m, n: verdicts.where((F.col("mode") == m) & F.col("ad_keyword").isNotNull()).select(*keys, F.col("verdict").alias(n))
    j = side(first, "a").where("a in ('hit', 'miss')").join(side(second, "b"), keys)
    n = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y))
    return j.rollup("gap_type").agg(n("hit", "hit").alias("both_hit"), n("hit", "miss").alias("first_only"), n("miss", "hit").alias("second_only"), n("miss", "miss").alias("both_miss"))


def ads_per_page(mapped: DataFrame, pages: DataFrame, page: int = 1, size: int = PAGE) -> DataFrame:
    """K-10: number of images per landing page, and their ids on one page of the list (``ad_pages`` has them all)."""
    counts = mapped.groupBy("page_id").agg(count_rows().alias("creatives"))
    ids = page_text(ad_pages(mapped, size), ["page_id"], "creative_id", page, name="creative_ids")
    return counts.join(ids, "page_id", "left").join(pages.select("page_id", "title"), "page_id")


def ad_pages(mapped: DataFrame, size: int = PAGE) -> DataFrame:
    """K-10: the images of each landing page as numbered rows."""
    return list_pages(mapped, ["page_id"], "creative_id", size)


def check_consistency(log: DataFrame, verdicts: DataFrame, answers: DataFrame, ledger: DataFrame, job: str, runs: DataFrame, mapped: DataFrame, modes: int = 2) -> DataFrame:
    """K-11: completeness, token counts, ledger copy, truncation, kinds inside the options, every answer judged, answers unchanged."""
    c = F.col
    keys = ["creative_id", "mode"]
    ok = log.where(readable()).select(*keys).distinct()
    listed = log.where("status = ''").select(F.explode(F.from_json("result", GAPS_JSON)["gaps"]).alias("g")).select("g.gap_type")
    struct = lambda df, **a: df.agg(F.struct(*[x.alias(k) for k, x in a.items()])).scalar()
    used = ledger.where(c("job") == job).join(log.select("run_id").distinct(), "run_id", "left_semi")
    cut = log.where("finish_reason = 'MAX_TOKENS'").select(*keys).distinct().join(ok, keys, "left_anti")
    prints = runs.select("fingerprint").union(fingerprint(answers).select("fingerprint")).distinct()
    facts = one_row(
        log.sparkSession, m=struct(mapped, n=count_rows()), o=struct(ok, n=count_rows()), l=struct(log, n=count_rows(), nou=F.count_if((c("status") == "") & (c("prompt_tokens").isNull() | c("output_tokens").isNull()))),
        u=struct(used, n=count_rows()), x=struct(cut, n=count_rows()), g=struct(listed, n=F.count_if(~F.coalesce(c("gap_type").isin(list(GAP_TYPES)), F.lit(False)))),
        v=struct(verdicts, n=F.count_if(c("verdict").isin("hit", "miss"))), a=struct(answers, n=F.count_if(~c("disputed"))), p=struct(prints, n=count_rows()))
    return check_rows(facts, [
        ("01 successful combinations", c("m.n") * modes, c("o.n")), ("02 token counts recorded", "0", c("l.nou")), ("03 ledger rows = log rows", c("l.n"), c("u.n")),
        ("04 cut by output cap and never fixed", "0", c("x.n")), ("05 kinds outside options", "0", c("g.n")), ("06 scored answers judged", c("a.n") * modes, c("v.n")),
        ("07 answer table unchanged since scoring", "1", c("p.n"))])


# ---- comparison of models -----------------------------------------------------------------------------------------------------

def reuse_replies(source: DataFrame, bench: DataFrame, task: str, model: str, success: Column, label: str) -> DataFrame:
    """B-01: latest earlier success of each image that the comparison does not have yet."""
    have = bench.where((F.col("task") == task) & (F.col("model") == model) & F.col("ok")).select("creative_id").distinct()
    keep = [c for c in source.columns if c != "creative_id"]
    latest = source.where((F.col("model") == model) & success).groupBy("creative_id").agg(newest(keep, "created_us", "event_id").alias("b")).select("creative_id", "b.*")
    return latest.join(have, "creative_id", "left_anti").withColumns({"task": F.lit(task), "source": F.lit(label), "ok": F.lit(True)})


def source_counts(bench: DataFrame) -> DataFrame:
    return bench.groupBy("task", "model", "source").agg(count_rows().alias("call_rows"), F.count_if("ok").alias("ok_rows"))


def bench_todo(images: DataFrame, bench: DataFrame, combos: Sequence[tuple[str, str]], batch_limit: int, source: str, strict: tuple[str, str] | None = None, max_failures: int = 2) -> DataFrame:
    """B-02: what to ask next per task and model: no success, fewer than two answered failures, not waiting for the strict retry, at most
    ``batch_limit`` images. The per-combination limit is a ranked filter, which Spark applies on each side of the shuffle."""
    from pyspark.sql import Window
    c = F.col
    keys = ["task", "model", "creative_id"]
    grid = images.select("creative_id", F.inline(F.array(*[F.struct(F.lit(t).alias("task"), F.lit(m).alias("model")) for t, m in combos])))
    failed = bench.where((c("source") == source) & ~c("ok") & (c("status") == ""))
    todo = grid.join(bench.where("ok").select(*keys).distinct(), keys, "left_anti") \
        .join(failed.groupBy(*keys).agg(count_rows().alias("n")).where(c("n") >= max_failures).select(*keys), keys, "left_anti")
    if strict:
        waiting = failed.where((c("task") == strict[0]) & (c("model") == strict[1]) & c("method").isNull()).select(*keys).distinct()
        todo = todo.join(waiting, keys, "left_anti")
    w = Window.partitionBy("task", "model").orderBy("creative_id")
    return todo.withColumn("rn", F.row_number().over(w)).where(c("rn") <= batch_limit).drop("rn")


def strict_todo(images: DataFrame, bench: DataFrame, task: str, model: str, source: str, batch_limit: int) -> DataFrame:
    """B-02, strict retry: main round answered but not good, and not yet answered under the strict method."""
    c = F.col
    mine = (c("task") == task) & (c("model") == model)
    answered = bench.where((c("source") == source) & mine & ~c("ok") & (c("status") == "") & c("method").isNull()).select("creative_id").distinct()
    settled = bench.where(mine & (c("ok") | ((c("method") == "response_schema") & (c("status") == "")))).select("creative_id").distinct()
    return answered.join(images.select("creative_id"), "creative_id", "left_semi").join(settled, "creative_id", "left_anti").orderBy("creative_id").limit(batch_limit)


def pending_counts(todo: DataFrame) -> DataFrame:
    return todo.groupBy("task", "model").agg(count_rows().alias("pending"))


def known_models(bench: DataFrame, task: str, models: Sequence[str]) -> Column:
    """The wanted models and any others in the log, as one short array."""
    logged = bench.where(F.col("task") == task).agg(F.collect_set("model")).scalar()
    return F.array_union(F.array(*[F.lit(m) for m in models]), logged)


def score_cells(bench: DataFrame, truth: DataFrame, review: DataFrame, models: Sequence[str]) -> DataFrame:
    """B-03: model x image x field: correct, wrong or no_call; whether the cell counts; whether the answer is one of the options."""
    c = F.col
    picked = bench.where((c("task") == "features") & c("ok")).groupBy("model", "creative_id").agg(newest(["result"], "created_us", "event_id").alias("b")).select(
        "model", "creative_id", F.from_json("b.result", ", ".join(f"{f} string" for f in FIELDS)).alias("j"), F.lit(True).alias("called"))
    squash = lambda x: F.regexp_replace(x, r"(?U)[\s\x1C-\x1F]", "")
    text = lambda f, x: squash(x) if f == "headline" else x.cast("string")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), text(f, c(f"j.{f}")).alias("said"), text(f, c(f)).alias("spec")) for f in FIELDS])
    grid = truth.withColumn("model", F.explode(known_models(bench, "features", models))).join(picked, ["model", "creative_id"], "left")
    long = grid.select("model", "creative_id", "called", F.inline(cells)).join(review.select("creative_id", "field", F.col("verdict").alias("review")), ["creative_id", "field"], "left")
    allowed = {"has_person": ("true", "false"), **OPTIONS}
    inside = F.lit(None).cast("boolean")
    for f, values in allowed.items():
        inside = F.when(c("field") == f, c("said").isin(list(values))).otherwise(inside)
    return long.select("model", "creative_id", "field", "said", "spec", "review",
                       F.when(c("called").isNull(), "no_call").when(F.coalesce(c("said") == c("spec"), F.lit(False)), "correct").otherwise("wrong").alias("verdict"),
                       ((c("field") != "headline") & ~c("review").eqNullSafe(F.lit("disagree"))).alias("counted"), inside.alias("in_option"))


def score_gaps_by_model(bench: DataFrame, answers: DataFrame, mapped: DataFrame, models: Sequence[str]) -> DataFrame:
    """B-04: the gap scoring with the model in place of the mode."""
    gaps = bench.where(F.col("task") == "gaps")
    return gap_verdicts(answers, latest_readable(gaps, "model", F.col("ok")), mapped, known_models(bench, "gaps", models), "model")


HOUR_US = 3_600_000_000


def batch_seconds(bench: DataFrame, jobs: DataFrame) -> DataFrame:
    """B-05: the largest batch per task and model and the duration of the job that wrote it.

    Job intervals are spread into hours, so 'created while the job ran' becomes an equi join on the hour with a residual check.
    """
    c = F.col
    sizes = bench.groupBy("task", "model", "source", "created_us").agg(count_rows().alias("calls"))
    b = sizes.groupBy("task", "model").agg(F.max_by(F.struct("source", "created_us", "calls"), F.struct("calls", "created_us")).alias("x")).select("task", "model", "x.*") \
        .withColumn("hour", F.floor(c("created_us") / HOUR_US))
    j = jobs.select("job_id", "start_us", "end_us", F.explode(F.sequence(F.floor(c("start_us") / HOUR_US), F.floor(c("end_us") / HOUR_US))).alias("hour"))
    inside = b.join(j, "hour").where(c("created_us").between(c("start_us"), c("end_us"))).groupBy("task", "model").agg(
        F.count("job_id").alias("jobs_matched"), F.round(F.max(c("end_us") - c("start_us")) / 1_000_000, 1).alias("seconds"))
    return b.drop("hour").join(inside, ["task", "model"], "left").withColumn("jobs_matched", F.coalesce("jobs_matched", F.lit(0)))


def provenance(bench: DataFrame) -> DataFrame:
    """B-06."""
    c = F.col
    return bench.groupBy("task", "model", "source", F.coalesce("method", F.lit("main")).alias("method")).agg(
        count_rows().alias("call_rows"), F.count_if("ok").alias("ok_rows"), F.count_if(~c("ok")).alias("failed"), F.count_if(c("finish_reason") == "MAX_TOKENS").alias("cut_by_cap"),
        F.min("created_us").alias("first_us"), F.max("created_us").alias("last_us"))


def cell_accuracy(cells: DataFrame) -> DataFrame:
    c = F.col
    right, edge, head = c("verdict") == "correct", c("review") == "borderline", c("field") == "headline"
    return cells.groupBy("model").agg(
        F.count_if("counted").alias("cells"), F.count_if(c("counted") & right).alias("correct"), F.round(ratio(F.count_if(c("counted") & right), F.count_if("counted")), 3).alias("accuracy"),
        F.count_if(head).alias("headlines"), F.count_if(head & right).alias("headline_correct"), F.count_if(~head & ~F.coalesce("in_option", F.lit(False))).alias("off_option"),
        F.count_if(edge).alias("borderline_cells"), F.count_if(edge & right).alias("borderline_correct"), F.count_if(c("verdict") == "no_call").alias("no_call"))


def cell_accuracy_by_field(cells: DataFrame) -> DataFrame:
    used = F.col("counted") | (F.col("field") == "headline")
    return cells.groupBy("field", "model").agg(F.count_if(used).alias("cells"), F.count_if(used & (F.col("verdict") == "correct")).alias("correct"))


def wrong_cell_rows(cells: DataFrame) -> DataFrame:
    return cells.where("verdict = 'wrong'").select("model", "creative_id", "field", "said", "spec", "review", "counted")


def cost_per_thousand(bench: DataFrame, prices: Mapping[str, tuple[float, float]]) -> DataFrame:
    c = F.col
    p_in, p_out = price_columns(prices)
    z = lambda x: F.coalesce(x, F.lit(0))
    cost = z("prompt_tokens") * p_in + (z("output_tokens") + z("thoughts_tokens")) * p_out
    good = lambda x: F.round(F.avg(F.when(c("ok"), x))).cast("bigint")
    return bench.withColumn("_cost", cost).groupBy("task", "model").agg(
        count_rows().alias("call_rows"), F.count_if("ok").alias("ok_calls"), good(c("prompt_tokens")).alias("avg_input"), good(z("output_tokens")).alias("avg_output"),
        good(z("thoughts_tokens")).alias("avg_thoughts"), F.max(z("output_tokens") + z("thoughts_tokens")).alias("max_output_and_thoughts"),
        F.round(F.avg(F.when(c("ok"), c("_cost"))) / 1e6 * TWD * 1000, 1).alias("twd_per_1000"), F.round(F.sum("_cost") / 1e6 * TWD, 3).alias("spent_twd"))


def score_and_cost(cells: DataFrame, gaps: DataFrame, cost: DataFrame) -> DataFrame:
    """Score as right/all next to the cost per thousand calls."""
    def part(df: DataFrame, task: str, right: Column, all_: Column) -> DataFrame:
        return df.groupBy("model").agg(F.concat_ws("/", F.count_if(right).cast("string"), F.count_if(all_).cast("string")).alias("score"),
                                       F.round(ratio(F.count_if(right), F.count_if(all_)), 3).alias("rate")).withColumn("task", F.lit(task))
    v = F.col("verdict")
    s = part(cells, "features", F.col("counted") & (v == "correct"), F.col("counted")).unionByName(part(gaps, "gaps", v == "hit", v.isin("hit", "miss")))
    return s.join(cost.select("task", "model", "twd_per_1000"), ["task", "model"], "left").select("task", "model", "score", "rate", "twd_per_1000")


def verdict_totals(cells: DataFrame, gaps: DataFrame) -> DataFrame:
    n = lambda df, t: df.groupBy("model", "verdict").agg(count_rows().alias("n")).select(F.lit(t).alias("task"), "model", "verdict", "n")
    return n(cells, "features").unionByName(n(gaps, "gaps"))


def check_bench(bench: DataFrame, cells: DataFrame, gaps: DataFrame, earlier: DataFrame, answers: DataFrame, truth: DataFrame, prompts: Mapping[str, str], models: Mapping[str, Sequence[str]]) -> DataFrame:
    """B-07: grids complete, verdicts equal to the earlier mart for the reused model, one call per image and run, one prompt version per task."""
    c = F.col
    struct = lambda df, **a: df.agg(F.struct(*[x.alias(k) for k, x in a.items()])).scalar()
    twice = bench.groupBy("run_id", "task", "model", "creative_id").agg(count_rows().alias("n")).where("n > 1")
    double_ok = bench.where("ok").groupBy("task", "model", "creative_id").agg(count_rows().alias("n")).where("n > 1")
    keys = ["creative_id", "gap_type", "ad_keyword"]
    mine = gaps.where(c("model") == models["gaps"][0]).where(c("ad_keyword").isNotNull()).select(*keys, "verdict")
    differs = mine.join(earlier.where(c("ad_keyword").isNotNull()).select(*keys, c("verdict").alias("before")), keys).where(c("verdict") != c("before"))
    stray = F.lit(False)
    for task, v in prompts.items():
        stray = stray | ((c("task") == task) & (c("prompt_version") != v))
    facts = one_row(
        bench.sparkSession, e=struct(cells, n=count_rows(), m=F.count_distinct("model"), nocall=F.count_if(c("verdict") == "no_call")), t=struct(truth, n=count_rows()),
        g=struct(gaps, n=F.count_if(c("ad_keyword").isNotNull()), m=F.count_distinct("model")), a=struct(answers, n=count_rows()), w=struct(twice, n=count_rows()),
        o=struct(double_ok, n=count_rows()), d=struct(differs, n=count_rows()), p=struct(bench, n=F.count_if(stray), nou=F.count_if(c("ok") & c("prompt_tokens").isNull()), bad=F.count_if(c("ok") & (c("status") != ""))))
    return check_rows(facts, [
        ("01 cells = models x images x fields", c("e.m") * c("t.n") * len(FIELDS), c("e.n")), ("02 cells without a call", "0", c("e.nocall")), ("03 gap rows = models x answers", c("g.m") * c("a.n"), c("g.n")),
        ("04 more than one call per image in a run", "0", c("w.n")), ("05 more than one success per image", "0", c("o.n")), ("06 verdicts that differ from the earlier mart", "0", c("d.n")),
        ("07 prompt version differs", "0", c("p.n")), ("08 successes without token counts", "0", c("p.nou")), ("09 successes with an error status", "0", c("p.bad"))])
