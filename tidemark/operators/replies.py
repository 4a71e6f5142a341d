"""Logs of model replies: what is still to ask, which reply counts, how right it is and what it cost.

Logs are append-only. 'Latest' and 'best' picks are arg-max aggregates, never per-key sorts, so a log in which one item has a large
part of all rows is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..functions.checks import check_rows, one_row, union_all
from ..functions.exprs import count_rows, expand_once, newest, ratio
from .reply_json import SHAPES, read_reply


# The options an answer may take, the least length of a description.
OPTIONS = {"cta_position": ("center", "bottom_right", "none"), "dominant_color": ("warm", "cool", "neutral"), "text_density": ("low", "high")}
CITED = ("person", "cta", "warm", "text")
FIELDS = ("has_person", "cta_position", "dominant_color", "text_density", "headline")
OUTPUT_CAP = 256
SHORTEST_DESCRIPTION = 20
TWD = 32.0

LOG_SCHEMAS = {
    "features": "run_id string, resolution string, method string, model string, creative_id string, has_person boolean, cta_position string, "
                "dominant_color string, text_density string, headline string, prompt_tokens bigint, output_tokens bigint, status string, created_at timestamp",
    "structured": "round string, method string, model string, run_no bigint, creative_id string, has_person boolean, cta_position string, dominant_color string, "
                  "text_density string, headline string, raw_output string, prompt_tokens bigint, output_tokens bigint, status string, created_at timestamp",
    "describe": "model string, resolution string, run_no bigint, creative_id string, description string, prompt_tokens bigint, output_tokens bigint, status string, created_at timestamp",
    "drafts": "run_id string, version string, sample bigint, creative_id string, model string, headline string, subhead string, badge string, cta_text string, "
              "cta_position string, has_person boolean, dominant_color string, text_density string, composition string, image_prompt string, changes string, "
              "cited_feature string, cited_ratio double, expected_effect string, prompt_tokens bigint, output_tokens bigint, thoughts_tokens bigint, "
              "finish_reason string, status string, created_at timestamp, method string",
    "gaps": "run_id string, mode string, creative_id string, page_id string, model string, result string, gaps bigint, prompt_tokens bigint, output_tokens bigint, "
            "thoughts_tokens bigint, finish_reason string, status string, created_at timestamp, prompt_version string",
    "bench": "run_id string, task string, model string, creative_id string, page_id string, result string, prompt_tokens bigint, output_tokens bigint, "
             "thoughts_tokens bigint, finish_reason string, status string, created_at timestamp, source string, prompt_version string, ok boolean, method string",
    "cache_runs": "run_at timestamp, scenario string, round bigint, anomaly_id string, cause string, prompt_tokens bigint, cached_tokens bigint, output_tokens bigint, status string, usage string",
    "usage": "logged_at timestamp, day string, job string, run_id string, model string, endpoint_type string, media_resolution string, item_id string, "
             "prompt_tokens bigint, output_tokens bigint, status string",
}


def reply_log(spark: SparkSession, name: str) -> DataFrame:
    """R-28: an empty log."""
    return spark.createDataFrame([], LOG_SCHEMAS[name])


def into_log(rows: DataFrame, name: str) -> DataFrame:
    """R-28: ``rows`` in the columns of a log, cast to their types; what the rows do not have is NULL, what the log does not have goes."""
    schema = reply_log(rows.sparkSession, name).schema
    has = {f.name for f in rows.schema.fields}
    return rows.select(*[(F.col(f.name).cast(f.dataType) if f.name in has else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


# ---- reading replies ------------------------------------------------------------------------------------------------------

# Members of the replies and of their usage records.
FEATURE_JSON = "has_person string, cta_position string, dominant_color string, text_density string, headline string"
USAGE_PATHS = {"prompt_tokens": "prompt_token_count", "output_tokens": "candidates_token_count", "thoughts_tokens": "thoughts_token_count", "cached_tokens": "cached_content_token_count"}


def parse_reply(responses: DataFrame, task: str = "features", result: str = "result", full: str = "full_response") -> DataFrame:
    """R-27: raw response to typed log columns and an ``ok`` flag.

    Tasks are ``features``, ``structured`` (with ``raw_output``), ``describe`` (free text), ``drafts`` and ``gaps`` (``found``, the gaps as structs, and their
    number). ``features`` is read strictly: malformed or truncated JSON gives NULLs. The others go through ``read_reply``, keep what a broken reply
    still holds and say so in ``reply_state``; only whole replies are ``ok``.
    """
    usage = {n: F.get_json_object(full, f"$.usage_metadata.{k}").try_cast("bigint") for n, k in USAGE_PATHS.items()}
    out = responses.withColumns({**usage, "finish_reason": F.get_json_object(full, "$.candidates[0].finish_reason")})
    sound = (F.col("status") == "") & (F.coalesce("finish_reason", F.lit("")) != "MAX_TOKENS")
    if task == "features":
        out = expand_once(out, F.from_json(result, FEATURE_JSON)).withColumn("has_person", F.col("has_person").try_cast("boolean"))
        return out.withColumn("ok", F.coalesce(complete() & in_option() & sound, F.lit(False)))
    if task == "describe":
        long = F.char_length(F.trim(result)) >= SHORTEST_DESCRIPTION
        return out.withColumn("description", F.trim(result)).withColumn("ok", F.coalesce(long & sound, F.lit(False)))
    if task not in SHAPES:
        raise ValueError(f"task must be one of {sorted([*SHAPES, 'describe'])}")
    out = read_reply(out, SHAPES[task], result)
    sound = sound & (F.col("reply_state") == "whole")
    if task == "gaps":
        return out.withColumnRenamed("gaps", "found").withColumn("gaps", F.size("found").cast("bigint")).withColumn("gaps", F.when(F.col("found").isNotNull(), F.col("gaps"))) \
            .withColumn("ok", F.coalesce(F.col("found").isNotNull() & sound, F.lit(False)))
    out = out.withColumn("has_person", F.col("has_person").try_cast("boolean"))
    if task == "structured":
        return out.withColumn("raw_output", F.col(result)).withColumn("ok", F.coalesce(complete() & in_option() & sound, F.lit(False)))
    out = out.withColumn("cited_ratio", F.col("cited_ratio").try_cast("double"))
    return out.withColumn("ok", F.coalesce(draft_done() & sound, F.lit(False)))


def draft_done() -> Column:
    """A draft that can be used: text, button, person and ratio are there and every choice is inside its options."""
    filled = (F.col("headline") != "") & F.col("cta_text").isNotNull() & F.col("has_person").isNotNull() & F.col("cited_ratio").isNotNull()
    return F.coalesce((F.col("status") == "") & filled & in_option() & F.col("cited_feature").isin(list(CITED)), F.lit(False))


def complete() -> Column:
    """A successful reply with every field filled."""
    filled = F.col("status") == ""
    for f in FIELDS:
        filled = filled & F.col(f).isNotNull()
    return F.coalesce(filled & (F.col("headline") != ""), F.lit(False))


def in_option() -> Column:
    inside = F.lit(True)
    for f, values in OPTIONS.items():
        inside = inside & F.col(f).isin(list(values))
    return F.coalesce(inside, F.lit(False))


# ---- what to ask ----------------------------------------------------------------------------------------------------------

def request_grid(items: DataFrame, variants: Mapping[str, Sequence]) -> DataFrame:
    """R-29: every item with every combination of a few literal values."""
    for name, values in variants.items():
        items = items.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return items


def work_todo(items: DataFrame, variants: Mapping[str, Sequence], log: DataFrame, success: Column, keys: Sequence[str]) -> DataFrame:
    """R-01: combinations without a successful call."""
    done = log.where(success).select(*keys).distinct()
    return request_grid(items, variants).join(done, list(keys), "left_anti")


def off_option_retry(log: DataFrame) -> DataFrame:
    """R-02: items answered outside the options, without a later good answer and without a success under the strict method.

    'No later good answer' is a comparison of two per-item maxima, so the log is not joined with itself.
    """
    main = (F.col("resolution") == "default") & (F.col("method") == "output_schema") & (F.col("status") == "")
    strict = (F.col("resolution") == "default") & (F.col("method") == "response_schema")
    off = main & ~(in_option() & F.col("has_person").isNotNull() & (F.coalesce("headline", F.lit("")) != ""))
    good = main & in_option() & F.col("has_person").isNotNull() & (F.coalesce("headline", F.lit("")) != "")
    per = log.groupBy("creative_id").agg(F.max(F.when(off, F.col("created_us"))).alias("off_us"), F.max(F.when(good, F.col("created_us"))).alias("good_us"),
                                         F.bool_or(strict & complete()).alias("strict_ok"))
    return per.where("off_us is not null and (good_us is null or good_us <= off_us) and not strict_ok").select("creative_id")


def best_reply(log: DataFrame, resolution: str = "default") -> DataFrame:
    """R-03: one complete reply per item, inside the options first, newest next."""
    fields = [*FIELDS, "in_option", "model", "method", "resolution", "created_us"]
    used = log.where((F.col("resolution") == resolution) & complete()).withColumn("in_option", in_option())
    return used.groupBy("creative_id").agg(newest(fields, "in_option", "created_us", "event_id").alias("b")).select("creative_id", "b.*")


def latest_success(log: DataFrame, success: Column, keys: Sequence[str], order: Sequence[str] = ("created_us", "event_id")) -> DataFrame:
    fields = [c for c in log.columns if c not in keys]
    return log.where(success).groupBy(*keys).agg(newest(fields, *order).alias("b")).select(*keys, "b.*")


def append_usage(log: DataFrame, ledger: DataFrame, job: str, day: str, endpoint: str = "non-global", item: str = "creative_id", resolution: Column | None = None) -> DataFrame:
    """R-04: ledger rows of the runs not copied yet; thinking tokens are billed as output."""
    copied = ledger.where((F.col("job") == job) & F.col("run_id").isNotNull()).select("run_id").distinct()
    thoughts = F.coalesce("thoughts_tokens", F.lit(0)) if "thoughts_tokens" in log.columns else F.lit(0)
    out = F.col("output_tokens") + thoughts
    return log.join(copied, "run_id", "left_anti").select(
        F.col("created_us").alias("logged_us"), F.lit(day).alias("day"), F.lit(job).alias("job"), "run_id", "model", F.lit(endpoint).alias("endpoint_type"),
        (F.lit("none") if resolution is None else resolution).alias("media_resolution"), F.col(item).alias("item_id"), "prompt_tokens", out.alias("output_tokens"), "status")


# ---- how right ------------------------------------------------------------------------------------------------------------

def _squash(c: Column) -> Column:
    return F.regexp_replace(c, r"\s", "")


def _cells(left: str, right: str) -> Column:
    text = lambda side, f: _squash(F.col(f"{side}.{f}")) if f == "headline" else F.col(f"{side}.{f}").cast("string")
    return F.array(*[F.struct(F.lit(f).alias("field"), text(left, f).alias("said"), text(right, f).alias("spec")) for f in FIELDS])


def _same(left: str, right: str, f: str) -> Column:
    a, b = F.col(f"{left}.{f}"), F.col(f"{right}.{f}")
    return _squash(a) == _squash(b) if f == "headline" else a == b


NAMES = {"has_person": "person", "cta_position": "cta", "dominant_color": "color", "text_density": "density", "headline": "headline"}


def feature_distribution(picked: DataFrame) -> DataFrame:
    """R-05: items per field and value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in FIELDS[:4]])
    return picked.select(F.inline(pairs)).groupBy("field", "value").agg(count_rows().alias("images"))


def color_by_person(picked: DataFrame) -> DataFrame:
    return picked.groupBy("dominant_color", "has_person").agg(count_rows().alias("images"))


def accuracy_by_field(picked: DataFrame, truth: DataFrame, by: Sequence[str] = ("resolution",)) -> DataFrame:
    """R-06: right answers per field; headlines compare without white space."""
    j = picked.alias("p").join(truth.alias("g"), F.col("p.creative_id") == F.col("g.creative_id"))
    four = F.lit(True)
    for f in FIELDS[:4]:
        four = four & _same("p", "g", f)
    return j.groupBy(*[F.col(f"p.{b}") for b in by]).agg(count_rows().alias("images"), *[F.count_if(_same("p", "g", f)).alias(f"{NAMES[f]}_ok") for f in FIELDS], F.count_if(four).alias("all_four_ok"))


def wrong_cells(picked: DataFrame, truth: DataFrame, review: DataFrame, by: Sequence[str] = ("resolution",)) -> DataFrame:
    """R-07: every differing field with the reviewer's note."""
    j = picked.alias("p").join(truth.alias("g"), F.col("p.creative_id") == F.col("g.creative_id"))
    cells = j.select(*[F.col(f"p.{b}") for b in by], F.col("p.creative_id"), F.inline(_cells("p", "g"))).where(~F.col("said").eqNullSafe(F.col("spec")))
    return cells.join(review.select("creative_id", "field", "verdict", "eye_value"), ["creative_id", "field"], "left") \
        .select(*by, "creative_id", "field", "said", "spec", "verdict", "eye_value")


def accuracy_excluding_disputed(picked: DataFrame, truth: DataFrame, review: DataFrame, field: str = "dominant_color", by: Sequence[str] = ("resolution",)) -> DataFrame:
    """R-08: all items, items the reviewer agrees with, borderline items."""
    notes = review.where(F.col("field") == field).select("creative_id", "verdict")
    j = picked.alias("p").join(truth.alias("g"), F.col("p.creative_id") == F.col("g.creative_id")).join(notes.alias("r"), F.col("p.creative_id") == F.col("r.creative_id"), "left")
    ok, clear, edge = _same("p", "g", field), ~F.col("r.verdict").eqNullSafe(F.lit("disagree")), F.col("r.verdict") == "borderline"
    return j.groupBy(*[F.col(f"p.{b}") for b in by]).agg(
        count_rows().alias("all_images"), F.count_if(ok).alias("all_ok"), F.count_if(clear).alias("clear_images"), F.count_if(clear & ok).alias("clear_ok"),
        F.count_if(edge).alias("borderline_images"), F.count_if(edge & ok).alias("borderline_ok"))


def agreement_between_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """R-09: same answer in two runs, per field."""
    j = a.alias("a").join(b.alias("b"), F.col("a.creative_id") == F.col("b.creative_id"))
    return j.agg(count_rows().alias("images"), *[F.count_if(_same("a", "b", f)).alias(f"{NAMES[f]}_same") for f in FIELDS])


def agreement_per_item(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.alias("a").join(b.alias("b"), F.col("a.creative_id") == F.col("b.creative_id"))
    return j.select(F.col("a.creative_id"), *[_same("a", "b", f).alias(f"{NAMES[f]}_same") for f in FIELDS])


def price_columns(prices: Mapping[str, tuple[float, float]], model: str = "model") -> tuple[Column, Column]:
    p_in, p_out = F.lit(None).cast("double"), F.lit(None).cast("double")
    for m, (i, o) in prices.items():
        p_in, p_out = F.when(F.col(model) == m, float(i)).otherwise(p_in), F.when(F.col(model) == m, float(o)).otherwise(p_out)
    return p_in, p_out


def reply_cost_rollup(log: DataFrame, by: Sequence[str], prices: Mapping[str, tuple[float, float]]) -> DataFrame:
    """R-10: tokens and cost per group with subtotals and a grand total; the level column keeps totals apart from NULL groups."""
    p_in, p_out = price_columns(prices)
    z = lambda c: F.coalesce(c, F.lit(0))
    out = z("output_tokens") + (z("thoughts_tokens") if "thoughts_tokens" in log.columns else F.lit(0))
    priced = log.withColumns({"_out": out, "_cost": z("prompt_tokens") * p_in + out * p_out})
    return priced.rollup(*by).agg(
        F.grouping_id().cast("int").alias("level"), count_rows().alias("calls"), F.min("prompt_tokens").alias("min_input"), F.max("prompt_tokens").alias("max_input"),
        F.min("output_tokens").alias("min_output"), F.max("output_tokens").alias("max_output"), F.sum("prompt_tokens").alias("input_tokens"),
        F.sum("_out").alias("output_tokens"), F.round(F.sum("_cost") / 1e6 * TWD, 3).alias("twd"), F.round(F.avg("_cost") / 1e6 * TWD * 1000, 1).alias("twd_per_1000_calls"))


def off_option_counts(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """R-11."""
    missing = F.lit(False)
    for f in FIELDS:
        missing = missing | F.col(f).isNull()
    return log.groupBy(*by).agg(count_rows().alias("calls"), *[F.count_if(~F.col(f).isin(list(v))).alias(f"{NAMES[f]}_off_option") for f, v in OPTIONS.items()],
                                F.count_if(missing | (F.col("headline") == "")).alias("missing_field"), F.min("output_tokens").alias("min_out"), F.max("output_tokens").alias("max_out"))


def per_item_truth_table(log: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R-12: every reply against the truth, field by field."""
    j = log.alias("m").join(truth.alias("g"), F.col("m.creative_id") == F.col("g.creative_id"))
    return j.select(*[F.col(f"m.{k}") for k in keys], *[_same("m", "g", f).alias(f"{NAMES[f]}_ok") for f in FIELDS], F.col("m.dominant_color").alias("said_color"),
                    F.col("g.dominant_color").alias("spec_color"), F.col("m.headline").alias("said_headline"))


def split_answer_columns(raw: DataFrame, headlines: Mapping[str, str], columns: Sequence[str] = FIELDS[:4]) -> tuple[DataFrame, DataFrame]:
    """R-13: the answer table, and the dimension without the answer columns."""
    head = F.lit(None).cast("string")
    for item, text in headlines.items():
        head = F.when(F.col("product_focus") == item, text).otherwise(head)
    return raw.where("format = 'image'").select("creative_id", *columns, head.alias("headline")), raw.drop(*columns)


def answer_columns_left(answer: DataFrame, dim: DataFrame, columns: Sequence[str] = FIELDS[:4]) -> DataFrame:
    return answer.agg(count_rows().alias("design_rows"), F.count_if(F.col("headline").isNull()).alias("missing_headline"),
                      F.lit(sum(c in dim.columns for c in columns)).alias("design_columns_left_in_dim"))


def pick_sample(picks: DataFrame, creatives: DataFrame, files: DataFrame, pattern: str = r"/([^/]+)\.jpg$") -> DataFrame:
    """R-14: a pick list with metadata; the id is cut out of the path, so the suffix match is an equi join."""
    by_id = files.withColumn("creative_id", F.regexp_extract("uri", pattern, 1)).where("creative_id <> ''")
    return picks.join(creatives.select("creative_id", "channel", "ad_group_id", "product_focus"), "creative_id").join(by_id.select("creative_id", "uri", "size"), "creative_id")


# Words by which a description tells of people or warm colours.
PERSON_WORDS = "人物|男性|女性|男子|女子|男生|女生|模特|年輕人|一位|一名"
WARM_WORDS = "暖色|暖調|橘|橙|磚紅|赤陶|陶土|米色|大地色|奶茶"


def keyword_tags(df: DataFrame, column: str, person: str = PERSON_WORDS, warm: str = WARM_WORDS) -> DataFrame:
    """R-15."""
    return df.withColumns({"says_person": F.col(column).rlike(person), "says_warm": F.col(column).rlike(warm), "quoted_texts": F.size(F.regexp_extract_all(column, F.lit("「[^」]+」"), 0))})


def describe_stats(log: DataFrame, text: str = "description") -> DataFrame:
    """R-16."""
    return log.groupBy("model", "resolution").agg(F.min("prompt_tokens").alias("min_input"), F.max("prompt_tokens").alias("max_input"), F.round(F.avg("output_tokens")).alias("avg_output"),
                                                  F.round(F.avg(F.char_length(text))).alias("avg_chars"), F.count_distinct(text).alias("distinct_texts"))


def demo_metrics(picks: DataFrame, ads: DataFrame) -> DataFrame:
    return picks.join(ads.drop("ad_group_id"), "creative_id").groupBy("pick_no", "creative_id").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.round(100 * ratio(F.sum("clicks"), F.sum("impressions")), 2).alias("ctr_pct"),
        F.round(F.sum("cost").cast("double")).alias("cost_twd"))


def repeat_after_success(log: DataFrame, success: Column, keys: Sequence[str]) -> DataFrame:
    """Rows asked again although another run had already succeeded.

    Per key the earliest success, and the earliest success of any other run, decide it: no self join of the log.
    """
    per_run = log.where(success).groupBy(*keys, "run_id").agg(F.min("created_us").alias("t"))
    first = per_run.groupBy(*keys).agg(F.min(F.struct("t", "run_id")).alias("first"))
    second = per_run.join(first, list(keys)).where(F.col("run_id") != F.col("first.run_id")).groupBy(*keys).agg(F.min("t").alias("other_t"))
    known = first.join(second, list(keys), "left")
    earliest = F.when(F.col("run_id") != F.col("first.run_id"), F.col("first.t")).otherwise(F.col("other_t"))
    return log.join(known, list(keys)).where(earliest < F.col("created_us")).drop("first", "other_t")


def check_features_log(log: DataFrame, picked: DataFrame, ledger: DataFrame, items: object, job: str, expected_items: Column | None = None) -> DataFrame:
    """R-17: checks of a reply log and its mart."""
    c = F.col
    struct = lambda df, **a: df.agg(F.struct(*[x.alias(k) for k, x in a.items()])).scalar()
    done = lambda r: F.count_distinct(F.when(complete() & (c("resolution") == r), c("creative_id")))
    empty = (c("status") == "") & ~complete()
    runs = log.select("run_id").distinct()
    used = ledger.where(c("job") == job).join(runs, "run_id", "left_semi")
    lo = log.where("resolution = 'low' and status = '' and prompt_tokens is not null").groupBy("creative_id").agg(F.min("prompt_tokens").alias("lo"))
    hi = log.where("resolution = 'default' and method = 'output_schema' and status = ''").groupBy("creative_id").agg(F.min("prompt_tokens").alias("hi"))
    again = repeat_after_success(log, complete(), ["creative_id", "resolution", "method"])
    facts = one_row(
        log.sparkSession, k=struct(log, n=count_rows(), d=done("default"), lo=done("low"), empty=F.count_if(empty), cap=F.count_if(c("output_tokens") >= OUTPUT_CAP),
                                   nou=F.count_if((c("status") == "") & c("prompt_tokens").isNull())),
        f=struct(picked, n=count_rows(), off=F.count_if(~c("in_option"))), u=struct(used, n=count_rows()), r=struct(lo.join(hi, "creative_id"), n=count_rows(), low=F.count_if(c("lo") < c("hi"))), a=struct(again, n=count_rows()))
    i = F.lit(str(items))
    return check_rows(facts, [
        ("01 default resolution done", i, c("k.d")), ("02 low resolution done", i, c("k.lo")), ("03 mart one row per image", i, c("f.n")), ("04 mart off-option", "0", c("f.off")),
        ("05 missing field in success rows", "0", c("k.empty")), ("06 hit output cap", "0", c("k.cap")), ("07 missing token usage", "0", c("k.nou")),
        ("08 every call in the ledger", c("k.n"), c("u.n")), ("09 low resolution cheaper", c("r.n"), c("r.low")), ("10 no repeat call after success", "0", c("a.n"))])


def check_structured_log(log: DataFrame, rounds: Sequence[str], images: int) -> DataFrame:
    c = F.col
    per = log.groupBy("round").agg(F.count_distinct("creative_id").alias("images"))
    missing = F.lit(False)
    for f in FIELDS:
        missing = missing | c(f).isNull()
    off = F.coalesce(~in_option(), F.lit(False)) & (c("method") == "response_schema")
    struct = lambda df, **a: df.agg(F.struct(*[x.alias(k) for k, x in a.items()])).scalar()
    facts = one_row(log.sparkSession, m=struct(log, n=count_rows(), rounds=F.count_distinct("round"), err=F.count_if(c("status") != ""), missing=F.count_if(missing | (c("headline") == "")),
                                               nou=F.count_if(c("prompt_tokens").isNull()), cap=F.count_if(c("output_tokens") >= OUTPUT_CAP), off=F.count_if(off)),
                    b=struct(per, n=F.count_if(c("images") != images)))
    return check_rows(facts, [("1 rounds", str(len(rounds)), c("m.rounds")), ("2 every round all images", "0", c("b.n")), ("3 api_error", "0", c("m.err")), ("4 missing field", "0", c("m.missing")),
                              ("5 off-option (enum rounds)", "0", c("m.off")), ("6 missing token usage", "0", c("m.nou")), ("7 hit output cap", "0", c("m.cap"))])


def run_summary(log: DataFrame, by: Sequence[str], run_id: str | None = None) -> DataFrame:
    """R-18."""
    used = log if run_id is None else log.where(F.col("run_id") == run_id)
    return used.groupBy(*by).agg(count_rows().alias("calls"), F.count_if(F.col("status") == "").alias("ok"), F.count_if(F.col("status") != "").alias("failed"),
                                 F.sum("prompt_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def usage_overview(ledger: DataFrame) -> DataFrame:
    """R-19."""
    return ledger.groupBy("day", "job", "model", "endpoint_type", "media_resolution").agg(count_rows().alias("calls"), F.sum("prompt_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def prompt_version(text: str | Column) -> Column:
    """R-30: content hash of a prompt."""
    return F.md5(F.lit(text) if isinstance(text, str) else text)


def require_prompt_version(df: DataFrame, prompt: str, recorded: str) -> DataFrame:
    """Fails when the prompt is not the one recorded."""
    same = F.md5(F.lit(prompt)) == recorded
    return df.where(F.assert_true(same, F.lit("the prompt differs from the recorded one")).isNull())


# ---- drafts ---------------------------------------------------------------------------------------------------------------

def lift_table_text(lift: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """R-20: one line per feature with both lifts and the interval, marked when the interval contains 1 (a handful of features)."""
    c = F.col
    pick = lambda m, x: F.max(F.when(c("metric") == m, c(x)))
    per = lift.groupBy("attr").agg(pick("ctr", "stratified").alias("ctr"), pick("cvr", "stratified").alias("cvr"), pick("cvr", "ci95_low").alias("lo"), pick("cvr", "ci95_high").alias("hi"))
    name = c("attr")
    for k, v in (names or {}).items():
        name = F.when(c("attr") == k, v).otherwise(name)
    r = lambda x: F.round(x, 2)
    note = F.when((r("lo") <= 1) & (r("hi") >= 1), "，區間包含 1，看不出差別").otherwise("")
    line = F.format_string("%s：點擊率 %.2f 倍，轉換率 %.2f 倍（95%% 信賴區間 %.2f–%.2f%s）", name, r("ctr"), r("cvr"), r("lo"), r("hi"), note)
    lines = F.array_sort(F.collect_list(F.struct((-c("ctr")).alias("o"), line.alias("t"))))
    return per.agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("lift_text"))


def lowest_ctr_targets(perf: DataFrame, features: DataFrame, creatives: DataFrame, n: int = 3, audience: str = "prospecting") -> DataFrame:
    """R-21: the n images with the lowest click rate; a top-n, not a global window."""
    low = perf.where(F.col("audience") == audience).select("creative_id", "channel", "ctr").orderBy("ctr", "creative_id").limit(n)
    f = features.select("creative_id", *FIELDS[:4], F.col("headline").alias("old_headline"))
    return low.join(f, "creative_id", "left").join(creatives.select("creative_id", "product_focus"), "creative_id")


def render_draft_prompt(targets: DataFrame, facts: DataFrame, lift_text: Column, versions: Mapping[str, str], samples: Sequence[int] = (1, 2), item: str = "item_id") -> DataFrame:
    """R-22: the prompt of every target x version x sample."""
    c = F.col
    grid = request_grid(targets.join(facts, targets.product_focus == facts[item]), {"version": list(versions), "sample": list(samples)})
    rules = F.lit("")
    for v, t in versions.items():
        rules = F.when(c("version") == v, t).otherwise(rules)
    prompt = F.concat(F.format_string("商品資料：%s。\n這張圖投放在 %s，點擊率 %.2f%%。\n", F.coalesce("facts", F.lit("")), "channel", F.round(100 * c("ctr"), 2)),
                      lift_text, F.lit("\n"), rules)
    return grid.select("creative_id", "version", "sample", prompt.alias("prompt"))


def draft_ok() -> Column:
    ok = (F.col("status") == "") & (F.coalesce("headline", F.lit("")) != "") & F.col("cta_text").isNotNull() & F.col("has_person").isNotNull() & F.col("cited_ratio").isNotNull()
    return F.coalesce(ok & in_option() & F.col("cited_feature").isin(list(CITED)) & (F.col("method") == "response_schema"), F.lit(False))


# Fixed value: words in an expected effect that promise sales.
SALES_WORDS = "轉換|成交|銷售|銷量|業績|營收|下單|購買|訂單|回購|買氣"
PUFFERY = "極致|強效|黃金|日本級"


def draft_text() -> Column:
    return F.concat_ws(" ", "headline", F.coalesce("subhead", F.lit("")), F.coalesce("badge", F.lit("")), "cta_text")


def draft_mart(log: DataFrame, features: DataFrame, lift: DataFrame, terms: Sequence[tuple[str, str]] = tx.CLAIM_TERMS) -> DataFrame:
    """R-24: latest good draft per image, version and sample, with the old features, what changed, whether the cited ratio is right and the
    banned terms it contains."""
    c = F.col
    ok = latest_success(log, draft_ok(), ["creative_id", "version", "sample"])
    r2 = lambda m: F.round(F.max(F.when(c("metric") == m, c("stratified"))), 2)
    table = lift.groupBy(c("attr").alias("cited_feature")).agg(r2("ctr").alias("table_ctr"), r2("cvr").alias("table_cvr"))
    old = features.select("creative_id", *[c(f).alias(f"old_{f}") for f in FIELDS])
    text = draft_text()
    hits = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.struct(F.lit(t).alias("term"), F.lit(k).alias("kind"))) for t, k in terms]))
    said = F.round("cited_ratio", 2)
    match = F.when(c("table_ctr").isNull() & c("table_cvr").isNull(), "unknown_feature").when((c("table_ctr") == c("table_cvr")) & (said == c("table_ctr")), "ctr_or_cvr") \
        .when(said == c("table_ctr"), "ctr").when(said == c("table_cvr"), "cvr").otherwise("none")
    sorted_of = lambda x: F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h[x])))
    return ok.join(old, "creative_id").join(table, "cited_feature", "left").withColumn("_hits", hits).withColumns({
        "added_person": c("has_person") & ~c("old_has_person"),
        "moved_cta": (c("cta_position") == "bottom_right") & (c("old_cta_position") != "bottom_right"),
        "turned_warm": (c("dominant_color") == "warm") & (c("old_dominant_color") != "warm"),
        "in_option": F.lit(True), "cited_match": match, "claim_terms": sorted_of("term"), "claim_kinds": sorted_of("kind"),
        "mentions_sales": F.coalesce("expected_effect", F.lit("")).rlike(SALES_WORDS)}).drop("_hits", "table_cvr")


def draft_summary(drafts: DataFrame) -> DataFrame:
    return drafts.groupBy("version").agg(count_rows().alias("drafts"), F.count_if(F.size("claim_terms") > 0).alias("with_claims"), F.count_if(F.col("cited_match") == "ctr").alias("cited_ctr_ok"))


def draft_list(drafts: DataFrame) -> DataFrame:
    """R-25."""
    return drafts.select("version", "creative_id", "sample", "headline", "subhead", F.char_length("headline").alias("h_len"), F.char_length("subhead").alias("s_len"), "has_person",
                         "cta_position", "dominant_color", "text_density", "cited_feature", "cited_ratio", "cited_match", F.array_join("claim_terms", "、").alias("claims"))


def draft_changes(drafts: DataFrame) -> DataFrame:
    """Changed out of possible, per version."""
    of = lambda a, b: F.concat_ws("/", F.count_if(a).cast("string"), F.count_if(b).cast("string"))
    c = F.col
    return drafts.groupBy("version").agg(
        count_rows().alias("drafts"), of(c("added_person"), ~c("old_has_person")).alias("added_person"), of(c("moved_cta"), c("old_cta_position") != "bottom_right").alias("moved_cta"),
        of(c("turned_warm"), c("old_dominant_color") != "warm").alias("turned_warm"), F.count_if(c("text_density") == "high").alias("text_high"))


def cited_values(drafts: DataFrame) -> DataFrame:
    """Distinct cited ratios per feature; ratios have two decimals, so the list is short."""
    return drafts.groupBy("version", "cited_feature", "cited_match").agg(
        count_rows().alias("drafts"), F.array_join(F.array_sort(F.collect_set(F.format_string("%.2f", F.col("cited_ratio")))), "、").alias("cited_values"), F.min("table_ctr").alias("table_ctr"))


def term_counts(drafts: DataFrame, terms: Sequence[tuple[str, str]] = tx.CLAIM_TERMS) -> DataFrame:
    """Drafts with banned terms and how often each occurs, per version (at most one entry per term of the fixed list)."""
    kinds = F.create_map(*[F.lit(x) for t, k in terms for x in (t, k)])
    n = drafts.select("version", F.explode("claim_terms").alias("term")).groupBy("version", "term").agg(count_rows().alias("n"))
    entry = F.format_string("%s:%s×%d", kinds[F.col("term")], "term", "n")
    joined = n.groupBy("version").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "term", entry.alias("t")))), lambda x: x["t"]), "、").alias("terms"))
    per = drafts.groupBy("version").agg(count_rows().alias("drafts"), F.count_if(F.size("claim_terms") > 0).alias("drafts_with_claims"))
    return per.join(joined, "version", "left")


def puffery_words(drafts: DataFrame, pattern: str = PUFFERY) -> DataFrame:
    """Exaggerating words per version, and drafts that promise the ratio of the table."""
    found = drafts.withColumn("found", F.regexp_extract_all(draft_text(), F.lit(pattern), 0))
    promise = F.contains(F.coalesce("expected_effect", F.lit("")), F.format_string("%.2f", "table_ctr")) & F.col("table_ctr").isNotNull()
    return found.groupBy("version").agg(
        count_rows().alias("drafts"), F.count_if(F.size("found") > 0).alias("drafts_with_puffery"), F.count_if(promise).alias("promises_ratio"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort(F.array_distinct("found")))))), "、").alias("words"))


def claim_hits_by_lexicon(drafts: DataFrame, lexicons: Mapping[str, Sequence[tuple[str, str]]]) -> DataFrame:
    """R-26: normalised matching with several word lists; versions without a hit stay in the table."""
    hits = F.array(*[F.struct(F.lit(n).alias("lexicon"), F.transform(tx.find_claims(draft_text(), t), lambda x: x["term"]).alias("terms")) for n, t in lexicons.items()])
    long = drafts.select("version", "creative_id", "sample", F.inline(hits))
    words = long.select("lexicon", "version", F.explode("terms").alias("t")).groupBy("lexicon", "version").agg(F.array_join(F.array_sort(F.collect_set("t")), "、").alias("terms_found"))
    per = long.groupBy("lexicon", "version").agg(count_rows().alias("drafts"), F.count_if(F.size("terms") > 0).alias("drafts_flagged"))
    return per.join(words, ["lexicon", "version"], "left")


def check_drafts(log: DataFrame, drafts: DataFrame, ledger: DataFrame, job: str, targets: DataFrame) -> DataFrame:
    c = F.col
    keys = ["creative_id", "version", "sample"]
    ok = log.where(draft_ok()).select(*keys).distinct()
    never = log.join(ok, keys, "left_anti")
    off = (c("status") == "") & c("headline").isNotNull() & ~F.coalesce(in_option() & c("cited_feature").isin(list(CITED)), F.lit(False))
    struct = lambda df, **a: df.agg(F.struct(*[x.alias(k) for k, x in a.items()])).scalar()
    used = ledger.where(c("job") == job).join(log.select("run_id").distinct(), "run_id", "left_semi")
    facts = one_row(
        log.sparkSession, o=struct(ok, n=count_rows()), d=struct(drafts, n=count_rows(), tokens=F.count_if(c("prompt_tokens").isNull() | c("output_tokens").isNull())),
        t=struct(targets.select("creative_id").subtract(drafts.select("creative_id")), n=count_rows()),
        x=struct(never, off=F.count_if(off), cut=F.count_distinct(F.when(c("finish_reason") == "MAX_TOKENS", F.struct(*keys)))),
        u=struct(used, n=count_rows()), l=struct(log, n=count_rows()))
    return check_rows(facts, [
        ("01 targets without a draft", "0", c("t.n")), ("02 drafts = successful combinations", c("o.n"), c("d.n")), ("03 out of options and never fixed", "0", c("x.off")),
        ("04 token counts recorded", "0", c("d.tokens")), ("05 ledger rows = log rows", c("l.n"), c("u.n")), ("06 cut by output cap and never fixed", "0", c("x.cut"))])
