"""Usage ledger with effective-dated prices, and the economics of prompt caching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.checks import check_rows, one_row, union_all
from ..functions.exprs import count_rows, local_date, ratio, within_local_days
from .replies import TWD

PRICE_SCHEMA = "model string, endpoint_type string, valid_from date, valid_to date, usd_in_per_m decimal(18,6), usd_out_per_m decimal(18,6), note string"
ENDPOINTS = ("global", "non-global")


def price_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """U-01: unit prices per model, endpoint and period; a short reference table handed in by the caller."""
    return spark.createDataFrame(list(rows), PRICE_SCHEMA)


def usage_calls(ledger: DataFrame, prices: DataFrame, tz: str = "Asia/Taipei", twd: float = TWD) -> DataFrame:
    """U-02: every call with its local date and the price valid on that date; calls without a price stay, unpriced.

    An equi join on model and endpoint with the date range as residual; the price table decides by its size whether it is broadcast.
    """
    c = F.col
    u = ledger.withColumn("usage_date", local_date("logged_us", tz))
    p = prices.drop("note").withColumn("priced", F.lit(True)).withColumnsRenamed({"model": "p_model", "endpoint_type": "p_endpoint"})
    on = (c("model") == c("p_model")) & (c("endpoint_type") == c("p_endpoint")) & c("usage_date").between(c("valid_from"), c("valid_to"))
    i, o = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    usd_in, usd_out = i * c("usd_in_per_m").cast("double") / 1e6, o * c("usd_out_per_m").cast("double") / 1e6
    return u.join(p, on, "left").select(
        "logged_us", "usage_date", "day", "job", "run_id", "model", "endpoint_type", "media_resolution", "item_id", F.when(c("status") == "", "ok").otherwise("failed").alias("call_result"), "status",
        i.alias("prompt_tokens"), o.alias("output_tokens"), F.coalesce("priced", F.lit(False)).alias("priced"), (usd_in * twd).alias("cost_in_twd"), (usd_out * twd).alias("cost_out_twd"),
        (usd_in + usd_out).alias("cost_usd"), ((usd_in + usd_out) * twd).alias("cost_twd"))


def usage_daily(calls: DataFrame) -> DataFrame:
    """U-03."""
    c = F.col
    return calls.groupBy("usage_date", "day", "job", "model", "endpoint_type", "priced").agg(
        count_rows().alias("calls"), F.count_if(c("call_result") == "failed").alias("failed_calls"), F.count_if(~c("priced")).alias("unpriced_calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum(c("prompt_tokens") + c("output_tokens")).alias("total_tokens"), *[F.sum(x).alias(x) for x in ("cost_in_twd", "cost_out_twd", "cost_usd", "cost_twd")])


def _total(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def usage_per_article(daily: DataFrame) -> DataFrame:
    """U-04."""
    return daily.groupBy("day").agg(*_total("calls", "failed_calls", "prompt_tokens", "output_tokens"), F.round(F.sum("cost_twd"), 2).alias("cost_twd"), *_total("unpriced_calls"))


def usage_per_day(daily: DataFrame) -> DataFrame:
    return daily.groupBy("usage_date").agg(*_total("calls", "total_tokens"), F.round(F.sum("cost_twd"), 2).alias("cost_twd"), *_total("unpriced_calls"))


def usage_per_model(daily: DataFrame) -> DataFrame:
    return daily.groupBy("model", "endpoint_type").agg(
        *_total("calls", "prompt_tokens", "output_tokens"), F.round(F.sum("cost_twd"), 2).alias("cost_twd"),
        F.round(ratio(F.sum("output_tokens"), F.sum("total_tokens")), 3).alias("output_share_of_tokens"), F.round(ratio(F.sum("cost_out_twd"), F.sum("cost_twd")), 3).alias("output_share_of_cost"))


def unpriced(daily: DataFrame) -> DataFrame:
    return daily.where(~F.col("priced")).groupBy("day", "job", "model", "endpoint_type").agg(*_total("calls", "prompt_tokens", "output_tokens"))


def overlapping_periods(prices: DataFrame) -> DataFrame:
    """How many pairs of price periods of one model and endpoint share a day (identical rows included).

    A sweep over starts and ends: a period overlaps as many earlier ones as have started and not yet ended, so pairs are counted
    without being formed.
    """
    keys = ["model", "endpoint_type"]
    marks = prices.select(*keys, F.inline(F.array(F.struct(F.col("valid_from").alias("d"), F.lit(0).alias("is_end")), F.struct(F.col("valid_to").alias("d"), F.lit(1).alias("is_end")))))
    before = Window.partitionBy(*keys).orderBy("d", "is_end").rowsBetween(Window.unboundedPreceding, -1)
    still_open = F.coalesce(F.sum(1 - 2 * F.col("is_end")).over(before), F.lit(0))
    return marks.withColumn("open", still_open).where("is_end = 0").groupBy(*keys).agg(F.sum("open").alias("pairs")).where("pairs > 0")


def check_usage(ledger: DataFrame, prices: DataFrame, calls: DataFrame, daily: DataFrame) -> DataFrame:
    """U-05: twelve checks: nothing lost or doubled by the price join, periods disjoint, costs add up."""
    c = F.col
    struct = lambda df, **a: df.agg(F.struct(*[x.alias(k) for k, x in a.items()])).scalar()
    z = lambda x: F.coalesce(F.sum(x), F.lit(0))
    facts = one_row(
        ledger.sparkSession,
        u=struct(ledger, n=count_rows(), i=z("prompt_tokens"), o=z("output_tokens"), ep=F.count_if(~F.coalesce(c("endpoint_type").isin(list(ENDPOINTS)), F.lit(False))), day=F.count_if(F.coalesce("day", F.lit("")) == "")),
        k=struct(calls, n=count_rows(), np=F.count_if(~c("priced") & (c("prompt_tokens") + c("output_tokens") > 0)), bad=F.count_if(c("priced") & (c("cost_twd").isNull() | (c("cost_twd") < 0))), un=F.count_if(~c("priced"))),
        d=struct(daily, n=z("calls"), i=z("prompt_tokens"), o=z("output_tokens"), un=z("unpriced_calls"), gap=F.abs(z("cost_in_twd") + z("cost_out_twd") - z("cost_twd"))),
        o=struct(overlapping_periods(prices), n=F.coalesce(F.sum("pairs"), F.lit(0))))
    true = F.lit("true")
    return check_rows(facts, [
        ("01 usage table has rows", true, c("u.n") > 0), ("02 calls = usage rows", c("u.n"), c("k.n")), ("03 daily calls = usage rows", c("u.n"), c("d.n")),
        ("04 daily input tokens", c("u.i"), c("d.i")), ("05 daily output tokens", c("u.o"), c("d.o")), ("06 price periods overlapping", "0", c("o.n")),
        ("07 calls with tokens but no price", "0", c("k.np")), ("08 unknown endpoint", "0", c("u.ep")), ("09 negative or null cost on priced calls", "0", c("k.bad")),
        ("10 rows without a day label", "0", c("u.day")), ("11 unpriced calls", c("k.un"), c("d.un")), ("12 input + output cost = cost", true, c("d.gap") < 0.0001)])


def spend_between(ledger: DataFrame, job: str, first: Column, last: Column, price_in: float, price_out: float, tz: str = "Asia/Taipei", twd: float = TWD, partition: str | None = None) -> DataFrame:
    """U-06: cost of one job from one local date to another; the dates become bounds on ``logged_us`` and on ``partition``, if the table has one."""
    used = ledger.where((F.col("job") == job) & within_local_days("logged_us", first, last, tz, partition))
    return used.agg(F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens")).withColumn(
        "spent_twd", (F.col("prompt_tokens") * price_in + F.col("output_tokens") * price_out) / 1e6 * twd)


def spend_today(ledger: DataFrame, job: str, today: Column, price_in: float, price_out: float, tz: str = "Asia/Taipei", twd: float = TWD, partition: str | None = None) -> DataFrame:
    """U-06: today's cost of one job; ``today`` is a date column or literal, by default the caller's local date."""
    return spend_between(ledger, job, today, today, price_in, price_out, tz, twd, partition)


# ---- prompt caching -------------------------------------------------------------------------------------------------------

SCENARIOS = ("old", "new", "explicit")
CACHE_PRICE = {"input": 0.30, "cached": 0.03, "output": 2.50, "storage_hour": 1.00}  # fixed values, USD per million tokens


def shared_context_text(products: DataFrame, dates: DataFrame, creatives: DataFrame, ads: DataFrame, opening: str, start: date, end: date) -> DataFrame:
    """H-01: the fixed part of the prompt: products, promotion windows, creatives and weekly figures of the ad groups as one text.

    Each list has one line per dimension row or week, so the text grows with the dimensions, not with the facts.
    """
    c = F.col
    dash = lambda x: F.coalesce(c(x).cast("string"), F.lit("-"))
    pipe = lambda *x: F.concat_ws("|", *x)

    def text(df: DataFrame, order: Sequence[str], line: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("t"))))
        return df.agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n")).scalar()

    prod = text(products, ["item_id"], pipe(c("item_id"), dash("unit_price"), c("first_seen_date").cast("string")))
    windows = dates.select("date", F.explode("promotion_ids").alias("p")).groupBy("p").agg(F.min("date").alias("mn"), F.max("date").alias("mx"))
    promo = text(windows, ["p"], F.format_string("%s：%s 到 %s", "p", c("mn").cast("string"), c("mx").cast("string")))
    cr = text(creatives, ["creative_id"], pipe(c("creative_id"), c("channel"), c("ad_group_id"), *[dash(x) for x in ("audience", "format", "start_date", "end_date", "product_focus")]))
    wk = ads.where(c("date").between(F.lit(start), F.lit(end))).groupBy("ad_group_id", F.trunc("date", "week").alias("w")).agg(
        F.count_distinct("date").alias("d"), F.sum("clicks").alias("clk"), F.sum("impressions").alias("imp"), F.sum("cost").alias("cost"))
    shown = lambda f, x: F.when(x.isNotNull(), F.format_string(f, x)).otherwise("-")
    weekly = text(wk, ["ad_group_id", "w"], pipe(c("ad_group_id"), c("w").cast("string"), c("d").cast("string"), F.coalesce("clk", F.lit(0)).cast("string"),
                                                 shown("%.2f", F.round(100 * ratio("clk", "imp"), 2)), shown("%.1f", F.round(ratio("cost", "clk"), 1))))
    parts = ["\n\n【背景一】商品清單（商品|定價元|第一次出現）\n", prod, "\n\n【背景二】專案檔期\n", promo, "\n\n【背景三】素材清單（素材|通路|廣告群組|受眾|格式|上線日|下檔日|主打商品）\n", cr,
             "\n\n【背景四】各廣告群組每週成效（廣告群組|週一日期|有資料天數|點擊|點擊率%|每次點擊花費元）\n", weekly]
    return products.sparkSession.range(1).select(F.concat(F.lit(opening), *[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("context"))


def context_questions(facts: DataFrame) -> DataFrame:
    return facts.select("anomaly_id", "level", "entity", "period_start", F.concat(F.lit("【這次要判斷的異常】\n"), "facts").alias("question"))


def cache_hit_report(runs: DataFrame, by_round: bool = True, scenarios: Sequence[str] = SCENARIOS, twd: float = TWD) -> DataFrame:
    """H-02: calls, hits, cached share and cost per scenario (and round); cached input is a tenth of the price."""
    i, h, o, p = F.sum("prompt_tokens"), F.sum("cached_tokens"), F.sum("output_tokens"), CACHE_PRICE
    input_usd = ((i - h) * p["input"] + h * p["cached"]) / 1e6
    output_usd = o * p["output"] / 1e6
    keys = ["scenario", "round"] if by_round else ["scenario"]
    return runs.where(F.col("scenario").isin(list(scenarios))).groupBy(*keys).agg(
        count_rows().alias("calls"), F.count_if(F.col("cached_tokens") > 0).alias("hit_calls"), i.alias("input_tokens"), h.alias("cached_tokens"), F.round(100 * ratio(h, i), 1).alias("cached_pct"),
        o.alias("output_tokens"), F.round(input_usd * twd, 3).alias("input_twd"), F.round(output_usd * twd, 3).alias("output_twd"), F.round((input_usd + output_usd) * twd, 3).alias("twd"))


def breakeven_calls(df: DataFrame, ttl: str = "ttl_minutes") -> DataFrame:
    """H-03: calls after which an explicit cache that lives ``ttl`` minutes pays off."""
    p = CACHE_PRICE
    return df.select(ttl, F.round((p["input"] + p["storage_hour"] * F.col(ttl) / 60) / (p["input"] - p["cached"]), 1).alias("breakeven_calls"))


def check_cache_runs(runs: DataFrame, answers: Mapping[str, str], causes: Sequence[str], per_scenario: int, min_cached: int = 4096) -> DataFrame:
    """H-04: rows, errors, causes from the list, answers as keyed by entity, hits."""
    c = F.col
    key = F.get(F.split("anomaly_id", r"\|"), F.lit(1))
    right = F.lit(None).cast("string")
    for entity, cause in answers.items():
        right = F.when(key == entity, cause).otherwise(right)
    per = runs.where(c("scenario").isin(list(SCENARIOS))).groupBy("scenario").agg(
        count_rows().alias("rows"), F.count_if(c("status") != "").alias("api_error"), F.count_if(~F.coalesce(c("cause").isin(list(causes)), F.lit(False))).alias("bad_cause"),
        F.count_if(c("cause") != right).alias("wrong_answer"), F.count_if(c("cached_tokens") > 0).alias("hits"), F.min("cached_tokens").alias("min_cached"))
    judged = lambda n, name, e, a, ok: F.struct(F.concat(F.lit(f"{n} "), "scenario", F.lit(f" {name}")).alias("check_name"), F.lit(e).alias("expected"), a.cast("string").alias("actual"), F.when(ok, "OK").otherwise("DIFF").alias("ok"))
    base = [judged(1, "rows", str(per_scenario), c("rows"), c("rows") == per_scenario)] + [judged(n, x, "0", c(x), c(x) == 0) for n, x in ((2, "api_error"), (3, "bad_cause"), (4, "wrong_answer"))]
    old = per.where("scenario = 'old'").select(F.inline(F.array(judged(5, "hits", "0", c("hits"), c("hits") == 0))))
    exp = per.where("scenario = 'explicit'").select(F.inline(F.array(judged(6, "hits", str(per_scenario), c("hits"), c("hits") == per_scenario),
                                                                     judged(7, "min_cached", f">={min_cached}", c("min_cached"), c("min_cached") >= min_cached))))
    return union_all([per.select(F.inline(F.array(*base))), old, exp])
