"""Weekly and daily performance anomalies, their text form, and the diagnoses that come back for them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.checks import check_rows, union_all
from ..functions.exprs import expand_once, monday, ratio

TRAILING_WEEKS = 4
TRAILING_DAYS = 7


def _in_period(df: DataFrame, column: str, start: date | None, end: date | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end))
    return df


def _before(keys: Sequence[str], order: str, rows: int) -> Window:
    """Trailing rows without the current one. Applied to aggregates with one row per key and week (or day)."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, -1)


def channel_of(mapping: Mapping[tuple[str, str], str]) -> Column:
    out = F.lit(None).cast("string")
    for (source, medium), channel in mapping.items():
        out = F.when((F.col("utm_source") == source) & (F.col("utm_medium") == medium), channel).otherwise(out)
    return out


def channel_week_roas(events: DataFrame, ads: DataFrame, mapping: Mapping[tuple[str, str], str], start=None, end=None) -> DataFrame:
    """D-01: tracked revenue over cost per channel and week, and over the four previous weeks."""
    bought = _in_period(events, "event_dt", start, end).where("event_name = 'purchase' and data_source = 'synthetic'")
    rev = bought.groupBy(channel_of(mapping).alias("channel"), monday("event_dt").alias("wk")).agg(F.sum("value").alias("rev"))
    cost = _in_period(ads, "date", start, end).groupBy("channel", monday("date").alias("wk")).agg(F.sum("cost").alias("cost"))
    w = _before(["channel"], "wk", TRAILING_WEEKS)
    return cost.join(rev, ["channel", "wk"], "left").select(
        "channel", "wk", ratio("rev", "cost").alias("roas"), ratio(F.sum("rev").over(w), F.sum("cost").over(w)).alias("roas_base"))


def adgroup_week(ads: DataFrame, start=None, end=None) -> DataFrame:
    """D-02: weekly figures per ad group with trailing baselines."""
    week = _in_period(ads, "date", start, end).groupBy("ad_group_id", monday("date").alias("wk")).agg(
        F.min("channel").alias("channel"), F.count_distinct("date").alias("days"), F.sum("impressions").alias("imp"),
        F.sum("clicks").alias("clk"), F.sum("cost").alias("cost"))
    w = _before(["ad_group_id"], "wk", TRAILING_WEEKS)
    s = {c: F.sum(c).over(w) for c in ("clk", "imp", "cost", "days")}
    return week.withColumns({
        "ctr": ratio("clk", "imp"), "cpc": ratio("cost", "clk"), "ctr_base": ratio(s["clk"], s["imp"]),
        "cpc_base": ratio(s["cost"], s["clk"]), "clk_per_day_base": ratio(s["clk"], s["days"]),
        "base_weeks": F.count(F.lit(1)).over(w)})


def _first_period(df: DataFrame) -> DataFrame:
    """Keep the earliest flagged week of each entity."""
    fields = [c for c in df.columns if c not in ("level", "entity")]
    return df.groupBy("level", "entity").agg(F.min_by(F.struct(*fields), "period_start").alias("r")).select("level", "entity", "r.*")


def _pct(now: Column, base: Column) -> Column:
    return F.round(100 * (ratio(now, base) - 1))


def flag_adgroup(week: DataFrame, roas: DataFrame, cpc_change: float = 0.30, ctr_drop: float = -0.20, min_base: int = 2, min_days: int = 3) -> DataFrame:
    """D-03: first week in which the click cost moved by 30 % either way or the click rate fell by 20 %."""
    c = F.col
    hit = (F.abs(ratio("cpc", "cpc_base") - 1) >= cpc_change) | (ratio("ctr", "ctr_base") - 1 <= ctr_drop)
    flagged = week.where((c("base_weeks") >= min_base) & (c("days") >= min_days) & hit)
    r2 = lambda x: F.round(x, 2)
    rows = flagged.join(roas, ["channel", "wk"], "left").select(
        F.lit("adgroup_week").alias("level"), c("ad_group_id").alias("entity"), "channel", c("wk").alias("period_start"),
        F.date_add("wk", 6).alias("period_end"),
        F.struct("days", "imp", "clk", F.round(c("cost").cast("double")).alias("cost"), r2(100 * c("ctr")).alias("ctr_pct"), r2(100 * c("ctr_base")).alias("ctr_base_pct"),
                 r2("cpc").alias("cpc"), r2("cpc_base").alias("cpc_base"), F.round(c("clk") / c("days"), 1).alias("clk_per_day"),
                 F.round("clk_per_day_base", 1).alias("clk_per_day_base"), r2("roas").alias("channel_roas"), r2("roas_base").alias("channel_roas_base")).alias("m"),
        _pct(c("cpc"), c("cpc_base")).alias("cpc_chg_pct"), _pct(c("ctr"), c("ctr_base")).alias("ctr_chg_pct"))
    return _first_period(rows)


def creative_launch_baseline(ads: DataFrame, days: int = 14, start=None, end=None) -> DataFrame:
    """D-04: click rate and cost in the first two weeks of each creative."""
    ads = _in_period(ads, "date", start, end)
    # the launch date comes from an aggregate, not from a window over all of a creative's rows
    launch = ads.groupBy("creative_id").agg(F.min("date").alias("launch"))
    early = ads.join(launch, "creative_id").where(F.col("date") < F.date_add("launch", days))
    return early.groupBy("creative_id").agg(F.min("launch").alias("launch"), ratio(F.sum("clicks"), F.sum("impressions")).alias("ctr_base"),
                                            ratio(F.sum("cost"), F.sum("clicks")).alias("cpc_base"))


def flag_creative(ads: DataFrame, base: DataFrame, ctr_drop: float = -0.25, after_days: int = 14, min_days: int = 3, start=None, end=None) -> DataFrame:
    """D-05: first week, two weeks or more after launch, with a click rate 25 % below the creative's own launch level."""
    c = F.col
    week = _in_period(ads, "date", start, end).groupBy("creative_id", monday("date").alias("wk")).agg(
        F.min("channel").alias("channel"), F.count_distinct("date").alias("days"), F.sum("impressions").alias("imp"),
        F.sum("clicks").alias("clk"), F.sum("cost").cast("double").alias("cost"))
    j = week.join(base, "creative_id").withColumns({"ctr": ratio("clk", "imp"), "cpc": ratio("cost", "clk")})
    flagged = j.where((c("wk") >= F.date_add("launch", after_days)) & (c("days") >= min_days) & (ratio("ctr", "ctr_base") - 1 <= ctr_drop))
    r2 = lambda x: F.round(x, 2)
    rows = flagged.select(
        F.lit("creative_week").alias("level"), c("creative_id").alias("entity"), "channel", c("wk").alias("period_start"),
        F.date_add("wk", 6).alias("period_end"),
        F.struct("days", "imp", "clk", F.round(c("cost").cast("double")).alias("cost"), r2(100 * c("ctr")).alias("ctr_pct"), r2(100 * c("ctr_base")).alias("ctr_base_pct"),
                 r2("cpc").alias("cpc"), r2("cpc_base").alias("cpc_base"), F.datediff("wk", "launch").alias("days_since_launch")).alias("m"),
        _pct(c("cpc"), c("cpc_base")).alias("cpc_chg_pct"), _pct(c("ctr"), c("ctr_base")).alias("ctr_chg_pct"))
    return _first_period(rows)


def site_day(events: DataFrame, orders: DataFrame, ads: DataFrame, start=None, end=None) -> DataFrame:
    """D-06: per day with advertising: tracked purchases against back-office orders, with seven-day trailing averages."""
    tracked = _in_period(events, "event_dt", start, end).where("event_name = 'purchase' and data_source = 'synthetic'") \
        .groupBy(F.col("event_dt").alias("d")).agg(F.count(F.lit(1)).alias("tracked"), F.sum("value").cast("double").alias("tracked_rev"))
    booked = _in_period(orders, "order_date", start, end).groupBy(F.col("order_date").alias("d")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("revenue").cast("double").alias("order_rev"))
    spine = _in_period(ads, "date", start, end).groupBy(F.col("date").alias("d")).agg(
        F.sum("cost").cast("double").alias("cost"), F.sum("clicks").alias("clk"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    day = spine.join(tracked, "d", "left").join(booked, "d", "left").select(
        "d", zero("tracked"), zero("tracked_rev"), zero("orders"), zero("order_rev"), "cost", "clk")
    # one row per calendar day, so the unpartitioned window is bounded by the calendar
    w = Window.orderBy("d").rowsBetween(-TRAILING_DAYS, -1)
    return day.withColumns({f"{c}_base": F.avg(c).over(w) for c in ("tracked", "orders", "clk")} | {"base_days": F.count(F.lit(1)).over(w)})


def flag_site(day: DataFrame, share: float = 0.5, min_base: int = 5) -> DataFrame:
    """D-07: every day on which tracked purchases or orders are at most half of their trailing average."""
    c = F.col
    hit = (c("tracked") <= share * c("tracked_base")) | (c("orders") <= share * c("orders_base"))
    return day.where((c("base_days") >= min_base) & hit).select(
        F.lit("site_day").alias("level"), F.lit("all_site").alias("entity"), F.lit(None).cast("string").alias("channel"),
        c("d").alias("period_start"), c("d").alias("period_end"),
        F.struct("tracked", F.round("tracked_base", 1).alias("tracked_base"), "orders", F.round("orders_base", 1).alias("orders_base"),
                 F.round(ratio("tracked_rev", "cost"), 2).alias("tracked_roas"), F.round(ratio("order_rev", "cost"), 2).alias("order_roas"),
                 "clk", F.round("clk_base").alias("clk_base")).alias("m"),
        F.lit(None).cast("double").alias("cpc_chg_pct"), F.lit(None).cast("double").alias("ctr_chg_pct"))


def anomaly_summary(*flagged: DataFrame) -> DataFrame:
    """D-08: all anomalies in one table; metrics as JSON with NULL fields kept."""
    as_json = [f.withColumn("metrics_json", F.to_json("m", {"ignoreNullFields": "false"})).drop("m") for f in flagged]
    return union_all(as_json).select(
        F.concat_ws("|", "level", "entity", F.col("period_start").cast("string")).alias("anomaly_id"),
        "level", "entity", "channel", "period_start", "period_end", "metrics_json", "cpc_chg_pct", "ctr_chg_pct")


# The wording of the facts, one text per level.
FACTS_ADGROUP = ("對象：廣告群組 %s（通路 %s）\n期間：%s 到 %s，這週有資料 %s 天，對照前四週\n"
                 "- 每天平均點擊：%s 次（前四週 %s 次）\n- 點擊率：%s%%（前四週 %s%%）\n"
                 "- 平均每次點擊花費：%s 元（前四週 %s 元），變化 %s%%\n- 這週花費：%s 元\n- 同通路的網站追蹤 ROAS：%s（前四週 %s）")
FACTS_CREATIVE = ("對象：廣告素材 %s（通路 %s）\n期間：%s 到 %s，這週有資料 %s 天，素材已上線 %s 天，對照素材上線頭 14 天\n"
                  "- 曝光：%s 次，點擊：%s 次\n- 點擊率：%s%%（上線頭 14 天 %s%%），變化 %s%%\n"
                  "- 平均每次點擊花費：%s 元（上線頭 14 天 %s 元）\n- 這週花費：%s 元")
FACTS_SITE = ("對象：全站\n期間：%s 單日，對照前七天平均\n- 網站追蹤到的購買：%s 筆（前七天平均 %s 筆）\n"
              "- 後台成立的訂單：%s 筆（前七天平均 %s 筆）\n- 廣告點擊：%s 次（前七天平均 %s 次）\n"
              "- 用網站追蹤營收算的 ROAS：%s，用後台訂單營收算的 ROAS：%s")
NO_DATA = "無資料"


def _strict_format(template: str, *args: Column) -> Column:
    """Like ``format_string``, but NULL as soon as one argument is NULL."""
    missing = F.exists(F.array(*[a.cast("string") for a in args]), lambda x: x.isNull())
    return F.when(~missing, F.format_string(template, *args))


def render_facts(summary: DataFrame) -> DataFrame:
    """D-09: the numbers of each anomaly as a short text."""
    j = lambda k: F.get_json_object("metrics_json", f"$.{k}")
    signed = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%+.0f", F.col(c)))
    whole = F.format_string("%.0f", j("cost").try_cast("double"))
    known = lambda k: F.coalesce(j(k), F.lit(NO_DATA))
    d = lambda c: F.col(c).cast("string")
    head = [F.col("entity"), F.col("channel"), d("period_start"), d("period_end"), j("days")]
    adgroup = _strict_format(FACTS_ADGROUP, *head, j("clk_per_day"), j("clk_per_day_base"), j("ctr_pct"), j("ctr_base_pct"), j("cpc"),
                             j("cpc_base"), signed("cpc_chg_pct"), whole, known("channel_roas"), known("channel_roas_base"))
    creative = _strict_format(FACTS_CREATIVE, *head, j("days_since_launch"), j("imp"), j("clk"), j("ctr_pct"), j("ctr_base_pct"),
                              signed("ctr_chg_pct"), j("cpc"), j("cpc_base"), whole)
    site = _strict_format(FACTS_SITE, d("period_start"), j("tracked"), j("tracked_base"), j("orders"), j("orders_base"), j("clk"), j("clk_base"),
                          j("tracked_roas"), j("order_roas"))
    facts = F.when(F.col("level") == "adgroup_week", adgroup).when(F.col("level") == "creative_week", creative).when(F.col("level") == "site_day", site)
    return summary.select("anomaly_id", "level", "entity", "period_start", facts.alias("facts"))


def render_prompt(facts: DataFrame, before: str, after: str) -> DataFrame:
    return facts.withColumn("prompt", F.concat(F.lit(before), F.lit("\n\n"), "facts", F.lit("\n\n"), F.lit(after)))


DIAGNOSIS_SCHEMA = "cause string, evidence string, confidence string, next_check string"


def parse_diagnosis(replies: DataFrame, raw: str = "raw_result") -> DataFrame:
    """D-10: fields of each JSON reply; what cannot be read becomes NULL, never an error."""
    parsed = expand_once(replies, F.from_json(raw, DIAGNOSIS_SCHEMA))
    return parsed.withColumn("confidence", F.col("confidence").try_cast("double"))


def check_replies(diagnosis: DataFrame, summary_rows: Column, causes: Sequence[str], models: int = 2) -> DataFrame:
    """D-11: per model: complete, no call errors, readable, cause from the list, confidence in 0..1, evidence given, no thinking."""
    c = F.col
    thought = F.get_json_object("statistics", "$.thoughts_token_count").try_cast("bigint") > 0
    bad = {
        "api_error": F.count_if(c("status") != ""),
        "bad_json": F.count_if(F.try_parse_json("raw_result").isNull()),
        "bad_cause": F.count_if(c("cause").isNull() | ~c("cause").isin(list(causes))),
        "bad_confidence": F.count_if(c("confidence").isNull() | ~c("confidence").between(0, 1)),
        "no_evidence": F.count_if(c("evidence").isNull() | (c("evidence") == "")),
        "used_thinking": F.count_if(thought),
    }
    per = diagnosis.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in bad.items()]).withColumn("wanted", summary_rows)
    judged = lambda name, e, a: F.struct(F.concat(c("model"), F.lit(f" {name}")).alias("check_name"), e.cast("string").alias("expected"),
                                         a.cast("string").alias("actual"), F.when(e == a, "OK").otherwise("DIFF").alias("ok"))
    zero = F.lit(0).cast("bigint")
    rows = per.select(F.inline(F.array(judged("rows", c("wanted"), c("rows")), *[judged(k, zero, c(k)) for k in bad])))
    count = check_rows(diagnosis.agg(F.count_distinct("model").alias("n")), [("models", str(models), c("n"))])
    return count.unionByName(rows)


def models_side_by_side(diagnosis: DataFrame, models: Sequence[str]) -> DataFrame:
    """D-12: one column per model with ``cause（confidence）``, and token sums."""
    text = F.when(F.col("cause").isNotNull() & F.col("confidence").isNotNull(), F.format_string("%s（%.2f）", "cause", "confidence"))
    tokens = lambda k: F.sum(F.get_json_object("statistics", f"$.{k}").try_cast("bigint"))
    return diagnosis.groupBy("entity", "period_start").agg(
        *[F.max(F.when(F.col("model") == m, text)).alias(m) for m in models],
        tokens("prompt_token_count").alias("input_tokens"), tokens("candidates_token_count").alias("output_tokens"))


def promo_share_before_after(orders: DataFrame, products: DataFrame, promotion: str, start: date, end: date, before_days: int = 21) -> DataFrame:
    """D-13: quantity and revenue share of the promoted items in the weeks before and during a promotion."""
    o = _in_period(orders, "order_date", None, end).where(F.col("order_date") >= F.date_sub(F.lit(start), before_days))
    promo = F.array_contains("promotion_ids", promotion)
    period = F.when(F.col("order_date") >= F.lit(start), "2_during").otherwise("1_before")
    part = lambda c: F.sum(F.when(promo, F.col(c)).otherwise(0))
    return o.join(products.select("item_id", "promotion_ids"), "item_id").groupBy(period.alias("period")).agg(
        F.sum("quantity").alias("qty"), part("quantity").alias("promo_qty"),
        F.round(100 * ratio(part("quantity"), F.sum("quantity")), 1).alias("promo_qty_share_pct"),
        F.round(100 * ratio(part("revenue"), F.sum("revenue")), 1).alias("promo_rev_share_pct")).orderBy("period")


def worst_case_cost(tokens: DataFrame, prices: Mapping[str, tuple[float, float]], output_cap: int, overhead: int = 0, twd: float = 32.0) -> DataFrame:
    """D-14: calls, input and largest possible output per model, in USD and TWD, with a total row.

    ``tokens`` has one row per request with its token count; each request goes to every priced model.
    """
    base = tokens.agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("prompt_tokens") + overhead).alias("input_tokens"))
    price_list = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(i)).alias("p_in"), F.lit(float(o)).alias("p_out")) for m, (i, o) in prices.items()])
    per = base.select("calls", "input_tokens", (F.col("calls") * output_cap).alias("max_output_tokens"), F.inline(price_list))
    usd = (F.col("input_tokens") * F.col("p_in") + F.col("max_output_tokens") * F.col("p_out")) / 1e6
    per = per.withColumn("usd", usd)
    total = per.agg(F.lit("total").alias("model"), F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
                    F.sum("max_output_tokens").alias("max_output_tokens"), F.sum("usd").alias("usd"))
    cols = ["model", "calls", "input_tokens", "max_output_tokens", "usd"]
    return per.select(*cols).unionByName(total.select(*cols)).select(
        *cols[:-1], F.round("usd", 4).alias("usd"), F.round(F.col("usd") * twd, 2).alias("twd"))


def compare_prompt_variants(a: DataFrame, b: DataFrame) -> DataFrame:
    """D-16: parsed replies to the forced-choice wording and to the one that allows 'insufficient data', in one table."""
    cols = ["anomaly_id", "model", "cause", "confidence"]
    pick = lambda df, v: parse_diagnosis(df).select(F.lit(v).alias("variant"), *cols)
    return pick(a, "A").unionByName(pick(b, "B"))


def diagnosis_reasons(diagnosis: DataFrame, model: str) -> DataFrame:
    """D-17."""
    return diagnosis.where(F.col("model") == model).select("entity", "period_start", "cause", "evidence", "next_check").orderBy("period_start", "entity")


def diagnosis_lookup(summary: DataFrame, diagnosis: DataFrame, channel: str = "all", skip_model: str | None = None,
                     channels: Sequence[str] | None = None) -> DataFrame:
    """D-15: anomalies of one channel (site-wide ones always) with their diagnosis, long texts trimmed."""
    if channels is not None and channel != "all" and channel not in channels:
        raise ValueError(f"unknown channel {channel}")
    d = diagnosis if skip_model is None else diagnosis.where(F.col("model") != skip_model)
    own = F.nullif(F.col("channel"), F.lit(""))
    s = summary.where(F.lit(channel == "all") | (F.col("channel") == channel) | own.isNull())
    return s.join(d.select("anomaly_id", "cause", "evidence", "confidence"), "anomaly_id", "left").select(
        "anomaly_id", "level", "entity", F.coalesce(own, F.lit("all_site")).alias("channel"), "period_start", "period_end", "cpc_chg_pct", "ctr_chg_pct",
        F.substring("cause", 1, 40).alias("cause"), F.substring("evidence", 1, 120).alias("evidence"), "confidence")
