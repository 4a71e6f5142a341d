"""Scorecards against criteria that were fixed before scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.checks import check_rows, one_row, union_all
from ..functions.exprs import count_rows, monday, ratio, sunday_weeks_between
from .lift import VERDICTS, judge

CRITERIA_SCHEMA = "signal_id string, check_id string, found_by string, method string, rule string, lower_bound double, upper_bound double"

# What is judged and inside which bounds.
CRITERIA = [
    ("S1", "S1a", "Day 09", "SQL", "click cost after the change over click cost before", 1.6, 2.4),
    ("S1", "S1b", "Day 09", "AI", "ad group diagnosed as dearer bidding (1 = yes)", 1.0, 1.0),
    ("S2", "S2a", "Day 09", "SQL", "tracked purchases over orders on the outage day", 0.0, 0.1),
    ("S2", "S2b", "Day 09", "AI", "outage day diagnosed as broken tracking (1 = yes)", 1.0, 1.0),
    ("S3", "S3a", "Day 09", "SQL", "weekly click-rate multiplier of the tired creative, complete weeks", 0.88, 0.96),
    ("S3", "S3b", "Day 09", "AI", "creative diagnosed as tired (1 = yes)", 1.0, 1.0),
    ("S5", "S5a", "Day 11", "ML", "lowest share of a customer type inside clusters where it is the majority", 0.6, 1.0),
    ("S5", "S5b", "Day 12", "ML", "predicted value of the regular type over all others", 1.5, 99.0),
    ("S6", "S6a", "Day 08", "SQL", "first-touch over last-touch credit of the opening channel", 1.2, 99.0),
    ("S6", "S6b", "Day 08", "SQL", "last-touch over first-touch credit of the closing channel", 1.2, 99.0),
    ("S7", "S7a", "Day 09", "SQL", "promoted quantity share during minus before, in points", 5.0, 99.0),
]
CRITERIA_V1_S4 = [("S4", "S4a", "Day 17", "-", "effect of image features on click rate, judged later", None, None)]
CRITERIA_V2_S4 = [
    ("S4", "S4a", "Day 17", "SQL", "stratified click-rate ratio, image has a person", 1.05, 1.50),
    ("S4", "S4b", "Day 17", "SQL", "stratified click-rate ratio, button bottom right", 1.05, 1.32),
    ("S4", "S4c", "Day 17", "SQL", "stratified click-rate ratio, warm colours", 1.05, 1.32),
    ("S4", "S4d", "Day 17", "SQL", "negative control: stratified click-rate ratio, much text", 0.95, 1.05),
    ("S4", "S4e", "Day 17", "SQL", "negative control: conversion ratio furthest from 1", 0.70, 1.43),
]


def criteria(spark: SparkSession, version: int = 1) -> DataFrame:
    """C-01."""
    return spark.createDataFrame(CRITERIA + (CRITERIA_V1_S4 if version == 1 else CRITERIA_V2_S4), CRITERIA_SCHEMA)


@dataclass(frozen=True)
class SignalParams:
    """Which entities and days carry the planted effects."""
    cost_group: str
    cost_from: date
    cost_until: date | None = None
    cost_since: date | None = None
    outage_day: date | None = None
    tired_creative: str = ""
    week_anchor: date | None = None
    regular_type: str = ""
    opening_channel: str = ""
    closing_channel: str = ""
    promotion: str = ""
    promo_start: date | None = None
    promo_end: date | None = None
    dearer: str = "競價變貴"
    broken: str = "追蹤碼失效"
    tired: str = "素材疲乏"
    expect: Mapping[str, str] = field(default_factory=dict)


def _value(check_id: str, df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.lit(check_id).alias("check_id"), value.cast("double").alias("actual"))


def complete_week_multiplier(ads: DataFrame, creative: str, anchor: date) -> DataFrame:
    """Weekly click-rate multiplier: slope of log click rate over Sunday-counted weeks that have all seven days."""
    wk = sunday_weeks_between("date", F.lit(anchor))
    weeks = ads.where(F.col("creative_id") == creative).groupBy(wk.alias("wk")).agg(count_rows().alias("days"), ratio(F.sum("clicks"), F.sum("impressions")).alias("ctr"))
    return weeks.where("days = 7 and ctr > 0")


def _values(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Rows of (check_id, actual) from one aggregate."""
    one = df.agg(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_id"), F.col(f"v{i}").alias("actual")) for i, n in enumerate(values)])))


def measured_signals(ads: DataFrame, events: DataFrame, orders: DataFrame, products: DataFrame, diagnosis: DataFrame, segments: DataFrame,
                     truth: DataFrame, ltv: DataFrame, attribution: DataFrame, p: SignalParams) -> DataFrame:
    """C-02: one (check_id, actual) row per check.

    ``segments`` is the frozen copy of the segment table (customer_id, centroid_id, observed_30d); ``truth`` is (customer_id, segment).
    """
    c, lit = F.col, F.lit
    g = ads.where(c("ad_group_id") == p.cost_group)
    if p.cost_since is not None:
        g = g.where(c("date") >= lit(p.cost_since))
    if p.cost_until is not None:
        g = g.where(c("date") <= lit(p.cost_until))
    after = c("date") >= lit(p.cost_from)
    cpc = lambda x: ratio(F.sum(F.when(x, c("cost"))), F.sum(F.when(x, c("clicks"))))
    s1a = _value("S1a", g, ratio(cpc(after), cpc(~after)))
    said = lambda cond: F.when(F.bool_or(F.coalesce(cond, lit(False))), 1.0).otherwise(0.0)
    # the replies are parsed once for all three questions
    told = _values(diagnosis, {
        "S1b": said((c("entity") == p.cost_group) & (c("cause") == p.dearer)),
        "S2b": said((c("entity") == "all_site") & (c("period_start") == lit(p.outage_day)) & (c("cause") == p.broken)),
        "S3b": said((c("entity") == p.tired_creative) & (c("cause") == p.tired))})
    booked = orders.where((c("order_date") == lit(p.outage_day)) & (c("data_source") == "synthetic")).agg(count_rows()).scalar()
    tracked = events.where((c("event_dt") == lit(p.outage_day)) & (c("event_name") == "purchase") & (c("data_source") == "synthetic"))
    s2a = _value("S2a", tracked, ratio(count_rows(), booked))
    weeks = complete_week_multiplier(ads, p.tired_creative, p.week_anchor)
    s3a = _value("S3a", weeks, F.exp(F.regr_slope(F.log("ctr"), c("wk").cast("double"))))
    seg = segments.where("observed_30d").join(truth, "customer_id").groupBy("centroid_id", "segment").agg(count_rows().alias("n"))
    major = seg.groupBy("centroid_id").agg(F.max_by("segment", F.struct("n", "segment")).alias("major"))
    recall = seg.join(major, "centroid_id").groupBy("segment").agg(ratio(F.sum(F.when(c("segment") == c("major"), c("n")).otherwise(0)), F.sum("n")).alias("recall"))
    s5a = _value("S5a", recall, F.min("recall"))
    mine = c("segment") == p.regular_type
    s5b = _value("S5b", ltv.where("scope = 'eval'").join(truth, "customer_id"),
                 ratio(F.avg(F.when(mine, c("predicted_revenue_30d"))), F.avg(F.when(~mine, c("predicted_revenue_30d")))))
    first = attribution.where("not is_repeat and not window_truncated")
    credit = lambda ch, x: F.sum(F.when(c("channel") == ch, c(x)))
    credits = _values(first, {
        "S6a": ratio(credit(p.opening_channel, "credit_first_nd"), credit(p.opening_channel, "credit_last_nd")),
        "S6b": ratio(credit(p.closing_channel, "credit_last_nd"), credit(p.closing_channel, "credit_first_nd"))})
    sold = orders.where(c("order_date").between(F.date_sub(lit(p.promo_start), 21), lit(p.promo_end))).join(products.select("item_id", "promotion_ids"), "item_id")
    during, promo, q = c("order_date") >= lit(p.promo_start), F.array_contains("promotion_ids", p.promotion), c("quantity")
    share = lambda x: ratio(F.sum(F.when(x & promo, q).otherwise(0)), F.sum(F.when(x, q)))
    s7a = _value("S7a", sold, 100 * (share(during) - share(~during)))
    return union_all([s1a, told, s2a, s3a, s5a, s5b, credits, s7a])


def score(criteria_table: DataFrame, measured: DataFrame) -> DataFrame:
    """C-03."""
    return judge(criteria_table, measured)


def signal_verdict(scorecard: DataFrame) -> DataFrame:
    """C-04: all, some or none of a signal's checks found."""
    v = F.col("verdict")
    is_ = lambda k: v == VERDICTS[k]
    return scorecard.groupBy("signal_id").agg(
        count_rows().alias("checks"), F.count_if(is_("found")).alias("found"),
        F.when(F.bool_and(is_("pending")), VERDICTS["pending"]).when(F.bool_and(is_("found")), VERDICTS["found"])
         .when(F.bool_or(is_("found")), "部分找到").otherwise(VERDICTS["missed"]).alias("verdict")).orderBy("signal_id")


# ---- season report --------------------------------------------------------------------------------------------------------

def _md(c: str) -> list[Column]:
    return [F.month(c), F.dayofmonth(c)]


def weekly_lines(ads: DataFrame, events: DataFrame, orders: DataFrame, items: Mapping[str, str], channel_names: Mapping[str, str] | None = None) -> DataFrame:
    """C-05, lines: (section, position, line) with one line per ad group, per creative, one for the site and one for the product lines."""
    channel_names = channel_names or {}
    c = F.col
    wk = monday("date")
    pct = lambda a, b: F.coalesce(F.round(100 * ratio(a, b), 2), F.lit(0.0))
    ag = ads.groupBy("ad_group_id", wk.alias("wk")).agg(F.min("channel").alias("channel"), F.min("utm_campaign").alias("campaign"),
                                                        F.sum("impressions").alias("imp"), F.sum("clicks").alias("clk"), F.sum("cost").alias("cost"))
    cell = F.format_string("%d/%d %d/%.2f/%.1f/%d", *_md("wk"), c("clk"), pct("clk", "imp"), F.coalesce(F.round(ratio("cost", "clk"), 1), F.lit(0.0)),
                           F.round("cost").cast("bigint"))
    name = c("channel")
    for k, v in channel_names.items():
        name = F.when(c("channel") == k, v).otherwise(name)
    groups = ag.groupBy("ad_group_id", "channel", "campaign").agg(F.min("wk").alias("first_wk"), _ordered(cell, "wk", "；").alias("cells")).select(
        F.lit(1).alias("section"), F.concat_ws("|", c("first_wk").cast("string"), "ad_group_id").alias("position"),
        F.format_string("%s（%s、%s）：%s", "ad_group_id", name, "campaign", "cells").alias("line"))
    cr = ads.groupBy("creative_id", wk.alias("wk")).agg(F.min("ad_group_id").alias("ad_group_id"), F.sum("impressions").alias("imp"), F.sum("clicks").alias("clk"),
                                                        F.min("date").alias("first_date"))
    creative = cr.groupBy("creative_id").agg(F.min("ad_group_id").alias("ad_group_id"), F.min("first_date").alias("launch"),
                                             _ordered(F.format_string("%d/%d %.2f", *_md("wk"), pct("clk", "imp")), "wk", "、").alias("cells")).select(
        F.lit(2).alias("section"), F.concat_ws("|", "ad_group_id", "creative_id").alias("position"),
        F.format_string("%s（%s，上線 %d/%d）：%s", "creative_id", "ad_group_id", *_md("launch"), "cells").alias("line"))
    ev = events.where("event_name = 'purchase' and data_source = 'synthetic'").groupBy(monday("event_dt").alias("wk")).agg(count_rows().alias("tracked"))
    own = orders.where("data_source = 'synthetic'")
    od = own.groupBy(monday("order_date").alias("wk")).agg(count_rows().alias("orders"), F.sum("revenue").alias("rev"))
    weeks = ads.select(wk.alias("wk")).union(od.select("wk")).distinct()
    zero = lambda x: F.coalesce(c(x), F.lit(0)).cast("bigint")
    site = weeks.join(ev, "wk", "left").join(od, "wk", "left").agg(
        F.lit(3).alias("section"), F.lit("").alias("position"),
        _ordered(F.format_string("%d/%d %d/%d/%d", *_md("wk"), zero("tracked"), zero("orders"), F.round(F.coalesce(c("rev"), F.lit(0))).cast("bigint")), "wk", "；").alias("line"))
    sums = {f"q{i}": F.sum(F.when(c("item_id") == k, c("quantity")).otherwise(0)) for i, k in enumerate(items)}
    pr = own.groupBy(monday("order_date").alias("wk")).agg(*[v.alias(k) for k, v in sums.items()], F.coalesce(F.sum("quantity"), F.lit(0)).alias("total"))
    template = "%d/%d " + "、".join(f"{label} %d" for label in items.values()) + "（合計 %d）"
    product = pr.agg(F.lit(4).alias("section"), F.lit("").alias("position"), _ordered(F.format_string(template, *_md("wk"), *[c(k) for k in sums], c("total")), "wk", "；").alias("line"))
    return union_all([groups, creative, site, product])


def _ordered(text: Column, by: str, separator: str) -> Column:
    """Text of all rows of a group in order. Used where a group has one row per calendar week."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def weekly_report_text(lines: DataFrame, opening: str, headings: Sequence[str], closing: str, runs: int = 1) -> DataFrame:
    """C-05: the whole season report as one text per run; one line per ad group and creative, so its size follows the dimensions."""
    c = F.col
    per = lines.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("body"))
    heading = F.get(F.array(*[F.lit(h) for h in headings]), c("section") - 1)
    whole = per.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", F.concat(heading, F.lit("\n"), "body").alias("t")))), lambda x: x["t"]), "\n\n").alias("b"))
    return whole.select(F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run_no"), F.concat(F.lit(opening + "\n\n"), "b", F.lit("\n\n" + closing)).alias("prompt"))


# ---- blind test -----------------------------------------------------------------------------------------------------------

FINDING = "target string, period string, observation string, likely_cause string, next_check string"


def explode_findings(replies: DataFrame, raw: str = "raw_result", keys: Sequence[str] = ("model", "run_no")) -> DataFrame:
    """C-06: findings of each reply with their number; unreadable replies give none."""
    parsed = F.from_json(raw, f"findings array<struct<{', '.join(p.replace(' ', ':', 1) for p in FINDING.split(', '))}>>")["findings"]
    return replies.select(*keys, F.posexplode(parsed).alias("pos", "f")).select(*keys, (F.col("pos") + 1).alias("finding_no"), "f.*")


def match_findings(findings: DataFrame, rules: Sequence[tuple], keys: Sequence[str] = ("model", "run_no")) -> DataFrame:
    """C-07: a finding hits a signal when all three of its patterns occur in the finding's text.

    ``rules`` is the fixed list (signal_id, rule, must_1, must_2, must_3). The patterns become column expressions, so there is no
    join without a key.
    """
    txt = F.concat_ws("｜", *[F.coalesce(x, F.lit("")) for x in ("target", "period", "observation", "likely_cause")])
    hit = [F.when(txt.rlike(a) & txt.rlike(b) & txt.rlike(d), F.lit(s)) for s, _, a, b, d in rules]
    return findings.select(*keys, "finding_no", F.explode(F.array_compact(F.array(*hit))).alias("signal_id"))


def blind_scorecard(runs: DataFrame, matches: DataFrame, rules: Sequence[tuple], keys: Sequence[str] = ("model", "run_no")) -> DataFrame:
    """C-08: every run x signal with the findings that hit it."""
    signals = F.array(*[F.struct(F.lit(r[0]).alias("signal_id"), F.lit(r[1]).alias("rule")) for r in rules])
    grid = runs.select(*keys).distinct().select(*keys, F.inline(signals))
    hits = matches.groupBy(*keys, "signal_id").agg(F.array_sort(F.collect_set("finding_no")).alias("matched_findings"))
    return grid.join(hits, [*keys, "signal_id"], "left").select(
        *keys, "signal_id", "rule", F.col("matched_findings").isNotNull().alias("found"),
        F.coalesce("matched_findings", F.array().cast("array<int>")).alias("matched_findings"))


def runs_found(scorecard: DataFrame) -> DataFrame:
    return scorecard.groupBy("model", "signal_id").agg(F.count_if("found").alias("runs_found"), count_rows().alias("runs"))


def tokens_of(key: str, column: str = "statistics") -> Column:
    return F.get_json_object(column, f"$.{key}").try_cast("bigint")


def blind_reports(results: DataFrame, findings: DataFrame, scorecard: DataFrame, matches: DataFrame, prices: Mapping[str, tuple[float, float]],
                  twd: float = 32.0, models: Sequence[str] = ()) -> dict[str, DataFrame]:
    """C-09: found runs per signal and model; per run; cost per model; each finding with its signals."""
    keys = ["model", "run_no"]
    by_signal = scorecard.groupBy("signal_id").agg(*[F.count_if((F.col("model") == m) & F.col("found")).alias(f"{m}_found") for m in models])
    n_find = findings.groupBy(*keys).agg(count_rows().alias("findings"))
    n_sig = scorecard.groupBy(*keys).agg(F.count_if("found").alias("signals_found"))
    z = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    used = [tokens_of("prompt_token_count").alias("input_tokens"), tokens_of("candidates_token_count").alias("output_tokens"),
            tokens_of("thoughts_token_count").alias("thinking_tokens")]
    per_run = results.join(n_find, keys, "left").join(n_sig, keys, "left").select(*keys, z("findings"), z("signals_found"), *used)
    p_in, p_out = F.lit(None).cast("double"), F.lit(None).cast("double")
    for m, (i, o) in prices.items():
        p_in, p_out = F.when(F.col("model") == m, float(i)).otherwise(p_in), F.when(F.col("model") == m, float(o)).otherwise(p_out)
    cost = results.select("model", *used).groupBy("model").agg(count_rows().alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")) \
        .where(p_in.isNotNull()).withColumn("usd", (F.col("input_tokens") * p_in + F.col("output_tokens") * p_out) / 1e6) \
        .select("model", "calls", "input_tokens", "output_tokens", F.round("usd", 4).alias("usd"), F.round(F.col("usd") * twd, 2).alias("twd"))
    signals = matches.groupBy(*keys, "finding_no").agg(F.array_join(F.array_sort(F.collect_set("signal_id")), ",").alias("signals"))
    listing = findings.join(signals, [*keys, "finding_no"], "left").select(*keys, "finding_no", "signals", "target", "period", "observation", "likely_cause")
    return {"by_signal": by_signal, "per_run": per_run, "cost": cost, "findings": listing}


def check_acceptance(criteria_table: DataFrame, scorecard: DataFrame, rules: Sequence[tuple], prompts: DataFrame, results: DataFrame,
                     findings: DataFrame, blind: DataFrame, expected: Mapping[str, object]) -> DataFrame:
    """C-10: fifteen structural checks; ``expected`` gives the wanted counts."""
    v, c = F.col("verdict"), F.col
    struct = lambda df, **a: df.agg(F.struct(*[x.alias(k) for k, x in a.items()])).scalar()
    facts = one_row(
        scorecard.sparkSession, c=struct(criteria_table, n=count_rows()),
        s=struct(scorecard, n=count_rows(), pending=F.count_if(v == VERDICTS["pending"]), nd=F.count_if(v == VERDICTS["no_data"]),
                 judged=F.count_if(v.isin(VERDICTS["found"], VERDICTS["missed"]))),
        p=struct(prompts, n=count_rows(), kinds=F.count_distinct("prompt")),
        r=struct(results, n=count_rows(), models=F.count_distinct("model"), err=F.count_if(c("status") != ""), bad=F.count_if(F.try_parse_json("raw_result").isNull()),
                 think=F.count_if(tokens_of("thoughts_token_count") > 0)),
        f=struct(findings, n=F.count_distinct("model", "run_no")), b=struct(blind, n=count_rows()))
    e = lambda k: str(expected[k])
    return check_rows(facts, [
        ("01 criteria rows", e("criteria"), c("c.n")), ("02 scorecard rows", e("criteria"), c("s.n")), ("03 scorecard pending", e("pending"), c("s.pending")),
        ("04 scorecard no data", "0", c("s.nd")), ("05 scorecard judged", e("judged"), c("s.judged")), ("06 blind criteria rows", e("rules"), F.lit(str(len(rules)))),
        ("07 blind prompt rows", e("prompts"), c("p.n")), ("08 blind prompt identical", "1", c("p.kinds")), ("09 blind result rows", e("results"), c("r.n")),
        ("10 blind models", e("models"), c("r.models")), ("11 blind api_error", "0", c("r.err")), ("12 blind bad_json", "0", c("r.bad")),
        ("13 blind used_thinking", "0", c("r.think")), ("14 runs with findings", e("results"), c("f.n")), ("15 blind scorecard rows", e("blind"), c("b.n"))])


# Three patterns per signal, all of which have to occur in one finding.
BLIND_RULES = [
    ("S1", "click cost of the ad group doubled",
     r"(meta-trn-prospecting|(Meta|meta).{0,8}重訓襪.{0,12}(開發新客|prospecting))",
     r"(CPC|點擊成本|每次點擊|單次點擊|點擊花費|點擊單價|點擊費用|點擊價格|每點擊|花費.{0,8}(倍|翻))",
     r"(升|漲|貴|增|倍|飆|跳|攀|拉高|走高|提高|變高)"),
    ("S2", "tracked purchases fell short of orders in the outage week",
     r"(8/24|8/27|8 ?月 ?24|8 ?月 ?27|08-24|08-27|0824|0827)",
     r"(追蹤|purchase|購買事件|購買|事件|GA4)",
     r"(少|低|落差|缺|漏|不一致|對不上|差距|差異|遺漏|失效|沒有|未|短|減|降|異常|掉|不符|不等)"),
    ("S3", "click rate of the creative fell week by week",
     r"cr-meta-evg-p1", r"(點擊率|CTR)",
     r"(降|滑|衰|退|減|跌|疲|走低|降低|遞減|逐週|逐漸|越來越)"),
    ("S7", "promoted items sold more during the promotion",
     r"(秋日|autumn|AUTUMN|9/1|9/8|9/14|9 ?月|09-0|09-1)",
     r"(洗臉|入門組合|中筒襪|專案商品|占比|比例|比重)",
     r"(升|增|多|高|成長|拉高|上揚|翻|倍|跳)"),
]
