"""Load verification metrics and data-quality rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.checks import union_all
from ..functions.exprs import BUSINESS_TZ, count_rows, local_date, ratio
from ..functions.skew import Cuts, keyed_sequence, order_slices



def _long(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One-row aggregate to (metric, value) rows; one pass over the table however many metrics."""
    one = df.agg(*[c.alias(f"m{i}") for i, c in enumerate(values.values())])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").cast("string").alias("value"))
                                         for i, n in enumerate(values)])))


def _by_group(df: DataFrame, name: Column, value: Column) -> DataFrame:
    return df.groupBy(name.alias("metric")).agg(value.cast("string").alias("value"))


@dataclass(frozen=True)
class Signals:
    """What the seven signals look at."""

    cost_group: str
    cost_day: date
    gap_day: date
    decay_creative: str
    decay_anchor: date
    sources: Mapping[str, str]  # name in the metric: source/medium
    promo_items: Sequence[str]
    promo_start: date
    promo_end: date
    promo_before: int = 21


def as_number(c: Column) -> Column:
    """Nine decimals as text, the same in every engine."""
    return F.round(c, 9).cast("decimal(28,9)").cast("string")


def metric_vector(events: DataFrame, orders: DataFrame, ads: DataFrame, creatives: DataFrame, customers: DataFrame, signals: Signals | None = None, tz: str = BUSINESS_TZ) -> DataFrame:
    """V-01: one (metric, value) row per fact about the load, values as text; with ``signals`` also the rows of the seven signals.

    ``tz`` is the zone that business dates were written in.
    """
    sessions = events.where("event_name = 'session_start'").select("user_pseudo_id", "ga_session_id").distinct()
    cents = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    facts = [
        _long(creatives, {"rows.creatives": count_rows(), "check.image_has_person_null": F.count_if((F.col("format") == "image") & F.col("has_person").isNull())}),
        _long(customers, {"rows.customers": count_rows(), "check.phone_leading_zero": F.count_if(F.col("phone").startswith("0"))}),
        _long(ads, {"rows.ad_daily": count_rows(), "ad.impressions": F.sum("impressions"), "ad.clicks": F.sum("clicks"), "ad.cost": F.sum("cost").cast("decimal(28,2)")}),
        _long(orders, {"rows.orders": count_rows(), "orders.revenue": F.sum("revenue"), "orders.quantity": F.sum("quantity"),
                       "orders.customers": F.count_distinct("customer_id"), "orders.min_date": F.min("order_date"), "orders.max_date": F.max("order_date"),
                       "check.order_date_mismatch": F.count_if(F.col("order_date") != local_date("order_us", tz)),
                       "aov": F.round(F.sum("revenue").cast("double") / count_rows(), 6)}),
        _long(events, {"rows.events": count_rows(), "events.users": F.count_distinct("user_pseudo_id"), "events.min_date": F.min("event_date"),
                       "events.max_date": F.max("event_date"),
                       "check.event_date_mismatch": F.count_if(F.col("event_date") != F.date_format(local_date("event_timestamp", tz), "yyyyMMdd")),
                       "check.user_id_with_dot": F.count_if(F.instr(F.col("user_pseudo_id").cast("string"), ".") > 0)}),
        _long(events.where("event_name = 'purchase'"), {"events.purchase_value": cents("value")}),
        _long(sessions, {"events.sessions": count_rows()}),
        _by_group(events, F.concat(F.lit("events."), "event_name"), count_rows()),
        _by_group(ads, F.concat(F.lit("ctr."), "channel"), F.round(ratio(F.sum("clicks"), F.sum("impressions")), 9)),
        _long(sessions, {"cvr.session": as_number(ratio(orders.agg(count_rows()).scalar(), count_rows()))}),
    ]
    return union_all(facts + (signal_rows(events, orders, ads, creatives, signals) if signals else []))


def signal_rows(events: DataFrame, orders: DataFrame, ads: DataFrame, creatives: DataFrame, s: Signals) -> list[DataFrame]:
    """The seven signals as (metric, value) rows."""
    wide = lambda df, prefix, form=as_number: df.select(F.inline(F.array(*[F.struct(F.lit(f"{prefix}.{c}").alias("metric"), form(F.col(c)).alias("value")) for c in df.columns])))
    text = lambda c: c.cast("string")
    touch = first_last_touch_before_first_order(events, orders)
    at = {f"{n}_{end}": F.coalesce(F.sum(F.when(F.col("source") == source, F.col(f"as_{end}"))), F.lit(0)) for n, source in s.sources.items() for end in ("first", "last")}
    return [
        wide(cost_per_click_before_after(ads, s.cost_group, s.cost_day), "s1"),
        wide(event_vs_order_gap(events, orders, s.gap_day), "s2", text),
        wide(weekly_decay(ads, s.decay_creative, s.decay_anchor).select("weekly_decay"), "s3"),
        stratified_ratio(ads, creatives, [s.decay_creative]).select(F.concat(F.lit("s4."), "attr").alias("metric"), as_number(F.col("estimate")).alias("value")),
        orders_per_customer_histogram(orders).select(F.concat(F.lit("s5."), "metric").alias("metric"), F.col("value").cast("string").alias("value")),
        wide(touch.agg(*[c.alias(n) for n, c in at.items()]), "s6", text),
        wide(basket_share_window(orders, s.promo_items, s.promo_start, s.promo_end, s.promo_before), "s7"),
    ]


def cost_per_click_before_after(ads: DataFrame, group: str, day: date) -> DataFrame:
    """V-02."""
    before = F.col("date") < F.lit(day)
    cpc = lambda p: ratio(F.sum(F.when(p, F.col("cost"))), F.sum(F.when(p, F.col("clicks"))))
    return ads.where(F.col("ad_group_id") == group).agg(F.round(cpc(before), 9).alias("cpc_before"), F.round(cpc(~before), 9).alias("cpc_after"))


def event_vs_order_gap(events: DataFrame, orders: DataFrame, day: date) -> DataFrame:
    """V-03: tracked purchases and orders of a day, and orders of other days that were never tracked."""
    tracked = events.where("event_name = 'purchase'")
    lost = orders.where(F.col("order_date") != F.lit(day)).join(
        tracked.where(F.col("transaction_id").isNotNull()).select("transaction_id"), "transaction_id", "left_anti")
    return tracked.where(F.col("event_dt") == F.lit(day)).agg(count_rows().alias("purchase_events")).select(
        "purchase_events", orders.where(F.col("order_date") == F.lit(day)).agg(count_rows()).scalar().alias("orders"),
        lost.agg(count_rows()).scalar().alias("orders_without_event_elsewhere"))


def weekly_decay(ads: DataFrame, creative: str, anchor: date) -> DataFrame:
    """V-04: 1 - exp(slope) of log click rate on weeks since the anchor, one point per day."""
    x = F.datediff("date", F.lit(anchor)) / 7.0
    y = F.log(F.col("clicks") / F.col("impressions"))
    days = ads.where((F.col("creative_id") == creative) & (F.col("clicks") > 0) & (F.col("date") >= F.lit(anchor)))
    return days.agg(F.round(1 - F.exp(F.regr_slope(y, x)), 9).alias("weekly_decay"), count_rows().alias("points"))


def flag_columns(creatives: DataFrame) -> DataFrame:
    """The yes/no design flags of an image; an unknown value counts as no."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return creatives.withColumns({
        "f_person": yes(F.col("has_person")), "f_cta": yes(F.regexp_replace("cta_position", "-", "_") == "bottom_right"),
        "f_warm": yes(F.col("dominant_color") == "warm"), "f_text": yes(F.col("text_density") == "high")})


def unpivot_flags(df: DataFrame, keep: Sequence[str], attrs: Sequence[str] = ("person", "cta", "warm", "text")) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"f_{a}").alias("flag")) for a in attrs])
    return df.select(*keep, F.inline(pairs))


def stratified_ratio(ads: DataFrame, creatives: DataFrame, exclude: Sequence[str] = (), attrs: Sequence[str] = ("person", "cta", "warm")) -> DataFrame:
    """V-05: geometric-mean click-rate ratio within channel x audience, pooled over strata that have both sides."""
    rate = ads.groupBy("creative_id").agg(F.sum("clicks").alias("clk"), F.sum("impressions").alias("imp"))
    images = flag_columns(creatives.where((F.col("format") == "image") & ~F.col("creative_id").isin(list(exclude)))).drop("clicks")
    per = images.join(rate, "creative_id").where("clk > 0").withColumn("ctr", F.col("clk") / F.col("imp"))
    long = unpivot_flags(per, ["channel", "audience", "ctr"], attrs)
    return pool_ratio(strata_ratio(long)).select("attr", F.round("estimate", 9).alias("estimate"))


def strata_ratio(long: DataFrame, value: str = "ctr") -> DataFrame:
    flag = F.col("flag")
    ln = lambda p: F.avg(F.when(p, F.log(F.col(value))))
    return long.groupBy("attr", "channel", "audience").agg(
        F.count_if(flag).alias("ny"), F.count_if(~flag).alias("nn"), F.exp(ln(flag) - ln(~flag)).alias("ratio")).where("ny > 0 and nn > 0")


def pool_ratio(strata: DataFrame) -> DataFrame:
    weight = F.col("ny") * F.col("nn") / (F.col("ny") + F.col("nn"))
    return strata.groupBy("attr").agg(F.exp(F.sum(F.log("ratio") * weight) / F.sum(weight)).alias("estimate"))


def orders_per_customer_histogram(orders: DataFrame, cap: int = 3) -> DataFrame:
    """V-06."""
    return orders.groupBy("customer_id").agg(F.least(count_rows(), F.lit(cap)).alias("n")).groupBy("n").agg(count_rows().alias("customers")).select(
        F.concat(F.lit("customers_with_"), F.col("n").cast("string"), F.when(F.col("n") == cap, "_plus").otherwise(""), F.lit("_orders")).alias("metric"),
        F.col("customers").alias("value"))


def first_last_touch_before_first_order(events: DataFrame, orders: DataFrame) -> DataFrame:
    """V-07: how often each source is the first and the last of at least two session starts up to the first purchase.

    First and last are arg-min / arg-max aggregates, so no visitor's list of touches is ever collected.
    """
    first_order = orders.groupBy("user_pseudo_id").agg(F.min_by("transaction_id", F.struct("order_us", "transaction_id")).alias("transaction_id"))
    bought = events.where("event_name = 'purchase'").select("user_pseudo_id", "transaction_id", F.col("event_timestamp").alias("bought_us"))
    buy = bought.join(first_order, ["user_pseudo_id", "transaction_id"]).select("user_pseudo_id", "bought_us")
    src = F.concat(F.coalesce("utm_source", F.lit("")), F.lit("/"), F.coalesce("utm_medium", F.lit("")))
    starts = events.where("event_name = 'session_start'").select("user_pseudo_id", "event_timestamp", src.alias("src"))
    order = F.struct("event_timestamp", "src")
    # a visitor may buy a transaction in several recorded events, hence one row per purchase time; a hot visitor's join can be split
    paths = starts.join(buy.distinct(), "user_pseudo_id").where("event_timestamp <= bought_us").groupBy("user_pseudo_id", "bought_us").agg(
        count_rows().alias("n"), F.min_by("src", order).alias("first_src"), F.max_by("src", order).alias("last_src")).where("n >= 2")
    sides = paths.select(F.inline(F.array(F.struct(F.col("first_src").alias("source"), F.lit(1).alias("f"), F.lit(0).alias("l")),
                                          F.struct(F.col("last_src").alias("source"), F.lit(0).alias("f"), F.lit(1).alias("l")))))
    return sides.groupBy("source").agg(F.sum("f").alias("as_first"), F.sum("l").alias("as_last"))


def basket_share_window(orders: DataFrame, items: Sequence[str], start: date, end: date, pre_days: int = 21) -> DataFrame:
    """V-08: quantity share of the promoted items in the window and in the days before it."""
    d, q, promo = F.col("order_date"), F.col("quantity"), F.col("item_id").isin(list(items))
    inside = d.between(F.lit(start), F.lit(end))
    before = (d >= F.date_sub(F.lit(start), pre_days)) & (d < F.lit(start))
    share = lambda p: F.round(ratio(F.sum(F.when(p & promo, q).otherwise(0)), F.sum(F.when(p, q).otherwise(0))), 9)
    return orders.agg(share(before).alias("share_pre"), share(inside).alias("share_window"))


# ---- rules -------------------------------------------------------------------------------------------------------------

def verdict(df: DataFrame, name: str, bad: Column, detail: Column | None = None) -> DataFrame:
    """PASS when no row violates the rule."""
    return df.agg(bad.alias("bad")).select(F.lit(name).alias("rule"), F.when(F.col("bad") == 0, "PASS").otherwise("FAIL").alias("result"),
                                           F.col("bad").cast("bigint").alias("violations"))


def required_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """DQ-00: NULLs per key column."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls"),
                                                  F.when(F.col(c) == 0, "PASS").otherwise("FAIL").alias("result")) for c in columns])))


def values_in_catalog(df: DataFrame, column: str, catalog: DataFrame, key: str, name: str = "item_in_catalog") -> DataFrame:
    """DQ-01 / DQ-07: references to unknown keys."""
    lost = df.where(F.col(column).isNotNull()).join(catalog.select(F.col(key).alias(column)).distinct(), column, "left_anti")
    return verdict(lost, name, count_rows())


def variant_in_options(df: DataFrame, options: DataFrame) -> DataFrame:
    """DQ-02: ``options`` is (item_id, size_options array)."""
    j = df.where(F.col("item_variant").isNotNull()).join(options, "item_id", "left")
    return verdict(j, "variant_in_options", F.count_if(~F.coalesce(F.array_contains("size_options", F.col("item_variant")), F.lit(False))))


def amount_equals_price_times_qty(orders: DataFrame, prices: DataFrame) -> DataFrame:
    """DQ-03: ``prices`` is (item_id, price)."""
    j = orders.join(prices, "item_id", "left")
    return verdict(j, "amount_equals_price_times_qty", F.count_if(~F.coalesce(F.col("revenue") == F.col("price") * F.col("quantity"), F.lit(False))))


def purchase_events_match_orders(events: DataFrame, orders: DataFrame) -> DataFrame:
    """DQ-04: purchase events name existing orders, and none twice."""
    bought = events.where("event_name = 'purchase'")
    unknown = bought.join(orders.select("transaction_id"), "transaction_id", "left_anti").agg(count_rows().alias("n"))
    twice = bought.groupBy("transaction_id").count().where("count > 1").agg(count_rows().alias("n"))
    return verdict(unknown.union(twice), "purchase_events_match_orders", F.sum("n"))


def order_id_unique(orders: DataFrame, max_length: int = 20) -> DataFrame:
    """DQ-05."""
    per = orders.groupBy("transaction_id").count()
    return verdict(per, "order_id_unique", F.count_if((F.col("count") > 1) | (F.length(F.col("transaction_id").cast("string")) > max_length)))


def customer_fk(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """DQ-06, first half."""
    return values_in_catalog(orders, "customer_id", customers, "customer_id", "customer_fk")


def first_order_date_consistent(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """DQ-06, second half: stored first date equals the date of the first order in time."""
    first = orders.groupBy("customer_id").agg(F.min_by("order_date", F.struct("order_us", "order_date")).alias("d"))
    j = customers.join(first, "customer_id", "left")
    return verdict(j, "first_order_date_consistent", F.count_if(~F.col("d").eqNullSafe(F.col("first_order_date"))))


def clicks_le_impressions(ads: DataFrame) -> DataFrame:
    """DQ-08."""
    fine = (F.col("clicks") >= 0) & (F.col("clicks") <= F.col("impressions")) & (F.col("cost") >= 0)
    return verdict(ads, "clicks_le_impressions", F.count_if(~fine))


def dates_in_period(df: DataFrame, column: str, start: date, end: date, name: str = "dates_in_period") -> DataFrame:
    """DQ-09."""
    return verdict(df, name, F.count_if(~F.col(column).between(F.lit(start), F.lit(end))))


def local_date_matches(events: DataFrame, tz: str = "Asia/Taipei") -> DataFrame:
    """DQ-10."""
    return verdict(events, "local_date_matches", F.count_if(F.col("event_dt") != local_date("event_timestamp", tz)))


def first_event_is_first_visit(events: DataFrame, first_name: str = "first_visit") -> DataFrame:
    """DQ-11, first half."""
    first = events.groupBy("user_pseudo_id").agg(F.min_by("event_name", F.struct("event_timestamp", "event_name")).alias("first_name"))
    return verdict(first, "first_event_is_first_visit", F.count_if(F.col("first_name") != first_name))


def visitor_id_suffix(events: DataFrame) -> DataFrame:
    """DQ-11, second half: the part after the dot is the second of the visitor's first event."""
    first = events.groupBy("user_pseudo_id").agg(F.min("event_timestamp").alias("us"))
    suffix = F.get(F.split(F.col("user_pseudo_id").cast("string"), "\\."), F.lit(1)).try_cast("bigint")
    return verdict(first, "visitor_id_suffix", F.count_if(~F.coalesce(suffix == F.floor(F.col("us") / 1_000_000), F.lit(False))))


def session_rules(sessions: DataFrame, gap_seconds: int = 1800, cuts: Cuts | Sequence[float] | None = None) -> DataFrame:
    """DQ-12: (visitor, session id) occurs once, and a visitor's sessions start more than 30 minutes apart.

    ``sessions`` is (user_pseudo_id, ga_session_id) with the session id being its start in seconds.
    """
    twice = sessions.groupBy("user_pseudo_id", "ga_session_id").count()
    cuts = order_slices(sessions, "ga_session_id") if cuts is None else cuts
    gaps = keyed_sequence(twice.select("user_pseudo_id", "ga_session_id"), ["user_pseudo_id"], ["ga_session_id"], cuts=cuts,
                          slice_on="ga_session_id", lag={"before": "ga_session_id"})
    return union_all([verdict(twice, "session_unique", F.count_if(F.col("count") > 1)),
                      verdict(gaps, "session_gap", F.count_if(F.col("ga_session_id") - F.col("before") <= gap_seconds))])


def range_targets(ads: DataFrame, orders: DataFrame, events: DataFrame, days: int, ctr=(0.015, 0.035), cvr=(0.018, 0.025),
                  volume=(400_000, 600_000), full_days: int = 90) -> DataFrame:
    """DQ-13: click rate per channel, conversion rate and volume inside their ranges; SKIP when the period is not the full one."""
    def judge(name: Column, value: Column, lo: float, hi: float, skip: bool = False) -> list[Column]:
        result = F.lit("SKIP") if skip else F.when(value.between(lo, hi), "PASS").otherwise("FAIL")
        return [name.alias("rule"), F.round(value, 6).alias("value"), result.alias("result")]

    per = ads.groupBy("channel").agg(ratio(F.sum("clicks"), F.sum("impressions")).alias("v"))
    sessions = events.where("event_name = 'session_start'").agg(count_rows()).scalar()
    cvr_df = orders.agg(count_rows().alias("n")).select(ratio("n", sessions).alias("v"))
    vol = events.agg(count_rows().cast("double").alias("v"))
    partial = days != full_days
    return union_all([
        per.select(*judge(F.concat(F.lit("ctr."), "channel"), F.col("v"), *ctr)),
        cvr_df.select(*judge(F.lit("cvr"), F.col("v"), *cvr, partial)),
        vol.select(*judge(F.lit("volume"), F.col("v"), *volume, partial))])


def signal_checks(measured: DataFrame, planted: dict[str, float]) -> DataFrame:
    """DQ-14: measured effects against planted ones.

    ``measured`` is (signal, value): s1 ratio of click costs, s3 weekly decay, s4.* ratios, s6.* first/last ratios, s7 share ratio.
    Tolerances: s1 within 15 %, s3 within 0.025, s4 at least 40 % of the effect, s6 more than 1.5 times, s7 more than 1.1 times.
    """
    name, v = F.col("signal"), F.col("value")
    want = F.lit(None).cast("double")
    for k, w in planted.items():
        want = F.when(name == k, float(w)).otherwise(want)
    ok = F.when(name == "s1", v.between(0.85 * want, 1.15 * want)) \
        .when(name == "s3", F.abs(v - want) <= 0.025) \
        .when(name.startswith("s4"), v > 1 + (want - 1) * 0.4) \
        .when(name.startswith("s6"), v > 1.5).when(name == "s7", v > 1.1)
    return measured.select("signal", F.round("value", 6).alias("value"), want.alias("planted"),
                           F.when(ok.isNull(), "SKIP").when(ok, "PASS").otherwise("FAIL").alias("result"))
