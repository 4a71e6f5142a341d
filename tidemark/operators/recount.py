"""The metric vector a second way, for reconciliation: every table is first reduced to partial sums per key, and all metrics are merged from those.

Nothing is shared with ``quality.metric_vector`` but names and number formats. Slopes come from sums of products instead of a regression aggregate,
geometric means from sums of logarithms, first and last sources from least and greatest text keys, untracked orders from one grouping of both
sides instead of an anti join. A fault in one of the two ways therefore shows as a difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.checks import union_all
from ..functions.exprs import BUSINESS_TZ, DAY_US
from .quality import Signals, as_number


def _rows(one: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(metric, value) rows from a table of one row."""
    return one.select(F.explode(F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v.cast("string"))])).alias("metric", "value"))


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _part(p: Column, c: str) -> Column:
    return F.sum(F.expr(c) * p.cast("int"))


def _shifted_day(micros: str, tz: str) -> Column:
    """Date in a zone, by the zone's offset at that instant added to the microseconds."""
    instant = F.timestamp_micros(micros)
    offset = F.unix_micros(F.from_utc_timestamp(instant, tz)) - F.unix_micros(instant)
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((F.col(micros) + offset) / DAY_US).cast("int"))


def _ads(ads: DataFrame, creatives: DataFrame, s: Signals) -> list[DataFrame]:
    day = ads.groupBy("creative_id", "channel", "ad_group_id", "date").agg(F.count("*").alias("n"), F.sum("impressions").alias("imp"), F.sum("clicks").alias("clk"), F.sum("cost").alias("cost"))
    own, late = F.col("ad_group_id") == s.cost_group, F.col("date") >= F.lit(s.cost_day)
    sums = day.agg(_total("n").alias("n"), F.sum("imp").alias("imp"), F.sum("clk").alias("clk"), F.sum("cost").alias("cost"),
                   _part(own & ~late, "cost").alias("c0"), _part(own & ~late, "clk").alias("k0"), _part(own & late, "cost").alias("c1"), _part(own & late, "clk").alias("k1"))
    per = lambda a, b: as_number(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")))
    out = [_rows(sums, {"rows.ad_daily": F.col("n"), "ad.impressions": F.col("imp"), "ad.clicks": F.col("clk"), "ad.cost": F.col("cost").cast("decimal(28,2)"), "s1.cpc_before": per("c0", "k0"), "s1.cpc_after": per("c1", "k1")})]
    out.append(day.groupBy("channel").agg(F.sum("clk").alias("k"), F.sum("imp").alias("i")).select(
        F.concat(F.lit("ctr."), "channel").alias("metric"), F.round(F.try_divide(F.col("k").cast("double"), F.col("i").cast("double")), 9).cast("string").alias("value")))
    # least squares from sums over days
    worn = day.where((F.col("creative_id") == s.decay_creative) & (F.col("clk") > 0) & (F.col("date") >= F.lit(s.decay_anchor))) \
        .select((F.datediff("date", F.lit(s.decay_anchor)) / 7.0).alias("x"), (F.log("clk") - F.log("imp")).alias("y"))
    m = worn.agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.expr("x * x")).alias("xx"), F.sum(F.expr("x * y")).alias("xy"))
    out.append(_rows(m, {"s3.weekly_decay": as_number(1 - F.exp(F.try_divide(F.expr("n * xy - x * y"), F.expr("n * xx - x * x"))))}))
    # strata from sums of logarithms
    rate = day.groupBy("creative_id").agg(F.log(F.sum("clk") / F.sum("imp")).alias("l"), F.sum("clk").alias("clk")).where("clk > 0")
    image = creatives.where((F.col("format") == "image") & ~F.col("creative_id").isin(s.decay_creative))
    flags = {"person": F.col("has_person"), "cta": F.translate("cta_position", "-", "_") == "bottom_right", "warm": F.col("dominant_color") == "warm"}
    side = image.select("creative_id", "channel", "audience", F.explode(F.create_map(*[x for n, f in flags.items() for x in (F.lit(n), F.coalesce(f, F.lit(False)))])).alias("attr", "yes"))
    sides = side.join(rate, "creative_id").groupBy("attr", "channel", "audience").pivot("yes", [True, False]).agg(F.count("creative_id").alias("n"), F.sum("l").alias("l"))
    weight = F.expr("true_n * false_n / (true_n + false_n)")
    both = sides.where("true_n > 0 and false_n > 0").withColumn("w", weight).withColumn("wl", F.col("w") * F.expr("true_l / true_n - false_l / false_n"))
    out.append(both.groupBy("attr").agg((F.sum("wl") / F.sum("w")).alias("e")).select(F.concat(F.lit("s4."), "attr").alias("metric"), as_number(F.exp("e")).alias("value")))
    return out


def _orders(orders: DataFrame, sessions: Column, s: Signals, tz: str) -> list[DataFrame]:
    part = orders.groupBy("customer_id", "order_date", "item_id").agg(
        F.count("*").alias("n"), F.sum("revenue").alias("r"), F.sum("quantity").alias("q"), F.sum((F.col("order_date") != _shifted_day("order_us", tz)).cast("int")).alias("off"))
    d, promo = F.col("order_date"), F.col("item_id").isin(list(s.promo_items))
    before = (d < F.lit(s.promo_start)) & (F.datediff(F.lit(s.promo_start), d) <= s.promo_before)
    inside = (d >= F.lit(s.promo_start)) & (d <= F.lit(s.promo_end))
    one = part.agg(_total("n").alias("n"), F.sum("r").alias("r"), F.sum("q").alias("q"), F.min(d).alias("d0"), F.max(d).alias("d1"), _total("off").alias("off"), _part(d == F.lit(s.gap_day), "n").alias("s2"),
                   _part(before, "q").alias("b"), _part(before & promo, "q").alias("bp"), _part(inside, "q").alias("w"), _part(inside & promo, "q").alias("wp")).withColumn("sessions", sessions)
    share = lambda a, b: as_number(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")))
    buyers = part.groupBy("customer_id").agg(F.sum("n").alias("n"))
    kind = F.when(F.col("n") >= 3, "3_plus").otherwise(F.col("n").cast("string"))
    return [
        _rows(one, {"rows.orders": F.col("n"), "orders.revenue": F.col("r"), "orders.quantity": F.col("q"), "orders.min_date": F.col("d0"), "orders.max_date": F.col("d1"), "check.order_date_mismatch": F.col("off"),
                    "aov": F.round(F.try_divide(F.col("r").cast("double"), F.col("n").cast("double")), 6), "cvr.session": share("n", "sessions"), "s2.orders": F.coalesce("s2", F.lit(0)), "s7.share_pre": share("bp", "b"), "s7.share_window": share("wp", "w")}),
        _rows(buyers.agg(F.count("*").alias("c")), {"orders.customers": F.col("c")}),
        buyers.groupBy(F.concat(F.lit("s5.customers_with_"), kind, F.lit("_orders")).alias("metric")).agg(F.count("*").cast("string").alias("value"))]


def _paths(events: DataFrame, orders: DataFrame, s: Signals) -> DataFrame:
    """First and last source by text keys that sort like (time, source)."""
    key = lambda us, rest: F.concat(F.lpad(us.cast("string"), 20, "0"), rest)
    first = orders.groupBy("user_pseudo_id").agg(F.min(key(F.col("order_us"), F.col("transaction_id").cast("string"))).alias("k"), F.min("order_us").alias("us")) \
        .join(orders.select("user_pseudo_id", F.col("order_us").alias("us"), "transaction_id"), ["user_pseudo_id", "us"]).groupBy("user_pseudo_id").agg(F.min("transaction_id").alias("transaction_id"))
    bought = events.where("event_name = 'purchase'").groupBy("user_pseudo_id", "transaction_id", "event_timestamp").agg(F.count("*").alias("n")).join(first, ["user_pseudo_id", "transaction_id"])
    src = F.concat_ws("/", F.coalesce("utm_source", F.lit("")), F.coalesce("utm_medium", F.lit("")))
    starts = events.where("event_name = 'session_start'").groupBy("user_pseudo_id", F.col("event_timestamp").alias("us"), src.alias("src")).agg(F.count("*").alias("n"))
    path = starts.join(bought.select("user_pseudo_id", "event_timestamp"), "user_pseudo_id").where("us <= event_timestamp").groupBy("user_pseudo_id", "event_timestamp").agg(
        F.sum("n").alias("n"), F.min(key(F.col("us"), F.col("src"))).alias("a"), F.max(key(F.col("us"), F.col("src"))).alias("z")).where("n > 1")
    at = lambda side, source: F.coalesce(F.sum((F.substring(side, 21, 1000) == source).cast("int")), F.lit(0))
    counts = {f"s6.{n}_{end}": at(side, source) for n, source in s.sources.items() for end, side in (("first", "a"), ("last", "z"))}
    one = path.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts.values())])
    return _rows(one, {n: F.col(f"c{i}") for i, n in enumerate(counts)})


def recount_vector(events: DataFrame, orders: DataFrame, ads: DataFrame, creatives: DataFrame, customers: DataFrame, signals: Signals, tz: str = BUSINESS_TZ) -> DataFrame:
    """V-09: the rows of ``quality.metric_vector`` from partial sums."""
    off = F.col("event_date") != F.date_format(_shifted_day("event_timestamp", tz), "yyyyMMdd")
    tracked = F.col("event_name") == "purchase"
    part = events.groupBy("user_pseudo_id", "ga_session_id", "event_date", "event_name").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("v"), F.sum(off.cast("int")).alias("off"), F.sum(F.col("user_pseudo_id").cast("string").contains(".").cast("int")).alias("dot"))
    gap = F.date_format(F.lit(signals.gap_day), "yyyyMMdd")
    e = part.agg(_total("n").alias("n"), F.min("event_date").alias("d0"), F.max("event_date").alias("d1"), _total("off").alias("off"), _total("dot").alias("dot"), F.sum(F.when(tracked, F.col("v"))).alias("v"),
                 F.coalesce(_part(tracked & (F.col("event_date") == gap), "n"), F.lit(0)).alias("s2"))
    users = part.groupBy("user_pseudo_id").agg(F.sum("n").alias("n")).agg(F.count("user_pseudo_id").alias("c"))
    sessions = part.where("event_name = 'session_start'").groupBy("user_pseudo_id", "ga_session_id").agg(F.sum("n").alias("n")).agg(F.count("*").alias("c"))
    sides = union_all([orders.where(F.col("order_date") != F.lit(signals.gap_day)).select("transaction_id", F.lit(1).alias("o"), F.lit(0).alias("e")),
                       events.where(tracked & F.col("transaction_id").isNotNull()).select("transaction_id", F.lit(0), F.lit(1)).toDF("transaction_id", "o", "e")])
    lost = sides.groupBy("transaction_id").agg(F.sum("o").alias("o"), F.sum("e").alias("e")).where("e = 0").agg(F.coalesce(F.sum("o"), F.lit(0)).alias("c"))
    plain = creatives.groupBy("format", F.col("has_person").isNull().alias("unknown")).agg(F.count("*").alias("n")).agg(_total("n").alias("n"), F.coalesce(_part((F.col("format") == "image") & F.col("unknown"), "n"), F.lit(0)).alias("u"))
    phones = customers.groupBy(F.substring("phone", 1, 1).alias("p")).agg(F.count("*").alias("n")).agg(_total("n").alias("n"), F.coalesce(_part(F.col("p") == "0", "n"), F.lit(0)).alias("z"))
    return union_all([
        _rows(e, {"rows.events": F.col("n"), "events.min_date": F.col("d0"), "events.max_date": F.col("d1"), "check.event_date_mismatch": F.col("off"), "check.user_id_with_dot": F.col("dot"), "events.purchase_value": F.col("v"), "s2.purchase_events": F.col("s2")}),
        _rows(users, {"events.users": F.col("c")}), _rows(sessions, {"events.sessions": F.col("c")}), _rows(lost, {"s2.orders_without_event_elsewhere": F.col("c")}),
        part.groupBy(F.concat(F.lit("events."), "event_name").alias("metric")).agg(F.sum("n").cast("string").alias("value")),
        _rows(plain, {"rows.creatives": F.col("n"), "check.image_has_person_null": F.col("u")}), _rows(phones, {"rows.customers": F.col("n"), "check.phone_leading_zero": F.col("z")}),
        *_ads(ads, creatives, signals), *_orders(orders, sessions.scalar(), signals, tz), _paths(events, orders, signals)])
