"""Multi-touch attribution: customer journeys and how each order's credit is shared among its touches."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.checks import check_rows, one_row
from ..functions.exprs import DAY_US, ratio, utc_ntz
from ..functions.skew import Cuts, keyed_sequence, order_slices, quantiles, slice_count

CREDITS = ("credit_first", "credit_last", "credit_decay", "credit_first_nd", "credit_last_nd", "credit_decay_nd")
MODELS = {"first_touch": "credit_first", "last_touch": "credit_last", "time_decay": "credit_decay"}


def order_sequence(orders: DataFrame, cuts: Cuts | Sequence[float] | None = None) -> DataFrame:
    """AT-01: running order number and previous order time of each visitor."""
    cuts = order_slices(orders, "order_us") if cuts is None else cuts
    return keyed_sequence(orders, ["user_pseudo_id"], ["order_us", "transaction_id"], cuts=cuts, slice_on="order_us",
                          row_number="order_seq", lag={"prev_order_us": "order_us"})


def session_touches(events: DataFrame, lo: date | Column | None = None, hi: date | Column | None = None, lookback_days: int = 30) -> DataFrame:
    """AT-02: one touch per session start; the date bounds prune partitions of the event fact."""
    keep = (F.col("event_name") == "session_start") & (F.col("data_source") == "synthetic")
    if lo is not None:
        keep &= F.col("event_dt") >= F.date_sub(F.lit(lo), lookback_days + 1)
    if hi is not None:
        keep &= F.col("event_dt") <= F.lit(hi)
    return events.where(keep).select(
        "user_pseudo_id",
        F.col("event_id").alias("touch_id"),
        F.col("event_timestamp").alias("touch_us"),
        F.concat("utm_source", F.lit(" / "), "utm_medium").alias("channel"),
        "utm_campaign",
        (F.col("utm_source") == "(direct)").alias("is_direct"),
    )


def journeys(orders: DataFrame, touches: DataFrame, lookback_days: int = 30, cuts: Cuts | Sequence[float] | None = None) -> DataFrame:
    """AT-03: the touches that lead to each order.

    A touch belongs to the visitor's next order and to no other one, so no touch x order pairs are formed: orders and
    touches are put on one time line per visitor, a running count of orders numbers the paths, and the order's own fields
    come back through an equi join on (visitor, path number).
    """
    cuts = order_slices(touches, "touch_us") if cuts is None else cuts
    of_touch = F.struct("touch_us", "channel", "utm_campaign", "is_direct", "touch_id").alias("t")
    line = orders.select("user_pseudo_id", F.col("order_us").alias("us"), F.lit(1).alias("is_order"), F.col("transaction_id").alias("row_id"), F.lit(None).cast(touches.select(of_touch).schema[0].dataType).alias("t")) \
        .unionByName(touches.select("user_pseudo_id", F.col("touch_us").alias("us"), F.lit(0).alias("is_order"), F.col("touch_id").alias("row_id"), of_touch))
    # at equal times the touch comes before the order it leads to
    numbered = keyed_sequence(line, ["user_pseudo_id"], ["us", "is_order", "row_id"], cuts=cuts, slice_on="us",
                              running={"orders_so_far": F.col("is_order").cast("bigint")})
    left = numbered.where("is_order = 0").select("user_pseudo_id", (F.col("orders_so_far") + 1).alias("order_seq"), "t.*")
    # the orders number themselves: the time line is not computed a second time for them
    right = keyed_sequence(orders, ["user_pseudo_id"], ["order_us", "transaction_id"], cuts=cuts, slice_on="order_us", row_number="order_seq").withColumn("order_seq", F.col("order_seq").cast("bigint"))
    lookback_us = lookback_days * DAY_US
    return left.join(right, ["user_pseudo_id", "order_seq"]).where(F.col("touch_us") > F.col("order_us") - lookback_us)


def touch_positions(journey: DataFrame, half_life_days: float = 7.0, cuts: Cuts | Sequence[float] | None = None) -> DataFrame:
    """AT-04: position in the path, path lengths with and without direct visits, decay weights and their sums."""
    cuts = order_slices(journey, "touch_us") if cuts is None else cuts
    weighted = journey.withColumn("decay_w", F.pow(F.lit(0.5), (F.col("order_us") - F.col("touch_us")) / (half_life_days * DAY_US)))
    nd = F.when(~F.col("is_direct"), 1).otherwise(0).cast("bigint")
    return keyed_sequence(
        weighted, ["user_pseudo_id", "order_seq"], ["touch_us", "channel", "utm_campaign", "touch_id"], cuts=cuts, slice_on="touch_us",
        row_number="touch_seq",
        running={"nd_seq": nd},
        totals={"path_len": F.lit(1).cast("bigint"), "nd_len": nd, "decay_sum": F.col("decay_w"),
                "decay_sum_nd": F.when(F.col("is_direct"), 0.0).otherwise(F.col("decay_w"))})


def _one(p: Column) -> Column:
    return F.when(p, 1.0).otherwise(0.0)


def credit_columns() -> dict[str, Column]:
    """AT-05, AT-06, AT-07: the six credit rules; ``_nd`` gives direct visits nothing unless there is nothing else."""
    first, last = F.col("touch_seq") == 1, F.col("touch_seq") == F.col("path_len")
    decay = F.col("decay_w") / F.col("decay_sum")
    all_direct, nd = F.col("nd_len") == 0, ~F.col("is_direct")
    return {
        "credit_first": _one(first),
        "credit_last": _one(last),
        "credit_decay": decay,
        "credit_first_nd": F.when(all_direct, _one(first)).otherwise(_one(nd & (F.col("nd_seq") == 1))),
        "credit_last_nd": F.when(all_direct, _one(last)).otherwise(_one(nd & (F.col("nd_seq") == F.col("nd_len")))),
        "credit_decay_nd": F.when(all_direct, decay).when(nd, F.col("decay_w") / F.col("decay_sum_nd")).otherwise(0.0),
    }


def path_flags(lookback_days: int, data_start: Column) -> dict[str, Column]:
    """AT-08."""
    return {
        "is_repeat": F.col("order_seq") > 1,
        "window_truncated": F.date_sub("order_date", lookback_days) < data_start,
        "days_before_order": F.round((F.col("order_us") - F.col("touch_us")) / DAY_US, 3),
    }


def mart_attribution(orders: DataFrame, events: DataFrame, lookback_days: int = 30, half_life_days: float = 7.0,
                     cuts: Cuts | Sequence[float] | None = None) -> DataFrame:
    """AT-09: order x touch with six credits, each adding up to 1 per order.

    Two small jobs run while the query is built: the period of the orders, and the start and the cut points of the events.
    """
    orders = orders.where(F.col("data_source") == "synthetic")
    # one pass over each fact for everything that describes the whole of it; as constants these values prune folders and stay out of the plan
    slices, own = slice_count(events), F.col("data_source") == "synthetic"
    period = orders.agg(F.min("order_date").alias("first"), F.max("order_date").alias("last")).first()
    whole = events.agg(F.min(F.when(own, F.col("event_dt"))).alias("start"), *([quantiles("event_timestamp", slices).alias("cuts")] if cuts is None else [])).first()
    cuts = whole["cuts"] or [] if cuts is None else cuts
    touches = session_touches(events, period["first"], period["last"], lookback_days)
    seq = touch_positions(journeys(orders, touches, lookback_days, cuts), half_life_days, cuts)
    out = seq.withColumns({**credit_columns(), **path_flags(lookback_days, F.lit(whole["start"]).cast("date")), "touch_ts": utc_ntz("touch_us")})
    return out.select("order_date", "transaction_id", "order_us", "customer_id", "user_pseudo_id", "item_id", "revenue", "order_seq",
                      "is_repeat", "window_truncated", "touch_seq", "path_len", "touch_us", "touch_ts", "days_before_order", "channel",
                      "utm_campaign", "is_direct", *CREDITS)


def check_attribution(mart: DataFrame, orders: DataFrame, lookback_days: int = 30, covered_only: bool = False) -> DataFrame:
    """AT-10: conservation and position checks, computed from the finished mart and the orders, not from the builder's steps.

    ``covered_only`` compares with the orders that have a touch at all, for data in which some orders have none.
    """
    per_order = mart.groupBy("transaction_id").agg(
        F.min("revenue").alias("revenue"), *[F.sum(c).alias(c) for c in CREDITS], F.count(F.lit(1)).alias("touches"),
        F.bool_or(F.col("touch_us") > F.col("order_us")).alias("future"), F.max("days_before_order").alias("max_days"),
        F.min("path_len").alias("path_len"))
    a = per_order.agg(
        F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue"),
        *[F.count_if(F.abs(F.col(c) - 1) > 1e-9).alias(c) for c in CREDITS],
        F.count_if("future").alias("future"), F.max("max_days").alias("max_days"),
        F.count_if(F.col("touches") != F.col("path_len")).alias("bad_len"), F.sum("touches").alias("touch_rows"))
    paid = orders.where(F.col("data_source") == "synthetic")
    if covered_only:
        paid = paid.join(mart.select("transaction_id"), "transaction_id", "left_semi")
    o = paid.agg(F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue"))
    # independent look at the previous order: latest order of the visitor that is earlier in (time, id), taken from the order table
    prev = order_sequence(orders.where(F.col("data_source") == "synthetic")).select("transaction_id", "prev_order_us")
    wrong_first = (F.col("credit_first") == 1) != (F.col("touch_seq") == 1)
    wrong_last = (F.col("credit_last") == 1) != (F.col("touch_seq") == F.col("path_len"))
    pos = mart.join(prev, "transaction_id").agg(
        F.count_if(wrong_first).alias("bad_first"), F.count_if(wrong_last).alias("bad_last"),
        F.count_if(F.col("touch_us") <= F.col("prev_order_us")).alias("cross_prev"))
    facts = one_row(mart.sparkSession, o=o.select(F.struct("*")).scalar(), a=a.select(F.struct("*")).scalar(), p=pos.select(F.struct("*")).scalar())
    c = F.col
    return check_rows(facts, [
        ("orders_covered", c("o.orders"), c("a.orders")),
        ("revenue_covered", c("o.revenue"), c("a.revenue")),
        *[(f"{name}_sum_ne_1", "0", c(f"a.{name}")) for name in CREDITS],
        ("touch_after_order", "0", c("a.future")),
        (f"max_days_before_order_le_{lookback_days}", f"<= {lookback_days}", c("a.max_days"), c("a.max_days") <= lookback_days),
        ("path_len_consistent", "0", c("a.bad_len")),
        ("first_touch_position", "0", c("p.bad_first")),
        ("last_touch_position", "0", c("p.bad_last")),
        ("touch_before_prev_order", "0", c("p.cross_prev")),
        ("info.touch_rows", "", c("a.touch_rows")),
    ])


def report_direct_effect(mart: DataFrame, digits: int = 1) -> DataFrame:
    """AT-11: credit per channel with direct visits counted."""
    s = lambda c, n: F.round(F.sum(c), digits).alias(n)
    return mart.groupBy("channel").agg(s("credit_first", "first_touch"), s("credit_last", "last_touch"),
                                       s("credit_decay", "time_decay"), s("credit_last_nd", "last_touch_nd")) \
        .orderBy(F.desc("first_touch"), "channel")


def report_first_purchase_credit(mart: DataFrame, digits: int = 1) -> DataFrame:
    """AT-12: first purchases with a complete look-back window, direct not counted."""
    rules = {"first": "credit_first_nd", "last": "credit_last_nd", "decay": "credit_decay_nd"}
    names = {"first": "first_touch", "last": "last_touch", "decay": "time_decay"}
    return mart.where(~F.col("is_repeat") & ~F.col("window_truncated")).groupBy("channel").agg(
        *[F.round(F.sum(c), digits).alias(names[k]) for k, c in rules.items()],
        *[F.round(F.sum(F.col(c) * F.col("revenue").cast("double")), 0).alias(f"revenue_{k}") for k, c in rules.items()],
    ).orderBy(F.desc("first_touch"), "channel")


def report_path_length(mart: DataFrame, cap: int = 5) -> DataFrame:
    """AT-13."""
    return mart.where("touch_seq = 1").groupBy(F.least(F.col("path_len"), F.lit(cap)).alias("path_len_capped")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if("is_repeat").alias("repeat_orders"),
        F.count_if("window_truncated").alias("truncated_orders")).orderBy("path_len_capped")


def report_path_days(mart: DataFrame, accuracy: int = 100_000) -> DataFrame:
    """AT-14: median and 90th percentile of days from first touch to order; a mergeable sketch, exact on small input."""
    q = lambda p: F.percentile_approx("days_before_order", p, accuracy)
    return mart.where((F.col("touch_seq") == 1) & (F.col("path_len") >= 2) & ~F.col("window_truncated")) \
        .groupBy("is_repeat").agg(F.count(F.lit(1)).alias("orders"), q(0.5).alias("p50_days"), q(0.9).alias("p90_days")).orderBy("is_repeat")


def report_campaign_credit(mart: DataFrame, start: date, end: date, digits: int = 1) -> DataFrame:
    """AT-15: campaign credit inside one promotion window."""
    s = lambda c, n: F.round(F.sum(c), digits).alias(n)
    return mart.where(F.col("order_date").between(F.lit(start), F.lit(end))).groupBy("utm_campaign").agg(
        s("credit_first_nd", "first_touch"), s("credit_last_nd", "last_touch"), s("credit_decay_nd", "time_decay")) \
        .orderBy(F.desc("time_decay"), "utm_campaign")


def channel_attribution(mart: DataFrame, model: str, start: date, end: date, exclude_direct: bool = False) -> DataFrame:
    """AT-16: credited orders, revenue and share of one model in a period; the column comes from a fixed list."""
    if model not in MODELS:
        raise ValueError(f"model must be one of {sorted(MODELS)}")
    if start > end:
        raise ValueError("start after end")
    credit = MODELS[model] + ("_nd" if exclude_direct else "")
    inside = mart.where(F.col("order_date").between(F.lit(start), F.lit(end)))
    per = inside.groupBy("channel").agg(F.sum(credit).alias("c"), F.sum(F.col(credit) * F.col("revenue").cast("double")).alias("r"))
    # one row per channel
    total = inside.agg(F.sum(credit)).scalar()
    return per.select("channel", F.round("c", 1).alias("credited_orders"), F.round("r", 0).cast("bigint").alias("credited_revenue"),
                      F.round(ratio("c", total), 4).alias("share_of_orders")).orderBy(F.desc("credited_orders"), "channel")
