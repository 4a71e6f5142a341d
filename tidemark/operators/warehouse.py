"""Star schema: flattening of the nested web export, facts, dimensions and their reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.checks import check_rows, one_row, union_all
from ..functions.exprs import local_date, monday, oldest

FACT_COLUMNS = ("event_dt", "event_date", "event_timestamp", "event_name", "user_pseudo_id", "ga_session_id", "customer_id",
                "utm_source", "utm_medium", "utm_campaign", "creative_id", "promotion_id", "item_id", "item_variant", "quantity",
                "item_count", "value", "transaction_id", "data_source")
NOT_SET = "(not set)"
DIRECT = ("(direct)", "(none)", "(direct)")


def _value_of(params: str, key: str) -> Column:
    return F.get(F.filter(F.col(params), lambda p: p["key"] == key), F.lit(0))["value"]


def param(params: str, key: str, kind: str = "string") -> Column:
    """W-02: value of a key in an array of key/value structs; whole numbers may also arrive as text."""
    v = _value_of(params, key)
    if kind == "int":
        return F.coalesce(v["int_value"], v["string_value"].try_cast("bigint"))
    return v["string_value"]


def numeric_param(params: str, key: str) -> Column:
    """W-03: the number is in whichever of three slots the sender used."""
    v = _value_of(params, key)
    return F.coalesce(v["int_value"].cast("double"), v["double_value"], v["float_value"].cast("double"))


def session_source_fill(events: DataFrame, source: Sequence[str] = ("ev_source", "ev_medium", "ev_campaign")) -> DataFrame:
    """W-04: every event of a session gets the source triple of the session's first event that has one.

    The triple is an arg-min aggregate (combined before the shuffle) joined back on (visitor, session), so a huge session is
    split by the skew join instead of being sorted in one window task.
    """
    session = F.coalesce("ga_session_id", "event_timestamp")
    events = events.withColumn("_session", session)
    s, m, c = source
    any_set = F.col(s).isNotNull() | F.col(m).isNotNull() | F.col(c).isNotNull()
    first = events.where(any_set).groupBy("user_pseudo_id", "_session").agg(
        oldest(list(source), "event_timestamp", s, m, c).alias("_first"))
    out = events.join(first, ["user_pseudo_id", "_session"], "left")
    names = ("utm_source", "utm_medium", "utm_campaign")
    return out.withColumns({n: F.coalesce(F.col(f"_first.{x}"), F.lit(d)) for n, x, d in zip(names, source, DIRECT)}) \
        .drop("_session", "_first")


def single_item(items: str = "items") -> dict[str, Column]:
    """W-05: item fields only when the event carries exactly one item."""
    one = F.size(items) == 1
    first = F.get(F.col(items), F.lit(0))
    return {
        "item_id": F.when(one, F.nullif(first["item_id"], F.lit(NOT_SET))),
        "item_variant": F.when(one, F.nullif(first["item_variant"], F.lit(NOT_SET))),
        "quantity": F.when(one, first["quantity"]),
        "item_count": F.size(items).cast("bigint"),
    }


def flatten_events(nested: DataFrame) -> DataFrame:
    """W-06: nested export to the columns of the event fact; events without a visitor id are dropped."""
    sent = F.col("collected_traffic_source")
    src = nested.where(F.col("user_pseudo_id").isNotNull()).withColumns({
        "ga_session_id": param("event_params", "ga_session_id", "int"),
        "ev_source": F.coalesce(sent["manual_source"], param("event_params", "source")),
        "ev_medium": F.coalesce(sent["manual_medium"], param("event_params", "medium")),
        "ev_campaign": F.coalesce(sent["manual_campaign_name"], param("event_params", "campaign")),
        "event_dt": F.to_date("event_date", "yyyyMMdd"),
        "customer_id": F.col("user_id"),
        "creative_id": param("event_params", "creative_name"),
        "promotion_id": param("event_params", "promotion_id"),
        **single_item(),
        "value": numeric_param("event_params", "value"),
        "transaction_id": F.coalesce(F.nullif(F.col("ecommerce.transaction_id"), F.lit(NOT_SET)), param("event_params", "transaction_id")),
        "data_source": F.lit("ga4"),
    }).drop("event_params", "items", "ecommerce", "collected_traffic_source")
    return session_source_fill(src).select(*FACT_COLUMNS)


def build_fct_events(raw: DataFrame, flat: DataFrame) -> DataFrame:
    """W-07."""
    plain = raw.withColumns({
        "event_dt": F.to_date("event_date", "yyyyMMdd"),
        "item_count": F.when(F.col("item_id").isNull(), 0).otherwise(1).cast("bigint"),
        "data_source": F.coalesce("data_source", F.lit("synthetic"))}).select(*FACT_COLUMNS)
    return plain.unionByName(flat.select(*FACT_COLUMNS))


def build_fct_ad_daily(raw: DataFrame, source: str = "synthetic") -> DataFrame:
    """W-08."""
    return raw.select("date", "creative_id", "channel", "ad_group_id", "utm_campaign", "impressions", "clicks", "cost",
                      F.lit(source).alias("data_source"))


def build_fct_orders(raw: DataFrame, source: str = "synthetic") -> DataFrame:
    return raw.drop("data_source").withColumn("data_source", F.lit(source))


DESIGN_COLUMNS = ("has_person", "cta_position", "dominant_color", "text_density")
PII_COLUMNS = ("name", "email", "phone")


def build_dim_creative(raw: DataFrame) -> DataFrame:
    """W-09: the design columns are answers and stay out of the analysis schema."""
    return raw.drop(*DESIGN_COLUMNS)


def build_dim_customer(raw: DataFrame) -> DataFrame:
    return raw.select("customer_id", "city", "first_order_date")


def build_dim_product(events: DataFrame, orders: DataFrame, creatives: DataFrame) -> DataFrame:
    """W-10: all items ever seen, most frequent price (lowest one on ties), promotions, first date."""
    sightings = [
        events.select("item_id", F.col("event_dt").alias("d")),
        orders.select("item_id", F.col("order_date").alias("d")),
        creatives.select(F.col("product_focus").alias("item_id"), F.col("start_date").alias("d")),
    ]
    seen = union_all(sightings).where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("d").alias("first_seen_date"))
    price = orders.where(F.col("item_id").isNotNull() & F.col("unit_price").isNotNull()).groupBy("item_id", "unit_price").count() \
        .groupBy("item_id").agg(F.max_by("unit_price", F.struct("count", -F.col("unit_price"))).alias("unit_price"))
    promo = creatives.where(F.col("promotion_id").isNotNull() & F.col("product_focus").isNotNull()) \
        .groupBy(F.col("product_focus").alias("item_id")).agg(F.array_sort(F.collect_set("promotion_id")).alias("promotion_ids"))
    return seen.join(price, "item_id", "left").join(promo, "item_id", "left").select(
        "item_id", "unit_price", F.coalesce("promotion_ids", F.array().cast("array<string>")).alias("promotion_ids"), "first_seen_date")


def build_dim_date(dates: Sequence[DataFrame], creatives: DataFrame) -> DataFrame:
    """W-11: calendar over all given one-column date frames, with the promotions running on each day.

    Promotion intervals are spread into days, so the interval join becomes an equi join.
    """
    ranges = [d.toDF("d").agg(F.min("d").alias("lo"), F.max("d").alias("hi")) for d in dates]
    bounds = union_all(ranges).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    running = creatives.where(F.col("promotion_id").isNotNull() & (F.col("start_date") <= F.col("end_date"))) \
        .select("promotion_id", F.explode(F.sequence("start_date", "end_date")).alias("date")).distinct() \
        .groupBy("date").agg(F.array_sort(F.collect_set("promotion_id")).alias("promotion_ids"))
    dow = F.dayofweek("date")
    return days.join(running, "date", "left").select(
        "date", F.date_format("date", "yyyyMMdd").alias("event_date"), monday("date").alias("week_start"),
        dow.alias("day_of_week"), dow.isin(1, 7).alias("is_weekend"),
        F.coalesce("promotion_ids", F.array().cast("array<string>")).alias("promotion_ids"))


def _session_key() -> Column:
    return F.concat_ws(".", "user_pseudo_id", F.coalesce(F.col("ga_session_id").cast("string"), F.lit("null")))


def reconcile(spark: SparkSession, raw_events: DataFrame, nested: DataFrame, raw_ads: DataFrame, raw_orders: DataFrame,
              raw_creatives: DataFrame, raw_customers: DataFrame, star: Mapping[str, DataFrame]) -> DataFrame:
    """W-12: totals before and after the build. ``before`` reads the raw shapes, ``after`` the finished tables."""
    n = F.count(F.lit(1))

    def packed(df: DataFrame, **aggs: Column) -> Column:
        return df.agg(F.struct(*[c.alias(k) for k, c in aggs.items()]).alias("s")).scalar()

    events, ads, orders = star["fct_events"], star["fct_ad_daily"], star["fct_orders"]
    per_event = lambda: dict(n=n, users=F.count_distinct("user_pseudo_id"), sessions=F.count_distinct(_session_key()))
    # read straight from the nested field, not through the flattening helpers
    hit = F.get(F.filter("event_params", lambda p: p["key"] == "ga_session_id"), F.lit(0))["value"]
    sid = F.when(hit["int_value"].isNotNull(), hit["int_value"]).otherwise(hit["string_value"].try_cast("bigint"))
    web = nested.where("user_pseudo_id is not null").withColumn("ga_session_id", sid)
    tx = F.coalesce(F.nullif(F.col("ecommerce.transaction_id"), F.lit(NOT_SET)), param("event_params", "transaction_id"))
    purchase = F.col("event_name") == "purchase"
    items_before = union_all([
        raw_events.select("item_id"), raw_orders.select("item_id"), raw_creatives.select(F.col("product_focus").alias("item_id")),
        web.where(F.size("items") == 1).select(F.nullif(F.get(F.col("items"), F.lit(0))["item_id"], F.lit(NOT_SET)).alias("item_id"))])
    before_after = {
        "eb": packed(raw_events, **per_event(), value=F.sum(F.col("value").cast("decimal(18,2)"))),
        "ea": packed(events.where("data_source = 'synthetic'"), **per_event(), value=F.sum(F.col("value").cast("decimal(18,2)"))),
        "wb": packed(web, **per_event(), revenue=F.sum(F.when(purchase, F.col("ecommerce.purchase_revenue").cast("decimal(18,2)"))),
                     tx=F.count_distinct(tx), items=F.sum(F.size("items")),
                     valued=F.count_if(F.exists("event_params", lambda p: p["key"] == "value"))),
        "wa": packed(events.where("data_source = 'ga4'"), **per_event(), revenue=F.sum(F.when(purchase, F.col("value").cast("decimal(18,2)"))),
                     tx=F.count_distinct("transaction_id"), items=F.sum("item_count"), valued=F.count("value"),
                     not_set=F.count_if((F.col("item_variant") == NOT_SET) | (F.col("transaction_id") == NOT_SET)),
                     no_source=F.count_if(F.col("utm_source").isNull()), no_session=F.count_if(F.col("ga_session_id").isNull())),
        "lost": packed(nested, n=F.count_if(F.col("user_pseudo_id").isNull())),
        "ab": packed(raw_ads, n=n, cost=F.sum("cost"), impressions=F.sum("impressions"), clicks=F.sum("clicks")),
        "aa": packed(ads, n=n, cost=F.sum("cost"), impressions=F.sum("impressions"), clicks=F.sum("clicks")),
        "ob": packed(raw_orders, n=n, revenue=F.sum("revenue"), tx=F.count_distinct("transaction_id")),
        "oa": packed(orders, n=n, revenue=F.sum("revenue"), tx=F.count_distinct("transaction_id")),
        "cb": packed(raw_creatives, n=n), "ca": packed(star["dim_creative"], n=n),
        "ub": packed(raw_customers, n=n), "ua": packed(star["dim_customer"], n=n),
        "pb": packed(items_before, n=F.count_distinct("item_id")), "pa": packed(star["dim_product"], n=n),
    }
    f = F.col
    ratio6 = lambda a, b: F.round(F.try_divide(f(a).cast("double"), f(b).cast("double")), 6)
    return check_rows(one_row(spark, **before_after), [
        ("rows.fct_events.synthetic", f("eb.n"), f("ea.n")),
        ("rows.fct_events.ga4", f("wb.n"), f("wa.n")),
        ("rows.fct_events.total", f("eb.n") + f("wb.n"), f("ea.n") + f("wa.n")),
        ("rows.fct_ad_daily", f("ab.n"), f("aa.n")),
        ("rows.fct_orders", f("ob.n"), f("oa.n")),
        ("rows.dim_creative", f("cb.n"), f("ca.n")),
        ("rows.dim_customer", f("ub.n"), f("ua.n")),
        ("rows.dim_product", f("pb.n"), f("pa.n")),
        ("ad.cost", f("ab.cost"), f("aa.cost")),
        ("ad.impressions", f("ab.impressions"), f("aa.impressions")),
        ("ad.clicks", f("ab.clicks"), f("aa.clicks")),
        ("orders.revenue", f("ob.revenue"), f("oa.revenue")),
        ("orders.distinct_transaction", f("ob.tx"), f("oa.tx")),
        ("synthetic.value_sum", f("eb.value"), f("ea.value")),
        ("synthetic.users", f("eb.users"), f("ea.users")),
        ("synthetic.sessions", f("eb.sessions"), f("ea.sessions")),
        ("synthetic.cvr_session", ratio6("ob.n", "eb.sessions"), ratio6("oa.n", "ea.sessions")),
        ("synthetic.aov", ratio6("ob.revenue", "ob.n"), ratio6("oa.revenue", "oa.n")),
        ("ga4.users", f("wb.users"), f("wa.users")),
        ("ga4.sessions", f("wb.sessions"), f("wa.sessions")),
        ("ga4.purchase_revenue", f("wb.revenue"), f("wa.revenue")),
        ("ga4.transactions", f("wb.tx"), f("wa.tx")),
        ("ga4.items", f("wb.items"), f("wa.items")),
        ("ga4.events_with_value", f("wb.valued"), f("wa.valued")),
        ("info.ga4_rows_without_user_pseudo_id", "-", f("lost.n")),
        ("ga4.not_set_left", "0", f("wa.not_set")),
        ("info.ga4_null_session_id", "-", f("wa.no_session")),
        ("ga4.null_utm_source", "0", f("wa.no_source")),
    ], "before", "after")


def reconcile_by_name(raw_events: DataFrame, nested: DataFrame, fact: DataFrame) -> DataFrame:
    """W-13: rows per source and event name on both sides."""
    before = raw_events.groupBy("event_name").count().withColumn("src", F.lit("synthetic")).unionByName(
        nested.where("user_pseudo_id is not null").groupBy("event_name").count().withColumn("src", F.lit("ga4")))
    after = fact.groupBy(F.col("data_source").alias("src"), "event_name").agg(F.count(F.lit(1)).alias("after_n"))
    j = before.withColumnRenamed("count", "before_n").join(after, ["src", "event_name"], "full")
    b, a = (F.coalesce(c, F.lit(0)).cast("string") for c in ("before_n", "after_n"))
    return j.select(F.concat_ws(".", F.lit("events"), "src", "event_name").alias("check_name"), b.alias("before"), a.alias("after"),
                    F.when(b == a, "OK").otherwise("DIFF").alias("ok"))


def orphan_count(fact: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """W-14: rows whose key is set but unknown to the dimension."""
    d = dim.select(F.col(dim_key or key).alias(key)).distinct()
    return fact.where(F.col(key).isNotNull()).join(d, key, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def orphan_checks(star: Mapping[str, DataFrame]) -> DataFrame:
    dates = star["fct_events"].select(F.col("event_dt").alias("date")).union(star["fct_ad_daily"].select("date")) \
        .union(star["fct_orders"].select("order_date")).distinct()
    counts = {
        "check.orphan_ad_creative": orphan_count(star["fct_ad_daily"], star["dim_creative"], "creative_id"),
        "check.orphan_synthetic_event_creative":
            orphan_count(star["fct_events"].where("data_source = 'synthetic'"), star["dim_creative"], "creative_id"),
        "check.orphan_order_customer": orphan_count(star["fct_orders"], star["dim_customer"], "customer_id"),
        "check.orphan_order_product": orphan_count(star["fct_orders"], star["dim_product"], "item_id"),
        "check.fact_dates_missing_in_dim_date": orphan_count(dates, star["dim_date"], "date"),
    }
    return union_all([check_rows(df, [(name, "0", F.col("orphans"))], "before", "after") for name, df in counts.items()])


def layout_check(spark: SparkSession, star: Mapping[str, DataFrame], layout: Mapping[str, tuple[str, Sequence[str]]],
                 wanted: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """W-15: no personal columns in the customer dimension; partition and cluster columns as planned (from table metadata)."""
    pii = sum(c in star["dim_customer"].columns for c in PII_COLUMNS)
    parts = lambda m: ",".join(sorted(p for p, _ in m.values()))
    clusters = lambda m: "|".join(f"{t}:{','.join(c)}" for t, (_, c) in sorted(m.items()))
    return check_rows(spark.range(1), [
        ("check.dim_customer_pii_columns", "0", F.lit(str(pii))),
        ("check.partition_columns", parts(wanted), F.lit(parts(layout))),
        ("check.cluster_columns", clusters(wanted), F.lit(clusters(layout)))], "before", "after")


def local_date_check(events: DataFrame, date: str = "event_dt", micros: str = "event_timestamp", tz: str = "Asia/Taipei") -> DataFrame:
    """W-16: stored business date against the local date of the UTC microseconds."""
    bad = F.count_if(F.col(date) != local_date(micros, tz))
    return check_rows(events.agg(bad.alias("bad")), [("check.event_dt_vs_local", "0", F.col("bad"))], "before", "after")
