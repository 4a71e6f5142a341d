"""The given tables seen as marketing tables.

Every adapter exists twice: as a DataFrame for the operators and, in ``plans.oracle``, as plain SQL for the cross-check.
Amounts are exact decimals, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.exprs import micros_of

# Which traffic source each event type stands for.
TOUCH_SOURCES = {
    "signup": ("(direct)", "(none)"),
    "view": ("google", "organic"),
    "click": ("meta", "paid_social"),
    "error": ("line", "push"),
}


# Tables whose rows are costly to work on (texts, and events that become JSON), with their unique key.
WIDE = {"events": "event_id", "documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table dealt over all cores by its key: the given files are one row group each, which is one task otherwise."""
    return table(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism, WIDE[name])


def _k() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def _by_type(position: int) -> Column:
    out = F.lit(None).cast("string")
    for kind, pair in TOUCH_SOURCES.items():
        out = F.when(F.col("event_type") == kind, pair[position]).otherwise(out)
    return out


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the event fact: purchases stay, every other event opens a session."""
    e = table(spark, sf_dir, "events")
    purchase = F.col("event_type") == "purchase"
    return e.select(
        "event_id",
        F.to_date("ts").alias("event_dt"),
        micros_of("ts").alias("event_timestamp"),
        F.when(purchase, "purchase").otherwise("session_start").alias("event_name"),
        F.col("user_id").alias("user_pseudo_id"),
        _by_type(0).alias("utm_source"),
        _by_type(1).alias("utm_medium"),
        F.when(F.col("event_type") == "signup", "(direct)")
         .when(~purchase, F.concat(F.lit("c"), (_k() % 5).cast("string"))).alias("utm_campaign"),
        F.concat(F.lit("cr"), (_k() % 24).cast("string")).alias("creative_id"),
        F.concat(F.lit("i"), (_k() % 20).cast("string")).alias("item_id"),
        F.col("value").cast("decimal(18,2)").alias("value"),
        F.when(purchase, F.col("event_id")).alias("transaction_id"),
        F.lit("synthetic").alias("data_source"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as the order fact of the attribution jobs."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return e.select(
        F.col("event_id").alias("transaction_id"),
        F.to_date("ts").alias("order_date"),
        micros_of("ts").alias("order_us"),
        F.col("user_id").alias("customer_id"),
        F.col("user_id").alias("user_pseudo_id"),
        F.concat(F.lit("i"), (_k() % 20).cast("string")).alias("item_id"),
        (1 + _k() % 3).cast("bigint").alias("quantity"),
        F.col("value").cast("decimal(18,2)").alias("revenue"),
        F.lit("synthetic").alias("data_source"),
    )


def shop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with the item of the first line; a few orders have no line."""
    o = table(spark, sf_dir, "orders")
    first = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")).alias("line"))
        .select("l_orderkey", "line.l_partkey", "line.l_quantity")
    )
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return (
        o.join(first, o.o_orderkey == first.l_orderkey, "left")
        .join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select(
            F.col("o_orderkey").alias("transaction_id"),
            F.to_date("o_orderdate").alias("order_date"),
            micros_of("o_orderdate").alias("order_us"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_custkey").alias("user_pseudo_id"),
            F.col("p_brand").alias("item_id"),
            F.col("p_type").alias("category"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.col("p_size").cast("bigint").alias("unit_price"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("revenue"),
            F.concat(F.lit("s"), F.substring("o_orderpriority", 1, 1)).alias("utm_source"),
            F.col("o_orderstatus").alias("utm_medium"),
            F.concat(F.lit("k"), (F.col("o_orderkey") % 7).cast("string")).alias("utm_campaign"),
            F.lit("synthetic").alias("data_source"),
        )
    )


def creative_number(c: str = "l_suppkey") -> Column:
    return (F.col(c) % 24).cast("int")


def ad_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` per ship date and supplier group as the daily advertising fact."""
    li = table(spark, sf_dir, "lineitem")
    cost = F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)")
    c = F.col("creative")
    return (
        li.groupBy(F.to_date("l_shipdate").alias("date"), creative_number().alias("creative"))
        .agg(
            F.sum("l_quantity").cast("bigint").alias("impressions"),
            F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).cast("bigint").alias("clicks"),
            F.sum(cost).cast("decimal(18,4)").alias("cost"),
        )
        .select(
            "date",
            F.concat(F.lit("cr"), c.cast("string")).alias("creative_id"),
            F.concat(F.lit("ch"), (c % 3).cast("string")).alias("channel"),
            F.concat(F.lit("g"), (c % 6).cast("string")).alias("ad_group_id"),
            F.concat(F.lit("k"), (c % 7).cast("string")).alias("utm_campaign"),
            "impressions", "clicks", "cost", F.lit("synthetic").alias("data_source"),
        )
    )


def creatives(spark: SparkSession, sf_dir: str, first_start: str = "1996-01-01", step: int = 10, length: int = 90) -> DataFrame:
    """Suppliers grouped into 24 creatives, with flags balanced in every channel x audience stratum."""
    s = table(spark, sf_dir, "supplier")
    c = F.col("creative")
    return (
        s.groupBy(creative_number("s_suppkey").alias("creative")).agg(F.count(F.lit(1)).alias("suppliers"))
        .select(
            F.concat(F.lit("cr"), c.cast("string")).alias("creative_id"),
            F.concat(F.lit("ch"), (c % 3).cast("string")).alias("channel"),
            F.concat(F.lit("k"), (c % 7).cast("string")).alias("utm_campaign"),
            F.concat(F.lit("P"), (c % 4).cast("string")).alias("promotion_id"),
            F.concat(F.lit("g"), (c % 6).cast("string")).alias("ad_group_id"),
            F.when(c < 12, "prospecting").otherwise("retargeting").alias("audience"),
            F.lit("image").alias("format"),
            F.date_add(F.lit(first_start).cast("date"), c * step).alias("start_date"),
            F.date_add(F.lit(first_start).cast("date"), c * step + length).alias("end_date"),
            F.concat(F.lit("Brand#"), (1 + c % 10).cast("string")).alias("product_focus"),
            (F.floor(c / 3) % 2 == 0).alias("has_person"),
            F.when(F.floor(c / 6) % 2 == 0, "bottom-right").otherwise("center").alias("cta_position"),
            F.when(c % 4 < 2, "warm").otherwise("cool").alias("dominant_color"),
            F.when((c % 4).isin(0, 3), "high").otherwise("low").alias("text_density"),
        )
    )


def nested_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a nested web export, with every irregular shape the flattening has to deal with."""
    e = wide_table(spark, sf_dir, "events").withColumn("k", _k())
    i, k = F.col("event_id"), F.col("k")
    text = lambda c: c.cast("string")
    void = lambda t: F.lit(None).cast(t)

    def p(key: str, s=None, n=None, d=None, f=None) -> Column:
        return F.struct(F.lit(key).alias("key"), F.struct(
            (s if s is not None else void("string")).alias("string_value"), (n if n is not None else void("bigint")).alias("int_value"),
            (d if d is not None else void("double")).alias("double_value"), (f if f is not None else void("double")).alias("float_value")).alias("value"))

    day = F.date_format("ts", "yyyyMMdd")
    slot = i % 3
    params = F.array(
        p("ga_session_id", s=F.when(k % 2 == 0, day), n=F.when((k % 2 == 1) & (k != 13), day.cast("bigint"))),
        p("value", n=F.when(slot == 0, F.floor("value").cast("bigint")), d=F.when(slot == 1, F.col("value")), f=F.when(slot == 2, F.col("value"))),
        p("creative_name", s=F.concat(F.lit("cr"), text(k % 24))),
        p("campaign", s=F.when(k % 4 == 2, F.concat(F.lit("c"), text(k % 5)))),
        p("transaction_id", s=F.when((F.col("event_type") == "purchase") & (k % 3 == 0), F.concat(F.lit("T"), text(i)))))
    item = lambda j: F.struct(
        F.when(k % 10 == 7, "(not set)").otherwise(F.concat(F.lit("i"), text((k + j) % 20))).alias("item_id"),
        F.when(k % 10 == 3, "(not set)").otherwise(F.concat(F.lit("v"), text(k % 4))).alias("item_variant"),
        (1 + k % 3).cast("bigint").alias("quantity"))
    tagged = k % 4 == 1
    return e.select(
        day.alias("event_date"), micros_of("ts").alias("event_timestamp"), F.col("event_type").alias("event_name"),
        F.when(i % 97 != 0, text(F.col("user_id"))).alias("user_pseudo_id"),
        F.when(k % 2 == 0, F.concat(F.lit("C"), text(F.col("user_id")))).alias("user_id"),
        params.alias("event_params"),
        F.when(slot == 0, F.slice(F.array(item(0)), 1, 0)).when(slot == 1, F.array(item(0))).otherwise(F.array(item(0), item(1))).alias("items"),
        F.struct(F.when((F.col("event_type") == "purchase") & (k % 3 == 1), F.concat(F.lit("T"), text(i)))
                 .when(F.col("event_type") == "purchase", "(not set)").alias("transaction_id"),
                 F.when(F.col("event_type") == "purchase", F.when(slot == 0, F.floor("value").cast("double")).otherwise(F.col("value"))).alias("purchase_revenue")).alias("ecommerce"),
        F.struct(F.when(tagged, F.concat(F.lit("src"), text(k % 3))).alias("manual_source"),
                 F.when(tagged & (k % 8 != 5), F.lit("medium")).alias("manual_medium"),
                 void("string").alias("manual_campaign_name")).alias("collected_traffic_source"),
        day.alias("day"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in the flat raw shape."""
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    k, purchase = F.col("k"), F.col("event_type") == "purchase"
    text = lambda c: F.col(c).cast("string")
    return e.select(
        F.date_format("ts", "yyyyMMdd").alias("event_date"), micros_of("ts").alias("event_timestamp"), F.col("event_type").alias("event_name"),
        text("user_id").alias("user_pseudo_id"), F.date_format("ts", "yyyyMMdd").cast("bigint").alias("ga_session_id"),
        F.when(purchase, text("user_id")).alias("customer_id"), _by_type(0).alias("utm_source"), _by_type(1).alias("utm_medium"),
        F.concat(F.lit("c"), (k % 5).cast("string")).alias("utm_campaign"), F.concat(F.lit("cr"), (k % 24).cast("string")).alias("creative_id"),
        F.lit(None).cast("string").alias("promotion_id"), F.when(k % 4 > 0, F.concat(F.lit("i"), (k % 20).cast("string"))).alias("item_id"),
        F.concat(F.lit("v"), (k % 4).cast("string")).alias("item_variant"), (1 + k % 3).cast("bigint").alias("quantity"), F.col("value"),
        F.when(purchase, text("event_id")).alias("transaction_id"), F.lit(None).cast("string").alias("data_source"))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases in the raw order shape."""
    p = purchases(spark, sf_dir)
    return p.select(F.col("transaction_id").cast("string").alias("transaction_id"), "order_us", "order_date",
                    F.col("customer_id").cast("string").alias("customer_id"), F.col("user_pseudo_id").cast("string").alias("user_pseudo_id"),
                    "item_id", "quantity", F.pmod(F.col("order_us"), F.lit(4)).alias("unit_price"), "revenue")


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("name"),
                    F.concat(F.lower("c_mktsegment"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
                    F.concat(F.lit("09"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("phone"),
                    F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("city"),
                    F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int")).alias("first_order_date"))


def site_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (ship date, order) pairs of ``lineitem`` as the purchases a web site would have tracked."""
    li = table(spark, sf_dir, "lineitem")
    amount = F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))
    return li.groupBy(F.to_date("l_shipdate").alias("event_dt"), F.col("l_orderkey").alias("transaction_id")).agg(amount.alias("value")).select(
        "event_dt", "transaction_id", F.lit("purchase").alias("event_name"), F.concat(F.lit("ch"), (F.col("transaction_id") % 3).cast("string")).alias("utm_source"),
        F.lit("paid").alias("utm_medium"), F.col("value").cast("decimal(18,2)").alias("value"), F.lit("synthetic").alias("data_source"))


# The causes a diagnosis may name.
CAUSES = ("競價變貴", "追蹤碼失效", "素材疲乏", "需求或季節變化", "其他", "資料不足")


def diagnosis_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as model replies: mostly sound JSON, some broken, off-list or failed."""
    e = wide_table(spark, sf_dir, "events").withColumn("k", _k())
    k = F.col("k")
    causes = F.array(*[F.lit(c) for c in CAUSES], F.lit("不明"))
    body = F.format_string('{"cause": "%s", "evidence": "%s", "confidence": %s, "next_check": "n%d"}',
                           F.get(causes, k % 7), F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("e"), k.cast("string"))),
                           F.when(k % 19 == 0, "1.5").when(k % 23 == 0, '"high"').otherwise(F.concat(F.lit("0."), F.lpad((k % 100).cast("string"), 2, "0"))), k)
    return e.select(
        F.concat(F.lit("site_day|all_site|"), F.to_date("ts").cast("string")).alias("anomaly_id"), F.lit("all_site").alias("entity"),
        F.to_date("ts").alias("period_start"), F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("model"), F.col("event_id"),
        F.when(k % 10 == 9, F.substring(body, 1, 20)).otherwise(body).alias("raw_result"),
        F.format_string('{"prompt_token_count": %d, "candidates_token_count": %d, "thoughts_token_count": %d}', k + 100, k % 50,
                        F.when(k % 29 == 0, 5).otherwise(0)).alias("statistics"),
        F.when(k % 31 == 0, "RESOURCE_EXHAUSTED").otherwise("").alias("status"), micros_of("ts").alias("created_us"))


# Fixed values for the constructed season-report replies.
TARGETS = ("meta-trn-prospecting", "cr-meta-evg-p1", "全站", "秋日專案商品")
PERIODS = ("8/12", "8/24", "整季")
OBSERVATIONS = ("CPC 上升一倍", "追蹤到的購買事件少了", "點擊率逐週下降", "占比上升", "沒有變化")


def season_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as replies to the season report: up to two findings each, some replies broken."""
    e = wide_table(spark, sf_dir, "events").withColumn("k", _k())
    k = F.col("k")
    at = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i % len(values))
    finding = lambda s: F.format_string(
        '{"target": "%s", "period": "%s", "observation": "%s", "likely_cause": "c%d"}', at(TARGETS, k + s), at(PERIODS, k + s), at(OBSERVATIONS, k + 2 * s), k)
    body = F.when(k % 6 == 0, F.lit('{"findings": []}')).when(k % 6 < 3, F.format_string('{"findings": [%s]}', finding(0))) \
        .otherwise(F.format_string('{"findings": [%s, %s]}', finding(0), finding(1)))
    return e.select(
        F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("model"), F.col("event_id").alias("run_no"),
        F.when(k % 10 == 9, F.substring(body, 1, 30)).otherwise(body).alias("raw_result"),
        F.format_string('{"prompt_token_count": %d, "candidates_token_count": %d, "thoughts_token_count": %d}', k + 100, k % 50,
                        F.when(k % 29 == 0, 5).otherwise(0)).alias("statistics"),
        F.when(k % 31 == 0, "RESOURCE_EXHAUSTED").otherwise("").alias("status"))


# Fixed values for the constructed reply logs.
REPLY_CTA = ("center", "bottom_right", "none", "left")
REPLY_COLOR = ("warm", "cool", "neutral", "brown")
REPLY_DENSITY = ("low", "high")
DRAFT_WORDS = ("抗菌", "除臭", "最好", "保證", "極致", "柔軟", "舒服", "日常", "黃金", "預防")


def _at(values, i: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))


def raw_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as raw model responses about one image per user."""
    e = wide_table(spark, sf_dir, "events").withColumn("k", _k())
    k, i = F.col("k"), F.col("event_id")
    q = lambda c: F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), c, F.lit('"')))
    body = F.format_string(
        '{"has_person": %s, "cta_position": %s, "dominant_color": %s, "text_density": %s, "headline": %s}',
        F.when(k % 19 == 0, "null").when(k % 2 == 0, "true").otherwise("false"), q(_at(REPLY_CTA, F.floor(i / 3) % 9)), q(F.when(k % 5 < 4, _at(REPLY_COLOR, k % 5))),
        q(_at(REPLY_DENSITY, F.floor(k / 2))), q(F.when(k % 23 == 0, "").otherwise(F.concat(F.lit("H "), (F.col("user_id") % 5).cast("string")))))
    num = lambda c: F.when(c.isNull(), "null").otherwise(c.cast("string"))
    full = F.format_string(
        '{"usage_metadata": {"prompt_token_count": %s, "candidates_token_count": %d, "thoughts_token_count": %s, "cached_content_token_count": %d}, "candidates": [{"finish_reason": "%s"}]}',
        num(F.when(k % 37 != 0, 1000 + k)), 20 + k % 30, num(F.when(k % 3 == 0, k)), F.when(k % 4 == 0, 500).otherwise(0), F.when(k % 41 == 0, "MAX_TOKENS").otherwise("STOP"))
    return e.select(
        "event_id", F.concat(F.lit("r"), F.date_format("ts", "yyyyMMdd")).alias("run_id"), F.when(i % 3 == 0, "low").otherwise("default").alias("resolution"),
        F.when(i % 5 == 0, "response_schema").otherwise("output_schema").alias("method"), F.concat(F.lit("m"), (k % 2).cast("string")).alias("model"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("creative_id"), micros_of("ts").alias("created_us"),
        F.when(k % 43 == 0, F.substring(body, 1, 25)).otherwise(body).alias("result"), full.alias("full_response"), F.when(k % 31 == 0, "ERROR").otherwise("").alias("status"))


def _encoded(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _as_sent(i: Column, whole: Column, cut: Column) -> Column:
    """One of eight forms of a reply: three as asked, one fenced, one encoded twice, one cut off, one both, one refused."""
    return F.when(i % 8 < 3, whole).when(i % 8 == 3, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(i % 8 == 4, _encoded(whole)) \
        .when(i % 8 == 5, cut).when(i % 8 == 6, F.concat(F.regexp_replace(_encoded(cut), '"$', ""), F.lit("\\"))).otherwise("I cannot see {any} \"image\": [sorry")


def _with_result(spark: SparkSession, sf_dir: str, whole, cut) -> DataFrame:
    """``raw_replies`` with results of another task, built from number, event and user."""
    e = wide_table(spark, sf_dir, "events").select(F.col("event_id").alias("_e"), F.col("user_id").alias("_u"), _k().alias("_k"))
    k, i, u = F.col("_k"), F.col("_e"), F.col("_u")
    texts = e.select(F.col("_e").alias("event_id"), _as_sent(i, whole(k, i, u), cut(k, i, u)).alias("result"))
    return raw_replies(spark, sf_dir).drop("result").join(texts, "event_id")


def gap_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that list up to three gaps, with quotes and brackets in their texts; a cut one stops inside one more gap."""
    def listed(k, u):
        gap = lambda j, p: F.when(p, F.to_json(F.struct(_at(GAP_KINDS, u + j).alias("gap_type"), F.concat(F.lit('} "'), _at(GAP_WORDS, u + j), F.lit('" ] \\ ,')).alias("ad_text"), F.concat(F.lit("e"), k.cast("string")).alias("page_evidence"))))
        return F.concat_ws(", ", gap(0, k % 3 > 0), gap(1, k % 2 == 0), gap(2, k % 5 == 0))

    head = lambda u: F.concat(F.lit('{"ad_texts": ["'), _at(GAP_WORDS, u), F.lit('", "立即選購"], "gaps": ['))
    whole = lambda k, i, u: F.concat(head(u), listed(k, u), F.lit("]}"))
    cut = lambda k, i, u: F.concat(head(u), listed(k, u), F.when(listed(k, u) != "", ", ").otherwise(""), F.lit('{"gap_type": "other", "ad_text": "半'))
    return _with_result(spark, sf_dir, whole, cut)


def draft_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that draft an advertisement; a cut one stops inside the ratio."""
    def first(k, i, u):
        return F.struct(F.concat(_at(DRAFT_WORDS, k), F.lit(' "標題"')).alias("headline"), F.when(k % 3 == 0, _at(DRAFT_WORDS, k + 3)).alias("subhead"), F.when(k % 29 != 0, "立即選購").alias("cta_text"),
                        _at(REPLY_CTA, F.floor(i / 3) % 9).alias("cta_position"), (k % 2 == 0).alias("has_person"), _at(REPLY_COLOR, k % 5).alias("dominant_color"), _at(REPLY_DENSITY, F.floor(k / 2)).alias("text_density"),
                        F.lit("a {b}\n[c]").alias("changes"), _at(("person", "cta", "warm", "text", "other"), k).alias("cited_feature"))

    open_ = lambda k, i, u: F.concat(F.regexp_replace(F.to_json(first(k, i, u)), r"\}$", ""), F.lit(', "cited_ratio": 1.'))
    whole = lambda k, i, u: F.concat(open_(k, i, u), (k % 10).cast("string"), F.lit(', "expected_effect": "CTR"}'))
    return _with_result(spark, sf_dir, whole, lambda k, i, u: F.concat(open_(k, i, u), F.lit("0")))


def structured_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in the five fixed fields; a cut one stops inside the headline."""
    def head(k, i, u):
        return F.concat(F.lit('{"has_person": '), F.when(k % 2 == 0, "true").otherwise("false"), F.lit(', "cta_position" : "'), _at(REPLY_CTA, F.floor(i / 3) % 9), F.lit('", "dominant_color": "'),
                        _at(REPLY_COLOR, k % 5), F.lit('",\n "text_density": "'), _at(REPLY_DENSITY, F.floor(k / 2)), F.lit('", "headline": "H '), (u % 5).cast("string"))

    return _with_result(spark, sf_dir, lambda k, i, u: F.concat(head(k, i, u), F.lit('"}')), lambda k, i, u: head(k, i, u))


def describe_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free descriptions, some too short."""
    return raw_replies(spark, sf_dir).withColumn("result", F.when(F.col("event_id") % 6 == 0, F.lit("  短 ")).when(F.col("event_id") % 6 == 1, F.lit(None).cast("string"))
                                                 .otherwise(F.concat(F.lit(" 一張白色背景的圖，中間有一雙襪子，右下角有按鈕 "), F.col("creative_id"))))


def image_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design of each user's image."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    i = F.col("user_id")
    return u.select(F.concat(F.lit("c"), i.cast("string")).alias("creative_id"), (i % 2 == 0).alias("has_person"), _at(REPLY_CTA[:3], i).alias("cta_position"),
                    _at(REPLY_COLOR[:3], i).alias("dominant_color"), _at(REPLY_DENSITY, i).alias("text_density"), F.concat(F.lit("H"), (i % 5).cast("string")).alias("headline"),
                    F.concat(F.lit("i"), (i % 20).cast("string")).alias("product_focus"), F.lit("image").alias("format"), F.concat(F.lit("ch"), (i % 3).cast("string")).alias("channel"),
                    F.concat(F.lit("k"), (i % 4).cast("string")).alias("utm_campaign"), F.concat(F.lit("g"), (i % 6).cast("string")).alias("ad_group_id"))


def image_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = image_truth(spark, sf_dir)
    i = F.substring("creative_id", 2, 20).cast("bigint")
    return t.where(i % 7 < 2).select("creative_id", F.lit("dominant_color").alias("field"), F.when(i % 7 == 0, "disagree").otherwise("borderline").alias("verdict"), F.lit("eye").alias("eye_value"))


def draft_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as calls for new drafts of each user's image."""
    e = wide_table(spark, sf_dir, "events").withColumn("k", _k())
    k, i = F.col("k"), F.col("event_id")
    return e.select(
        "event_id", F.concat(F.lit("r"), F.date_format("ts", "yyyyMMdd")).alias("run_id"), _at(("free", "rules"), k).alias("version"), (1 + i % 2).cast("bigint").alias("sample"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("creative_id"), F.lit("m0").alias("model"), F.concat(_at(DRAFT_WORDS, k), F.lit("標題")).alias("headline"),
        F.when(k % 3 == 0, _at(DRAFT_WORDS, k + 3)).alias("subhead"), F.lit(None).cast("string").alias("badge"), F.when(k % 29 != 0, "立即選購").alias("cta_text"),
        _at(REPLY_CTA, F.floor(i / 3) % 9).alias("cta_position"), (k % 2 == 0).alias("has_person"), _at(REPLY_COLOR, k % 5).alias("dominant_color"), _at(REPLY_DENSITY, F.floor(k / 2)).alias("text_density"),
        _at(("person", "cta", "warm", "text", "other"), k).alias("cited_feature"), (F.lit(90) + k % 20).cast("double").alias("_r"),
        F.concat(F.lit("點擊率約 1.0"), (k % 10).cast("string"), F.when(k % 4 == 0, "，銷量會增加").otherwise("")).alias("expected_effect"),
        (1000 + k).cast("bigint").alias("prompt_tokens"), (20 + k % 30).cast("bigint").alias("output_tokens"), F.when(k % 3 == 0, k).cast("bigint").alias("thoughts_tokens"),
        F.when(k % 41 == 0, "MAX_TOKENS").otherwise("STOP").alias("finish_reason"), F.when(k % 31 == 0, "ERROR").otherwise("").alias("status"), micros_of("ts").alias("created_us"),
        F.when(i % 5 == 0, F.lit(None).cast("string")).otherwise("response_schema").alias("method")).withColumn("cited_ratio", F.col("_r") / 100).drop("_r")


# Fixed values for the constructed answer table and gap replies.
GAP_KINDS = ("limited_offer", "special_price", "free_shipping", "gift", "product_name", "product_option", "other")
GAP_WORDS = ("限定", "免運", "短襪", "特價", "多色")


def gap_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two known gaps per user's image; every fifth image has none."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    i = F.col("user_id")
    row = lambda j: F.struct(_at(GAP_KINDS[:6], i + 3 * j).alias("gap_type"), _at(GAP_WORDS, i + j).alias("ad_keyword"), F.lit(f"fact{j}").alias("page_fact"), (i % 9 == j).alias("disputed"))
    return u.where(i % 5 != 4).select(F.concat(F.lit("c"), i.cast("string")).alias("creative_id"), F.inline(F.array(row(0), row(1))))


def gap_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as replies that list gaps between an image and its page."""
    e = wide_table(spark, sf_dir, "events").withColumn("k", _k())
    k, i, u = F.col("k"), F.col("event_id"), F.col("user_id")
    gap = lambda kind, word: F.format_string('{"gap_type": "%s", "ad_text": "現在%s中", "page_evidence": "e%d"}', kind, word, k)
    gaps = F.concat_ws(", ", F.when(k % 3 > 0, gap(_at(GAP_KINDS[:6], u), _at(GAP_WORDS, u + F.when(k % 7 == 0, 1).otherwise(0)))),
                       F.when(k % 2 == 0, gap(_at(GAP_KINDS[:6], u + 3), _at(GAP_WORDS, u + 1))), F.when(k % 5 == 0, gap(F.lit("other"), F.lit("其他"))))
    body = F.format_string('{"ad_texts": ["%s", "立即選購"], "gaps": [%s]}', _at(GAP_WORDS, u), gaps)
    return e.select(
        "event_id", F.concat(F.lit("r"), F.date_format("ts", "yyyyMMdd")).alias("run_id"), _at(("image", "text"), i).alias("mode"), F.concat(F.lit("c"), u.cast("string")).alias("creative_id"),
        _at(("m0", "m1", "m2"), i).alias("model"), F.when(k % 43 == 0, F.substring(body, 1, 30)).otherwise(body).alias("result"), (1000 + k).cast("bigint").alias("prompt_tokens"),
        (20 + k % 30).cast("bigint").alias("output_tokens"), F.when(k % 3 == 0, k).cast("bigint").alias("thoughts_tokens"), F.when(k % 41 == 0, "MAX_TOKENS").otherwise("STOP").alias("finish_reason"),
        F.when(k % 31 == 0, "ERROR").otherwise("").alias("status"), micros_of("ts").alias("created_us"))


def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as model calls: some failed, some without token counts, one model without a price."""
    e = wide_table(spark, sf_dir, "events").withColumn("k", _k())
    k, i = F.col("k"), F.col("event_id")
    return e.select(
        micros_of("ts").alias("logged_us"), F.concat(F.lit("Day "), (k % 5).cast("string")).alias("day"), _at(("ask", "serve", "eval"), i).alias("job"),
        F.concat(F.lit("r"), F.date_format("ts", "yyyyMMdd")).alias("run_id"), _at(("m0", "m1", "m2", "m3"), k).alias("model"), _at(("global", "non-global"), i).alias("endpoint_type"),
        _at(("low", "default", "none"), k).alias("media_resolution"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("item_id"),
        F.when(k % 37 != 0, 1000 + k).cast("bigint").alias("prompt_tokens"), F.when(k % 29 != 0, 20 + k % 30).cast("bigint").alias("output_tokens"), F.when(k % 31 == 0, "ERROR").otherwise("").alias("status"))


# Unit prices of the constructed ledger, with a change in the middle of the month.
PRICE_ROWS = (
    ("m0", "global", "2023-01-01", "2024-01-15", "0.75", "3.75"), ("m0", "global", "2024-01-16", "9999-12-31", "1.50", "7.50"),
    ("m0", "non-global", "2023-01-01", "9999-12-31", "0.825", "4.125"), ("m1", "global", "2023-01-01", "9999-12-31", "0.30", "2.50"),
    ("m1", "non-global", "2023-01-01", "9999-12-31", "0.33", "2.75"), ("m2", "global", "2024-01-10", "2024-01-20", "2.00", "12.00"))


def price_rows() -> list[tuple]:
    from datetime import date
    from decimal import Decimal
    return [(m, e, date.fromisoformat(a), date.fromisoformat(b), Decimal(i), Decimal(o), "") for m, e, a, b, i, o in PRICE_ROWS]


def cache_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as calls with and without a cached prompt."""
    e = wide_table(spark, sf_dir, "events").withColumn("k", _k())
    k, i = F.col("k"), F.col("event_id")
    scenario = _at(("old", "new", "explicit", "verify_1"), i)
    return e.select(
        micros_of("ts").alias("run_us"), scenario.alias("scenario"), (1 + k % 3).cast("bigint").alias("round"),
        F.concat(F.lit("site_day|"), _at(("all_site", "g1", "cr3"), k), F.lit("|"), F.to_date("ts").cast("string")).alias("anomaly_id"), F.when(k % 47 != 0, _at(CAUSES[:3], k)).alias("cause"),
        (5000 + k).cast("bigint").alias("prompt_tokens"), F.when(scenario == "explicit", 4200 + k).when((scenario == "new") & (k % 2 == 0), 2000).otherwise(0).cast("bigint").alias("cached_tokens"),
        (50 + k % 20).cast("bigint").alias("output_tokens"), F.when(k % 31 == 0, "ERROR").otherwise("").alias("status"))


# Sample answers for the rule grader: right, half right and wrong ones, with the spaces that wide keyboards leave.
ANSWERS = (
    "變化始於 08-12，競爭加劇，單價翻倍", "8月10 起變貴，CPC 是之前的 2\u3000倍", "成本在春天就漲了", "手邊沒有資料可看", "8月27 追蹤中斷，訂單照常", "08-27 有 37 筆，追蹤碼\u00a0沒送出",
    "無法得知那天的情況", "cr-meta-evg-p1 從 7月20 起點擊變少", "是 cr-goo-brand-2", "人物是 1.30 倍、CTA 是 1.10 倍、暖色 1.05 倍，最有用的是人物", "暖色 8%、按鈕 13%、人物 28%，人物影響最大",
    "人物 2 倍、暖色 3 倍", "第一次接觸多半是 meta，最後一次接觸多半是 google", "兩個通路差不多", "沒有這項資料", "大約 1,240 件", "LINE 沒有異常", "LINE 的 8/27 也是追蹤碼", "　")


def eval_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as answers to eight questions, asked with and without tools."""
    e = wide_table(spark, sf_dir, "events").withColumn("k", _k())
    k, i = F.col("k"), F.col("event_id")
    tools = i % 2 == 0
    return e.select(
        "event_id", F.concat(F.lit("r"), F.date_format("ts", "yyyyMMdd")).alias("run_id"), F.concat(F.lit("e"), (1 + k % 8).cast("string")).alias("case_id"), F.when(tools, "tools").otherwise("none").alias("mode"),
        F.when(k % 8 < 5, "facts").otherwise("other").alias("kind"), F.concat(F.lit("q"), (k % 8).cast("string")).alias("question"), _at(ANSWERS, i).alias("answer"),
        F.when(k % 31 == 0, "error: quota").when(k % 29 == 0, "incomplete").otherwise("").alias("status"), F.when(k % 50 == 0, "v0").otherwise("v1").alias("spec"), (1 + k % 4).cast("bigint").alias("model_calls"),
        F.when(tools, k % 3).otherwise(0).cast("bigint").alias("tool_calls"),
        F.when(tools, F.format_string('[{"name": "get_ad_spend", "args": {"group_by": "%s"}}]', _at(("channel", "creative"), k))).otherwise("[]").alias("tools_called"), micros_of("ts").alias("created_us"))


def eval_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = eval_answers(spark, sf_dir)
    i = F.col("event_id")
    return a.select("event_id", "run_id", "case_id", "mode", F.lit("m0").alias("model"), (1000 + i % 500).cast("bigint").alias("prompt_tokens"), (20 + i % 30).cast("bigint").alias("output_tokens"),
                    F.when(i % 3 == 0, i % 40).cast("bigint").alias("thoughts_tokens"), "status")


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = wide_table(spark, sf_dir, "events").withColumn("k", _k())
    k, i = F.col("k"), F.col("event_id")
    return e.select(
        "event_id", F.concat(F.lit("e"), (1 + F.floor(k / 2) % 8).cast("string")).alias("case_id"), F.when(k % 2 == 0, "tools").otherwise("none").alias("mode"), _at(("rule", "human", "judge:m0-lite", "judge:m1"), i).alias("grader"),
        (k % 3).cast("bigint").alias("score"), F.concat(F.lit("x"), k.cast("string")).alias("explanation"), F.when(k % 31 == 0, "error").otherwise("").alias("status"),
        F.concat(F.lit("r"), F.date_format("ts", "yyyyMMdd")).alias("answer_run_id"), F.lit("v1").alias("spec"), (500 + k).cast("bigint").alias("prompt_tokens"), F.lit(256).cast("bigint").alias("output_tokens_cap"), micros_of("ts").alias("created_us"))


def serve_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as turns: a third of them are dialogues of their own, the others belong to one dialogue per user and day."""
    e = wide_table(spark, sf_dir, "events").withColumn("k", _k())
    k, i = F.col("k"), F.col("event_id")
    call = lambda n: F.format_string('{"name": "%s", "error": "%s"}', _at(("get_top_customers", "get_ad_spend", "get_campaign_notes"), n), F.when(n % 5 == 0, "refused").otherwise(""))
    return e.select(
        "event_id", F.when(i % 3 == 1, F.concat(F.lit("s"), i.cast("string"))).otherwise(F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "dd"))).alias("session_id"), (1 + F.floor(F.hour("ts") / 3)).cast("bigint").alias("turn"),
        F.when(k % 53 == 0, F.lit(None).cast("string")).otherwise(F.concat(_at(("runner@", "other@"), F.when(k % 59 == 0, 1).otherwise(0)), F.lit("example.com"))).alias("caller"),
        F.concat(F.lit("問題"), k.cast("string")).alias("question"), F.concat(F.lit("答"), k.cast("string")).alias("raw_answer"),
        F.concat(F.lit("答"), k.cast("string"), F.when(k % 61 == 0, " [x]").when(k % 67 == 0, " ab@mail.example.com").when(k % 71 == 0, " MKT-1").otherwise("")).alias("final_answer"),
        F.when(k % 17 == 0, '["ignore"]').otherwise("[]").alias("input_hits"), _at(("passed", "claims_flagged", "output_blocked"), F.floor(k / 10)).alias("action"),
        F.concat(F.lit("["), call(k), F.lit("]")).alias("tools_called"), (k % 4).cast("bigint").alias("model_calls"), (1000 + k).cast("bigint").alias("prompt_tokens"), (20 + k % 30).cast("bigint").alias("output_tokens"),
        ((1000 + k) * 0.75 / 1e6 * 32).alias("cost_twd"), F.lit("").alias("status"), (k % 3 > 0).alias("kept_in_history"), micros_of("ts").alias("created_us"))


def daily_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as sections of daily reports: several executions a day, sections recorded more than once, each in a dialogue of its own."""
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    k, i = F.col("k"), F.col("event_id")
    status = F.when(k % 7 == 0, "failed").when(k % 11 == 0, "skipped").otherwise("ok")
    return e.select(
        "event_id", F.to_date("ts").alias("report_date"), F.concat(F.lit("exec"), F.date_format("ts", "MMdd"), F.lit("-"), (F.col("user_id") % 4).cast("string")).alias("execution_id"),
        _at(("scheduler", "manual"), i).alias("trigger_source"), (1 + k % 3).cast("bigint").alias("section_no"), F.concat(F.lit("T"), (1 + k % 3).cast("string")).alias("section_title"), F.concat(F.lit("Q"), (k % 3).cast("string")).alias("question"),
        F.when(status == "ok", F.when(k % 83 == 0, "").otherwise(F.concat(F.lit("A"), k.cast("string")))).otherwise("").alias("answer"), status.alias("status"),
        F.when(status == "ok", F.when(k % 89 == 0, "odd").otherwise("passed")).otherwise("error").alias("detail"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("s"), i.cast("string"))).alias("session_id"),
        micros_of("ts").alias("created_us"))


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    k = F.col("k")
    kind = _at(("anomaly", "daily_report", "report_incomplete", "flow_error"), k)
    key = F.when(kind == "anomaly", F.concat(F.lit("anomaly:creative_week|cr"), (k % 24).cast("string"), F.lit("|1995-01-23"))).otherwise(F.concat(kind, F.lit(":"), F.to_date("ts").cast("string")))
    return e.select("event_id", micros_of("ts").alias("sent_us"), F.to_date("ts").alias("report_date"), F.concat(F.lit("exec"), F.date_format("ts", "MMdd"), F.lit("-0")).alias("execution_id"), kind.alias("kind"), key.alias("dedupe_key"),
                    F.when(k % 3 == 0, "failed").otherwise("sent").alias("status"), F.lit("").alias("detail"), F.concat(F.lit("訊息\n"), k.cast("string")).alias("message"))
