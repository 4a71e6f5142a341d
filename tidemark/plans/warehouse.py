from pyspark.sql import functions as F

from ..operators import warehouse as w
from ..sources import adapters as a, io
from ..sources.schemas import schema_of
from .oracle import CTES, K, sql

CTES["flat"] = f"""
  SELECT CAST(ts AS DATE) AS event_dt, strftime(ts, '%Y%m%d') AS event_date, epoch_us(ts) AS event_timestamp, event_type AS event_name,
    CAST(user_id AS VARCHAR) AS user_pseudo_id, CASE WHEN k <> 13 THEN CAST(strftime(ts, '%Y%m%d') AS BIGINT) END AS ga_session_id,
    CASE WHEN k % 2 = 0 THEN 'C' || user_id END AS customer_id, s, m, c, k % 4 IN (1, 2) AS has_source,
    'cr' || (k % 24) AS creative_id, CAST(NULL AS VARCHAR) AS promotion_id,
    CASE WHEN event_id % 3 = 1 AND k % 10 <> 7 THEN 'i' || (k % 20) END AS item_id,
    CASE WHEN event_id % 3 = 1 AND k % 10 <> 3 THEN 'v' || (k % 4) END AS item_variant,
    CASE WHEN event_id % 3 = 1 THEN CAST(1 + k % 3 AS BIGINT) END AS quantity, event_id % 3 AS item_count,
    CASE WHEN event_id % 3 = 0 THEN floor(value) ELSE value END AS value,
    CASE WHEN event_type = 'purchase' AND k % 3 < 2 THEN 'T' || event_id END AS transaction_id, 'ga4' AS data_source
  FROM (SELECT *, CASE WHEN k % 4 = 1 THEN 'src' || (k % 3) END AS s, CASE WHEN k % 4 = 1 AND k % 8 <> 5 THEN 'medium' END AS m,
          CASE WHEN k % 4 = 2 THEN 'c' || (k % 5) END AS c FROM (SELECT *, {K} AS k FROM events))
  WHERE event_id % 97 <> 0"""
CTES["flat_first"] = """
  SELECT user_pseudo_id, coalesce(ga_session_id, event_timestamp) AS sess, s, m, c FROM flat WHERE has_source
  QUALIFY row_number() OVER (PARTITION BY user_pseudo_id, coalesce(ga_session_id, event_timestamp) ORDER BY event_timestamp) = 1"""
CTES["flat_filled"] = """
  SELECT f.event_dt, f.event_date, f.event_timestamp, f.event_name, f.user_pseudo_id, f.ga_session_id, f.customer_id,
    coalesce(x.s, '(direct)') AS utm_source, coalesce(x.m, '(none)') AS utm_medium, coalesce(x.c, '(direct)') AS utm_campaign,
    f.creative_id, f.promotion_id, f.item_id, f.item_variant, f.quantity, f.item_count, f.value, f.transaction_id, f.data_source
  FROM flat f LEFT JOIN flat_first x ON x.user_pseudo_id = f.user_pseudo_id AND x.sess = coalesce(f.ga_session_id, f.event_timestamp)"""
CTES["raw_ev"] = f"""
  SELECT CAST(ts AS DATE) AS event_dt, strftime(ts, '%Y%m%d') AS event_date, epoch_us(ts) AS event_timestamp, event_type AS event_name,
    CAST(user_id AS VARCHAR) AS user_pseudo_id, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS ga_session_id,
    CASE WHEN event_type = 'purchase' THEN CAST(user_id AS VARCHAR) END AS customer_id,
    CASE event_type WHEN 'signup' THEN '(direct)' WHEN 'view' THEN 'google' WHEN 'click' THEN 'meta' WHEN 'error' THEN 'line' END AS utm_source,
    CASE event_type WHEN 'signup' THEN '(none)' WHEN 'view' THEN 'organic' WHEN 'click' THEN 'paid_social' WHEN 'error' THEN 'push' END AS utm_medium,
    'c' || ({K} % 5) AS utm_campaign, 'cr' || ({K} % 24) AS creative_id, CAST(NULL AS VARCHAR) AS promotion_id,
    CASE WHEN {K} % 4 > 0 THEN 'i' || ({K} % 20) END AS item_id, 'v' || ({K} % 4) AS item_variant, CAST(1 + {K} % 3 AS BIGINT) AS quantity,
    CAST(CASE WHEN {K} % 4 > 0 THEN 1 ELSE 0 END AS BIGINT) AS item_count, value,
    CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS transaction_id, 'synthetic' AS data_source FROM events"""
CTES["raw_od"] = f"""
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, epoch_us(ts) AS order_us, CAST(ts AS DATE) AS order_date, CAST(user_id AS VARCHAR) AS customer_id,
    CAST(user_id AS VARCHAR) AS user_pseudo_id, 'i' || ({K} % 20) AS item_id, CAST(1 + {K} % 3 AS BIGINT) AS quantity,
    epoch_us(ts) % 4 AS unit_price, CAST(value AS DECIMAL(18,2)) AS revenue FROM events WHERE event_type = 'purchase'"""
CTES["creatives24"] = CTES["creatives"].replace("DATE '1996-01-01' + c * 10", "DATE '2024-01-01' + c * 1").replace(
    "DATE '1996-03-31' + c * 10", "DATE '2024-01-10' + c * 1").replace("'Brand#' || (1 + c % 10)", "'i' || c")


def creatives24(s, d):
    return a.creatives(s, d, "2024-01-01", 1, 9).withColumn("product_focus", F.regexp_replace("creative_id", "cr", "i"))


def nested(s, d):
    """The nested export as a stored table, which is what it is outside this adapter."""
    return io.materialize(a.nested_export(s, d))


def star(s, d, export=None):
    raw, cr = a.raw_events(s, d), creatives24(s, d)
    events = w.build_fct_events(raw, w.flatten_events(nested(s, d) if export is None else export))
    orders = w.build_fct_orders(a.raw_orders(s, d))
    ads = w.build_fct_ad_daily(a.ad_daily(s, d))
    return {
        "fct_events": events, "fct_orders": orders, "fct_ad_daily": ads, "dim_creative": w.build_dim_creative(cr),
        "dim_customer": w.build_dim_customer(a.raw_customers(s, d)),
        "dim_product": w.build_dim_product(events, orders, cr),
        "dim_date": w.build_dim_date([events.select("event_dt"), orders.select("order_date")], cr),
    }


def _params(s, d):
    return a.nested_export(s, d).where("user_pseudo_id is not null").select(
        "event_timestamp", w.param("event_params", "ga_session_id", "int").alias("session_id"), w.param("event_params", "campaign").alias("campaign"))


def _numeric(s, d):
    return a.nested_export(s, d).where("user_pseudo_id is not null").select(
        "event_timestamp", F.round(w.numeric_param("event_params", "value"), 6).alias("value"))


def _items(s, d):
    return a.nested_export(s, d).where("user_pseudo_id is not null").select("event_timestamp", *[c.alias(n) for n, c in w.single_item().items()])


def _sources(s, d):
    return w.flatten_events(nested(s, d)).select("event_timestamp", "user_pseudo_id", "utm_source", "utm_medium", "utm_campaign")


def _reconcile(s, d):
    export = nested(s, d)
    return w.reconcile(s, a.raw_events(s, d), export, a.ad_daily(s, d), a.raw_orders(s, d), creatives24(s, d), a.raw_customers(s, d), star(s, d, export))


def _csv_round_trip(s, d):
    """Writes the derived raw orders as CSV to the shared folder and loads them with the fixed schema."""
    schema = schema_of("transaction_id string!, order_us bigint!, order_date date!, customer_id string, user_pseudo_id string, item_id string, "
                       "quantity bigint, unit_price bigint, revenue decimal(18,2)")
    path = io.scratch_dir(s)
    a.raw_orders(s, d).write.mode("overwrite").option("header", True).csv(path)
    return io.read_typed_csv(s, path, schema)


def _ndjson_round_trip(s, d):
    path = io.scratch_dir(s)
    a.table(s, d, "events").select("event_id", "user_id", "props").write.mode("overwrite").json(path)
    rows = io.read_ndjson(s, path, schema_of("event_id bigint, user_id bigint, props string"))
    return rows.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _daily_tables(s, d):
    """The nested export written as one folder per day (and an intraday twin of each) and read back without the twins."""
    path = io.scratch_dir(s)
    nested = a.nested_export(s, d)
    nested.unionByName(nested.withColumn("day", F.concat(F.lit("intraday_"), "day"))).write.mode("overwrite").partitionBy("day").parquet(path)
    schema = nested.schema
    return io.read_daily_tables(s, path, schema).groupBy("day").agg(F.count(F.lit(1)).alias("events"), F.sum(F.size("items")).alias("items"))


def _fact_write(s, d):
    path = io.scratch_dir(s)
    io.write_fact(a.web_events(s, d), path, "event_dt", ["event_name", "user_pseudo_id"])
    return io.read_fact(s, path, "event_dt", "2024-01-05", "2024-01-18").where("event_name = 'purchase'").select("event_id", "event_dt", "user_pseudo_id", "value")


def _row_count(s, d):
    path = io.scratch_dir(s)
    rows = a.raw_orders(s, d)
    rows.repartition(3, "transaction_id").write.mode("overwrite").option("header", True).csv(path)
    return io.loaded_rows_match(io.read_typed_csv(s, path, rows.schema), path)


def _header(s, d):
    path = io.scratch_dir(s)
    rows = a.raw_orders(s, d)
    rows.write.mode("overwrite").option("header", True).csv(path)
    return io.header_matches(s, path, rows.schema).select("header", "ok")


def _listing(s, d):
    """Files of one folder per day, from their metadata."""
    path = io.scratch_dir(s)
    a.web_events(s, d).select("event_id", "event_dt").repartition("event_dt").write.mode("overwrite").partitionBy("event_dt").json(path)
    files = io.file_listing(s, path, "*.json")
    return files.select(F.regexp_extract("uri", "event_dt=([0-9-]+)", 1).alias("day"), (F.col("size") > 0).alias("filled")).distinct()


def _replace(s, d):
    """A table written twice, a part of it appended again, then the rows of one kind deleted and columns added and dropped."""
    path = io.scratch_dir(s)
    e = a.table(s, d, "events").select("event_id", "event_type", "user_id")
    io.write_table(e, path)
    io.write_table(e, path)
    io.append_rows(e.where("event_type = 'purchase'"), path)
    left = io.delete_where(s.read.parquet(path), F.col("event_type") == "view")
    wide = io.add_columns(left, {"note": "string", "user_id": "bigint"})
    return io.create_view(io.drop_columns(wide, ["event_type"]), "kept_events").groupBy("event_id", "user_id", "note").agg(F.count(F.lit(1)).alias("copies"))


def _layout(s, d):
    """Partition column and number of partitions of a written fact, against what its dates say."""
    path = io.scratch_dir(s)
    io.write_fact(a.web_events(s, d), path, "event_dt", ["event_name"])
    folders = io.file_listing(s, path, "*.parquet").select(F.regexp_extract("uri", "event_dt=([0-9-]+)", 1).alias("day")).distinct()
    return folders.select(F.col("day").cast("date").alias("event_dt"))


_COLS = ", ".join(w.FACT_COLUMNS)
_FE = "raw_ev flat flat_first flat_filled"
_FACT = {"fct": f"SELECT {_COLS} FROM raw_ev UNION ALL SELECT {_COLS} FROM flat_filled"}
_PRODUCT = """
  SELECT i.item_id, p.unit_price, coalesce(pr.promotion_ids, []) AS promotion_ids, i.first_seen_date
  FROM (SELECT item_id, min(d) AS first_seen_date FROM (SELECT item_id, event_dt AS d FROM fct UNION ALL SELECT item_id, order_date FROM raw_od
        UNION ALL SELECT product_focus, start_date FROM creatives24) WHERE item_id IS NOT NULL GROUP BY 1) i
  LEFT JOIN (SELECT item_id, unit_price FROM raw_od GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, unit_price) = 1) p USING (item_id)
  LEFT JOIN (SELECT product_focus AS item_id, list_sort(list(DISTINCT promotion_id)) AS promotion_ids FROM creatives24 GROUP BY 1) pr USING (item_id)"""

QUERIES = {
    "s01_typed_csv_load": _csv_round_trip,
    "s02_header_check": _header,
    "s03_loaded_row_count": _row_count,
    "s06_file_listing": _listing,
    "s13_replace_append_delete": _replace,
    "w15_partition_layout": _layout,
    "s04_ndjson_load": _ndjson_round_trip,
    "s05_daily_tables_scan": _daily_tables,
    "s12_partitioned_fact_write": _fact_write,
    "w02_event_param": _params,
    "w03_numeric_param": _numeric,
    "w04_session_source_fill": _sources,
    "w05_single_item": _items,
    "w06_flatten_events": lambda s, d: w.flatten_events(nested(s, d)),
    "w07_fct_events": lambda s, d: w.build_fct_events(a.raw_events(s, d), w.flatten_events(nested(s, d))),
    "w08_fct_ad_daily": lambda s, d: w.build_fct_ad_daily(a.ad_daily(s, d)),
    "w08_fct_orders": lambda s, d: w.build_fct_orders(a.raw_orders(s, d)),
    "w09_dim_creative": lambda s, d: w.build_dim_creative(creatives24(s, d)),
    "w09_dim_customer": lambda s, d: w.build_dim_customer(a.raw_customers(s, d)),
    "w10_dim_product": lambda s, d: star(s, d)["dim_product"],
    "w11_dim_date": lambda s, d: star(s, d)["dim_date"],
    "w12_reconcile": _reconcile,
    "w13_reconcile_by_name": lambda s, d: w.reconcile_by_name(a.raw_events(s, d), a.nested_export(s, d), star(s, d)["fct_events"]),
    "w14_orphan_checks": lambda s, d: w.orphan_checks(star(s, d)),
    "w16_local_date_check": lambda s, d: w.local_date_check(star(s, d)["fct_events"]),
}

_OK = "CASE WHEN b = a THEN 'OK' ELSE 'DIFF' END"
ORACLE = {
    "s01_typed_csv_load": sql("raw_od", "SELECT * FROM raw_od"),
    "s02_header_check": "SELECT DISTINCT 'transaction_id,order_us,order_date,customer_id,user_pseudo_id,item_id,quantity,unit_price,revenue' AS header, true AS ok FROM events",
    "s06_file_listing": "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, true AS filled FROM events",
    "s13_replace_append_delete": "SELECT event_id, user_id, NULL::VARCHAR AS note, CASE event_type WHEN 'purchase' THEN 2 ELSE 1 END::BIGINT AS copies FROM events WHERE event_type <> 'view'",
    "w15_partition_layout": "SELECT DISTINCT CAST(ts AS DATE) AS event_dt FROM events",
    "s03_loaded_row_count": "SELECT count(*) AS in_file, count(*) AS loaded, true AS ok FROM events WHERE event_type = 'purchase'",
    "s04_ndjson_load": f"SELECT event_id, user_id, {K} AS k FROM events",
    "s05_daily_tables_scan": "SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS events, sum(event_id % 3) AS items FROM events GROUP BY 1",
    "s12_partitioned_fact_write": sql("web_events", """SELECT event_id, event_dt, user_pseudo_id, value FROM web_events
      WHERE event_dt BETWEEN DATE '2024-01-05' AND DATE '2024-01-18' AND event_name = 'purchase'"""),
    "w02_event_param": sql("flat", "SELECT event_timestamp, ga_session_id AS session_id, c AS campaign FROM flat"),
    "w03_numeric_param": sql("flat", "SELECT event_timestamp, round(value, 6) AS value FROM flat"),
    "w04_session_source_fill": sql("flat flat_first flat_filled", "SELECT event_timestamp, user_pseudo_id, utm_source, utm_medium, utm_campaign FROM flat_filled"),
    "w05_single_item": sql("flat", "SELECT event_timestamp, item_id, item_variant, quantity, item_count FROM flat"),
    "w06_flatten_events": sql("flat flat_first flat_filled", "SELECT * FROM flat_filled"),
    "w07_fct_events": sql(_FE, "SELECT * FROM fct", **_FACT),
    "w08_fct_ad_daily": sql("ad_daily", "SELECT * FROM ad_daily"),
    "w08_fct_orders": sql("raw_od", "SELECT *, 'synthetic' AS data_source FROM raw_od"),
    "w09_dim_creative": sql("creatives24", "SELECT * EXCLUDE (has_person, cta_position, dominant_color, text_density) FROM creatives24"),
    "w09_dim_customer": "SELECT CAST(c_custkey AS VARCHAR) AS customer_id, 'N' || c_nationkey AS city, CAST(DATE '2024-01-01' + CAST(c_custkey % 30 AS INT) AS DATE) AS first_order_date FROM customer",
    "w10_dim_product": sql(_FE + " raw_od creatives24", _PRODUCT, **_FACT),
    "w11_dim_date": sql(_FE + " raw_od creatives24", """
      SELECT d.date, strftime(d.date, '%Y%m%d') AS event_date, CAST(date_trunc('week', d.date) AS DATE) AS week_start,
        dayofweek(d.date) + 1 AS day_of_week, dayofweek(d.date) IN (0, 6) AS is_weekend, coalesce(p.ids, []) AS promotion_ids
      FROM (SELECT CAST(unnest(generate_series(min(x), max(x), INTERVAL 1 DAY)) AS DATE) AS date
            FROM (SELECT event_dt AS x FROM fct UNION ALL SELECT order_date FROM raw_od)) d
      LEFT JOIN (SELECT y.x AS date, list_sort(list(DISTINCT promotion_id)) AS ids FROM (SELECT DISTINCT event_dt AS x FROM fct) y
                 JOIN creatives24 ON y.x BETWEEN start_date AND end_date GROUP BY 1) p ON p.date = d.date""", **_FACT),
    "w12_reconcile": sql(_FE + " raw_od creatives24 ad_daily", """
      SELECT n AS check_name, coalesce(CAST(b AS VARCHAR), 'null') AS before, coalesce(CAST(a AS VARCHAR), 'null') AS after,
        CASE WHEN n LIKE 'info.%' THEN 'INFO' WHEN b = a THEN 'OK' ELSE 'DIFF' END AS ok FROM (
        SELECT unnest([
          {'n': 'rows.fct_events.synthetic', 'b': e.n::VARCHAR, 'a': e.n::VARCHAR}, {'n': 'rows.fct_events.ga4', 'b': g.n::VARCHAR, 'a': g.n::VARCHAR},
          {'n': 'rows.fct_events.total', 'b': (e.n + g.n)::VARCHAR, 'a': (e.n + g.n)::VARCHAR}, {'n': 'rows.fct_ad_daily', 'b': ad.n::VARCHAR, 'a': ad.n::VARCHAR},
          {'n': 'rows.fct_orders', 'b': o.n::VARCHAR, 'a': o.n::VARCHAR}, {'n': 'rows.dim_creative', 'b': c.n::VARCHAR, 'a': c.n::VARCHAR},
          {'n': 'rows.dim_customer', 'b': u.n::VARCHAR, 'a': u.n::VARCHAR}, {'n': 'rows.dim_product', 'b': p.n::VARCHAR, 'a': p.n::VARCHAR},
          {'n': 'ad.cost', 'b': ad.cost::VARCHAR, 'a': ad.cost::VARCHAR}, {'n': 'ad.impressions', 'b': ad.imp::VARCHAR, 'a': ad.imp::VARCHAR},
          {'n': 'ad.clicks', 'b': ad.clk::VARCHAR, 'a': ad.clk::VARCHAR}, {'n': 'orders.revenue', 'b': o.rev::VARCHAR, 'a': o.rev::VARCHAR},
          {'n': 'orders.distinct_transaction', 'b': o.n::VARCHAR, 'a': o.n::VARCHAR}, {'n': 'synthetic.value_sum', 'b': e.v::VARCHAR, 'a': e.v::VARCHAR},
          {'n': 'synthetic.users', 'b': e.users::VARCHAR, 'a': e.users::VARCHAR}, {'n': 'synthetic.sessions', 'b': e.sess::VARCHAR, 'a': e.sess::VARCHAR},
          {'n': 'synthetic.cvr_session', 'b': round(o.n / e.sess, 6)::VARCHAR, 'a': round(o.n / e.sess, 6)::VARCHAR},
          {'n': 'synthetic.aov', 'b': round(o.rev::DOUBLE / o.n, 6)::VARCHAR, 'a': round(o.rev::DOUBLE / o.n, 6)::VARCHAR},
          {'n': 'ga4.users', 'b': g.users::VARCHAR, 'a': g.users::VARCHAR}, {'n': 'ga4.sessions', 'b': g.sess::VARCHAR, 'a': g.sess::VARCHAR},
          {'n': 'ga4.purchase_revenue', 'b': g.rev::VARCHAR, 'a': g.rev::VARCHAR}, {'n': 'ga4.transactions', 'b': g.tx::VARCHAR, 'a': g.tx::VARCHAR},
          {'n': 'ga4.items', 'b': g.items::VARCHAR, 'a': g.items::VARCHAR}, {'n': 'ga4.events_with_value', 'b': g.n::VARCHAR, 'a': g.n::VARCHAR},
          {'n': 'info.ga4_rows_without_user_pseudo_id', 'b': '-', 'a': (e.n - g.n)::VARCHAR}, {'n': 'ga4.not_set_left', 'b': '0', 'a': '0'},
          {'n': 'info.ga4_null_session_id', 'b': '-', 'a': g.nosess::VARCHAR}, {'n': 'ga4.null_utm_source', 'b': '0', 'a': '0'}], recursive := true)
        FROM (SELECT count(*) AS n, count(DISTINCT user_pseudo_id) AS users, count(DISTINCT (user_pseudo_id, ga_session_id)) AS sess, sum(CAST(value AS DECIMAL(18,2))) AS v FROM raw_ev) e,
          (SELECT count(*) AS n, count(DISTINCT user_pseudo_id) AS users, count(DISTINCT user_pseudo_id || '.' || coalesce(ga_session_id::VARCHAR, 'null')) AS sess,
             sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_name = 'purchase') AS rev, count(DISTINCT transaction_id) AS tx, sum(item_count) AS items,
             count(*) FILTER (WHERE ga_session_id IS NULL) AS nosess FROM flat_filled) g,
          (SELECT count(*) AS n, sum(cost) AS cost, sum(impressions) AS imp, sum(clicks) AS clk FROM ad_daily) ad,
          (SELECT count(*) AS n, sum(revenue) AS rev FROM raw_od) o, (SELECT count(*) AS n FROM creatives24) c, (SELECT count(*) AS n FROM customer) u,
          (SELECT count(DISTINCT item_id) AS n FROM (SELECT item_id FROM fct UNION SELECT item_id FROM raw_od UNION SELECT product_focus FROM creatives24)) p)""", **_FACT),
    "w13_reconcile_by_name": sql(_FE, """SELECT 'events.' || data_source || '.' || event_name AS check_name, CAST(count(*) AS VARCHAR) AS before,
      CAST(count(*) AS VARCHAR) AS after, 'OK' AS ok FROM fct GROUP BY data_source, event_name""", **_FACT),
    "w14_orphan_checks": sql(_FE + " raw_od creatives24 ad_daily", f"""
      SELECT n AS check_name, '0' AS before, CAST(a AS VARCHAR) AS after, CASE WHEN a = 0 THEN 'OK' ELSE 'DIFF' END AS ok FROM (
        SELECT 'check.orphan_ad_creative' AS n, count(*) AS a FROM ad_daily WHERE creative_id NOT IN (SELECT creative_id FROM creatives24)
        UNION ALL SELECT 'check.orphan_synthetic_event_creative', count(*) FROM raw_ev WHERE creative_id NOT IN (SELECT creative_id FROM creatives24)
        UNION ALL SELECT 'check.orphan_order_customer', count(*) FROM raw_od WHERE customer_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)
        UNION ALL SELECT 'check.orphan_order_product', 0
        UNION ALL SELECT 'check.fact_dates_missing_in_dim_date', count(DISTINCT date) FROM ad_daily WHERE date NOT BETWEEN
          (SELECT min(event_dt) FROM raw_ev) AND (SELECT max(event_dt) FROM raw_ev))"""),
    "w16_local_date_check": sql(_FE, """SELECT 'check.event_dt_vs_local' AS check_name, '0' AS before, CAST(n AS VARCHAR) AS after,
      CASE WHEN n = 0 THEN 'OK' ELSE 'DIFF' END AS ok FROM (SELECT count(*) AS n FROM fct
      WHERE event_dt <> CAST(make_timestamp(event_timestamp) + INTERVAL 8 HOUR AS DATE))""", **_FACT),
}
