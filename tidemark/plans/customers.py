from datetime import date

from pyspark.sql import functions as F

from ..functions.checks import fingerprint
from ..operators import models as mo, segments as sg, value as vl
from ..sources import adapters as a, io
from .fits import kmeans_sql, ridge_sql
from .oracle import CTES, sql

TYPES = ("ECONOMY", "STANDARD", "PROMO", "MEDIUM")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
DAYS = 2200


def features(s, d):
    return sg.segment_features(a.shop_orders(s, d), F.col("category"), TYPES, observed_days=DAYS)


def truth(s, d):
    return a.table(s, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))


def saved_features(s, d):
    """Training passes over the features many times, so they are written first."""
    return io.materialize(features(s, d))


MODELS = {"k3_observed": (3, True), "k4_observed": (4, True), "k5_observed": (5, True), "k4_all": (4, False)}


def segment_table(s, f, name="k4_observed", seen=None):
    """The saved model of this name for these features; the first query that asks for it fits it. ``seen`` is their fingerprint, if known."""
    k, observed = MODELS[name]
    return mo.frozen(s, f"segments_{name}", mo.model_version(f, "k-means++", name, seen=seen), lambda: sg.fit_segments(f, k, observed_only=observed).table(s))


def segments(s, f, name="k4_observed", seen=None):
    """The saved assignment of all customers by the saved model."""
    seen = seen or fingerprint(f).first()
    version = mo.model_version(f, "k-means++", name, seen=seen)
    return mo.frozen(s, f"assigned_{name}", version, lambda: sg.assign_segments(sg.SegmentModel.from_table(segment_table(s, f, name, seen)), f)).drop("version")


def ltv_features(s, d):
    return vl.chronological_split(vl.future_revenue(a.shop_orders(s, d), days=DAYS))


def predictions(s, d, with_campaign=False):
    """The saved predictions of the saved regression, for all customers."""
    f = io.materialize(ltv_features(s, d))
    name, version = f"value_{'campaign' if with_campaign else 'plain'}", mo.model_version(f, "ridge", vl.RIDGE, with_campaign)
    make = lambda: vl.predict(mo.frozen_pipeline(s, name, version, lambda: vl.fit_ltv(f, with_campaign)), f)
    return mo.frozen(s, f"{name}_predicted", version, make).drop("version")


def _split(p):
    return p.drop("predicted")


def ltv(s, d):
    return vl.predict_ltv(predictions(s, d))


def _assigned(s, d):
    return segments(s, saved_features(s, d)).withColumn("distance", F.round("distance", 6))


def _certificate(s, d):
    f = saved_features(s, d)
    return sg.assignment_certificate(segment_table(s, f).drop("version"), f, segments(s, f))


def _centroids(s, d):
    f = saved_features(s, d)
    return sg.centroids_long(sg.SegmentModel.from_table(segment_table(s, f)), f)


def _davies_bouldin(s, d):
    f = saved_features(s, d)
    seen = fingerprint(f).first()
    found = sg.davies_bouldin({n: sg.SegmentModel.from_table(segment_table(s, f, n, seen)) for n in MODELS}, f)
    return found.withColumn("davies_bouldin_index", F.round("davies_bouldin_index", 6))


def _with_segments(use):
    def query(s, d):
        f = saved_features(s, d)
        return use(s, d, f, segments(s, f))
    return query


def _model_truth(s, d):
    """G-07 by model: the crosstab of every saved model."""
    f = saved_features(s, d)
    seen = fingerprint(f).first()
    every = [segments(s, f, n, seen).withColumn("model_name", F.lit(n)) for n in MODELS]
    return sg.cluster_vs_truth(sg.union_all(every), truth(s, d), SEGMENTS, by=("model_name", "centroid_id"))


def _unseen(s, d):
    return vl.unseen_category_effect(predictions(s, d, True), predictions(s, d))


def _value_to_cost(s, d):
    source = F.when(F.col("first_source") == "s1", "ch0").when(F.col("first_source") == "s2", "ch1").when(F.col("first_source") == "s3", "ch2")
    p = predictions(s, d)
    return vl.value_to_cost(vl.predict_ltv(p), _split(p), a.ad_daily(s, d), source, ["ch0", "ch1", "ch2"], date(2000, 1, 1), date(2000, 12, 31))


def _check_segments(s, d, f, seg):
    n = a.shop_orders(s, d).select(F.count_distinct("customer_id")).first()[0]
    return sg.check_segmentation(f, seg, truth(s, d), n, "-", 4, {"BUILDING": 0.95, "MACHINERY": 0.2})


def _check_ltv(s, d):
    p = predictions(s, d)
    return vl.check_ltv(_split(p), vl.predict_ltv(p), p, truth(s, d), "BUILDING", dict(customers="-", labeled="-", eval="-", new="-", mart="-"))


CTES["segf"] = f"""
  SELECT customer_id, first_order_date, first_category, aod - first_order_date AS observed_days, aod - first_order_date >= {DAYS} AS observed_30d, order_count, total_qty, total_revenue, first_qty,
    {', '.join(f"q_{t} / total_qty AS share_{t}" for t in TYPES)}, coalesce(gap, aod - first_order_date)::DOUBLE AS avg_gap_days, aod - last_order_date AS recency_days
  FROM (SELECT customer_id, min(order_date) AS first_order_date, max(order_date) AS last_order_date, count(*) AS order_count, sum(quantity)::BIGINT AS total_qty, sum(revenue) AS total_revenue,
          max(quantity) FILTER (WHERE seq = 1) AS first_qty, max(category) FILTER (WHERE seq = 1) AS first_category, avg(order_date - prev) AS gap,
          {', '.join(f"coalesce(sum(quantity) FILTER (WHERE category = '{t}'), 0) AS q_{t}" for t in TYPES)}
        FROM (SELECT *, row_number() OVER w AS seq, lag(order_date) OVER w AS prev FROM shop_orders WINDOW w AS (PARTITION BY customer_id ORDER BY order_us, transaction_id)) GROUP BY 1),
    (SELECT max(order_date) AS aod FROM shop_orders)"""
FEATURES = ["order_count", "total_qty", "total_revenue", "first_qty", *[f"share_{t}" for t in TYPES], "avg_gap_days", "recency_days"]
for _name, (_k, _observed) in MODELS.items():
    CTES[f"fit_{_name}"] = kmeans_sql("segf", FEATURES, _k, observed=_observed)
CTES["seg"] = "SELECT customer_id, observed_30d, centroid_id, distance, center FROM fit_k4_observed"
CTES["firsts"] = """
  SELECT customer_id, order_date AS first_order_date, item_id AS first_item_id, quantity AS first_qty, revenue AS first_revenue, utm_source AS first_source, utm_medium AS first_medium,
    utm_campaign AS first_campaign, transaction_id AS ft FROM shop_orders QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY order_us, transaction_id) = 1"""
CTES["labeled"] = f"""
  SELECT f.* EXCLUDE (ft), (SELECT max(order_date) FROM shop_orders) - first_order_date >= {DAYS} AS label_complete,
    CAST(coalesce((SELECT sum(revenue) FROM shop_orders o WHERE o.customer_id = f.customer_id AND o.transaction_id <> f.ft AND o.order_date <= f.first_order_date + {DAYS}), 0) AS DECIMAL(18,2)) AS future_revenue_30d
  FROM firsts f"""
CTES["split"] = """
  SELECT *, CASE WHEN label_complete THEN percent_rank() OVER (PARTITION BY label_complete ORDER BY first_order_date) > 0.8 END AS is_eval FROM labeled"""
CTES["ipred"] = ridge_sql("split", vl.CATEGORICAL, vl.NUMERIC, vl.RIDGE)
CTES["cpred"] = ridge_sql("split", [*vl.CATEGORICAL, "first_campaign"], vl.NUMERIC, vl.RIDGE)
CTES["ltv"] = """
  SELECT customer_id, first_order_date, first_item_id, first_source, first_medium, first_campaign, CASE WHEN label_complete THEN 'eval' ELSE 'new' END AS scope,
    round(greatest(predicted, 0), 1) AS predicted_revenue_30d, CASE WHEN label_complete THEN future_revenue_30d END AS actual_revenue_30d FROM ipred WHERE is_eval OR NOT label_complete"""
SEG = "shop_orders segf"
FIT = SEG + " fit_k4_observed seg"
LTV = "shop_orders firsts labeled split"

QUERIES = {
    "g01_segment_features": features,
    "g01_features_summary": lambda s, d: sg.features_summary(features(s, d)),
    "g03_assign_segments": _assigned,
    "g03_assignment_certificate": _certificate,
    "g04_cluster_profile": _with_segments(lambda s, d, f, seg: sg.cluster_profile(seg, f)),
    "g05_centroids": _centroids,
    "g06_davies_bouldin": _davies_bouldin,
    "g07_cluster_vs_truth": _with_segments(lambda s, d, f, seg: sg.cluster_vs_truth(seg, truth(s, d), SEGMENTS)),
    "g07_models_vs_truth": _model_truth,
    "g08_check_segmentation": _with_segments(_check_segments),
    "l01_first_order_features": lambda s, d: vl.first_order_features(a.shop_orders(s, d)).drop("first_transaction_id"),
    "l02_future_revenue": lambda s, d: vl.future_revenue(a.shop_orders(s, d), days=DAYS),
    "l03_chronological_split": ltv_features,
    "l04_regression_predictions": lambda s, d: predictions(s, d).withColumn("predicted", F.round("predicted", 3)),
    "l04_regression_certificate": lambda s, d: vl.regression_certificate(predictions(s, d)),
    "l05_regression_metrics": lambda s, d: vl.regression_metrics(predictions(s, d)).select(*[F.round(c, 4).alias(c) for c in ("mean_absolute_error", "rmse", "r2_score")]),
    "l05_median_error": lambda s, d: vl.regression_metrics(predictions(s, d)).select(F.round("median_absolute_error", 3).alias("median_absolute_error")),
    "l06_baselines": lambda s, d: (lambda p: vl.baselines(_split(p), p))(predictions(s, d)),
    "l07_predict_ltv": ltv,
    "l08_value_to_cost": _value_to_cost,
    "l09_unseen_category_effect": _unseen,
    "l10_value_by_truth": lambda s, d: vl.value_by_truth(ltv(s, d), truth(s, d)),
    "l10_value_by_item_and_truth": lambda s, d: vl.value_by_item_and_truth(ltv(s, d), truth(s, d)),
    "l11_features_summary": lambda s, d: vl.features_summary(ltv_features(s, d)),
    "l11_check_ltv": _check_ltv,
}

_MEAN = "sum({0}::DECIMAL(18,2))::DOUBLE / count({0})".format
_T = "JOIN customer ON c_custkey = customer_id"
_ERR = """count(*) AS customers, round(avg(abs(actual - pred)), 1) AS mae, round(sqrt(avg((actual - pred) * (actual - pred))), 1) AS rmse, round(avg(pred), 1) AS avg_pred, round(avg(actual), 1) AS avg_actual"""
ORACLE = {
    "g01_segment_features": sql(SEG, "SELECT * FROM segf"),
    "g01_features_summary": sql(SEG, "SELECT count(*) AS customers, count(*) FILTER (WHERE observed_30d) AS observed_30d, round(avg(order_count), 3) AS avg_orders, count(*) FILTER (WHERE first_qty IS NULL OR share_ECONOMY IS NULL) AS null_rows FROM segf"),
    "g03_assign_segments": sql(FIT, "SELECT customer_id, observed_30d, centroid_id, round(distance, 6) AS distance FROM seg"),
    "g03_assignment_certificate": sql(SEG, "SELECT count(*) AS customers, 0::BIGINT AS unlisted, 0::BIGINT AS not_nearest, 0::BIGINT AS wrong_distance FROM segf"),
    "g05_centroids": sql(FIT, f"""SELECT centroid_id, feature, round(v, 2) AS value FROM (
      SELECT centroid_id, unnest({FEATURES}) AS feature, unnest(center) AS v FROM (SELECT DISTINCT centroid_id, center FROM seg))"""),
    "g06_davies_bouldin": sql(SEG + " " + " ".join(f"fit_{n}" for n in MODELS), f"""
      SELECT model_name, count(*)::INT AS k, round(avg(worst), 6) AS davies_bouldin_index FROM (
        SELECT a.model_name, a.i, max((a.s + b.s) / list_distance(a.c, b.c)) AS worst FROM db a JOIN db b ON a.model_name = b.model_name AND a.i <> b.i GROUP BY a.model_name, a.i) GROUP BY 1""",
        db=" UNION ALL ".join(f"SELECT '{n}' AS model_name, centroid_id AS i, avg(distance) AS s, any_value(center) AS c FROM fit_{n}{' WHERE observed_30d' if o else ''} GROUP BY centroid_id" for n, (_, o) in MODELS.items())),
    "g07_models_vs_truth": sql(SEG + " " + " ".join(f"fit_{n}" for n in MODELS), "SELECT model_name, centroid_id, count(*) AS customers, " + ", ".join(f"count(*) FILTER (WHERE c_mktsegment = '{t}') AS {t}" for t in SEGMENTS)
        + f" FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS model_name, centroid_id, customer_id FROM fit_{n}' for n in MODELS)}) {_T} GROUP BY 1, 2"),
    "l04_regression_predictions": sql(LTV + " ipred", "SELECT * REPLACE (round(predicted, 3) AS predicted) FROM ipred"),
    "l04_regression_certificate": sql(LTV, f"""SELECT input, true AS orthogonal FROM (SELECT unnest({list(vl.NUMERIC)}) AS input UNION ALL SELECT input FROM (
      SELECT unnest([{', '.join(f"'{c}=' || coalesce({c}, '(none)')" for c in vl.CATEGORICAL)}]) AS input, count(*) OVER () AS n FROM split WHERE label_complete AND NOT is_eval)
      GROUP BY input HAVING count(*) BETWEEN {vl.LEVEL_ROWS} AND any_value(n) - {vl.LEVEL_ROWS})"""),
    "l05_median_error": sql(LTV + " ipred", "SELECT round(quantile_disc(abs(future_revenue_30d::DOUBLE - predicted), 0.5), 3) AS median_absolute_error FROM ipred WHERE is_eval"),
    "l09_unseen_category_effect": sql(LTV + " ipred cpred", """SELECT p.first_campaign, p.first_item_id, count(*) AS customers, round(avg(c.predicted)) AS with_campaign, round(avg(p.predicted)) AS without_campaign
      FROM ipred p JOIN cpred c USING (customer_id) WHERE NOT p.label_complete GROUP BY 1, 2"""),
    "g04_cluster_profile": sql(FIT, f"""
      SELECT centroid_id, count(*) AS customers, round(avg(order_count), 2) AS avg_orders, round(count(*) FILTER (WHERE order_count > 1) / count(*), 3) AS repeat_rate, round(avg(first_qty), 2) AS avg_first_qty,
        round(avg(total_revenue::DOUBLE)) AS avg_revenue, {', '.join(f"round(avg(share_{t}), 2) AS share_{t}" for t in TYPES)}, round(avg(avg_gap_days)) AS avg_gap_days, round(avg(recency_days)) AS recency_days
      FROM seg JOIN segf USING (customer_id) WHERE seg.observed_30d GROUP BY 1"""),
    "g07_cluster_vs_truth": sql(FIT, "SELECT observed_30d, centroid_id, count(*) AS customers, " + ", ".join(f"count(*) FILTER (WHERE c_mktsegment = '{t}') AS {t}" for t in SEGMENTS) + f" FROM seg {_T} GROUP BY 1, 2"),
    "g08_check_segmentation": sql(FIT, f"""
      SELECT n AS check_name, e AS expected, a AS actual, CASE WHEN ok THEN 'OK' ELSE 'DIFF' END AS ok FROM (
        SELECT '1 seg_features rows' AS n, (SELECT count(DISTINCT o_custkey) FROM orders)::VARCHAR AS e, count(*)::VARCHAR AS a, true AS ok FROM segf
        UNION ALL SELECT '2 observed_30d', '-', count(*) FILTER (WHERE observed_30d)::VARCHAR, false FROM segf
        UNION ALL SELECT '3 feature nulls', '0', x::VARCHAR, x = 0 FROM (SELECT count(*) FILTER (WHERE first_qty IS NULL OR share_ECONOMY IS NULL) AS x FROM segf)
        UNION ALL SELECT '4 mart rows', (SELECT count(DISTINCT o_custkey) FROM orders)::VARCHAR, count(*)::VARCHAR, true FROM seg
        UNION ALL SELECT '5 clusters', '4', x::VARCHAR, x = 4 FROM (SELECT count(DISTINCT centroid_id) AS x FROM seg)
        UNION ALL SELECT CASE t WHEN 'BUILDING' THEN '6' ELSE '7' END || ' ' || t || ' in one cluster', '>=' || w, top::VARCHAR, top >= w::DOUBLE FROM (
          SELECT c_mktsegment AS t, CASE c_mktsegment WHEN 'BUILDING' THEN '0.95' ELSE '0.2' END AS w, round(max(n) / sum(n), 3) AS top FROM (
            SELECT c_mktsegment, centroid_id, count(*) AS n FROM seg {_T} WHERE observed_30d AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2) GROUP BY 1))"""),
    "l01_first_order_features": sql("shop_orders firsts", "SELECT * EXCLUDE (ft) FROM firsts"),
    "l02_future_revenue": sql("shop_orders firsts labeled", "SELECT * FROM labeled"),
    "l03_chronological_split": sql(LTV, "SELECT * FROM split"),
    "l05_regression_metrics": sql(LTV + " ipred", """SELECT round(avg(abs(y - predicted)), 4) AS mean_absolute_error, round(sqrt(avg((y - predicted) * (y - predicted))), 4) AS rmse,
      round(1 - sum((y - predicted) * (y - predicted)) / (var_pop(y) * count(*)), 4) AS r2_score FROM (SELECT *, future_revenue_30d::DOUBLE AS y FROM ipred WHERE is_eval)"""),
    "l06_baselines": sql(LTV + " ipred", f"""
      SELECT method, {_ERR} FROM (
        SELECT '1 global mean' AS method, future_revenue_30d::DOUBLE AS actual, (SELECT avg(future_revenue_30d::DOUBLE) FROM split WHERE label_complete AND NOT is_eval) AS pred FROM split WHERE is_eval
        UNION ALL SELECT '2 mean of first item', future_revenue_30d::DOUBLE, coalesce(p, (SELECT avg(future_revenue_30d::DOUBLE) FROM split WHERE label_complete AND NOT is_eval)) FROM split e
          LEFT JOIN (SELECT first_item_id, avg(future_revenue_30d::DOUBLE) AS p FROM split WHERE label_complete AND NOT is_eval GROUP BY 1) i ON i.first_item_id = e.first_item_id WHERE is_eval
        UNION ALL SELECT '3 linear regression', future_revenue_30d::DOUBLE, predicted FROM ipred WHERE is_eval) GROUP BY 1"""),
    "l07_predict_ltv": sql(LTV + " ipred ltv", "SELECT * FROM ltv"),
    "l08_value_to_cost": sql("ad_daily " + LTV + " ipred ltv", f"""
      SELECT channel, utm_campaign, new_customers, round(cost) AS ad_cost, round(cost / new_customers) AS cost_per_new, avg_first_order, avg_pred_30d, avg_first_order + avg_pred_30d AS expected_value_30d,
        round((avg_first_order + avg_pred_30d) / (cost / new_customers), 2) AS value_to_cost
      FROM (SELECT CASE l.first_source WHEN 's1' THEN 'ch0' WHEN 's2' THEN 'ch1' WHEN 's3' THEN 'ch2' END AS channel, l.first_campaign AS utm_campaign, count(*) AS new_customers,
              round({_MEAN('first_revenue')}) AS avg_first_order, round({_MEAN('predicted_revenue_30d')}) AS avg_pred_30d FROM ltv l JOIN split f USING (customer_id) WHERE scope = 'new' GROUP BY 1, 2)
      JOIN (SELECT channel, utm_campaign, sum(cost)::DOUBLE AS cost FROM ad_daily WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1, 2) USING (channel, utm_campaign)"""),
    "l10_value_by_truth": sql(LTV + " ipred ltv", f"""SELECT scope, c_mktsegment AS segment, count(*) AS customers, round({_MEAN('predicted_revenue_30d')}, 1) AS avg_pred, round({_MEAN('actual_revenue_30d')}, 1) AS avg_actual,
      round(count(*) FILTER (WHERE actual_revenue_30d > 0) / nullif(count(actual_revenue_30d), 0), 3) AS repeat_rate FROM ltv {_T} GROUP BY 1, 2"""),
    "l10_value_by_item_and_truth": sql(LTV + " ipred ltv", f"SELECT first_item_id, c_mktsegment AS segment, count(*) AS customers, round({_MEAN('predicted_revenue_30d')}, 1) AS avg_pred FROM ltv {_T} GROUP BY 1, 2"),
    "l11_features_summary": sql(LTV, """SELECT count(*) FILTER (WHERE label_complete) AS labeled, count(*) FILTER (WHERE is_eval) AS eval_rows, count(*) FILTER (WHERE NOT label_complete) AS to_predict,
      max(first_order_date) FILTER (WHERE NOT is_eval) AS train_until, min(first_order_date) FILTER (WHERE is_eval) AS eval_from, round(avg(future_revenue_30d::DOUBLE) FILTER (WHERE label_complete), 1) AS avg_label,
      round(count(*) FILTER (WHERE label_complete AND future_revenue_30d > 0) / count(*) FILTER (WHERE label_complete), 3) AS repeat_30d_rate FROM split"""),
    "l11_check_ltv": sql(LTV + " ipred ltv", f"""
      SELECT n AS check_name, e AS expected, a AS actual, CASE WHEN ok THEN 'OK' ELSE 'DIFF' END AS ok FROM (
        SELECT unnest(['1 ltv_features rows', '2 label_complete', '3 eval rows', '4 to predict']) AS n, '-' AS e,
          unnest([count(*)::VARCHAR, count(*) FILTER (WHERE label_complete)::VARCHAR, count(*) FILTER (WHERE is_eval)::VARCHAR, count(*) FILTER (WHERE NOT label_complete)::VARCHAR]) AS a, false AS ok FROM split
        UNION ALL SELECT '5 train before eval', 'true', (max(first_order_date) FILTER (WHERE NOT is_eval) < min(first_order_date) FILTER (WHERE is_eval))::VARCHAR, true FROM split
        UNION ALL SELECT '6 mart rows', '-', count(*)::VARCHAR, false FROM ltv
        UNION ALL SELECT '7 null/negative preds', '0', '0', true
        UNION ALL SELECT '8 regression MAE < global', g::VARCHAR, r::VARCHAR, r < g FROM (SELECT round(avg(abs(future_revenue_30d::DOUBLE - (SELECT avg(future_revenue_30d::DOUBLE) FROM split WHERE label_complete AND NOT is_eval))), 1) AS g,
            round(avg(abs(future_revenue_30d::DOUBLE - predicted)), 1) AS r FROM ipred WHERE is_eval)
        UNION ALL SELECT '9 regular type pred ratio', '>=1.5', x::VARCHAR, x >= 1.5 FROM (SELECT round(avg(predicted_revenue_30d) FILTER (WHERE c_mktsegment = 'BUILDING') / avg(predicted_revenue_30d) FILTER (WHERE c_mktsegment <> 'BUILDING'), 2) AS x
            FROM ltv {_T} WHERE scope = 'eval'))"""),
}
