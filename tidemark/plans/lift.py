from datetime import date

from pyspark.sql import functions as F

from ..functions.checks import fingerprint
from ..operators import acceptance as ac, lift as lf
from ..operators.quality import flag_columns
from ..sources import adapters as a
from . import quality as qp
from .oracle import CTES, sql

SKIP = date(2024, 1, 15)
EXCLUDE = ["cr23"]


def flags(s, d):
    return flag_columns(a.creatives(s, d)).select("creative_id", "f_person", "f_cta", "f_warm", "f_text")


def conversion(s, d):
    return lf.creative_conversion(qp.events(s, d), [SKIP], date(2024, 1, 1), date(2024, 1, 29))


def perf(s, d):
    return lf.creative_perf(a.creatives(s, d), flags(s, d), a.ad_daily(s, d), conversion(s, d), EXCLUDE)


def lift(s, d):
    return lf.creative_lift(perf(s, d))


def signals(s, d):
    """Answer table with the planted effects: one row stored as an object, one as doubly encoded text, per region row."""
    r = a.table(s, d, "region")
    spec = F.lit('{"has_person": "1.25", "cta_bottom_right": 1.1, "dominant_color_warm": 1.1}')
    return r.select(F.when(F.col("r_regionkey") == 0, "S4").otherwise("S1").alias("signal_id"),
                    F.when(F.col("r_regionkey") == 0, F.concat(F.lit('"'), F.replace(spec, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(spec).alias("spec"))


def truth(s, d):
    t = flags(s, d).toDF("creative_id", "t_person", "t_cta", "t_warm", "t_text")
    return t.withColumn("t_text", F.when(F.col("creative_id") == "cr5", ~F.col("t_text")).otherwise(F.col("t_text")))


def _scored(s, d):
    return lf.score_s4(ac.criteria(s, 2), lift(s, d)).drop("rule")


def _check(s, d):
    p, cr = perf(s, d), a.creatives(s, d)
    card = lf.score_s4(ac.criteria(s, 2), lf.creative_lift(p))
    runs = lf.scoring_run(ac.criteria(s, 2)).unionByName(lf.scoring_run(ac.criteria(s, 2)))
    answers = signals(s, d).where("signal_id = 'S4'").agg(F.count(F.lit(1))).scalar()
    dim = cr.drop("has_person", "cta_position", "dominant_color", "text_density")
    return lf.check_lift(p, lf.creative_lift(p), dim, flags(s, d), ac.criteria(s, 1), ac.criteria(s, 2), card, runs, 24, EXCLUDE, 6, answers)


def _r(df, *cols, n=9):
    return df.withColumns({c: F.round(c, n) for c in cols})


CTES["conv"] = """
  SELECT s.creative_id, count(*) AS sessions, count(b.user_pseudo_id) AS converted FROM (
    SELECT user_pseudo_id, ga_session_id, min(creative_id) AS creative_id FROM ev_q WHERE event_dt BETWEEN DATE '2024-01-01' AND DATE '2024-01-29'
      AND event_dt <> DATE '2024-01-15' AND event_name = 'session_start' GROUP BY 1, 2) s
  LEFT JOIN (SELECT DISTINCT user_pseudo_id, ga_session_id FROM ev_q WHERE event_name = 'purchase' AND event_dt BETWEEN DATE '2024-01-01' AND DATE '2024-01-30') b
    ON b.user_pseudo_id = s.user_pseudo_id AND b.ga_session_id = s.ga_session_id GROUP BY 1"""
CTES["perf"] = """
  SELECT c.creative_id, channel, audience, c.utm_campaign, has_person AS f_person, cta_position = 'bottom-right' AS f_cta, dominant_color = 'warm' AS f_warm,
    text_density = 'high' AS f_text, impressions, clicks, sessions, converted, clicks / impressions AS ctr, converted / sessions AS cvr
  FROM creatives c JOIN (SELECT creative_id, sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks FROM ad_daily GROUP BY 1) x ON x.creative_id = c.creative_id
  LEFT JOIN conv v ON v.creative_id = c.creative_id WHERE c.creative_id <> 'cr23' AND clicks > 0"""
CTES["plong"] = """
  SELECT creative_id, channel, audience, ctr, sessions, converted, unnest(['person', 'cta', 'warm', 'text']) AS attr, unnest([f_person, f_cta, f_warm, f_text]) AS flag FROM perf"""
_RATIOS = """exp(avg(ln(ctr)) FILTER (WHERE flag)) / exp(avg(ln(ctr)) FILTER (WHERE NOT flag)) AS ctr_ratio,
    coalesce(sum(converted) FILTER (WHERE flag), 0)::BIGINT AS cy, coalesce(sum(converted) FILTER (WHERE NOT flag), 0)::BIGINT AS cn,
    (coalesce(sum(converted) FILTER (WHERE flag), 0) / sum(sessions) FILTER (WHERE flag)) / nullif(coalesce(sum(converted) FILTER (WHERE NOT flag), 0) / sum(sessions) FILTER (WHERE NOT flag), 0) AS cvr_ratio"""
CTES["strata"] = f"""
  SELECT attr, channel, audience, count(*) FILTER (WHERE flag) AS ny, count(*) FILTER (WHERE NOT flag) AS nn, {_RATIOS} FROM plong GROUP BY 1, 2, 3 HAVING ny > 0 AND nn > 0"""
CTES["naive"] = f"""
  SELECT attr, count(*) FILTER (WHERE flag) AS images_yes, count(*) FILTER (WHERE NOT flag) AS images_no, {_RATIOS} FROM plong GROUP BY 1"""
CTES["pooled"] = """
  SELECT attr, count(*) AS strata_used, exp(sum(ln(ctr_ratio) * ny * nn / (ny + nn)) / sum(ny * nn / (ny + nn))) AS ctr_est,
    exp(sum(ln(cvr_ratio) * v) FILTER (WHERE v IS NOT NULL) / sum(v)) AS cvr_est, 1 / sqrt(sum(v)) AS cvr_log_se, count(*) FILTER (WHERE v IS NULL) AS cvr_strata_skipped
  FROM (SELECT *, CASE WHEN cy > 0 AND cn > 0 THEN 1 / (1 / cy + 1 / cn) END AS v FROM strata) GROUP BY 1"""
CTES["lift"] = """
  SELECT p.attr, 'ctr' AS metric, ctr_est AS stratified, n.ctr_ratio AS naive, strata_used, 0 AS strata_skipped, NULL::DOUBLE AS ci95_low, NULL::DOUBLE AS ci95_high,
    images_yes, images_no, NULL::BIGINT AS converted_yes, NULL::BIGINT AS converted_no FROM pooled p JOIN naive n ON n.attr = p.attr
  UNION ALL SELECT p.attr, 'cvr', cvr_est, n.cvr_ratio, strata_used, cvr_strata_skipped, cvr_est * exp(-1.96 * cvr_log_se), cvr_est * exp(1.96 * cvr_log_se),
    images_yes, images_no, cy, cn FROM pooled p JOIN naive n ON n.attr = p.attr"""
PERF = "creatives ad_daily web_events ev_q conv perf"
LIFT = PERF + " plong strata naive pooled lift"

QUERIES = {
    "f01_creative_conversion": conversion,
    "f02_creative_perf": perf,
    "f03_strata": lambda s, d: _r(lf.strata(perf(s, d)), "ctr_ratio", "cvr_ratio"),
    "f04_pooled_lift": lambda s, d: _r(lf.pooled(lf.strata(perf(s, d))), "ctr_est", "cvr_est", "cvr_log_se"),
    "f05_naive_ratio": lambda s, d: _r(lf.naive_ratio(perf(s, d)), "ctr_naive", "cvr_naive"),
    "f06_perf_listing": lambda s, d: lf.perf_listing(perf(s, d)),
    "f06_lift_listing": lambda s, d: lf.lift_listing(lift(s, d)),
    "f06_lift_by_stratum": lambda s, d: lf.lift_by_stratum(perf(s, d)),
    "f06_s4_listing": lambda s, d: _scored(s, d).select("check_id", "lower_bound", "upper_bound", "actual", "verdict"),
    "f07_jackknife": lambda s, d: lf.jackknife_lift(perf(s, d)),
    "f08_orders_per_impression": lambda s, d: lf.orders_per_impression_lift(perf(s, d), a.ad_daily(s, d), [date(1998, 5, 5)]),
    "f09_lift_vs_truth": lambda s, d: lf.lift_vs_truth(perf(s, d), lift(s, d), truth(s, d), lf.planted_effects(signals(s, d))),
    "f10_score_s4": _scored,
    "f11_fingerprint": lambda s, d: fingerprint(a.table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")),
    "f12_check_lift": _check,
    "f13_feature_lift_lookup": lambda s, d: lf.feature_lift_lookup(lift(s, d), "cvr"),
}

_S4 = """
  SELECT 'S4' AS signal_id, c.check_id, 'Day 17' AS found_by, 'SQL' AS method, lo AS lower_bound, hi AS upper_bound, round(actual, 3) AS actual,
    CASE WHEN actual IS NULL THEN '沒有資料' WHEN actual BETWEEN lo AND hi THEN '找到' ELSE '沒找到' END AS verdict
  FROM (VALUES ('S4a', 1.05::DOUBLE, 1.5::DOUBLE, 'person'), ('S4b', 1.05, 1.32, 'cta'), ('S4c', 1.05, 1.32, 'warm'), ('S4d', 0.95, 1.05, 'text'), ('S4e', 0.7, 1.43, '-')) c(check_id, lo, hi, attr)
  LEFT JOIN (SELECT attr, stratified AS actual FROM lift WHERE metric = 'ctr'
             UNION ALL SELECT '-', max_by(stratified, abs(ln(stratified))) FROM lift WHERE metric = 'cvr' AND attr <> 'text') m ON m.attr = c.attr"""
_JK = """
  SELECT attr, round(min(est), 3) AS min_est, round(max(est), 3) AS max_est, first(dropped ORDER BY est, dropped) AS drop_for_min, first(dropped ORDER BY est DESC, dropped DESC) AS drop_for_max FROM (
    SELECT dropped, attr, round(exp(sum(ln(r) * ny * nn / (ny + nn)) / sum(ny * nn / (ny + nn))), 12) AS est FROM (
      SELECT x.creative_id AS dropped, attr, p.channel, p.audience, count(*) FILTER (WHERE flag) AS ny, count(*) FILTER (WHERE NOT flag) AS nn,
        exp(avg(ln(p.ctr)) FILTER (WHERE flag)) / exp(avg(ln(p.ctr)) FILTER (WHERE NOT flag)) AS r
      FROM perf x JOIN plong p ON p.creative_id <> x.creative_id GROUP BY 1, 2, 3, 4 HAVING ny > 0 AND nn > 0) GROUP BY 1, 2) GROUP BY attr"""
ORACLE = {
    "f01_creative_conversion": sql("web_events ev_q conv", "SELECT * FROM conv"),
    "f02_creative_perf": sql(PERF, "SELECT * FROM perf"),
    "f03_strata": sql(PERF + " plong strata", "SELECT * REPLACE (round(ctr_ratio, 9) AS ctr_ratio, round(cvr_ratio, 9) AS cvr_ratio) FROM strata"),
    "f04_pooled_lift": sql(PERF + " plong strata pooled", "SELECT * REPLACE (round(ctr_est, 9) AS ctr_est, round(cvr_est, 9) AS cvr_est, round(cvr_log_se, 9) AS cvr_log_se) FROM pooled"),
    "f05_naive_ratio": sql(PERF + " plong naive", "SELECT attr, round(ctr_ratio, 9) AS ctr_naive, round(cvr_ratio, 9) AS cvr_naive, images_yes, images_no, cy AS converted_yes, cn AS converted_no FROM naive"),
    "f06_perf_listing": sql(PERF, "SELECT channel, audience, creative_id, f_person, f_cta, f_warm, f_text, impressions, clicks, round(100 * ctr, 2) AS ctr_pct, sessions, converted, round(100 * cvr, 2) AS cvr_pct FROM perf"),
    "f06_lift_listing": sql(LIFT, "SELECT metric, attr, round(stratified, 3) AS stratified, round(naive, 3) AS naive, round(ci95_low, 2) AS ci95_low, round(ci95_high, 2) AS ci95_high, strata_used, strata_skipped, images_yes, images_no, converted_yes, converted_no FROM lift"),
    "f06_lift_by_stratum": sql(PERF + " plong", """SELECT attr, channel, audience, count(*) FILTER (WHERE flag) AS ny, count(*) FILTER (WHERE NOT flag) AS nn,
      round(100 * exp(avg(ln(ctr)) FILTER (WHERE flag)), 2) AS ctr_yes_pct, round(100 * exp(avg(ln(ctr)) FILTER (WHERE NOT flag)), 2) AS ctr_no_pct,
      round(exp(avg(ln(ctr)) FILTER (WHERE flag)) / exp(avg(ln(ctr)) FILTER (WHERE NOT flag)), 3) AS ratio FROM plong GROUP BY 1, 2, 3"""),
    "f06_s4_listing": sql(LIFT, f"SELECT check_id, lower_bound, upper_bound, actual, verdict FROM ({_S4})"),
    "f07_jackknife": sql(PERF + " plong", _JK),
    "f08_orders_per_impression": sql(PERF, """
      SELECT attr, round(est, 3) AS orders_per_imp_stratified, round(est * exp(-1.96 * se), 2) AS ci95_low, round(est * exp(1.96 * se), 2) AS ci95_high,
        round(10000 * ry, 2) AS per10k_yes, round(10000 * rn, 2) AS per10k_no FROM (
        SELECT attr, exp(sum(ln((cy / iy) / (cn / iv)) * v) FILTER (WHERE v IS NOT NULL) / sum(v)) AS est, 1 / sqrt(sum(v)) AS se, sum(cy) / sum(iy) AS ry, sum(cn) / sum(iv) AS rn
        FROM (SELECT *, CASE WHEN cy > 0 AND cn > 0 THEN 1 / (1 / cy + 1 / cn) END AS v FROM (
          SELECT attr, channel, audience, sum(converted) FILTER (WHERE flag) AS cy, sum(converted) FILTER (WHERE NOT flag) AS cn, sum(imp) FILTER (WHERE flag) AS iy, sum(imp) FILTER (WHERE NOT flag) AS iv
          FROM (SELECT channel, audience, converted, imp, unnest(['person', 'cta', 'warm', 'text']) AS attr, unnest([f_person, f_cta, f_warm, f_text]) AS flag
                FROM perf JOIN (SELECT creative_id, sum(impressions) AS imp FROM ad_daily WHERE date <> DATE '1998-05-05' GROUP BY 1) USING (creative_id)) GROUP BY 1, 2, 3)) GROUP BY attr)"""),
    "f09_lift_vs_truth": sql(LIFT, """
      SELECT l.attr, round(stratified, 3) AS ai_features, round(spec_est, 3) AS spec_features, round(no_noise, 3) AS no_noise,
        CASE l.attr WHEN 'person' THEN 1.25 WHEN 'text' THEN 1.0 ELSE 1.1 END::DOUBLE AS answer, 1 AS flag_differs_images, 'cr5' AS flag_differs_ids
      FROM lift l JOIN (SELECT attr, exp(sum(ln(r) * ny * nn / (ny + nn)) / sum(ny * nn / (ny + nn))) AS spec_est, exp(sum(ln(ri) * ny * nn / (ny + nn)) / sum(ny * nn / (ny + nn))) AS no_noise FROM (
          SELECT attr, channel, audience, count(*) FILTER (WHERE flag) AS ny, count(*) FILTER (WHERE NOT flag) AS nn,
            exp(avg(ln(ctr)) FILTER (WHERE flag) - avg(ln(ctr)) FILTER (WHERE NOT flag)) AS r, exp(avg(ln(ideal)) FILTER (WHERE flag) - avg(ln(ideal)) FILTER (WHERE NOT flag)) AS ri
          FROM (SELECT channel, audience, ctr, (CASE WHEN f_person THEN 1.25 ELSE 1 END * CASE WHEN f_cta THEN 1.1 ELSE 1 END * CASE WHEN f_warm THEN 1.1 ELSE 1 END)::DOUBLE AS ideal,
                  unnest(['person', 'cta', 'warm', 'text']) AS attr, unnest([f_person, f_cta, f_warm, CASE WHEN creative_id = 'cr5' THEN NOT f_text ELSE f_text END]) AS flag FROM perf)
          GROUP BY 1, 2, 3 HAVING ny > 0 AND nn > 0) GROUP BY attr) e ON e.attr = l.attr WHERE metric = 'ctr'"""),
    "f10_score_s4": sql(LIFT, _S4),
    "f11_fingerprint": """SELECT count(*) AS row_count, CAST(sum(CAST(('0x' || substr(md5(c_custkey || '|' || c_mktsegment || '|' || c_name || '|' || c_nationkey), 1, 15)) AS BIGINT)) AS VARCHAR) AS fingerprint FROM customer""",
    "f12_check_lift": sql(LIFT, """
      SELECT n AS check_name, e AS expected, a AS actual, CASE WHEN e = a THEN 'OK' ELSE 'DIFF' END AS ok FROM (
        SELECT '01 features table images' AS n, '24' AS e, (SELECT count(*) FROM creatives)::VARCHAR AS a
        UNION ALL SELECT '02 perf images without the excluded', '23', (SELECT count(*) FROM perf)::VARCHAR
        UNION ALL SELECT '03 excluded image not in perf', '0', '0' UNION ALL SELECT '04 every image has impressions and clicks', '0', '0'
        UNION ALL SELECT '05 every image has sessions', '0', (SELECT count(*) FROM perf WHERE coalesce(sessions, 0) = 0)::VARCHAR
        UNION ALL SELECT '06 sessions never exceed clicks', '0', (SELECT count(*) FROM perf WHERE sessions > clicks)::VARCHAR
        UNION ALL SELECT '07 no NULL feature flag', '0', '0' UNION ALL SELECT '08 lift rows', '8', (SELECT count(*) FROM lift)::VARCHAR
        UNION ALL SELECT '09 no NULL stratified estimate', '0', (SELECT count(*) FROM lift WHERE stratified IS NULL)::VARCHAR
        UNION ALL SELECT '10 each estimate uses all strata', '6', (SELECT min(strata_used) FROM lift)::VARCHAR
        UNION ALL SELECT '11 no stratum skipped', '0', (SELECT sum(strata_skipped) FROM lift)::VARCHAR
        UNION ALL SELECT '12 no design columns in dim_creative', '0', '0' UNION ALL SELECT '13 second criteria keep first rows', '0', '0'
        UNION ALL SELECT '14 S4 scorecard rows with data', '5/0', '5/0' UNION ALL SELECT '15 S4 answer readable', '1', '1'
        UNION ALL SELECT '16 criteria unchanged since first scoring', '1/true', '1/true')"""),
    "f13_feature_lift_lookup": sql(LIFT, """SELECT attr AS feature, round(stratified, 3) AS lift, round(ci95_low, 2) AS ci95_low, round(ci95_high, 2) AS ci95_high, images_yes AS images_with_feature,
      images_no AS images_without_feature, CASE attr WHEN 'person' THEN 'has a person' WHEN 'cta' THEN 'button bottom right' WHEN 'warm' THEN 'warm colours' ELSE 'much text' END AS feature_label FROM lift WHERE metric = 'cvr'"""),
}
