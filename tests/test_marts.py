"""Planted effects and border cases of the analytic marts."""

import math
import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.checks import check_rows, compare_metrics, fingerprint, symmetric_difference
from tidemark.functions.exprs import sunday_weeks_between
from tidemark.operators import acceptance as ac, anomaly as an, consistency as kc, costs as co, lift as lf, lookups as lk, ops, quality as q, replies as rp, segments as sg, value as vl

PERF = "creative_id string, channel string, audience string, f_person boolean, f_cta boolean, f_warm boolean, f_text boolean, impressions bigint, clicks bigint, ctr double, sessions bigint, converted bigint"


def _perf(spark, n=16, effect=1.25, noise=0.0, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        channel, audience = f"ch{i % 2}", f"a{i // 2 % 2}"
        person, cta, warm, text = bool(i // 4 % 2), bool(i // 8 % 2), bool((i * 7) % 3 == 0), bool(i % 3 == 1)
        ctr = 0.02 * (1 + i % 2) * (1 + i // 2 % 2) * (effect if person else 1) * math.exp(r.gauss(0, noise))
        rows.append((f"c{i}", channel, audience, person, cta, warm, text, 10_000, 200, ctr, 100 + i, 5 + i % 3))
    return spark.createDataFrame(rows, PERF)


def test_planted_lift_is_recovered(spark):
    lift = {(r.metric, r.attr): r for r in lf.creative_lift(_perf(spark)).collect()}
    assert math.isclose(lift[("ctr", "person")].stratified, 1.25, rel_tol=1e-9) and math.isclose(lift[("ctr", "cta")].stratified, 1.0, rel_tol=1e-9)
    assert lift[("cvr", "person")].ci95_low < lift[("cvr", "person")].stratified < lift[("cvr", "person")].ci95_high


def test_jackknife_equals_leaving_out_by_hand(spark):
    perf = _perf(spark, noise=0.3)
    got = {r.attr: r for r in lf.jackknife_lift(perf).collect()}
    ids = [r.creative_id for r in perf.select("creative_id").collect()]
    est = {i: {r.attr: r.ctr_est for r in lf.pooled(lf.strata(perf.where(F.col("creative_id") != i))).collect()} for i in ids}
    for a in ("person", "cta"):
        values = {i: e[a] for i, e in est.items() if a in e}
        assert got[a].min_est == pytest.approx(round(min(values.values()), 3), abs=1e-3) and got[a].drop_for_min == min(values, key=values.get)
        assert got[a].max_est == pytest.approx(round(max(values.values()), 3), abs=1e-3) and got[a].drop_for_max == max(values, key=values.get)


def _ads(spark, rows):
    return spark.createDataFrame(rows, "date date, creative_id string, channel string, ad_group_id string, utm_campaign string, impressions bigint, clicks bigint, cost decimal(18,2), data_source string")


def test_weekly_multiplier_and_decay(spark):
    start = date(2026, 6, 21)  # a Sunday
    rows = [(start + timedelta(days=d), "c", "ch", "g", "k", 10 ** 6, round(10 ** 5 * 0.92 ** (d // 7)), Decimal(10), "synthetic") for d in range(45)]
    weeks = ac.complete_week_multiplier(_ads(spark, rows), "c", date(2026, 6, 19))
    assert weeks.count() == 6  # the last three days are no complete week
    slope = weeks.agg(F.exp(F.regr_slope(F.log("ctr"), F.col("wk").cast("double")))).first()[0]
    assert slope == pytest.approx(0.92, abs=1e-4)
    assert q.weekly_decay(_ads(spark, rows), "c", start).first().weekly_decay == pytest.approx(0.08, abs=0.01)


def test_sunday_weeks(spark):
    f = lambda a, b: spark.range(1).select(sunday_weeks_between(F.lit(date.fromisoformat(a)), F.lit(date.fromisoformat(b))).alias("n")).first().n
    assert f("2026-06-21", "2026-06-19") == 1 and f("2026-06-20", "2026-06-19") == 0 and f("2026-06-28", "2026-06-21") == 1


def test_adgroup_flags_first_week_only(spark):
    monday = date(2026, 6, 1)
    cost = [10, 10, 10, 20, 20]
    rows = [(monday + timedelta(days=7 * w + d), "c", "ch", "g", "k", 1000, 20, Decimal(cost[w]), "synthetic") for w in range(5) for d in range(3)]
    week = an.adgroup_week(_ads(spark, rows))
    roas = spark.createDataFrame([], "channel string, wk date, roas double, roas_base double")
    out = an.flag_adgroup(week, roas).collect()
    assert len(out) == 1 and out[0].period_start == date(2026, 6, 22) and out[0].cpc_chg_pct == 100.0
    # two earlier weeks are enough of a baseline, one is not
    assert an.flag_adgroup(week.where("wk >= '2026-06-15'"), roas).count() == 1
    short = an.adgroup_week(_ads(spark, [r for r in rows if r[0] >= date(2026, 6, 15)]))
    assert [r.base_weeks for r in short.orderBy("wk").collect()] == [0, 1, 2]


def test_facts_without_data(spark):
    m = '{"days":3,"imp":1,"clk":1,"cost":5.0,"ctr_pct":1.0,"ctr_base_pct":1.0,"cpc":1.0,"cpc_base":1.0,"clk_per_day":1.0,"clk_per_day_base":1.0,"channel_roas":null,"channel_roas_base":null}'
    df = spark.createDataFrame([("a", "adgroup_week", "g", "ch", date(2026, 6, 1), date(2026, 6, 7), m, 30.0, -20.0)],
                               "anomaly_id string, level string, entity string, channel string, period_start date, period_end date, metrics_json string, cpc_chg_pct double, ctr_chg_pct double")
    text = an.render_facts(df).first().facts
    assert "變化 +30%" in text and text.endswith("無資料（前四週 無資料）")


def test_bad_replies_become_nulls(spark):
    rows = [('{"cause": "x", "confidence": "high"}',), ("{broken",), (None,), ('{"cause": "y", "confidence": 0.5}',)]
    out = an.parse_diagnosis(spark.createDataFrame(rows, "raw_result string")).collect()
    assert [(r.cause, r.confidence) for r in out] == [("x", None), (None, None), (None, None), ("y", 0.5)]


ORDERS = "transaction_id string, order_date date, order_us bigint, customer_id string, item_id string, quantity bigint, revenue decimal(18,2), utm_source string, utm_medium string, utm_campaign string, data_source string"


def _orders(spark, rows):
    day = lambda n: date(2026, 1, 1) + timedelta(days=n)
    return spark.createDataFrame([(f"t{i}", day(n), n * 86_400_000_000, c, it, qty, Decimal(rev), "s", "m", "k", "synthetic") for i, (c, n, it, qty, rev) in enumerate(rows)], ORDERS)


def test_segment_features(spark):
    o = _orders(spark, [("a", 0, "sock", 2, 10), ("a", 10, "bath", 2, 20), ("a", 30, "sock", 4, 5), ("b", 5, "set", 1, 7), ("z", 60, "sock", 1, 1)])
    f = {r.customer_id: r for r in sg.segment_features(o, F.col("item_id")).collect()}
    assert (f["a"].avg_gap_days, f["a"].recency_days, f["a"].share_sock, f["a"].first_qty, f["a"].first_category) == (15.0, 30, 0.75, 2, "sock")
    assert (f["b"].avg_gap_days, f["b"].observed_days, f["b"].observed_30d, f["z"].observed_30d) == (55.0, 55, True, False)


def test_kmeans_separates_and_scores_all(spark):
    r = random.Random(2)
    rows = [(f"c{i}", i % 10 != 0, float(10 * (i % 2) + r.random()), float(5 * (i % 2) + r.random())) for i in range(80)]
    f = spark.createDataFrame(rows, "customer_id string, observed_30d boolean, x double, y double")
    m = sg.fit_segments(f, 2, names=["x", "y"])
    seg = sg.assign_segments(m, f)
    assert seg.count() == 80 and seg.where("distance is null or distance < 0").count() == 0
    kinds = seg.groupBy((F.substring("customer_id", 2, 5).cast("int") % 2).alias("p")).agg(F.count_distinct("centroid_id").alias("n")).collect()
    assert all(k.n == 1 for k in kinds)
    db = {r.model_name: r.davies_bouldin_index for r in sg.davies_bouldin({"k2_observed": m, "k4_observed": sg.fit_segments(f, 4, names=["x", "y"])}, f).collect()}
    assert db["k2_observed"] < 0.5 < db["k4_observed"]
    assert sg.centroids_long(m, f).count() == 4


def test_split_never_divides_a_day(spark):
    days = [0] * 10 + [1] * 10 + [2] * 5 + [3] * 5
    o = _orders(spark, [(f"c{i}", d, "a", 1, 10) for i, d in enumerate(days)] + [("late", 40, "a", 1, 1)])
    f = vl.chronological_split(vl.future_revenue(o))
    per = f.where("label_complete").groupBy("first_order_date").agg(F.count_distinct("is_eval").alias("n"), F.max(F.col("is_eval").cast("int")).alias("e")).orderBy("first_order_date").collect()
    assert [r.n for r in per] == [1, 1, 1, 1] and [r.e for r in per] == [0, 0, 0, 1]  # 25 of 29 = 0.86 > 0.8, 20 of 29 = 0.69
    assert f.where("customer_id = 'late'").first().is_eval is None


def test_future_revenue_window(spark):
    o = _orders(spark, [("a", 0, "x", 1, 10), ("a", 0, "x", 1, 1), ("a", 30, "x", 1, 2), ("a", 31, "x", 1, 4), ("b", 31, "x", 1, 8)])
    f = {r.customer_id: r for r in vl.future_revenue(o).collect()}
    assert f["a"].future_revenue_30d == Decimal("3.00") and f["a"].label_complete and not f["b"].label_complete


def test_regression_learns_and_clips(spark):
    rows = []
    for i in range(120):
        it = "ab"[i % 2]
        rows += [(f"c{i}", i // 3, it, 1, 10), (f"c{i}", i // 3 + 5, it, 1, 100 if it == "a" else 5)]
    rows.append(("end", 100, "a", 1, 1))
    f = vl.chronological_split(vl.future_revenue(_orders(spark, rows)))
    p = vl.predict(vl.fit_ltv(f), f)
    assert vl.regression_metrics(p).first().mean_absolute_error < 1.0
    assert vl.predict_ltv(p.withColumn("predicted", F.lit(-3.0))).agg(F.min("predicted_revenue_30d")).first()[0] == 0.0


def test_verdict_roll_up(spark):
    rows = [("S1", "找到"), ("S1", "找到"), ("S2", "找到"), ("S2", "沒找到"), ("S3", "沒找到"), ("S4", "待考")]
    out = {r.signal_id: r.verdict for r in ac.signal_verdict(spark.createDataFrame(rows, "signal_id string, verdict string")).collect()}
    assert out == {"S1": "找到", "S2": "部分找到", "S3": "沒找到", "S4": "待考"}
    m = spark.createDataFrame([("S1a", 2.0), ("S2a", 0.5)], "check_id string, actual double")
    card = {r.check_id: r.verdict for r in ac.score(ac.criteria(spark), m).collect()}
    assert (card["S1a"], card["S2a"], card["S3a"], card["S4a"]) == ("找到", "沒找到", "沒有資料", "待考")
    assert symmetric_difference(ac.criteria(spark, 1).where("signal_id <> 'S4'"), ac.criteria(spark, 2).where("signal_id <> 'S4'")).count() == 0


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(i, f"x{i}") for i in range(50)], "a int, b string")
    f = lambda d: d.select("fingerprint").first()[0]
    assert f(fingerprint(df)) == f(fingerprint(df.orderBy(F.desc("a")).repartition(7))) != f(fingerprint(df.withColumn("b", F.when(F.col("a") == 3, "y").otherwise(F.col("b")))))


def test_compare_metrics(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1.0000000001"), ("z", "a"), ("only_a", "1"), ("n", "5")], "metric string, value string")
    b = spark.createDataFrame([("x", "1"), ("y", "1.0"), ("z", "b"), ("only_b", "1"), ("n", "6")], "metric string, value string")
    assert {r.metric: r.ok for r in compare_metrics(a, b).collect()} == {"x": "OK", "y": "OK", "z": "DIFF", "only_a": "DIFF", "only_b": "DIFF", "n": "DIFF"}


def test_check_rows_levels(spark):
    df = spark.range(1).select(F.lit(1).alias("x"), F.lit(None).cast("int").alias("y"))
    assert [(r.check_name, r.ok) for r in check_rows(df, [("a", "1", F.col("x")), ("b", "0", F.col("y")), ("info.c", "-", F.col("x"))]).collect()] == [("a", "OK"), ("b", "DIFF"), ("info.c", "INFO")]


PRICES = [("m", "global", date(2026, 1, 1), date(2026, 12, 31), Decimal("1"), Decimal("2"), ""), ("m", "global", date(2027, 1, 1), date(9999, 12, 31), Decimal("10"), Decimal("20"), "")]
LEDGER = "logged_us bigint, day string, job string, run_id string, model string, endpoint_type string, media_resolution string, item_id string, prompt_tokens bigint, output_tokens bigint, status string"


def test_price_of_the_local_day(spark):
    last = 1_798_732_799_000_000  # 2026-12-31 15:59:59 UTC, one second before the local new year
    led = spark.createDataFrame([(last, "d", "j", "r", "m", "global", "n", "i", 10 ** 6, None, ""), (last + 1_000_000, "d", "j", "r", "m", "global", "n", "i", 10 ** 6, 0, ""),
                                 (last, "d", "j", "r", "other", "global", "n", "i", 5, 5, "x")], LEDGER)
    prices = co.price_table(spark, PRICES)
    rows = co.usage_calls(led, prices).orderBy("model", "logged_us").collect()
    assert [r.cost_usd for r in rows] == [1.0, 10.0, None] and [r.priced for r in rows] == [True, True, False] and rows[2].call_result == "failed"
    calls = co.usage_calls(led, prices)
    bad = {r.check_name[:2]: r.ok for r in co.check_usage(led, prices, calls, co.usage_daily(calls)).collect()}
    assert bad["02"] == "OK" and bad["06"] == "OK" and bad["07"] == "DIFF"


def test_overlaps_counted_like_pairs(spark):
    r = random.Random(4)
    rows = []
    for _ in range(60):
        a = r.randrange(40)
        rows.append((r.choice("ab"), "g", date(2026, 1, 1) + timedelta(days=a), date(2026, 1, 1) + timedelta(days=a + r.randrange(8)), Decimal(1), Decimal(1), ""))
    want = {m: sum(1 for i in range(60) for j in range(i) if rows[i][0] == rows[j][0] == m and rows[i][2] <= rows[j][3] and rows[j][2] <= rows[i][3]) for m in "ab"}
    assert {x.model: x.pairs for x in co.overlapping_periods(co.price_table(spark, rows)).collect()} == want


def test_repeat_after_success_brute_force(spark):
    r = random.Random(8)
    rows = [(i, f"r{r.randrange(4)}", f"c{r.randrange(5)}", r.randrange(50), r.random() < 0.4) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id int, run_id string, creative_id string, created_us int, good boolean")
    want = {a[0] for a in rows if any(b[4] and b[2] == a[2] and b[1] != a[1] and b[3] < a[3] for b in rows)}
    assert {x.event_id for x in rp.repeat_after_success(df, F.col("good"), ["creative_id"]).collect()} == want


def test_gap_scoring(spark):
    ans = spark.createDataFrame([("c1", "free_shipping", "免運", "f", False), ("c2", "gift", "贈", "f", False), ("c3", "product_name", "襪", "f", True), ("c4", "gift", "贈", "f", False)],
                                "creative_id string, gap_type string, ad_keyword string, page_fact string, disputed boolean")
    g = lambda *x: '{"ad_texts": ["免運 贈品"], "gaps": [' + ", ".join(f'{{"gap_type": "{t}", "ad_text": "{a}", "page_evidence": "e"}}' for t, a in x) + "]}"
    log = [(1, "c1", g(("free_shipping", "全館免運"), ("gift", "別的")), 1), (2, "c2", g(("gift", "沒有那個詞")), 1), (3, "c3", g(("product_name", "襪子")), 1), (4, "c4", "{broken", 1), (5, "c1", "{broken", 9)]
    df = spark.createDataFrame([(i, "image", c, r, "STOP", "", t) for i, c, r, t in log], "event_id int, mode string, creative_id string, result string, finish_reason string, status string, created_us bigint")
    m = spark.createDataFrame([(f"c{i}", "p", "k", "x") for i in range(1, 5)], "creative_id string, page_id string, utm_campaign string, product_focus string")
    v = kc.gap_verdicts(ans, kc.latest_readable(df), m, F.array(F.lit("image")))
    got = sorted((r.creative_id, r.gap_type, r.verdict) for r in v.collect())
    assert got == [("c1", "free_shipping", "hit"), ("c1", "gift", "extra"), ("c2", "gift", "extra"), ("c2", "gift", "miss"), ("c3", "product_name", "disputed"), ("c4", "gift", "no_call")]
    r = kc.recall_precision(v, ans).first()
    assert (r.hit, r.miss, r.extra, r.decoy, r.disputed_listed, r.recall) == (1, 1, 2, 2, 1, 0.5)


def test_best_run_prefers_complete_over_later(spark):
    rows = [(i, date(2026, 9, 1), e, "scheduler", s, "t", "q", "a", st, "passed", "", t) for i, (e, s, st, t) in enumerate(
        [("x", 1, "ok", 1), ("x", 2, "ok", 2), ("x", 3, "ok", 3), ("x", 3, "failed", 9), ("y", 1, "ok", 10), ("y", 2, "failed", 11), ("y", 3, "ok", 12)])]
    df = spark.createDataFrame(rows, "event_id int, report_date date, execution_id string, trigger_source string, section_no bigint, section_title string, question string, answer string, status string, detail string, session_id string, created_us bigint")
    out = ops.best_run_per_day(df).collect()
    assert {r.execution_id for r in out} == {"x"} and len(out) == 3 and all(r.ok_sections == 3 and r.status == "ok" for r in out)


def test_unsent_after_failure(spark):
    al = spark.createDataFrame([("a",), ("b",), ("c",)], "anomaly_id string")
    no = spark.createDataFrame([("anomaly:a", "failed"), ("anomaly:b", "failed"), ("anomaly:b", "sent")], "dedupe_key string, status string")
    assert sorted(r.anomaly_id for r in ops.unsent(al, no).collect()) == ["a", "c"] and ops.unsent(al, no, renotify=True).count() == 3


def test_lookups_refuse_unknown_arguments(spark):
    for bad in (lambda: lk.ad_spend(None, date(2026, 1, 1), date(2026, 1, 2), "cost; drop"), lambda: lk.ad_spend(None, date(2026, 1, 2), date(2026, 1, 1), "channel"), lambda: lf.feature_lift_lookup(None, "x")):
        with pytest.raises(ValueError):
            bad()


def test_todo_skips_successes(spark):
    items = spark.createDataFrame([("a",), ("b",)], "creative_id string")
    log = spark.createDataFrame([("a", "low", True), ("b", "low", False)], "creative_id string, resolution string, good boolean")
    out = sorted((r.creative_id, r.resolution) for r in rp.work_todo(items, {"resolution": ["low", "default"]}, log, F.col("good"), ["creative_id", "resolution"]).collect())
    assert out == [("a", "default"), ("b", "default"), ("b", "low")]


def test_empty_logs_have_their_columns(spark):
    for name in rp.LOG_SCHEMAS:
        assert rp.reply_log(spark, name).count() == 0


def test_prompt_version_guard(spark):
    with pytest.raises(Exception):
        rp.require_prompt_version(spark.range(1), "changed", rp_md5("original")).collect()
    assert rp.require_prompt_version(spark.range(1), "original", rp_md5("original")).count() == 1


def rp_md5(text):
    import hashlib
    return hashlib.md5(text.encode()).hexdigest()


def test_blind_rules_need_all_three(spark):
    f = spark.createDataFrame([("m", 1, 1, "meta-trn-prospecting", "8/12", "CPC 上升", ""), ("m", 1, 2, "meta-trn-prospecting", "8/12", "CPC 持平", ""), ("m", 1, 3, None, "8/24", "追蹤事件少", None)],
                              "model string, run_no int, finding_no int, target string, period string, observation string, likely_cause string")
    assert sorted((r.finding_no, r.signal_id) for r in ac.match_findings(f, ac.BLIND_RULES).collect()) == [(1, "S1"), (3, "S2")]
