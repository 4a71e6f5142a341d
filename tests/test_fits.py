"""Fitted models: start and rounds against plain Python, certificates that must fail, and models that are fitted once."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as mo, segments as sg, value as vl


@pytest.fixture(scope="module")
def customers(spark):
    r = random.Random(12)
    rows = []
    for i in range(240):
        g = i % 3
        rows.append((f"c{i}", i % 8 != 0, 10.0 * g + r.gauss(0, 1), None if i == 7 else 5.0 * (g == 1) + r.gauss(0, 1), 4.0))
    return spark.createDataFrame(rows, "customer_id string, observed_30d boolean, x double, y double, flat double")


NAMES = ["x", "y", "flat"]


def plain_fit(rows, k, seed=11, rounds=20):
    train = [r for r in rows if r.observed_30d]
    means, scales = [], []
    for n in NAMES:
        v = [r[n] for r in train if r[n] is not None]
        m = sum(v) / len(v)
        s = math.sqrt(sum((x - m) ** 2 for x in v) / (len(v) - 1))
        means.append(m)
        scales.append(1 / s if s else 0.0)
    z = {r.customer_id: [0.0 if r[n] is None else (r[n] - m) * s for n, m, s in zip(NAMES, means, scales)] for r in train}
    race = lambda step, c: -math.log((int(hashlib.md5(f"{seed}:{step}:{c}".encode()).hexdigest()[:13], 16) + 1) / (16.0**13 + 1))
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    centers = []
    for step in range(k):
        weight = {c: min(d2(v, m) for m in centers) if centers else 1.0 for c, v in z.items()}
        centers.append(z[min((race(step, c) / w, c) for c, w in weight.items() if w > 0)[1]])
    for _ in range(rounds):
        near = {c: min(range(k), key=lambda i: d2(v, centers[i])) for c, v in z.items()}
        centers = [[sum(z[c][j] for c in own) / len(own) for j in range(len(NAMES))] if (own := [c for c in z if near[c] == i]) else centers[i] for i in range(k)]
    return centers


@pytest.mark.parametrize("k", [1, 3, 5])
def test_k_means_equals_plain_python(customers, k):
    model = sg.fit_segments(customers, k, names=NAMES)
    want = plain_fit(customers.collect(), k)
    assert all(abs(a - b) < 1e-9 for c, w in zip(model.centers, want) for a, b in zip(c, w)) and len(model.centers) == k
    again = sg.fit_segments(customers.repartition(7), k, names=NAMES)
    assert all(abs(a - b) < 1e-9 for c, w in zip(model.centers, again.centers) for a, b in zip(c, w))


def test_fewer_customers_than_centres(spark, customers):
    same = spark.createDataFrame([("a", True, 1.0, 2.0, 3.0), ("b", True, 1.0, 2.0, 3.0), ("c", True, 9.0, 2.0, 3.0)], customers.schema)
    assert len(sg.fit_segments(same, 4, names=NAMES).centers) == 2
    none = sg.fit_segments(same.limit(0), 4, names=NAMES)
    assert none.centers == ()
    assert [(r.centroid_id, r.distance) for r in sg.assign_segments(none, same).collect()] == [(None, None)] * 3


def test_model_table_round_trip(spark, customers):
    model = sg.fit_segments(customers, 3, names=NAMES)
    assert sg.SegmentModel.from_table(model.table(spark)) == model


def test_assignment_certificate_finds_faults(spark, customers):
    features = customers.withColumnsRenamed({"x": "share_x"}).withColumns({n: F.lit(1.0) for n in ("order_count", "total_qty", "total_revenue", "first_qty", "avg_gap_days", "recency_days")})
    model = sg.fit_segments(features, 3)
    right = sg.assign_segments(model, features)
    judge = lambda s: tuple(sg.assignment_certificate(model.table(spark), features, s).first())
    assert judge(right) == (240, 0, 0, 0)
    assert judge(right.withColumn("centroid_id", F.when(F.col("customer_id") == "c5", 9).otherwise(F.col("centroid_id"))))[1] == 1
    turned = right.withColumn("centroid_id", F.when(F.col("customer_id") == "c5", F.col("centroid_id") % 3 + 1).otherwise(F.col("centroid_id")))
    assert judge(turned)[2:] == (1, 1)
    assert judge(right.withColumn("distance", F.col("distance") + F.when(F.col("customer_id") == "c6", 0.1).otherwise(0)))[3] == 1


def test_regression_certificate_finds_a_wrong_fit(spark):
    import datetime
    r = random.Random(2)
    rows = [(f"c{i}", datetime.date(2024, 1, 1), r.choice(["a", "b", None]), r.randrange(1, 5), round(r.uniform(5, 90), 2), r.choice(["s", "t"]), "m", "k", True, i % 5 == 0, 0.0) for i in range(300)]
    schema = "customer_id string, first_order_date date, first_item_id string, first_qty long, first_revenue double, first_source string, first_medium string, first_campaign string, label_complete boolean, is_eval boolean, future_revenue_30d double"
    f = spark.createDataFrame(rows, schema).withColumn("future_revenue_30d", F.col("first_revenue") * 2 + F.col("first_qty") + F.when(F.col("first_item_id") == "a", 30).otherwise(0) + F.pmod(F.hash("customer_id"), F.lit(9)))
    p = vl.predict(vl.fit_ltv(f), f)
    assert p.where("first_item_id IS NULL").count() > 0  # inputs come back as they were
    assert {x.orthogonal for x in vl.regression_certificate(p).collect()} == {True}
    tilted = vl.regression_certificate(p.withColumn("predicted", F.col("predicted") + F.when(F.col("first_item_id") == "a", 3).otherwise(0))).collect()
    assert {x.input for x in tilted if not x.orthogonal} >= {"first_item_id=a"}


def test_a_frozen_model_is_fitted_once(spark, customers, tmp_path, monkeypatch):
    monkeypatch.setattr(mo, "shared_root", lambda s: f"file://{tmp_path}")
    calls = []

    def make():
        calls.append(1)
        return spark.createDataFrame([(len(calls),)], "n int")

    v = mo.model_version(customers, "a", 1)
    assert mo.model_version(customers.repartition(5), "a", 1) == v
    assert v not in (mo.model_version(customers, "a", 2), mo.model_version(customers.where("x > 1"), "a", 1))
    for _ in range(3):
        assert [tuple(r) for r in mo.frozen(spark, "m", v, make).collect()] == [(1, v)]
    assert len(calls) == 1
    (tmp_path / "models" / "m" / "other").mkdir(parents=True)  # a write that was broken off
    assert mo.frozen(spark, "m", "other", make).first().n == 2

    with pytest.raises(ZeroDivisionError):
        mo.frozen(spark, "m", "third", lambda: 1 / 0)
    assert mo.frozen(spark, "m", "third", make).first().n == 3


def test_own_tolerance_of_single_metrics(spark):
    from tidemark.functions.checks import compare_metrics
    a = spark.createDataFrame([("s1.x", "1.000"), ("s1.y", "1.000"), ("z", "1.000"), ("n", "7")], "metric string, value string")
    b = spark.createDataFrame([("s1.x", "1.010"), ("s1.y", "1.010"), ("z", "1.010"), ("n", "7")], "metric string, value string")
    ok = lambda **t: {r.metric for r in compare_metrics(a, b, **t).collect() if r.ok == "OK"}
    assert ok() == {"n"} and ok(tolerances={"s1.": 0.1}) == {"s1.x", "s1.y", "n"} and ok(tolerances={"s1.": 0.1, "s1.y": 1e-9}) == {"s1.x", "n"}


def test_both_ways_read_the_business_zone(spark):
    """An evening order in UTC belongs to the next day in Taipei, in both vectors."""
    import datetime
    from tidemark.operators import quality as q
    from tidemark.operators.recount import recount_vector
    day = datetime.date(2024, 1, 2)
    us = 1_704_128_400_000_000  # 2024-01-01 17:00 UTC
    ev = spark.createDataFrame([("u1", 1, "20240102", "session_start", us - 60_000_000, "meta", "paid_social", None, None, day), ("u1", 1, "20240102", "session_start", us - 30_000_000, "meta", "paid_social", None, None, day),
                                ("u1", 1, "20240102", "purchase", us, None, None, 5.0, "t1", day)],
                               "user_pseudo_id string, ga_session_id long, event_date string, event_name string, event_timestamp long, utm_source string, utm_medium string, value double, transaction_id string, event_dt date")
    od = spark.createDataFrame([("t1", "c", "u1", us, day, "i", 2, 5.0)], "transaction_id string, customer_id string, user_pseudo_id string, order_us long, order_date date, item_id string, quantity long, revenue double") \
        .withColumn("revenue", F.col("revenue").cast("decimal(18,2)"))
    ads = spark.createDataFrame([("a", "ch", "g", day, 100, 10, 3.0), ("a", "ch", "g", day + datetime.timedelta(7), 100, 5, 3.0)], "creative_id string, channel string, ad_group_id string, date date, impressions long, clicks long, cost double").withColumn("cost", F.col("cost").cast("decimal(18,4)"))
    cr = spark.createDataFrame([("a", "ch", "aud", "image", True, "center", "warm", "low")], "creative_id string, channel string, audience string, format string, has_person boolean, cta_position string, dominant_color string, text_density string")
    cu = spark.createDataFrame([("c", "0912")], "customer_id string, phone string")
    s = q.Signals("g", day, day, "a", day, {"meta": "meta/paid_social"}, ["i"], day, day)
    for tz, off in (("Asia/Taipei", "0"), ("UTC", "1")):
        one = {r.metric: r.value for r in q.metric_vector(ev, od, ads, cr, cu, s, tz).collect()}
        two = {r.metric: r.value for r in recount_vector(ev, od, ads, cr, cu, s, tz).collect()}
        assert one == two and one["check.order_date_mismatch"] == off and one["s6.meta_first"] == "1" and one["s3.weekly_decay"] == "0.500000000"


def test_rounds_share_their_code(customers, monkeypatch):
    """Every pass of a fit that compares with centres is one plan: centres in expressions would be compiled in every round."""
    plans, real = [], sg._sums
    monkeypatch.setattr(sg, "_sums", lambda points, centers: plans.append(real(points, centers)) or plans[-1])
    sg.fit_segments(customers, 3, names=NAMES)
    text = [re.sub(r"#\d+L?|work\([^)]*\)", "", p._jdf.queryExecution().optimizedPlan().toString()) for p in plans]
    assert len(plans) > 1 and set(text) == {text[0]}


def test_one_fingerprint_for_all_models(spark, monkeypatch):
    from tidemark.plans import customers as plan
    rows = [(i, i % 4 != 0, 1 + i % 5, 3 * i % 7, 10.0 * (i % 3), i % 2, 0.1 * (i % 4), 1.0 * i, i % 6) for i in range(40)]
    features = spark.createDataFrame(rows, "customer_id long, observed_30d boolean, order_count long, total_qty long, total_revenue double, first_qty long, share_ECONOMY double, avg_gap_days double, recency_days int")
    monkeypatch.setattr(plan, "saved_features", lambda s, d: features)
    monkeypatch.setattr(plan, "truth", lambda s, d: features.select("customer_id", F.lit("BUILDING").alias("segment")))
    asked, real = [], mo.fingerprint
    for where in (plan, mo):
        monkeypatch.setattr(where, "fingerprint", lambda df: asked.append(df) or real(df), raising=False)
    found = plan._model_truth(spark, "").collect()
    assert len(asked) == 1
    assert {n: sum(r.BUILDING for r in found if r.model_name == n) for n in plan.MODELS} == dict.fromkeys(plan.MODELS, 40)
