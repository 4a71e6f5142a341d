import math
import random
from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import attribution as at

DAY = 86_400_000_000
T0 = 1_780_000_000_000_000
CH = {"meta": ("meta", "paid_social"), "google": ("google", "cpc"), "direct": ("(direct)", "(none)")}


def _frames(spark, touches, orders):
    day = lambda us: date.fromordinal(date(1970, 1, 1).toordinal() + us // DAY)
    ev = [(i, day(t), t, "session_start", u, *CH[c], "c", "synthetic") for i, (u, t, c) in enumerate(touches)]
    e = spark.createDataFrame(ev, "event_id bigint, event_dt date, event_timestamp bigint, event_name string, user_pseudo_id string, utm_source string, utm_medium string, utm_campaign string, data_source string")
    od = [(i, day(t), t, u, u, "i", 100, "synthetic") for i, (u, t) in enumerate(orders)]
    o = spark.createDataFrame(od, "transaction_id bigint, order_date date, order_us bigint, customer_id string, user_pseudo_id string, item_id string, revenue bigint, data_source string")
    return o, e


def test_decay_and_direct(spark):
    t = T0
    o, e = _frames(spark, [("v", t - 10 * DAY, "meta"), ("v", t - DAY, "direct"), ("v", t - 3_600_000_000, "google"), ("v", t + DAY, "direct")], [("v", t), ("v", t + 2 * DAY)])
    rows = {(r.order_seq, r.channel): r for r in at.mart_attribution(o, e).collect()}
    w = {"meta": 0.5 ** (10 / 7), "direct": 0.5 ** (1 / 7), "google": 0.5 ** (1 / 24 / 7)}
    first = rows[(1, "meta / paid_social")]
    assert first.credit_first == 1 and first.credit_first_nd == 1 and math.isclose(first.credit_decay, w["meta"] / sum(w.values()))
    direct = rows[(1, "(direct) / (none)")]
    assert direct.credit_decay_nd == 0 and direct.credit_last_nd == 0 and direct.credit_decay > 0
    google = rows[(1, "google / cpc")]
    assert google.credit_last == 1 and math.isclose(google.credit_decay_nd, w["google"] / (w["google"] + w["meta"]))
    # the second path starts after the first order and is all direct, so direct keeps the credit
    second = rows[(2, "(direct) / (none)")]
    assert second.path_len == 1 and second.credit_first_nd == second.credit_last_nd == second.credit_decay_nd == 1 and second.is_repeat


def test_window_borders(spark):
    t = T0
    o, e = _frames(spark, [("v", t, "meta"), ("v", t - 30 * DAY, "google"), ("v", t - 30 * DAY + 1, "direct")], [("v", t)])
    channels = {r.channel for r in at.mart_attribution(o, e).collect()}
    assert channels == {"meta / paid_social", "(direct) / (none)"}


def _brute(touches, orders, lookback=30):
    """Touch x order by definition: every touch against every order."""
    out = set()
    for u in {x for x, _ in orders}:
        own = sorted((t, i) for i, (x, t) in enumerate(orders) if x == u)
        for n, (t, i) in enumerate(own):
            prev = own[n - 1][0] if n else -1
            for j, (x, s, _) in enumerate(touches):
                if x == u and s <= t and s > t - lookback * DAY and s > prev:
                    out.add((i, j))
    return out


def test_journeys_equal_brute_force_with_hot_visitor_and_slices(spark):
    r = random.Random(5)
    who = lambda: "hot" if r.random() < 0.6 else f"u{r.randrange(6)}"
    touches = [(who(), T0 + r.randrange(60) * DAY // 2, r.choice(list(CH))) for _ in range(300)]
    orders = [(who(), T0 + r.randrange(60) * DAY // 2) for _ in range(60)]
    o, e = _frames(spark, touches, orders)
    cuts = [float(T0 + k * 7 * DAY) for k in range(1, 5)]
    want = _brute(touches, orders)
    for c in ([], cuts):
        got = {(x.transaction_id, x.touch_id) for x in at.journeys(o, at.session_touches(e), cuts=c).collect()}
        assert got == want
    plain = at.mart_attribution(o, e, cuts=[]).select("transaction_id", "touch_us", "touch_seq", "path_len", *[F.round(c, 12).alias(c) for c in at.CREDITS])
    sliced = at.mart_attribution(o, e, cuts=cuts).select(*plain.columns[:4], *[F.round(c, 12).alias(c) for c in at.CREDITS])
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sliced.collect()))
    checks = at.check_attribution(at.mart_attribution(o, e), o, covered_only=True).collect()
    assert len(checks) == 15 and all(x.ok in ("OK", "INFO") for x in checks)


def test_row_order_and_partitions_do_not_matter(spark):
    r = random.Random(9)
    touches = [(f"u{r.randrange(5)}", T0 + r.randrange(900) * DAY // 40, r.choice(list(CH))) for _ in range(200)]
    orders = [(f"u{r.randrange(5)}", T0 + r.randrange(900) * DAY // 40) for _ in range(40)]
    o, e = _frames(spark, touches, orders)
    a = at.report_direct_effect(at.mart_attribution(o, e)).collect()
    b = at.report_direct_effect(at.mart_attribution(o.repartition(3).orderBy(F.rand(1)), e.repartition(7))).collect()
    assert a == b


def test_unknown_model_refused(spark):
    import pytest
    with pytest.raises(ValueError):
        at.channel_attribution(None, "revenue); drop", date(2026, 1, 1), date(2026, 1, 2))
