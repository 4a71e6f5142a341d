from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import quality as q, warehouse as w
from tidemark.sources import io
from tidemark.sources.schemas import NESTED_EXPORT, raw_schema, required_names, schema_of

V = lambda s=None, i=None, d=None, f=None: (s, i, d, f)


def _event(ts, user="u", params=(), items=(), tx=None, src=(None, None, None), name="view_item"):
    return ("20260901", ts, name, user, None, [(k, v) for k, v in params], list(items), (tx, None), src)


def test_flatten_special_cases(spark):
    rows = [
        _event(1, params=[("ga_session_id", V(i=7)), ("value", V(i=3))]),
        _event(2, params=[("ga_session_id", V(s="7")), ("value", V(d=2.5))], items=[("(not set)", "v", 2)], src=("meta", "cpc", None)),
        _event(3, params=[("ga_session_id", V(i=7)), ("value", V(f=1.5)), ("source", V(s="late"))], items=[("a", "v", 1), ("b", "v", 1)]),
        _event(4, user=None, params=[("ga_session_id", V(i=7))]),
        _event(5, params=[("transaction_id", V(s="T5"))], tx="(not set)", name="purchase"),
    ]
    df = spark.createDataFrame(rows, schema_of(NESTED_EXPORT))
    out = {r.event_timestamp: r for r in w.flatten_events(df).collect()}
    assert sorted(out) == [1, 2, 3, 5]
    # the source triple of the session's first tagged event goes to all its events, also to earlier ones
    assert all((out[t].utm_source, out[t].utm_medium, out[t].utm_campaign) == ("meta", "cpc", "(direct)") for t in (1, 2, 3))
    assert (out[5].utm_source, out[5].utm_medium, out[5].utm_campaign) == ("(direct)", "(none)", "(direct)")
    assert [out[t].value for t in (1, 2, 3)] == [3.0, 2.5, 1.5]
    assert out[2].item_id is None and out[2].item_variant == "v" and out[2].quantity == 2
    assert out[3].item_id is None and out[3].item_count == 2 and out[1].item_count == 0
    assert out[5].transaction_id == "T5" and out[1].ga_session_id == out[2].ga_session_id == 7


def test_modal_price_tie_takes_lowest(spark):
    ev = spark.createDataFrame([], "item_id string, event_dt date")
    od = spark.createDataFrame([("a", date(2026, 9, 2), 5), ("a", date(2026, 9, 1), 3), ("b", date(2026, 9, 3), None)], "item_id string, order_date date, unit_price bigint")
    cr = spark.createDataFrame([("c", date(2026, 8, 1), "P2"), ("c", date(2026, 8, 2), "P1"), ("c", date(2026, 8, 3), "P1")], "product_focus string, start_date date, promotion_id string")
    out = {r.item_id: r for r in w.build_dim_product(ev, od, cr).collect()}
    assert (out["a"].unit_price, out["a"].first_seen_date, out["a"].promotion_ids) == (3, date(2026, 9, 1), [])
    assert out["b"].unit_price is None and out["c"].promotion_ids == ["P1", "P2"]


def test_calendar(spark):
    d = spark.createDataFrame([(date(2026, 9, 5),), (date(2026, 9, 8),)], "d date")
    cr = spark.createDataFrame([("P1", date(2026, 9, 6), date(2026, 9, 7))], "promotion_id string, start_date date, end_date date")
    out = {r.date.day: r for r in w.build_dim_date([d], cr).collect()}
    assert sorted(out) == [5, 6, 7, 8]
    assert out[6].is_weekend and out[6].day_of_week == 1 and out[6].week_start == date(2026, 8, 31) and out[6].promotion_ids == ["P1"]
    assert out[7].week_start == date(2026, 9, 7) and not out[7].is_weekend and out[8].promotion_ids == []


def test_layout_and_personal_columns(spark):
    star = {"dim_customer": spark.createDataFrame([("1", "x", date(2026, 1, 1), "n", "e", "p")], "customer_id string, city string, first_order_date date, name string, email string, phone string")}
    layout = {"fct_orders": ("order_date", ("customer_id",))}
    rows = {r.check_name: r.ok for r in w.layout_check(spark, star, layout, layout).collect()}
    assert rows["check.dim_customer_pii_columns"] == "DIFF" and rows["check.partition_columns"] == "OK"
    assert w.build_dim_customer(star["dim_customer"]).columns == ["customer_id", "city", "first_order_date"]


def test_typed_csv(spark, tmp_path):
    schema = raw_schema("raw_ad_daily")
    good = tmp_path / "a.csv"
    good.write_text(",".join(schema.fieldNames()) + "\n2026-09-01,c1,g,meta,k,100,5,12.50\n")
    df = io.read_typed_csv(spark, str(good), schema)
    assert df.first().cost == __import__("decimal").Decimal("12.50")
    assert io.header_matches(spark, str(good), schema).first().ok
    assert required_names(schema) == ["date", "creative_id"]
    bad = tmp_path / "b.csv"
    bad.write_text(",".join(schema.fieldNames()) + "\n2026-09-01,c1,g,meta,k,many,5,12.50\n")
    import pytest
    with pytest.raises(Exception):
        io.read_typed_csv(spark, str(bad), schema).collect()
    missing = spark.createDataFrame([(None, "c")], "date date, creative_id string")
    assert [r.result for r in q.required_columns(missing, ["date", "creative_id"]).collect()] == ["FAIL", "PASS"]


def test_order_timestamps_carry_their_zone(spark, tmp_path):
    schema = raw_schema("raw_orders")
    f = tmp_path / "o.csv"
    f.write_text(",".join(schema.fieldNames()) + "\nT1,2026-09-01T07:30:00+08:00,2026-09-01,c,v,i,m,1,100,100,a,b,k,paid\n")
    row = io.read_typed_csv(spark, str(f), schema).select(F.unix_micros("order_ts").alias("us"), "order_date").first()
    from tidemark.functions.exprs import local_date
    assert row.us == 1788219000000000
    assert spark.range(1).select(local_date(F.lit(row.us)).alias("d")).first().d == row.order_date


def test_files_and_guard(spark, tmp_path):
    (tmp_path / "c1.jpg").write_bytes(b"123")
    (tmp_path / "x.txt").write_bytes(b"1")
    r = io.file_listing(spark, str(tmp_path), "*.jpg").collect()
    assert len(r) == 1 and r[0].size == 3
    import pytest
    with pytest.raises(io.UnfilteredScan):
        io.read_fact(spark, str(tmp_path), "event_dt")


def test_partition_filter_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(date(2026, 9, d), "e", d) for d in range(1, 10)], "event_dt date, event_name string, v int")
    io.write_fact(df, str(tmp_path / "f"), "event_dt", ["event_name"])
    got = io.read_fact(spark, str(tmp_path / "f"), "event_dt", "2026-09-03", "2026-09-04")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_dt" in plan and got.count() == 2


def test_columns_views_and_deletes(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert io.add_columns(df, {"b": "string", "c": "double"}).columns == ["a", "b", "c"]
    assert io.drop_columns(df, ["b", "zz"]).columns == ["a"]
    assert io.delete_where(df, F.col("b") == "x").count() == 1
    assert io.create_view(df, "v_test").count() == 2
