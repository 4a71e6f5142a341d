from tidemark.operators import ledgers as lg, replies as r

LOG = "event_id long, run_id string, model string, creative_id string, prompt_tokens long, output_tokens long, thoughts_tokens long, status string, created_us long"


def test_equal_totals_hide_nothing(spark):
    log = spark.createDataFrame([(1, "r1", "m", "a", 10, 5, None, "", 1), (2, "r1", "m", "b", 10, 5, 2, "", 2), (3, "r1", "m", "b", 10, 5, 2, "", 3), (4, "r1", "m", None, None, 5, None, "ERROR", 4)], LOG)
    copy = lambda df: r.append_usage(df, r.reply_log(spark, "usage"), "job", "day")
    judge = lambda ledger: tuple(lg.ledger_check("c", log, ledger, "job").first())
    assert judge(copy(log)) == ("c", 0, "OK", None)
    # one call lost and another doubled: as many rows and tokens as before
    swapped = copy(log.where("event_id <> 2").unionByName(log.where("event_id = 1")))
    assert swapped.count() == log.count()
    assert judge(swapped) == ("c", 2, "DIFF", "r1|m|a|10|5| 1/2")
    assert judge(copy(log.where("event_id <> 4"))) == ("c", 1, "DIFF", "r1|m|~|~|5|ERROR 1/0")
    assert judge(copy(log).where("false")) == ("c", 3, "DIFF", "r1|m|a|10|5| 1/0")
    assert lg.ledger_check("c", log.where("false"), copy(log).where("false"), "job").first().ok == "OK"


def test_contained_bags(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    assert [tuple(x) for x in lg.bag_difference(a, b, ["k"], contained=True).collect()] == [(1, 2, 1)]
    assert sorted(tuple(x) for x in lg.bag_difference(a, b, ["k"]).collect()) == [(1, 2, 1), (2, 1, 2), (3, 0, 1)]


def test_descriptions_have_a_failing_row_per_check(spark):
    schema = "model string, resolution string, run_no int, creative_id string, description string, prompt_tokens long, status string"
    long = "a picture of a pair of socks"
    good = [("m", "default", 1, "a", long, 90, ""), ("m", "low", 1, "a", long, 30, "")]
    files = spark.createDataFrame([("x.jpg",), ("y.jpg",)], "uri string")
    judge = lambda rows, f=files, d=files: [x.check_name[:2] for x in lg.check_descriptions(spark.createDataFrame(rows, schema), f, d, 2, 1, 2).collect() if x.ok == "DIFF"]
    assert judge(good) == []
    assert judge(good, files.limit(1), files) == ["01"]
    assert judge(good, spark.createDataFrame([("x.png",), ("y.jpg",)], "uri string")) == ["02"]
    assert judge(good, files, files.union(files)) == ["03"]
    assert judge(good + good[:1]) == ["04"]
    assert judge([good[0], ("m", "default", 1, "b", long, 90, "")]) == ["05", "06"]
    assert judge([good[0], ("m", "low", 1, "a", long, 30, "ERROR")]) == ["07"]
    assert judge([good[0], ("m", "low", 1, "a", "short", 30, "")]) == ["08"] and judge([good[0], ("m", "low", 1, "a", None, 30, "")]) == ["08"]
    assert judge([good[0], ("m", "low", 1, "a", long, None, "")]) == ["09"]
    assert judge([good[0], ("m", "low", 1, "a", long, 95, "")]) == ["10"]
