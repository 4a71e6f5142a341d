from tidemark.operators import scoring as sc

# question, answer, points: worked out by hand from the rules
CASES = [
    ("e1", "自 08-12 起競爭變多，成本是先前的兩倍", 2), ("e1", "8月10 開始漲", 1), ("e1", "點擊數量持平", 0), ("e1", "CPC 成長 78，發生於八月十日，因為變貴", 2), ("e1", "漲了 178%，沒有其他線索", 0),
    ("e2", "八月二十七追蹤有問題，實際上有訂單", 2), ("e2", "追蹤異常", 1), ("e2", "08-27 追蹤碼\u3000漏記，37\u00a0筆", 2), ("e2", "一切如常", 0),
    ("e3", "cr-meta-evg-p1 的 CTR 少了三成", 2), ("e3", "cr-meta-evg-p1 要換", 1), ("e3", "cr-meta-evg-p2 沒有變", 0),
    ("e4", "人物 28%，CTA 12%，暖色 9%，人物最好", 2), ("e4", "人物 1.27\u3000倍，其餘看不出來", 1), ("e4", "排版最重要", 0),
    ("e5", "meta 多為第一次接觸，google 多為最後一次接觸", 2), ("e5", "meta 多為第一次接觸", 1),
    ("e6", "查不到這項資料", 2), ("e6", "賣了 5,200\u3000件", 0), ("e7", "沒有資料，估計四成", 0), ("e8", "LINE 沒有異常", 2), ("e8", "LINE 流量暴跌", 0), ("e8", " \u3000\n", 0),
]


def test_rule_scores(spark):
    df = spark.createDataFrame([(i, c, a) for i, (c, a, _) in enumerate(CASES)], "id int, case_id string, answer string")
    got = {r.id: r.score for r in sc.rule_score(df).collect()}
    assert [(CASES[i], got[i]) for i in got if got[i] != CASES[i][2]] == []


def test_numbers_stand_alone(spark):
    schema = ("mode string, answer string, facts array<array<string>>, tools_expected array<string>, args_expected array<struct<tool:string,key:string,want:string>>, tools_called string")
    rows = [("tools", "約 1,380 筆", [["380"], ["1380"]], ["t"], [("t", "k", "v")], '[{"name": "t", "args": {"k": "v"}}]'), ("none", "", [["1"]], None, [], None)]
    a, b = sc.fact_score(spark.createDataFrame(rows, schema)).collect()
    assert (a.facts_found, a.facts_total, a.tools_ok, a.args_ok, a.has_figure) == (1, 2, True, True, True)
    assert (b.facts_found, b.tools_ok, b.args_ok, b.has_figure) == (0, None, None, False)


def test_attribution_arguments(spark):
    call = '[{"name": "get_channel_attribution", "args": {"model": "linear"%s}}]'
    rows = [("tools", "x", [["1"]], ["get_channel_attribution"], [], call % extra) for extra in ("", ', "start_date": "2024-01-01"', ', "start_date": "2023-12-31"', ', "end_date": "2025-01-01"', ', "exclude_direct": "false"', ', "exclude_direct": "true"', ', "exclude_direct": true')]
    schema = "mode string, answer string, facts array<array<string>>, tools_expected array<string>, args_expected array<struct<tool:string,key:string,want:string>>, tools_called string"
    got = [r.args_ok for r in sc.fact_score(spark.createDataFrame(rows, schema), ("2024-01-01", "2024-06-30")).collect()]
    assert got == [True, True, False, False, True, False, False]


def test_blind_order_is_stable_and_gapless(spark):
    df = spark.createDataFrame([(f"r{i}", "e1", "tools") for i in range(300)], "run_id string, case_id string, mode string")
    a = {r.run_id: r.serial for r in sc.blind_order(df).collect()}
    assert sorted(a.values()) == list(range(1, 301)) and a == {r.run_id: r.serial for r in sc.blind_order(df.repartition(5)).collect()}


def test_pending(spark):
    ans = spark.createDataFrame([("q1", "m", "s", ""), ("q2", "m", "s", "cut"), ("q2", "m", "s", "cut"), ("q3", "m", "s", "cut"), ("q3", "m", "s", "error: x"), ("q4", "m", "old", "")], "case_id string, mode string, spec string, status string")
    qs = spark.createDataFrame([(f"q{i}", "m", "s") for i in range(1, 6)], "case_id string, mode string, spec string")
    assert sorted(r.case_id for r in sc.pending_questions(qs, ans).collect()) == ["q3", "q4", "q5"]
