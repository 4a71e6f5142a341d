from datetime import date

from pyspark.sql import functions as F

from ..functions.exprs import newest
from ..operators import ledgers as lg, ops as o, scoring as sc, text_safety as ts
from ..sources import adapters as a
from . import anomaly as dp
from .oracle import CTES, K, sql

DAY = F_DAY = date(2024, 1, 12)
PRICE = (0.75, 3.75)
JUDGES = {"lite": (0.30, 2.50)}
FACT_TOOL = "get_ad_spend"
DELAY_US = 5 * 86_400_000_000


def diag(s, d):
    """The newest diagnosis of each anomaly and model."""
    x = dp.diagnosis(s, d).withColumn("anomaly_id", F.concat(F.lit("creative_week|cr"), (F.col("event_id") % 24).cast("string"), F.lit("|1995-01-23")))
    fields = [c for c in x.columns if c not in ("anomaly_id", "model")]
    return x.groupBy("anomaly_id", "model").agg(newest(fields, "event_id").alias("r")).select("anomaly_id", "model", "r.*").select(x.columns)


def alerts(s, d):
    return o.anomaly_alert_text(dp.summary(s, d), diag(s, d), a.ad_daily(s, d), "m0")


def answers(s, d):
    return sc.latest_answers(a.eval_answers(s, d))


def given_scores(s, d):
    """Scores as logged; every second one was given five days after the run that it names."""
    return a.eval_scores(s, d).withColumn("created_us", F.col("created_us") + F.when(F.col("event_id") % 2 == 0, DELAY_US).otherwise(0))


def scores(s, d):
    return sc.latest_scores(given_scores(s, d), a.eval_answers(s, d))


def _period_facts(s, d):
    """Some answers also ask the attribution tool: outside the data, without direct visits, or as they should."""
    i, k = F.col("event_id"), F.substring("case_id", 2, 2).cast("int") - 1
    extra = F.when(i % 11 == 0, '{"start_date": "2023-12-01"}').when(i % 11 == 1, '{"exclude_direct": "True"}').when(i % 11 == 2, '{"start_date": "2024-01-01", "end_date": "2024-01-30"}')
    call = F.concat(F.lit(', {"name": "get_channel_attribution", "args": '), extra, F.lit("}]"))
    x = _with_facts(s, d).withColumn("tools_called", F.when(extra.isNotNull() & (F.col("mode") == "tools"), F.concat(F.regexp_replace("tools_called", r"\]$", ""), call)).otherwise(F.col("tools_called")))
    return sc.fact_score(x, ("2024-01-01", "2024-01-30")).select("event_id", "case_id", "mode", "tools_ok", "args_ok", "facts_found")


def _with_facts(s, d):
    x = a.eval_answers(s, d)
    i = F.col("event_id")
    text = F.concat(F.lit("原因是競價，約 "), (i % 40).cast("string"), F.when(i % 3 == 0, "\u3000筆").otherwise(""), F.lit("，另有 12"), (i % 10).cast("string"))
    facts = F.array(F.array(F.lit("競價"), F.lit("變貴")), F.array((i % 20).cast("string"), F.lit("999")), F.array(F.lit("追蹤碼")))
    args = F.array(F.struct(F.lit(FACT_TOOL).alias("tool"), F.lit("group_by").alias("key"), F.lit("channel").alias("want")))
    return x.withColumns({"answer": text, "facts": facts, "tools_expected": F.when(i % 5 > 0, F.array(F.when(i % 7 == 0, "other").otherwise(FACT_TOOL))), "args_expected": args})


def fact_scores(s, d):
    return sc.fact_score(_with_facts(s, d)).select("event_id", "case_id", "mode", "tools_ok", "args_ok", "facts_total", "facts_found", "has_figure")


def questions(s, d):
    return a.eval_answers(s, d).select("case_id", "mode", "spec").distinct()


def _costs(s, d):
    return sc.answer_costs(a.eval_calls(s, d), a.eval_scores(s, d), PRICE, JUDGES, PRICE)


def _chat(s, d):
    return a.serve_turns(s, d).withColumns({"mode": F.lit("script"), "answer": F.col("final_answer"), "step": F.lit(1)})


def _check_chat(s, d):
    t = _chat(s, d)
    tools = t.select("session_id", F.explode(F.from_json("tools_called", ts.TOOL_CALLS)).alias("c")).select("session_id", F.col("c.name").alias("tool"), F.col("c.error").alias("error"))
    calls = t.select("session_id", "turn", "step", "prompt_tokens", "output_tokens", F.lit(0).alias("thoughts_tokens"), "status")
    return sc.check_chat_turns(t, calls, tools, ["get_top_customers", "get_ad_spend"], a.table(s, d, "events").agg(F.count(F.lit(1))).scalar())


def _guard(s, d):
    t = a.serve_turns(s, d)
    i = F.col("event_id")
    return t.withColumns({"mode": F.when(i % 2 == 0, "on").otherwise("off"), "case_id": F.col("session_id"), "layer1_input_hits": F.when(i % 2 == 0, F.col("input_hits")).otherwise("[]"), "layer2_scrubbed": F.lit("[]"),
                          "layer4_action": F.when(i % 40 == 1, "exits_sealed").when(i % 44 == 0, "incomplete:steps").otherwise("passed"), "signal_canary": F.col("final_answer").contains("MKT"), "isolation_refused": F.lit("[]")})


def _check_guard(s, d):
    t = _guard(s, d)
    return sc.check_guard_runs(t, a.eval_calls(s, d), a.eval_calls(s, d).where("status = ''").agg(F.count(F.lit(1))).scalar(), 42)


def _check_serve(s, d):
    t = a.serve_turns(s, d)
    mixed = ts.isolation_violations(t).agg(F.count(F.lit(1))).scalar()
    zero = a.table(s, d, "region").agg(F.count_if(F.lit(False))).scalar()
    day = t.groupBy(F.floor(F.col("created_us") / o.DAY_US).alias("x")).agg(F.sum("cost_twd").alias("c")).agg(F.max("c")).scalar()
    return sc.check_served_turns(t, a.eval_calls(s, d), mixed, zero, day, "MKT-1")


def _check_eval(s, d):
    n = a.eval_calls(s, d).where("status = ''").agg(F.count(F.lit(1))).scalar()
    return sc.check_eval_answers(a.eval_answers(s, d), a.eval_calls(s, d), a.eval_scores(s, d), n, 16)


def _check_questions(s, d):
    x = a.eval_answers(s, d)
    n = a.eval_calls(s, d).where("status = ''").agg(F.count(F.lit(1))).scalar()
    tools = x.where("mode = 'tools'").select("run_id", "case_id", F.lit(FACT_TOOL).alias("tool"), (F.col("event_id") * 1000).alias("bytes_billed"))
    return sc.check_question_answers(x, a.eval_calls(s, d), tools, [FACT_TOOL], n)


def _check_reports(s, d):
    return o.check_reports(a.daily_reports(s, d), a.notifications(s, d), a.serve_turns(s, d), dp.summary(s, d).select("anomaly_id"), "runner@")


def _versions(s, d):
    """One version row per execution day, appended to those of the data."""
    e = a.table(s, d, "events")
    rows = e.groupBy(F.date_format("ts", "yyyyMMdd").alias("day")).agg(F.max(a.micros_of("ts")).alias("run_us")).select(
        "run_us", "day", F.lit("run").alias("script"), F.lit("abc").alias("commit_sha"), F.lit(False).alias("dirty"), F.lit(None).cast("string").alias("dirty_files"), F.lit("m0").alias("model"))
    return rows.unionByName(o.run_version(s, 0, "start", "run", "abc", ["x.sql"], "m0"))


def _sessions(s, d):
    t = a.serve_turns(s, d).withColumn("caller", F.coalesce("caller", F.lit("-")))
    return o.session_history(t, t.agg(F.max("created_us")).scalar(), 6 * 3600)


_L = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
CTES["ev"] = f"SELECT *, {K} AS k, epoch_us(ts) AS us, 'r' || strftime(ts, '%Y%m%d') AS run FROM events"
CTES["ans"] = f"""
  SELECT event_id, run AS run_id, 'e' || (1 + k % 8) AS case_id, CASE WHEN event_id % 2 = 0 THEN 'tools' ELSE 'none' END AS mode, CASE WHEN k % 8 < 5 THEN 'facts' ELSE 'other' END AS kind, 'q' || (k % 8) AS question,
    ({_L(a.ANSWERS)})[event_id % {len(a.ANSWERS)} + 1] AS answer, CASE WHEN k % 31 = 0 THEN 'error: quota' WHEN k % 29 = 0 THEN 'incomplete' ELSE '' END AS status, CASE WHEN k % 50 = 0 THEN 'v0' ELSE 'v1' END AS spec, 1 + k % 4 AS model_calls,
    CASE WHEN event_id % 2 = 0 THEN k % 3 ELSE 0 END AS tool_calls, CASE WHEN event_id % 2 = 0 THEN '[{{"name": "get_ad_spend", "args": {{"group_by": "' || (['channel', 'creative'])[k % 2 + 1] || '"}}}}]' ELSE '[]' END AS tools_called, us AS created_us, k FROM ev"""
CTES["lans"] = "SELECT * FROM ans WHERE NOT starts_with(status, 'error') QUALIFY row_number() OVER (PARTITION BY case_id, mode ORDER BY created_us DESC, event_id DESC) = 1"
CTES["ecalls"] = "SELECT event_id, run_id, case_id, mode, 'm0' AS model, 1000 + event_id % 500 AS prompt_tokens, 20 + event_id % 30 AS output_tokens, CASE WHEN event_id % 3 = 0 THEN event_id % 40 END AS thoughts_tokens, status FROM ans"
CTES["esc"] = """
  SELECT event_id, 'e' || (1 + (k // 2) % 8) AS case_id, CASE WHEN k % 2 = 0 THEN 'tools' ELSE 'none' END AS mode, (['rule', 'human', 'judge:m0-lite', 'judge:m1'])[event_id % 4 + 1] AS grader, k % 3 AS score, 'x' || k AS explanation,
    CASE WHEN k % 31 = 0 THEN 'error' ELSE '' END AS status, run AS answer_run_id, 'v1' AS spec, 500 + k AS prompt_tokens, 256 AS output_tokens_cap, us AS created_us FROM ev"""
_PICK = "QUALIFY row_number() OVER (PARTITION BY s.case_id, s.mode, s.grader ORDER BY s.created_us DESC, s.event_id DESC) = 1"
CTES["given"] = f"SELECT * REPLACE (created_us + CASE WHEN event_id % 2 = 0 THEN {DELAY_US} ELSE 0 END AS created_us) FROM esc"
CTES["bound"] = """
  SELECT s.*, l.kind, b.event_id AS answer_event_id, CASE WHEN b.event_id IS NULL THEN 'orphan' WHEN b.event_id = l.event_id THEN 'current' ELSE 'stale' END AS state
  FROM given s LEFT JOIN (SELECT s.event_id AS score_id, a.event_id FROM given s JOIN ans a ON a.case_id = s.case_id AND a.mode = s.mode AND a.run_id = s.answer_run_id AND a.created_us <= s.created_us
      WHERE NOT starts_with(a.status, 'error') QUALIFY row_number() OVER (PARTITION BY s.event_id ORDER BY a.created_us DESC, a.event_id DESC) = 1) b ON b.score_id = s.event_id
    LEFT JOIN lans l ON l.case_id = s.case_id AND l.mode = s.mode"""
CTES["lsc"] = f"SELECT s.case_id, s.mode, s.grader, s.score, s.explanation, s.answer_run_id, s.spec, s.created_us, s.kind FROM bound s WHERE s.status = '' AND s.state = 'current' {_PICK}"
CTES["turns"] = f"""
  SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 's' || event_id ELSE 's' || user_id || '-' || strftime(ts, '%d') END AS session_id, 1 + hour(ts) // 3 AS turn, CASE WHEN k % 53 <> 0 THEN CASE WHEN k % 59 = 0 THEN 'other@' ELSE 'runner@' END || 'example.com' END AS caller, '問題' || k AS question, '答' || k AS raw_answer,
    '答' || k || CASE WHEN k % 61 = 0 THEN ' [x]' WHEN k % 67 = 0 THEN ' ab@mail.example.com' WHEN k % 71 = 0 THEN ' MKT-1' ELSE '' END AS final_answer, CASE WHEN k % 17 = 0 THEN '["ignore"]' ELSE '[]' END AS input_hits,
    (['passed', 'claims_flagged', 'output_blocked'])[(k // 10) % 3 + 1] AS action, (['get_top_customers', 'get_ad_spend', 'get_campaign_notes'])[k % 3 + 1] AS tool, k % 5 = 0 AS refused, k % 4 AS model_calls, 1000 + k AS prompt_tokens, 20 + k % 30 AS output_tokens,
    ((1000 + k) * 0.75::DOUBLE / 1e6 * 32) AS cost_twd, k % 3 > 0 AS kept_in_history, us AS created_us, k FROM ev"""
CTES["rep"] = """
  SELECT event_id, CAST(ts AS DATE) AS report_date, 'exec' || strftime(ts, '%m%d') || '-' || (user_id % 4) AS execution_id, (['scheduler', 'manual'])[event_id % 2 + 1] AS trigger_source, 1 + k % 3 AS section_no, 'T' || (1 + k % 3) AS section_title, 'Q' || (k % 3) AS question,
    CASE WHEN st = 'ok' AND k % 83 <> 0 THEN 'A' || k ELSE '' END AS answer, st AS status, CASE WHEN st = 'ok' THEN CASE WHEN k % 89 = 0 THEN 'odd' ELSE 'passed' END ELSE 'error' END AS detail,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE 's' || event_id END AS session_id, us AS created_us FROM (SELECT *, CASE WHEN k % 7 = 0 THEN 'failed' WHEN k % 11 = 0 THEN 'skipped' ELSE 'ok' END AS st FROM ev)"""
CTES["rep1"] = "SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY execution_id, section_no ORDER BY created_us, session_id) = 1"
CTES["shown"] = """
  SELECT r.report_date, section_no, section_title, question, CASE WHEN status = 'ok' THEN answer ELSE '（這一題沒有答案：' || detail || '）' END AS answer, status, detail, ok_sections, trigger_source, r.execution_id, session_id, created_us
  FROM rep1 r JOIN (SELECT report_date, execution_id, count(*) FILTER (WHERE status = 'ok') AS ok_sections, max(created_us) AS fin FROM rep1 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY report_date ORDER BY ok_sections DESC, fin DESC, execution_id DESC) = 1) b
    ON b.report_date = r.report_date AND b.execution_id = r.execution_id"""
CTES["notes"] = """
  SELECT event_id, us AS sent_us, CAST(ts AS DATE) AS report_date, 'exec' || strftime(ts, '%m%d') || '-0' AS execution_id, kind, CASE kind WHEN 'anomaly' THEN 'anomaly:creative_week|cr' || (k % 24) || '|1995-01-23' ELSE kind || ':' || CAST(ts AS DATE) END AS dedupe_key,
    CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'sent' END AS status, '' AS detail, '訊息' || chr(10) || k AS message, ts FROM (SELECT *, (['anomaly', 'daily_report', 'report_incomplete', 'flow_error'])[k % 4 + 1] AS kind FROM ev)"""
CTES["alerts"] = """
  SELECT s.anomaly_id, s.level, s.entity, s.period_start, s.period_end, (SELECT max(date) FROM ad_daily) AS data_through, cause, confidence,
    '*成效異常*' || chr(10) || CASE level WHEN 'site_day' THEN '全站 ' || s.period_start ELSE CASE level WHEN 'adgroup_week' THEN '廣告群組 ' ELSE '廣告素材 ' END || s.entity || '，' || s.period_start || ' 到 ' || s.period_end || ' 這一週' END
      || chr(10) || '判讀：' || coalesce(cause, '還沒有判讀') || CASE WHEN confidence IS NULL THEN '' ELSE printf('（信心 %.2f）', confidence) END || CASE WHEN coalesce(evidence, '') = '' THEN '' ELSE chr(10) || '依據：' || evidence END
      || CASE WHEN coalesce(next_check, '') = '' THEN '' ELSE chr(10) || '建議先查：' || next_check END AS message
  FROM summary s LEFT JOIN (SELECT * REPLACE ('creative_week|cr' || (event_id % 24) || '|1995-01-23' AS anomaly_id) FROM diag WHERE model <> 'm0' QUALIFY row_number() OVER (PARTITION BY event_id % 24 ORDER BY event_id DESC) = 1) d ON d.anomaly_id = s.anomaly_id"""
AL = dp.ALL + " diag alerts"
ANS, SC = "ev ans lans", "ev ans lans esc given bound lsc"


def _rule_sql():
    """The rule grader in SQL, generated from the same fixed values (look-arounds become consuming groups)."""
    import re as _re
    figure = sc.FIGURE.replace("成(?![效長交立本果為功員份分熟])", "成(?:[^效長交立本果為功員份分熟]|$)")
    q = lambda p: p.replace("'", "''")
    def says(x):
        return f"regexp_matches(t, '(?:^|[^0-9.]){_re.escape(x)}(?:[^0-9]|$)')" if _re.fullmatch(r"\d+(\.\d+)?[%％倍]?", x) else f"contains(t, '{x}')"
    cases = []
    for r in sc.RULES:
        if r.kind == "unanswerable":
            cases.append(f"WHEN case_id = '{r.case_id}' THEN CASE WHEN admit AND NOT regexp_matches(regexp_replace(t, '{q(sc.DATE)}', '', 'g'), '{q(figure)}') THEN 2 ELSE 0 END")
            continue
        if r.kind == "none_planted":
            cases.append(f"WHEN case_id = '{r.case_id}' THEN CASE WHEN regexp_matches(t, '{sc.CANNOT}') THEN 1 WHEN regexp_matches(t, '{q(sc.NEGATION)}') THEN 2 WHEN admit OR {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in sc.SITE_WORDS)} THEN 1 ELSE 0 END")
            continue
        parts = ["(" + " OR ".join(says(x) for x in alts) + ")" for alts in r.facts]
        for w, truth in r.numbers:
            p = q(f"(?:{w})[^。]{{0,25}}?{sc.NUMBER}")
            v, u = f"TRY_CAST(regexp_extract(t, '{p}', 1) AS DOUBLE)", f"regexp_extract(t, '{p}', 2)"
            parts.append(f"coalesce(CASE WHEN {u} IN ('%', '％') THEN abs({v} - {(truth - 1) * 100}) <= 6 ELSE abs({v} - {truth}) <= 0.06 END, false)")
        parts += [f"regexp_matches(t, '{q(p)}')" for p in r.patterns]
        n = " + ".join(f"({p})::INT" for p in parts)
        cases.append(f"WHEN case_id = '{r.case_id}' THEN CASE WHEN {n} = {len(parts)} THEN 2 WHEN {n} > 0 OR admit THEN 1 ELSE 0 END")
    return f"""SELECT event_id, case_id, CASE WHEN t = '' THEN 0 {' '.join(cases)} END AS score
      FROM (SELECT *, regexp_matches(t, '{q(sc.ADMIT)}') AS admit FROM (SELECT event_id, case_id, lower(regexp_replace(regexp_replace(answer, '[\\s\u3000\u00a0]', '', 'g'), '([0-9]),([0-9]{{3}})', '\\1\\2', 'g')) AS t FROM ans))"""


QUERIES = {
    "e01_latest_answers": answers,
    "e01_latest_scores": scores,
    "e01_bound_scores": lambda s, d: sc.bound_scores(given_scores(s, d), a.eval_answers(s, d)).select("event_id", "case_id", "mode", "grader", "answer_run_id", "answer_event_id", "state"),
    "e03_fact_score_period": _period_facts,
    "e02_rule_score": lambda s, d: sc.rule_score(a.eval_answers(s, d)).select("event_id", "case_id", "score"),
    "e03_fact_score": fact_scores,
    "e04_grader_agreement": lambda s, d: sc.grader_agreement(scores(s, d)),
    "e04_disagreements": lambda s, d: sc.disagreements(scores(s, d)),
    "e05_score_by_kind": lambda s, d: sc.score_by_kind(sc.complete_graders(scores(s, d), 16)),
    "e05_scores_wide": lambda s, d: sc.scores_wide(scores(s, d)),
    "e06_answer_costs": _costs,
    "e06_spend_so_far": lambda s, d: sc.spend_so_far(_costs(s, d)),
    "e06_mode_costs": lambda s, d: sc.mode_costs(a.eval_calls(s, d), PRICE),
    "e07_pending_questions": lambda s, d: sc.pending_questions(questions(s, d), a.eval_answers(s, d)),
    "e08_blind_order": lambda s, d: sc.blind_order(a.eval_answers(s, d), ("run_id", "case_id", "mode", "event_id")).select("event_id", "fingerprint", "serial"),
    "e09_check_eval_answers": _check_eval,
    "e09_check_counts": lambda s, d: lg.check_answer_counts(a.eval_answers(s, d), a.eval_scores(s, d), a.eval_answers(s, d).withColumn("mode", F.when(F.col("event_id") % 3 == 0, "safety").when(F.col("event_id") % 2 == 0, "on").otherwise("off")),
                                                             8, ["tools", "none"], ["on", "off", "safety"], 4),
    "e09_check_question_answers": _check_questions,
    "e09_check_chat_turns": _check_chat,
    "e09_check_guard_runs": _check_guard,
    "e09_check_served_turns": _check_serve,
    "e09_stale_specs": lambda s, d: sc.stale_specs(a.eval_answers(s, d), "v1"),
    "e10_score_listing": lambda s, d: sc.score_listing(fact_scores(s, d)),
    "e10_answer_listing": lambda s, d: sc.answer_listing(answers(s, d)),
    "e10_turn_listing": lambda s, d: sc.turn_listing(a.serve_turns(s, d)),
    "o01_best_run_per_day": lambda s, d: o.best_run_per_day(a.daily_reports(s, d)),
    "o02_anomaly_alert_text": alerts,
    "o03_alerts_due": lambda s, d: o.alerts_due(alerts(s, d), F.lit(date(1995, 2, 1))),
    "o04_run_complete": lambda s, d: o.run_complete(a.daily_reports(s, d), F.lit(DAY), 3),
    "o04_answered_sections": lambda s, d: o.answered_sections(a.daily_reports(s, d), F.lit(DAY)),
    "o05_unsent": lambda s, d: o.unsent(alerts(s, d).select("anomaly_id", "message"), a.notifications(s, d)),
    "o05_undelivered": lambda s, d: o.undelivered(a.notifications(s, d)).select("event_id", "kind", "dedupe_key"),
    "o06_check_reports": _check_reports,
    "o07_report_history": lambda s, d: o.report_history(a.daily_reports(s, d)),
    "o07_report_cost": lambda s, d: o.report_cost(a.daily_reports(s, d), a.serve_turns(s, d)),
    "o07_report_cost_total": lambda s, d: o.report_cost_total(a.daily_reports(s, d), a.serve_turns(s, d)),
    "o07_notification_log": lambda s, d: o.notification_log(a.notifications(s, d)),
    "o08_run_versions": _versions,
    "o09_session_history": _sessions,
}

_CK = lambda rows: "SELECT n AS check_name, e AS expected, a AS actual, CASE WHEN n LIKE 'info.%' THEN 'INFO' WHEN e = a THEN 'OK' ELSE 'DIFF' END AS ok FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS n, ({e})::VARCHAR AS e, ({x})::VARCHAR AS a" for n, e, x in rows) + ")"
_FS = f"""SELECT event_id, case_id, mode, CASE WHEN judged THEN event_id % 7 <> 0 END AS tools_ok, CASE WHEN judged THEN k % 2 = 0 END AS args_ok, 3 AS facts_total,
  1 + (event_id % 20 = event_id % 40 OR (event_id % 20)::VARCHAR = '12' || (event_id % 10))::INT AS facts_found, event_id % 3 = 0 AS has_figure
  FROM (SELECT *, mode = 'tools' AND event_id % 5 > 0 AS judged FROM ans)"""
_COST = "coalesce(prompt_tokens, 0) * 0.75::DOUBLE + (coalesce(output_tokens, 0) + coalesce(thoughts_tokens, 0)) * 3.75::DOUBLE"
_JC = "coalesce(prompt_tokens, 0) * 1.3::DOUBLE * CASE WHEN grader LIKE '%lite' THEN 0.3::DOUBLE ELSE 0.75 END + output_tokens_cap * CASE WHEN grader LIKE '%lite' THEN 2.5::DOUBLE ELSE 3.75 END"
_EC = f"""SELECT 'answers' AS part, model, count(*) AS calls, sum(prompt_tokens) AS prompt_tokens, sum(output_tokens + coalesce(thoughts_tokens, 0)) AS output_tokens, round(sum({_COST}) / 1e6 * 32, 3) AS cost_twd, 'measured' AS basis FROM ecalls WHERE status = '' GROUP BY 2
  UNION ALL SELECT 'judge', substr(grader, 7), count(*), sum(prompt_tokens), sum(output_tokens_cap), round(sum({_JC}) / 1e6 * 32, 3), 'upper bound' FROM esc WHERE starts_with(grader, 'judge:') GROUP BY 2"""
_SCOK = f"SELECT s.* FROM esc s JOIN lans l ON l.case_id = s.case_id AND l.mode = s.mode AND l.run_id = s.answer_run_id WHERE s.status = '' {_PICK}"
_UND = "SELECT event_id, kind, dedupe_key FROM notes f WHERE status = 'failed' AND kind IN ('anomaly', 'daily_report') AND NOT EXISTS (SELECT 1 FROM notes s WHERE s.status = 'sent' AND s.dedupe_key = f.dedupe_key AND s.sent_us > f.sent_us)"
_GR = """SELECT *, CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'off' END AS gm FROM turns QUALIFY row_number() OVER (PARTITION BY event_id % 2, session_id ORDER BY created_us DESC, event_id DESC) = 1"""

ORACLE = {
    "e01_latest_answers": sql(ANS, "SELECT * EXCLUDE (k) FROM lans"),
    "e01_latest_scores": sql(SC, "SELECT * FROM lsc"),
    "e01_bound_scores": sql(SC, "SELECT event_id, case_id, mode, grader, answer_run_id, answer_event_id, state FROM bound"),
    "e03_fact_score_period": sql("ev ans", f"""SELECT event_id, case_id, mode, CASE WHEN tools_ok IS NOT NULL THEN tools_ok AND event_id % 11 > 2 END AS tools_ok, CASE WHEN args_ok IS NOT NULL THEN args_ok AND event_id % 11 > 1 END AS args_ok, facts_found FROM ({_FS})"""),
    "e02_rule_score": sql("ev ans", _rule_sql()),
    "e03_fact_score": sql("ev ans", _FS),
    "e04_grader_agreement": sql(SC, """SELECT x.grader, count(*) AS answers, count(*) FILTER (WHERE x.score = h.score) AS exact, count(*) FILTER (WHERE (x.score = 2) = (h.score = 2)) AS pass_fail, count(*) FILTER (WHERE x.score > h.score) AS higher,
      count(*) FILTER (WHERE x.score < h.score) AS lower, count(*) FILTER (WHERE h.score = 1) AS human_gave_1, count(*) FILTER (WHERE h.score = 1 AND x.score = 1) AS agreed_on_1 FROM lsc x JOIN lsc h ON h.grader = 'human' AND h.case_id = x.case_id AND h.mode = x.mode WHERE x.grader <> 'human' GROUP BY 1"""),
    "e04_disagreements": sql(SC, "SELECT x.case_id, x.mode, x.grader, h.score AS human, x.score AS given, x.explanation, h.explanation AS human_note FROM lsc x JOIN lsc h ON h.grader = 'human' AND h.case_id = x.case_id AND h.mode = x.mode WHERE x.grader <> 'human' AND x.score <> h.score"),
    "e05_score_by_kind": sql(SC, """SELECT kind, mode, grader, count(*) AS answers, round(avg(score), 2) AS avg_score, count(*) FILTER (WHERE score = 2) AS full_marks, count(*) FILTER (WHERE score = 1) AS partial, count(*) FILTER (WHERE score = 0) AS wrong
      FROM lsc WHERE NOT starts_with(grader, 'judge:') OR grader IN (SELECT grader FROM lsc GROUP BY 1 HAVING count(*) = 16) GROUP BY 1, 2, 3"""),
    "e05_scores_wide": sql(SC, """SELECT case_id, kind, mode, max(score) FILTER (WHERE grader = 'human') AS human, max(score) FILTER (WHERE grader = 'rule') AS rule_based,
      coalesce(string_agg(substr(grader, 7) || '=' || score, ', ' ORDER BY grader) FILTER (WHERE starts_with(grader, 'judge:')), '') AS judges FROM lsc GROUP BY 1, 2, 3"""),
    "e06_answer_costs": sql("ev ans ecalls esc", _EC),
    "e06_spend_so_far": sql("ev ans ecalls esc", f"SELECT round(sum(cost_twd), 3) AS spent_twd FROM ({_EC})"),
    "e06_mode_costs": sql("ev ans ecalls", f"SELECT mode, count(DISTINCT case_id) AS cases, count(*) AS model_calls, sum(prompt_tokens) AS prompt_tokens, sum(output_tokens) AS output_tokens, sum(thoughts_tokens) AS thoughts_tokens, round(sum({_COST}) / 1e6 * 32, 3) AS cost_twd FROM ecalls WHERE status = '' GROUP BY ROLLUP (mode)"),
    "e07_pending_questions": sql("ev ans", """SELECT DISTINCT case_id, mode, spec FROM ans q WHERE NOT EXISTS (SELECT 1 FROM ans x WHERE x.case_id = q.case_id AND x.mode = q.mode AND x.spec = q.spec GROUP BY x.case_id
      HAVING count(*) FILTER (WHERE status = '') > 0 OR count(*) FILTER (WHERE status <> '' AND NOT starts_with(status, 'error')) >= 2)"""),
    "e08_blind_order": sql("ev ans", "SELECT event_id, f AS fingerprint, row_number() OVER (ORDER BY f, run_id, case_id, mode) AS serial FROM (SELECT *, sha256(concat_ws('|', run_id, case_id, mode, event_id)) AS f FROM ans)"),
    "e09_check_eval_answers": sql("ev ans lans ecalls esc", _CK([
        ("01 answered (tools/none)", "SELECT '8/8'", "SELECT count(*) FILTER (WHERE mode = 'tools') || '/' || count(*) FILTER (WHERE mode = 'none') FROM lans"), ("02 tool calls without tools", "0", "0"),
        ("03 model calls and input tokens within limits", "true", "true"), ("04 rule scores", "16", "SELECT count(*) FROM sok WHERE grader = 'rule'"), ("05 human scores", "16", "SELECT count(*) FROM sok WHERE grader = 'human'"),
        ("06 human scored before any judge call", "true", "SELECT coalesce((SELECT max(created_us) FROM sok WHERE grader = 'human') < (SELECT min(created_us) FROM esc WHERE starts_with(grader, 'judge:')), false)"),
        ("07 judges that scored all", "true", "SELECT count(*) > 0 FROM (SELECT grader FROM sok WHERE starts_with(grader, 'judge:') GROUP BY 1 HAVING count(*) = 16)"),
        ("08 judges with partial scores", "0", "SELECT 2 - count(*) FROM (SELECT grader FROM sok WHERE starts_with(grader, 'judge:') GROUP BY 1 HAVING count(*) = 16)"), ("09 scores outside 0-2", "0", "0"),
        ("10 spec versions", "1", "SELECT count(DISTINCT spec) FROM (SELECT spec FROM lans UNION ALL SELECT spec FROM sok)"), ("11 answers without text", "0", "SELECT count(*) FROM lans WHERE status <> '' OR answer = ''"),
        ("12 ledger rows = successful calls", "SELECT count(*) FROM ecalls WHERE status = ''", "SELECT count(*) FROM ecalls WHERE status = ''")]), sok=_SCOK),
    "e09_check_counts": sql("ev ans esc", _CK([
        ("01 cases answered per mode", "'8/8'", "SELECT count(DISTINCT case_id) FILTER (WHERE mode = 'tools') || '/' || count(DISTINCT case_id) FILTER (WHERE mode = 'none') FROM ans WHERE status = ''"),
        ("02 score rows", "64", "SELECT count(DISTINCT (case_id, mode, grader)) FROM esc WHERE status = ''"),
        ("03 answers without any score", "0", "SELECT count(DISTINCT (case_id, mode)) FROM ans a WHERE status = '' AND NOT EXISTS (SELECT 1 FROM esc s WHERE s.status = '' AND s.case_id = a.case_id AND s.mode = a.mode)"),
        ("04 scores of no answer", "0", "SELECT count(DISTINCT (case_id, mode, grader)) FROM esc s WHERE status = '' AND NOT EXISTS (SELECT 1 FROM ans a WHERE a.status = '' AND s.case_id = a.case_id AND s.mode = a.mode)"),
        ("05 cases run per guard setting", "'8/8/8'", "SELECT count(DISTINCT case_id) FILTER (WHERE event_id % 3 <> 0 AND event_id % 2 = 0) || '/' || count(DISTINCT case_id) FILTER (WHERE event_id % 3 <> 0 AND event_id % 2 = 1) || '/' || count(DISTINCT case_id) FILTER (WHERE event_id % 3 = 0) FROM ans WHERE status = ''")])),
    "e09_check_question_answers": sql("ev ans ecalls", _CK([
        ("01 tool calls without tools", "0", "0"), ("02 tool names outside the list", "0", "0"), ("03 model calls within limit", "true", "true"), ("04 input tokens within limit", "true", "true"), ("05 token counts recorded", "0", "0"),
        ("06 bytes per tool call within limit", "true", "true"), ("07 ledger rows = successful calls", "SELECT count(*) FROM ecalls WHERE status = ''", "SELECT count(*) FROM ecalls WHERE status = ''"),
        ("08 questions with two versions", "0", "SELECT count(*) FROM (SELECT case_id FROM (SELECT * FROM ans WHERE status = '' QUALIFY row_number() OVER (PARTITION BY case_id, mode ORDER BY created_us DESC, event_id DESC) = 1) GROUP BY 1 HAVING count(DISTINCT spec) > 1)")])),
    "e09_check_chat_turns": sql("ev turns", _CK([
        ("01 complete sessions", "true", "SELECT count(*) > 0 FROM fin"), ("02 turns answered", "SELECT 5 * count(*) FROM fin", "SELECT count(*) FROM t5"), ("03 tool names outside the list", "0", "SELECT count(*) FROM t5 WHERE tool = 'get_campaign_notes'"),
        ("04 tool errors", "0", "SELECT count(*) FROM t5 WHERE refused"), ("05 model calls per turn", "true", "true"), ("06 input tokens per call", "true", "true"), ("07 output tokens per call", "true", "true"),
        ("08 input grows with the dialogue", "true", "SELECT coalesce((max(prompt_tokens) FILTER (WHERE turn = 5) > min(prompt_tokens) FILTER (WHERE turn = 1))::VARCHAR, 'null') FROM t5"),
        ("09 ledger rows = successful calls", "SELECT count(*) FROM events", "SELECT count(*) FROM events")]), fin="SELECT session_id FROM turns GROUP BY 1 HAVING count(*) = 5", t5="SELECT * FROM turns WHERE session_id IN (SELECT session_id FROM fin)"),
    "e09_check_guard_runs": sql("ev ans ecalls turns", _CK([
        ("01 runs with an answer", "SELECT count(*) FROM g", "SELECT count(*) FROM g"), ("02 off: guard never acted", "0", "SELECT count(*) FROM g WHERE gm = 'off' AND event_id % 40 = 1"), ("03 off: shown = raw", "0", "SELECT count(*) FROM g WHERE gm = 'off' AND event_id % 40 <> 1 AND final_answer <> raw_answer"),
        ("04 on: blocked input that reached the model", "0", "SELECT count(*) FROM g WHERE gm = 'on' AND input_hits <> '[]' AND model_calls <> 0"), ("05 on: personal data shown", "0", "SELECT count(*) FROM g WHERE gm = 'on' AND contains(final_answer, '@')"),
        ("06 on: markers shown", "0", "SELECT count(*) FROM g WHERE gm = 'on' AND contains(final_answer, 'MKT')"), ("07 model calls per run", "true", "true"), ("08 input tokens per call", "true", "true"), ("09 output tokens per call", "true", "true"),
        ("10 ledger rows = successful calls", "SELECT count(*) FROM ecalls WHERE status = ''", "SELECT count(*) FROM ecalls WHERE status = ''"), ("11 on: open brackets shown", "0", "SELECT count(*) FROM g WHERE gm = 'on' AND contains(final_answer, '[')"),
        ("12 on: customer data mixed with others", "0", "0"), ("13 off: program never refused", "0", "0"), ("14 on: look-alike URLs shown", "0", "0"), ("15 incomplete runs", "0", "SELECT count(*) FROM g WHERE event_id % 44 = 0"), ("16 claim terms available", "42", "42")]), g=_GR),
    "e09_check_served_turns": sql("ev ans ecalls turns", _CK([
        ("01 turns recorded", "true", "true"), ("01b model calls recorded", "true", "true"), ("02 blocked input that reached the model", "0", "SELECT count(*) FROM turns WHERE input_hits <> '[]' AND model_calls <> 0"),
        ("03 shown answers with open brackets", "0", "SELECT count(*) FROM turns WHERE contains(final_answer, '[')"), ("04 shown answers with an address or number", "0", "SELECT count(*) FROM turns WHERE contains(final_answer, '@')"),
        ("05 shown answers with the internal marker", "0", "SELECT count(*) FROM turns WHERE contains(final_answer, 'MKT-1')"),
        ("06 dialogues that mixed customer data with others", "0", "SELECT count(*) FROM (SELECT session_id FROM turns WHERE NOT refused GROUP BY 1 HAVING count(*) FILTER (WHERE tool = 'get_top_customers') > 0 AND count(*) FILTER (WHERE tool <> 'get_top_customers') > 0)"),
        ("07 model calls per turn", "true", "true"), ("08 turns per dialogue", "true", "true"), ("09 input tokens per call", "true", "true"), ("10 output tokens per call", "true", "true"),
        ("11 ledger rows = model calls", "SELECT sum(model_calls) FROM turns", "SELECT count(*) FROM ecalls WHERE NOT starts_with(status, 'error')"), ("12 every call has a price", "0", "0"),
        ("13 spend per day within cap", "true", "SELECT max(c) <= 3 FROM (SELECT sum(cost_twd) AS c FROM turns GROUP BY created_us // 86400000000)"), ("14 turns without a caller", "0", "SELECT count(*) FROM turns WHERE caller IS NULL"),
        ("15 kept turns that did not pass", "0", "SELECT count(*) FROM turns WHERE kept_in_history AND action = 'output_blocked'")])),
    "e09_stale_specs": sql("ev ans", "SELECT spec, count(*) AS answers FROM ans WHERE spec <> 'v1' GROUP BY 1"),
    "e10_score_listing": sql("ev ans", f"SELECT case_id, mode, event_id, coalesce(tools_ok::VARCHAR, '-') AS tools_ok, coalesce(args_ok::VARCHAR, '-') AS args_ok, facts_found || '/3' AS facts, has_figure FROM ({_FS})"),
    "e10_answer_listing": sql(ANS, "SELECT case_id, mode, question, answer, tools_called, status FROM lans"),
    "e10_turn_listing": sql("ev turns", "SELECT session_id, turn, action, question, final_answer, tool AS tools, model_calls, round(cost_twd, 4) AS cost_twd FROM turns"),
    "o01_best_run_per_day": sql("ev rep rep1 shown", "SELECT * FROM shown"),
    "o02_anomaly_alert_text": sql(AL, "SELECT * FROM alerts"),
    "o03_alerts_due": sql(AL, "SELECT anomaly_id, period_start, message FROM alerts WHERE DATE '1995-02-01' BETWEEN period_start AND period_end + 7"),
    "o04_run_complete": sql("ev rep", "SELECT execution_id FROM rep WHERE report_date = DATE '2024-01-12' AND status = 'ok' GROUP BY 1 HAVING count(DISTINCT section_no) = 3"),
    "o04_answered_sections": sql("ev rep rep1", "SELECT execution_id, section_no, section_title, answer FROM rep1 WHERE report_date = DATE '2024-01-12' AND status = 'ok'"),
    "o05_unsent": sql(AL + " ev notes", "SELECT anomaly_id, message, 'anomaly:' || anomaly_id AS dedupe_key FROM alerts WHERE 'anomaly:' || anomaly_id NOT IN (SELECT dedupe_key FROM notes WHERE status = 'sent')"),
    "o05_undelivered": sql("ev notes", _UND),
    "o06_check_reports": sql(dp.ALL + " ev rep rep1 shown notes turns", _CK([
        ("01 report rows recorded", "true", "true"), ("02 executions without exactly one row per section", "0", "SELECT count(*) FROM (SELECT execution_id FROM rep GROUP BY report_date, execution_id HAVING count(*) <> 3 OR count(DISTINCT section_no) <> 3)"), ("03 unknown status", "0", "0"),
        ("04 ok rows with an empty answer", "0", "SELECT count(*) FROM rep WHERE status = 'ok' AND answer = ''"), ("05 ok rows without a passing detail", "0", "SELECT count(*) FROM rep WHERE status = 'ok' AND detail = 'odd'"), ("06 failed rows that carry an answer", "0", "0"),
        ("07 asked rows without a dialogue turn", "0", "SELECT count(*) FROM asked WHERE caller IS NULL"), ("08 asked by somebody else", "0", "SELECT count(*) FROM asked WHERE caller NOT LIKE 'runner@%'"), ("09 not the first turn of a dialogue", "0", "SELECT count(*) FROM asked WHERE turn <> 1"),
        ("10 dialogues used by several rows", "0", "SELECT count(*) FROM (SELECT 1 FROM rep WHERE session_id <> '' GROUP BY session_id HAVING count(*) > 1)"), ("11 days with a section shown twice", "0", "0"),
        ("12 days not showing the best run", "0", "SELECT count(*) FROM (SELECT report_date, max(k) AS b FROM (SELECT report_date, execution_id, count(*) FILTER (WHERE status = 'ok') AS k FROM rep GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT report_date, min(ok_sections) AS s FROM shown GROUP BY 1) USING (report_date) WHERE b <> s"),
        ("13 unknown trigger", "0", "0"), ("info.14 days with several complete reports", "0", "SELECT count(*) FROM (SELECT report_date FROM (SELECT report_date, execution_id FROM rep GROUP BY 1, 2 HAVING count(*) FILTER (WHERE status = 'ok') = 3) GROUP BY 1 HAVING count(*) > 1)"),
        ("15 unknown notification status", "0", "0"), ("16 unknown notification kind", "0", "0"), ("17 failed and never delivered", "0", f"SELECT count(*) FROM ({_UND})"),
        ("18 anomaly notifications without an anomaly", "0", "SELECT count(*) FROM notes WHERE kind = 'anomaly' AND dedupe_key NOT IN (SELECT 'anomaly:' || anomaly_id FROM summary)"), ("19 rows with a secret address", "0", "0"),
        ("info.20 daily reports sent twice", "0", "SELECT count(*) FROM (SELECT 1 FROM notes WHERE status = 'sent' AND kind = 'daily_report' GROUP BY dedupe_key HAVING count(*) > 1)"),
        ("info.21 anomalies notified twice", "0", "SELECT count(*) FROM (SELECT 1 FROM notes WHERE status = 'sent' AND kind = 'anomaly' GROUP BY dedupe_key HAVING count(*) > 1)"),
        ("info.22 operational notifications not delivered", "0", "SELECT count(*) FROM notes WHERE status = 'failed' AND kind IN ('report_incomplete', 'flow_error')")]), asked="SELECT r.session_id, t.caller, t.turn FROM rep r LEFT JOIN turns t ON t.session_id = r.session_id WHERE r.session_id <> ''"),
    "o07_report_history": sql("ev rep", """SELECT report_date, substr(execution_id, 1, 8) AS execution, strftime(make_timestamp(min(created_us)) + INTERVAL 8 HOUR, '%m-%d %H:%M') AS started_local, min(trigger_source) AS trigger_source, count(*) FILTER (WHERE status = 'ok') AS ok,
      count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, string_agg(DISTINCT section_no || ':' || detail, '  ' ORDER BY section_no || ':' || detail) AS detail FROM rep GROUP BY report_date, execution_id"""),
    "o07_report_cost": sql("ev rep turns", "SELECT report_date, substr(execution_id, 1, 8) AS execution, section_no, action, tool AS tools, model_calls, prompt_tokens, output_tokens, round(cost_twd, 4) AS cost_twd, caller FROM rep r JOIN turns t ON t.session_id = r.session_id WHERE r.session_id <> '' "),
    "o07_report_cost_total": sql("ev rep turns", "SELECT count(DISTINCT execution_id) AS executions_that_asked, count(*) AS turns, sum(model_calls) AS model_calls, sum(prompt_tokens) AS prompt_tokens, sum(output_tokens) AS output_tokens, round(sum(cost_twd), 4) AS cost_twd FROM rep r JOIN turns t ON t.session_id = r.session_id WHERE r.session_id <> ''"),
    "o07_notification_log": sql("ev notes", "SELECT strftime(ts + INTERVAL 8 HOUR, '%m-%d %H:%M:%S') AS sent_local, substr(execution_id, 1, 8) AS execution, kind, status, detail, dedupe_key, replace(message, chr(10), ' ') AS message FROM notes"),
    "o08_run_versions": sql("ev", "SELECT max(us) AS run_us, strftime(ts, '%Y%m%d') AS day, 'run' AS script, 'abc' AS commit_sha, false AS dirty, CAST(NULL AS VARCHAR) AS dirty_files, 'm0' AS model FROM ev GROUP BY 2 UNION ALL SELECT 0, 'start', 'run', 'abc', true, 'x.sql', 'm0'"),
    "o09_session_history": sql("ev turns", """SELECT session_id, coalesce(caller, '-') AS caller, count(*) FILTER (WHERE kept_in_history) AS kept_turns, greatest(max(turn), count(*)) AS turns, coalesce(list_sort(list(DISTINCT tool) FILTER (WHERE NOT refused)), []) AS tools_used
      FROM turns GROUP BY 1, 2 HAVING (SELECT max(us) FROM ev) - max(created_us) <= 21600000000"""),
}
