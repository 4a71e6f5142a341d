"""Report runs, alerts, notifications, run versions and dialogue sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.checks import check_rows, one_row
from ..functions.exprs import count_rows, newest, oldest, utc_ntz
from .text_safety import TOOL_CALLS

DAY_US = 86_400_000_000
REPORT_FIELDS = ("report_date", "trigger_source", "section_title", "question", "answer", "status", "detail", "session_id", "created_us")
PASSING = ("passed", "claims_flagged", "exits_sealed", "claims_flagged,exits_sealed")
CARRYING = ("input_blocked", "output_blocked", "safety_blocked", "daily_cap", "max_turns", "input_cap", "incomplete", "error", "unavailable")
KINDS = ("anomaly", "daily_report", "report_incomplete", "flow_error")


def first_row_per_section(reports: DataFrame) -> DataFrame:
    return reports.groupBy("execution_id", "section_no").agg(oldest(list(REPORT_FIELDS), "created_us", "session_id").alias("r")).select("execution_id", "section_no", "r.*")


def best_run_per_day(reports: DataFrame) -> DataFrame:
    """O-01: per day the execution with most answered sections, then the newest; a section recorded twice counts with its earliest row."""
    one = first_row_per_section(reports)
    ok = F.col("status") == "ok"
    runs = one.groupBy("report_date", "execution_id").agg(F.count_if(ok).alias("ok_sections"), F.max("created_us").alias("finished_us"))
    best = runs.groupBy("report_date").agg(newest(["execution_id", "ok_sections"], "ok_sections", "finished_us", "execution_id").alias("b")).select("report_date", "b.*")
    shown = F.when(ok, F.col("answer")).otherwise(F.concat(F.lit("（這一題沒有答案："), "detail", F.lit("）")))
    return one.join(best, ["report_date", "execution_id"]).select(
        "report_date", "section_no", "section_title", "question", shown.alias("answer"), "status", "detail", "ok_sections", "trigger_source", "execution_id", "session_id", "created_us")


def anomaly_alert_text(summary: DataFrame, diagnosis: DataFrame, ads: DataFrame, skip_model: str | None = None) -> DataFrame:
    """O-02: message per anomaly (and diagnosis), and the date up to which data exist."""
    c = F.col
    d = diagnosis if skip_model is None else diagnosis.where(c("model") != skip_model)
    span = F.concat(F.lit("，"), c("period_start").cast("string"), F.lit(" 到 "), c("period_end").cast("string"), F.lit(" 這一週"))
    head = F.when(c("level") == "site_day", F.concat(F.lit("全站 "), c("period_start").cast("string"))).when(c("level") == "adgroup_week", F.concat(F.lit("廣告群組 "), "entity", span)) \
        .when(c("level") == "creative_week", F.concat(F.lit("廣告素材 "), "entity", span)).otherwise(F.concat_ws(" ", "level", "entity", c("period_start").cast("string")))
    line = lambda label, x: F.when(F.coalesce(x, F.lit("")) == "", "").otherwise(F.concat(F.lit(f"\n{label}："), x))
    sure = F.when(c("confidence").isNull(), "").otherwise(F.format_string("（信心 %.2f）", "confidence"))
    message = F.concat(F.lit("*成效異常*\n"), head, F.lit("\n判讀："), F.coalesce("cause", F.lit("還沒有判讀")), sure, line("依據", c("evidence")), line("建議先查", c("next_check")))
    return summary.join(d.select("anomaly_id", "cause", "confidence", "evidence", "next_check"), "anomaly_id", "left").select(
        "anomaly_id", "level", "entity", "period_start", "period_end", ads.agg(F.max("date")).scalar().alias("data_through"), "cause", "confidence", message.alias("message"))


def alerts_due(alerts: DataFrame, as_of: Column | None = None, days: int = 7) -> DataFrame:
    """O-03: alerts whose period, or the week after it, contains the day (by default the last day with data)."""
    day = F.col("data_through") if as_of is None else as_of
    return alerts.where(day.between(F.col("period_start"), F.date_add("period_end", days))).select("anomaly_id", "period_start", "message")


def run_complete(reports: DataFrame, report_date: Column, sections: int) -> DataFrame:
    """O-04: executions of the day with all sections answered."""
    return reports.where((F.col("report_date") == report_date) & (F.col("status") == "ok")).groupBy("execution_id").agg(
        F.count_distinct("section_no").alias("n")).where(F.col("n") == sections).select("execution_id")


def answered_sections(reports: DataFrame, report_date: Column) -> DataFrame:
    return first_row_per_section(reports).where((F.col("report_date") == report_date) & (F.col("status") == "ok")).select("execution_id", "section_no", "section_title", "answer")


def unsent(alerts: DataFrame, notifications: DataFrame, prefix: str = "anomaly:", renotify: bool = False) -> DataFrame:
    """O-05: alerts whose key was never sent; a failed attempt does not count as sent."""
    keyed = alerts.withColumn("dedupe_key", F.concat(F.lit(prefix), "anomaly_id"))
    if renotify:
        return keyed
    sent = notifications.where("status = 'sent'").select("dedupe_key").distinct()
    return keyed.join(sent, "dedupe_key", "left_anti").select(*keyed.columns)


def undelivered(notifications: DataFrame, kinds: Sequence[str] = ("anomaly", "daily_report")) -> DataFrame:
    """Failed notifications without a later success for the same key: compared with the key's last success, not pairwise."""
    sent = notifications.where("status = 'sent'").groupBy("dedupe_key").agg(F.max("sent_us").alias("last_sent"))
    failed = notifications.where((F.col("status") == "failed") & F.col("kind").isin(list(kinds)))
    return failed.join(sent, "dedupe_key", "left").where("last_sent is null or last_sent <= sent_us").drop("last_sent")


def check_reports(reports: DataFrame, notifications: DataFrame, turns: DataFrame, alerts: DataFrame, caller_prefix: str, sections: int = 3, secret: str = r"hooks\.example\.com") -> DataFrame:
    """O-06: twenty-two checks of report runs and notifications."""
    c = F.col
    s = c("status")
    shown = best_run_per_day(reports)
    struct = lambda df, **a: df.agg(F.struct(*[x.alias(k) for k, x in a.items()])).scalar()
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    runs = reports.groupBy("report_date", "execution_id").agg(count_rows().alias("n"), F.count_distinct("section_no").alias("k"), F.count_if(s == "ok").alias("ok"))
    asked = reports.where(~empty(c("session_id"))).select("session_id").join(turns.select("session_id", "caller", "turn"), "session_id", "left")
    many = lambda df, *keys: df.groupBy(*keys).agg(count_rows().alias("n")).where("n > 1")
    best = runs.groupBy("report_date").agg(F.max("ok").alias("best")).join(shown.groupBy("report_date").agg(F.min("ok_sections").alias("shown")), "report_date")
    keys = alerts.select(F.concat(F.lit("anomaly:"), "anomaly_id").alias("dedupe_key")).distinct()
    stray = notifications.where("kind = 'anomaly'").join(keys, "dedupe_key", "left_anti")
    leak = lambda *x: F.count_if(F.concat_ws(" ", *[F.coalesce(y, F.lit("")) for y in x]).rlike(secret))
    sent = notifications.where("status = 'sent'")
    n = lambda df: df.agg(count_rows()).scalar()
    facts = one_row(
        reports.sparkSession,
        r=struct(reports, n=count_rows(), st=F.count_if(~s.isin("ok", "failed", "skipped")), ea=F.count_if((s == "ok") & empty(c("answer"))), pa=F.count_if((s == "ok") & ~c("detail").isin(list(PASSING))),
                 ca=F.count_if((s != "ok") & ~c("detail").isin(list(CARRYING)) & ~empty(c("answer"))), tr=F.count_if(~c("trigger_source").isin("scheduler", "manual")), lk=leak("answer", "detail")),
        x=struct(runs, bad=F.count_if((c("n") != sections) | (c("k") != sections))),
        a=struct(asked, lost=F.count_if(c("caller").isNull()), who=F.count_if(~c("caller").startswith(caller_prefix)), first=F.count_if(c("turn") != 1)),
        shared=n(many(reports.where(~empty(c("session_id"))), "session_id")), dup=n(many(shown, "report_date", "section_no")), wrong=n(best.where("best <> shown")),
        full=n(many(runs.where(c("ok") == sections), "report_date")),
        m=struct(notifications, st=F.count_if(~s.isin("sent", "failed")), kd=F.count_if(~c("kind").isin(list(KINDS))), lk=leak("message", "detail"), lost=F.count_if((s == "failed") & c("kind").isin("report_incomplete", "flow_error"))),
        und=n(undelivered(notifications)), stray=n(stray), twice=n(many(sent.where("kind = 'daily_report'"), "dedupe_key")), again=n(many(sent.where("kind = 'anomaly'"), "dedupe_key")))
    zero = "0"
    return check_rows(facts, [
        ("01 report rows recorded", "true", c("r.n") > 0), ("02 executions without exactly one row per section", zero, c("x.bad")), ("03 unknown status", zero, c("r.st")), ("04 ok rows with an empty answer", zero, c("r.ea")),
        ("05 ok rows without a passing detail", zero, c("r.pa")), ("06 failed rows that carry an answer", zero, c("r.ca")), ("07 asked rows without a dialogue turn", zero, c("a.lost")), ("08 asked by somebody else", zero, c("a.who")),
        ("09 not the first turn of a dialogue", zero, c("a.first")), ("10 dialogues used by several rows", zero, c("shared")), ("11 days with a section shown twice", zero, c("dup")), ("12 days not showing the best run", zero, c("wrong")),
        ("13 unknown trigger", zero, c("r.tr")), ("info.14 days with several complete reports", zero, c("full")), ("15 unknown notification status", zero, c("m.st")), ("16 unknown notification kind", zero, c("m.kd")),
        ("17 failed and never delivered", zero, c("und")), ("18 anomaly notifications without an anomaly", zero, c("stray")), ("19 rows with a secret address", zero, c("r.lk") + c("m.lk")),
        ("info.20 daily reports sent twice", zero, c("twice")), ("info.21 anomalies notified twice", zero, c("again")), ("info.22 operational notifications not delivered", zero, c("m.lost"))])


def _local(us: str, pattern: str, tz: str = "Asia/Taipei") -> Column:
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_ntz(us)), pattern)


def report_history(reports: DataFrame) -> DataFrame:
    """O-07: one row per execution; the detail list has one entry per section."""
    s = F.col("status")
    detail = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("section_no", F.concat_ws(":", F.col("section_no").cast("string"), "detail").alias("t")))), lambda x: x["t"]), "  ")
    return reports.groupBy("report_date", "execution_id").agg(
        F.min("created_us").alias("_first"), F.min("trigger_source").alias("trigger_source"), F.count_if(s == "ok").alias("ok"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "skipped").alias("skipped"), detail.alias("detail")) \
        .withColumn("started_local", _local("_first", "MM-dd HH:mm")).withColumn("execution", F.substring("execution_id", 1, 8)).drop("_first", "execution_id")


def report_cost(reports: DataFrame, turns: DataFrame) -> DataFrame:
    asked = reports.where("coalesce(session_id, '') <> ''").select("report_date", F.substring("execution_id", 1, 8).alias("execution"), "section_no", "session_id")
    tools = F.array_join(F.transform(F.from_json("tools_called", TOOL_CALLS), lambda x: x["name"]), "、")
    return asked.join(turns, "session_id").select("report_date", "execution", "section_no", "action", tools.alias("tools"), "model_calls", "prompt_tokens", "output_tokens", F.round("cost_twd", 4).alias("cost_twd"), "caller")


def report_cost_total(reports: DataFrame, turns: DataFrame) -> DataFrame:
    j = reports.where("coalesce(session_id, '') <> ''").select("execution_id", "session_id").join(turns, "session_id")
    return j.agg(F.count_distinct("execution_id").alias("executions_that_asked"), count_rows().alias("turns"), *[F.sum(x).alias(x) for x in ("model_calls", "prompt_tokens", "output_tokens")], F.round(F.sum("cost_twd"), 4).alias("cost_twd"))


def notification_log(notifications: DataFrame) -> DataFrame:
    return notifications.select(_local("sent_us", "MM-dd HH:mm:ss").alias("sent_local"), F.substring("execution_id", 1, 8).alias("execution"), "kind", "status", "detail", "dedupe_key",
                                F.substring(F.replace("message", F.lit("\n"), F.lit(" ")), 1, 60).alias("message"))


VERSION_SCHEMA = "run_us bigint, day string, script string, commit_sha string, dirty boolean, dirty_files string, model string"


def run_version(spark: SparkSession, run_us: int, day: str, script: str, commit_sha: str, dirty_files: Sequence[str], model: str) -> DataFrame:
    """O-08: the row appended at every start."""
    return spark.createDataFrame([(run_us, day, script, commit_sha or None, bool(dirty_files), ",".join(dirty_files) or None, model)], VERSION_SCHEMA)


def session_history(turns: DataFrame, now_us: Column, ttl_seconds: int = 1800) -> DataFrame:
    """O-09: dialogues that can be continued: last turn within half an hour; kept turns, tools used, number of turns."""
    c = F.col
    names = F.transform(F.filter(F.from_json("tools_called", TOOL_CALLS), lambda x: F.coalesce(x["error"], F.lit("")) == ""), lambda x: x["name"])
    kept = F.coalesce(c("kept_in_history"), F.lit(False)) & (F.coalesce("question", F.lit("")) != "") & (F.coalesce("raw_answer", F.lit("")) != "")
    per = turns.groupBy("session_id", "caller").agg(F.max("created_us").alias("last_us"), F.count_if(kept).alias("kept_turns"), count_rows().alias("rows"), F.max("turn").alias("max_turn"))
    tools = turns.select("session_id", "caller", F.explode(names).alias("t")).groupBy("session_id", "caller").agg(F.sort_array(F.collect_set("t")).alias("tools_used"))
    return per.where(now_us - c("last_us") <= ttl_seconds * 1_000_000).join(tools, ["session_id", "caller"], "left").select(
        "session_id", "caller", "kept_turns", F.greatest("max_turn", "rows").cast("bigint").alias("turns"), F.coalesce("tools_used", F.array().cast("array<string>")).alias("tools_used"))
