from pyspark.sql import functions as F

from ..functions.checks import fingerprint
from ..operators import consistency as k, ledgers as l, replies as r
from ..sources import adapters as a, io
from . import replies as rp
from .oracle import CTES, K, sql

PAGES = {"k0": "0", "k1": "1", "k2": "2"}
MODES = ["image", "text"]
MODELS = ["m0", "m1", "m2", "m9"]
PRICES = {"m0": (0.33, 2.75), "m1": (0.825, 4.125), "m2": (2.0, 12.0)}


def mapped(s, d):
    return k.page_map(a.image_truth(s, d), PAGES, "3")


def pages(s, d):
    return k.landing_pages(a.wide_table(s, d, "pages").withColumn("page_id", F.col("page_id").cast("string")))


def shots(s, d):
    p = a.table(s, d, "pages")
    return p.select(F.concat(F.lit("file:/landing/"), (F.col("page_id") % 5).cast("string"), F.lit("-"), (1 + F.col("page_id") % 4).cast("string"), F.lit(".jpg")).alias("uri"), F.length("html").cast("bigint").alias("size"))


def latest(s, d):
    return io.materialize(k.latest_readable(a.gap_log(s, d)))


def values():
    return F.array(*[F.lit(m) for m in MODES])


def verdicts(s, d):
    return k.gap_verdicts(a.gap_answers(s, d), latest(s, d), mapped(s, d), values())


def bench(s, d):
    f = rp.log(s, d)
    i = F.col("event_id")
    cols = ["event_id", "run_id", "task", "model", "creative_id", "result", "prompt_tokens", "output_tokens", "thoughts_tokens", "finish_reason", "status", "created_us", "source", "prompt_version", "ok", "method"]
    feats = f.withColumns({"task": F.lit("features"), "source": F.when(i % 4 == 0, "day16").otherwise("day20"), "prompt_version": F.lit("v1"), "method": F.when(i % 5 == 0, "response_schema")})
    g = a.gap_log(s, d).where("mode = 'text'")
    gaps = g.withColumns({"task": F.lit("gaps"), "source": F.lit("day20"), "prompt_version": F.when(i % 100 == 1, "v0").otherwise("v2"), "ok": k.readable(), "method": F.lit(None).cast("string")})
    return feats.select(*cols).unionByName(gaps.select(*cols))


def unsettled(s, d):
    """The whole comparison log of images some of which one model never got right: calls that failed, or answers that were not good and a strict
    retry that failed."""
    n = F.substring("creative_id", 2, 20).cast("bigint") % 10
    stuck = (F.col("task") == "features") & (F.col("model") == "m1") & n.isin(3, 6)
    failed = stuck & ((n == 3) | F.coalesce(F.col("method") == "response_schema", F.lit(False)))
    return bench(s, d).withColumns({"ok": F.col("ok") & ~stuck, "status": F.when(failed, "ERROR").when(stuck, "").otherwise(F.col("status"))})


def cells(s, d):
    return k.score_cells(bench(s, d), a.image_truth(s, d), a.image_review(s, d), ["m0", "m1", "m9"])


def gaps(s, d):
    return k.score_gaps_by_model(bench(s, d), a.gap_answers(s, d), mapped(s, d), MODELS)


def cost(s, d):
    return k.cost_per_thousand(bench(s, d), PRICES)


def jobs(s, d):
    """``events`` of one type as jobs that ran for half an hour each."""
    e = a.table(s, d, "events").where("event_type = 'signup'")
    us = a.micros_of("ts")
    return e.select(F.col("event_id").alias("job_id"), (us - 600_000_000).alias("start_us"), (us + 1_200_000_000).alias("end_us"))


def _ledger(s, d):
    x = a.gap_log(s, d).where("run_id > 'r20240103'")
    return r.append_usage(x, r.reply_log(s, "usage"), "consistency", "Day 19", "global")


def _check(s, d):
    answers = a.gap_answers(s, d)
    return k.check_consistency(a.gap_log(s, d), verdicts(s, d), answers, _ledger(s, d), "consistency", fingerprint(answers), mapped(s, d))


def _flawed(x):
    """A log as a careless copy of it: one row lost, one doubled, one with other tokens."""
    i = F.col("event_id")
    return x.where("event_id <> 7").unionByName(x.where("event_id = 11")).withColumn("prompt_tokens", F.col("prompt_tokens") + F.when(i == 13, 1).otherwise(0))


def _ledger_bags(s, d):
    """Sound and flawed ledgers of two jobs; the flawed ones must be found out although their totals are those of the log."""
    f, g = rp.log(s, d), a.draft_log(s, d)
    empty = r.reply_log(s, "usage")
    copy = lambda x, job: r.append_usage(x, empty, job, "Day 16")
    return l.union_all([
        l.ledger_check("features, sound", f, copy(f, "features"), "features"), l.ledger_check("features, flawed", f, copy(_flawed(f), "features"), "features"),
        l.ledger_check("drafts, sound", g, copy(g, "drafts"), "drafts"), l.ledger_check("drafts, flawed", g, copy(_flawed(g), "drafts"), "drafts"),
        l.ledger_check("drafts under another job", g, copy(g, "features"), "drafts")])


def _reconcile_bench(s, d):
    b, f = io.materialize(bench(s, d)), rp.log(s, d)
    ledger = r.append_usage(_flawed(b.where("source = 'day20'")), r.reply_log(s, "usage"), "bench", "Day 20")
    now = a.gap_answers(s, d)
    then = now.withColumn("page_fact", F.when((F.col("creative_id") == "c5") & (F.col("page_fact") == "fact0"), "fact9").otherwise(F.col("page_fact")))
    listed = a.gap_log(s, d).where("mode = 'text' and status = ''").select(F.explode(F.from_json("result", k.GAPS_JSON)["gaps"]["gap_type"]).alias("gap_type"))
    taken = b.where("source = 'day16'").withColumn("output_tokens", F.col("output_tokens") + F.when(F.col("event_id") == 40, 1).otherwise(0)).unionByName(b.where("source <> 'day16'"))
    return l.reconcile_bench(taken, f, ledger, "bench", cells(s, d), r.best_reply(f).where("model = 'm0'"), now, then, listed, [x for x in a.GAP_KINDS if x != "gift"], ("day16", "m0"), "day20")


def _descriptions(s, d):
    x = r.parse_reply(a.describe_replies(s, d), "describe").withColumn("run_no", F.when(F.col("resolution") == "default", 1 + F.col("event_id") % 2).otherwise(1))
    files = shots(s, d)
    return l.check_descriptions(x, files, files.where("uri like '%-1.jpg'"), 6, 150, 20)


def _check_bench(s, d):
    earlier = k.gap_verdicts(a.gap_answers(s, d), latest(s, d), mapped(s, d), values()).where("mode = 'text'")
    return k.check_bench(bench(s, d), cells(s, d), gaps(s, d), earlier, a.gap_answers(s, d), a.image_truth(s, d), {"features": "v1", "gaps": "v2"}, {"gaps": ["m1"]})


_L = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
CTES["mapped"] = "SELECT creative_id, 'ch' || (user_id % 3) AS channel, 'k' || (user_id % 4) AS utm_campaign, product_focus, (user_id % 4)::VARCHAR AS page_id FROM truth"
CTES["answers"] = f"""
  SELECT 'c' || user_id AS creative_id, ({_L(a.GAP_KINDS[:6])})[(user_id + 3 * j) % 6 + 1] AS gap_type, ({_L(a.GAP_WORDS)})[(user_id + j) % 5 + 1] AS ad_keyword, 'fact' || j AS page_fact, user_id % 9 = j AS disputed
  FROM (SELECT user_id, unnest([0, 1]) AS j FROM (SELECT DISTINCT user_id FROM events)) WHERE user_id % 5 <> 4"""
CTES["glog"] = f"""
  SELECT event_id, 'r' || strftime(ts, '%Y%m%d') AS run_id, (['image', 'text'])[event_id % 2 + 1] AS mode, 'c' || user_id AS creative_id, (['m0', 'm1', 'm2'])[event_id % 3 + 1] AS model, epoch_us(ts) AS created_us, k, user_id AS u,
    1000 + k AS prompt_tokens, 20 + k % 30 AS output_tokens, CASE WHEN k % 3 = 0 THEN k END AS thoughts_tokens, CASE WHEN k % 41 = 0 THEN 'MAX_TOKENS' ELSE 'STOP' END AS finish_reason, CASE WHEN k % 31 = 0 THEN 'ERROR' ELSE '' END AS status,
    k % 31 <> 0 AND k % 41 <> 0 AND k % 43 <> 0 AS ok, ({_L(a.GAP_WORDS)})[user_id % 5 + 1] || ' ｜ 立即選購' AS ad_texts,
    list_filter([CASE WHEN k % 3 > 0 THEN {{'t': ({_L(a.GAP_KINDS[:6])})[user_id % 6 + 1], 'x': '現在' || ({_L(a.GAP_WORDS)})[(user_id + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) % 5 + 1] || '中'}} END,
      CASE WHEN k % 2 = 0 THEN {{'t': ({_L(a.GAP_KINDS[:6])})[(user_id + 3) % 6 + 1], 'x': '現在' || ({_L(a.GAP_WORDS)})[(user_id + 1) % 5 + 1] || '中'}} END,
      CASE WHEN k % 5 = 0 THEN {{'t': 'other', 'x': '現在其他中'}} END], lambda y: y IS NOT NULL) AS gl
  FROM (SELECT *, {K} AS k FROM events)"""


def _chain(key, log, grid):
    """SQL of the gap scoring with ``key`` as mode or model."""
    return {
        "lat": f"SELECT * FROM {log} WHERE ok QUALIFY row_number() OVER (PARTITION BY {key}, creative_id ORDER BY created_us DESC, event_id DESC) = 1",
        "fnd": f"SELECT {key}, creative_id, pos, gl[pos + 1].t AS gap_type, gl[pos + 1].x AS ad_text, 'e' || k AS page_evidence FROM (SELECT *, unnest(range(len(gl))) AS pos FROM lat)",
        "grd": f"SELECT a.*, m.v AS {key} FROM answers a, (SELECT unnest({grid}) AS v) m",
        "mat": f"SELECT g.{key}, g.creative_id, g.gap_type, g.ad_keyword, f.pos, f.ad_text, f.page_evidence FROM grd g JOIN fnd f ON f.{key} = g.{key} AND f.creative_id = g.creative_id AND f.gap_type = g.gap_type AND contains(f.ad_text, g.ad_keyword)",
        "verd": f"""
  SELECT x.{key}, x.creative_id, m.page_id, m.utm_campaign, m.product_focus, gap_type, verdict, listed, ad_keyword, page_fact, CASE WHEN ad_keyword IS NOT NULL THEN contains(coalesce(l.ad_texts, ''), ad_keyword) END AS ad_read,
    ad_text, page_evidence, l.ad_texts
  FROM (SELECT g.{key}, g.creative_id, g.gap_type, CASE WHEN l.creative_id IS NULL THEN 'no_call' WHEN disputed THEN 'disputed' WHEN t.n > 0 THEN 'hit' ELSE 'miss' END AS verdict, coalesce(t.n, 0) > 0 AS listed, g.ad_keyword, page_fact, t.ad_text, t.page_evidence
        FROM grd g LEFT JOIN lat l ON l.{key} = g.{key} AND l.creative_id = g.creative_id
        LEFT JOIN (SELECT {key}, creative_id, gap_type, ad_keyword, count(*) AS n, string_agg(ad_text, ' ／ ' ORDER BY pos) AS ad_text, string_agg(page_evidence, ' ／ ' ORDER BY pos) AS page_evidence FROM mat GROUP BY 1, 2, 3, 4) t
          ON t.{key} = g.{key} AND t.creative_id = g.creative_id AND t.gap_type = g.gap_type AND t.ad_keyword = g.ad_keyword
        UNION ALL
        SELECT {key}, creative_id, gap_type, CASE gap_type WHEN 'other' THEN 'other' ELSE 'extra' END, true, NULL, NULL, string_agg(ad_text, ' ／ ' ORDER BY pos), string_agg(page_evidence, ' ／ ' ORDER BY pos)
        FROM fnd f WHERE NOT EXISTS (SELECT 1 FROM mat t WHERE t.{key} = f.{key} AND t.creative_id = f.creative_id AND t.pos = f.pos) GROUP BY 1, 2, 3) x
  JOIN mapped m ON m.creative_id = x.creative_id LEFT JOIN lat l ON l.{key} = x.{key} AND l.creative_id = x.creative_id""",
    }


def gsql(body, key="mode", extra="", **more):
    log, grid = ("glog", "['image', 'text']") if key == "mode" else ("(SELECT * FROM glog WHERE mode = 'text')", "['m0', 'm1', 'm2', 'm9']")
    return sql(("truth mapped answers glog " + extra).strip(), body, **_chain(key, log, grid), **more)


def _rp(key):
    return f"""SELECT {key}, count(*) FILTER (WHERE verdict IN ('hit', 'miss')) AS answers, count(*) FILTER (WHERE verdict = 'hit') AS hit, count(*) FILTER (WHERE verdict = 'miss') AS miss, count(*) FILTER (WHERE verdict = 'extra') AS extra,
      round(count(*) FILTER (WHERE verdict = 'hit') / nullif(count(*) FILTER (WHERE verdict IN ('hit', 'miss')), 0), 3) AS recall, round(count(*) FILTER (WHERE verdict = 'hit') / nullif(count(*) FILTER (WHERE verdict IN ('hit', 'extra')), 0), 3) AS precision,
      count(DISTINCT creative_id) FILTER (WHERE verdict = 'extra' AND creative_id NOT IN (SELECT creative_id FROM answers WHERE NOT disputed)) AS clean_flagged, count(*) FILTER (WHERE verdict = 'extra' AND gap_type IN ('gift', 'warranty')) AS decoy,
      count(*) FILTER (WHERE verdict = 'disputed' AND listed) AS disputed_listed, count(*) FILTER (WHERE verdict = 'other') AS other_rows FROM verd GROUP BY 1"""


def _bt(key):
    return f"""SELECT gap_type, {key}, count(*) FILTER (WHERE verdict IN ('hit', 'miss')) AS answers, count(*) FILTER (WHERE verdict = 'hit') AS hit, count(*) FILTER (WHERE verdict = 'miss') AS miss, count(*) FILTER (WHERE verdict = 'extra') AS extra,
      count(*) FILTER (WHERE verdict = 'miss' AND ad_read) AS miss_but_read, count(*) FILTER (WHERE verdict = 'miss' AND NOT ad_read) AS miss_not_read FROM verd WHERE verdict IN ('hit', 'miss', 'extra') GROUP BY 1, 2"""


def _rows(key, wanted):
    return f"SELECT {key}, verdict, creative_id, page_id, gap_type, ad_keyword, ad_read, listed, ad_text, page_evidence, page_fact FROM verd WHERE verdict IN ({wanted})"


_OKF = f"coalesce({rp._COMPLETE} AND {rp._INOPT} AND finish_reason <> 'MAX_TOKENS', false)"
CTES["bench"] = f"""
  SELECT event_id, run_id, 'features' AS task, model, creative_id, prompt_tokens, output_tokens, thoughts_tokens, finish_reason, status, created_us, CASE WHEN event_id % 4 = 0 THEN 'day16' ELSE 'day20' END AS source, 'v1' AS prompt_version, {_OKF} AS ok,
    CASE WHEN event_id % 5 = 0 THEN 'response_schema' END AS method, has_person, cta_position, dominant_color, text_density, headline FROM rlog
  UNION ALL SELECT event_id, run_id, 'gaps', model, creative_id, prompt_tokens, output_tokens, thoughts_tokens, finish_reason, status, created_us, 'day20', CASE WHEN event_id % 100 = 1 THEN 'v0' ELSE 'v2' END, ok, NULL, NULL, NULL, NULL, NULL, NULL
    FROM glog WHERE mode = 'text'"""
CTES["cells"] = f"""
  SELECT c.model, c.creative_id, c.field, said, spec, r.verdict AS review, CASE WHEN NOT called THEN 'no_call' WHEN coalesce(said = spec, false) THEN 'correct' ELSE 'wrong' END AS verdict,
    c.field <> 'headline' AND r.verdict IS DISTINCT FROM 'disagree' AS counted,
    CASE c.field WHEN 'has_person' THEN said IN ('true', 'false') WHEN 'cta_position' THEN said IN ('center', 'bottom_right', 'none') WHEN 'dominant_color' THEN said IN ('warm', 'cool', 'neutral') WHEN 'text_density' THEN said IN ('low', 'high') END AS in_option
  FROM (SELECT g.model, g.creative_id, p.creative_id IS NOT NULL AS called, unnest(['has_person', 'cta_position', 'dominant_color', 'text_density', 'headline']) AS field,
          unnest([p.has_person::VARCHAR, p.cta_position, p.dominant_color, p.text_density, {rp._SQ('p.headline')}]) AS said, unnest([g.has_person::VARCHAR, g.cta_position, g.dominant_color, g.text_density, {rp._SQ('g.headline')}]) AS spec
        FROM (SELECT *, unnest(['m0', 'm1', 'm9']) AS model FROM truth) g
        LEFT JOIN (SELECT * FROM bench WHERE task = 'features' AND ok QUALIFY row_number() OVER (PARTITION BY model, creative_id ORDER BY created_us DESC, event_id DESC) = 1) p ON p.model = g.model AND p.creative_id = g.creative_id) c
  LEFT JOIN review r ON r.creative_id = c.creative_id AND r.field = c.field"""
BENCH = "rlog glog bench"
CELLS = "truth review rlog glog bench cells"
_PRICE = "CASE model WHEN 'm0' THEN {0}::DOUBLE WHEN 'm1' THEN {1} WHEN 'm2' THEN {2} END"
_CST = f"(coalesce(prompt_tokens, 0) * {_PRICE.format(0.33, 0.825, 2.0)} + (coalesce(output_tokens, 0) + coalesce(thoughts_tokens, 0)) * {_PRICE.format(2.75, 4.125, 12.0)})"
_COST = f"""SELECT task, model, count(*) AS call_rows, count(*) FILTER (WHERE ok) AS ok_calls, round(avg(prompt_tokens) FILTER (WHERE ok))::BIGINT AS avg_input, round(avg(coalesce(output_tokens, 0)) FILTER (WHERE ok))::BIGINT AS avg_output,
  round(avg(coalesce(thoughts_tokens, 0)) FILTER (WHERE ok))::BIGINT AS avg_thoughts, max(coalesce(output_tokens, 0) + coalesce(thoughts_tokens, 0)) AS max_output_and_thoughts, round(avg({_CST}) FILTER (WHERE ok) / 1e6 * 32 * 1000, 1) AS twd_per_1000,
  round(sum({_CST}) / 1e6 * 32, 3) AS spent_twd FROM bench GROUP BY 1, 2"""
_TXT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
CTES["pgs"] = f"SELECT page_id::VARCHAR AS page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1) AS path, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, {_TXT} AS page_text FROM pages"

COMBOS = [("features", "m0"), ("features", "m1"), ("gaps", "m0"), ("gaps", "m1"), ("gaps", "m2")]
CTES["unsettled"] = """
  SELECT * EXCLUDE (n, stuck) REPLACE (ok AND NOT stuck AS ok, CASE WHEN stuck AND (n = 3 OR coalesce(method, '') = 'response_schema') THEN 'ERROR' WHEN stuck THEN '' ELSE status END AS status)
  FROM (SELECT *, task = 'features' AND model = 'm1' AND n IN (3, 6) AS stuck FROM (SELECT *, substr(creative_id, 2)::BIGINT % 10 AS n FROM bench))"""
_FAILED = "(SELECT * FROM unsettled WHERE source = 'day20' AND NOT ok AND status = '')"
_TODO = f"""SELECT task, model, creative_id FROM (SELECT creative_id, unnest({_L(t for t, _ in COMBOS)}) AS task, unnest({_L(m for _, m in COMBOS)}) AS model FROM truth) g
  WHERE NOT EXISTS (SELECT 1 FROM unsettled b WHERE ok AND b.task = g.task AND b.model = g.model AND b.creative_id = g.creative_id)
    AND NOT EXISTS (SELECT 1 FROM {_FAILED} b WHERE b.task = g.task AND b.model = g.model AND b.creative_id = g.creative_id GROUP BY b.task HAVING count(*) >= 2)
    AND NOT (task = 'features' AND model = 'm1' AND EXISTS (SELECT 1 FROM {_FAILED} b WHERE b.task = 'features' AND b.model = 'm1' AND b.method IS NULL AND b.creative_id = g.creative_id))
  QUALIFY row_number() OVER (PARTITION BY task, model ORDER BY creative_id) <= 20"""


def _todo(s, d):
    return k.bench_todo(a.image_truth(s, d), unsettled(s, d), COMBOS, 20, "day20", ("features", "m1"))


QUERIES = {
    "k01_page_map": mapped,
    "k02_page_summary": lambda s, d: k.page_summary(mapped(s, d), pages(s, d), shots(s, d)),
    "k03_answer_pages": lambda s, d: k.answer_pages(a.gap_answers(s, d), 10),
    "k10_ad_pages": lambda s, d: k.ad_pages(mapped(s, d), 10),
    "k03_answer_overview": lambda s, d: k.answer_overview(a.gap_answers(s, d)),
    "k04_explode_gaps": lambda s, d: k.explode_gaps(latest(s, d)),
    "k05_match_gaps": lambda s, d: k.match_gaps(k.answer_grid(a.gap_answers(s, d), values()), k.explode_gaps(latest(s, d))),
    "k06_gap_verdicts": verdicts,
    "k06_verdict_counts": lambda s, d: k.verdict_counts(verdicts(s, d)),
    "k07_recall_precision": lambda s, d: k.recall_precision(verdicts(s, d), a.gap_answers(s, d)),
    "k08_by_gap_type": lambda s, d: k.by_gap_type(verdicts(s, d)),
    "k08_misses_and_extras": lambda s, d: k.verdict_rows(verdicts(s, d), ["miss", "extra"]),
    "k08_disputed_and_other": lambda s, d: k.verdict_rows(verdicts(s, d), ["disputed", "other"]),
    "k09_agreement_matrix": lambda s, d: k.agreement_matrix(verdicts(s, d)),
    "k10_ads_per_page": lambda s, d: k.ads_per_page(mapped(s, d), pages(s, d)),
    "k11_check_consistency": _check,
    "k12_landing_pages": pages,
    "k12_gap_requests": lambda s, d: k.render_gap_request(mapped(s, d), pages(s, d)),
    "b01_reuse_replies": lambda s, d: k.reuse_replies(rp.log(s, d).drop("ok"), bench(s, d).where("run_id <= 'r20240105'"), "features", "m0", r.complete(), "day16").select("creative_id", "event_id", "task", "source", "ok"),
    "b01_source_counts": lambda s, d: k.source_counts(bench(s, d)),
    "b02_bench_todo": _todo,
    "b02_pending_counts": lambda s, d: k.pending_counts(_todo(s, d)),
    "b02_strict_todo": lambda s, d: k.strict_todo(a.image_truth(s, d), unsettled(s, d), "features", "m1", "day20", 15),
    "b03_score_cells": cells,
    "b04_score_gaps_by_model": gaps,
    "b05_batch_seconds": lambda s, d: k.batch_seconds(bench(s, d), jobs(s, d)),
    "b06_provenance": lambda s, d: k.provenance(bench(s, d)),
    "b06_cell_accuracy": lambda s, d: k.cell_accuracy(cells(s, d)),
    "b06_cell_accuracy_by_field": lambda s, d: k.cell_accuracy_by_field(cells(s, d)),
    "b06_wrong_cells": lambda s, d: k.wrong_cell_rows(cells(s, d)),
    "b06_recall_by_model": lambda s, d: k.recall_precision(gaps(s, d), a.gap_answers(s, d), "model"),
    "b06_gap_type_by_model": lambda s, d: k.by_gap_type(gaps(s, d), "model"),
    "b06_cost_per_thousand": cost,
    "b06_score_and_cost": lambda s, d: k.score_and_cost(cells(s, d), gaps(s, d), cost(s, d)),
    "b06_verdict_totals": lambda s, d: k.verdict_totals(cells(s, d), gaps(s, d)),
    "b07_check_bench": _check_bench,
    "b07_reconcile_bench": _reconcile_bench,
    "r17_ledger_bags": _ledger_bags,
    "r17_check_descriptions": _descriptions,
    "r17_check_inputs": lambda s, d: l.check_picture_inputs(a.creatives(s, d), shots(s, d), rp._sample(s, d), rp._structured(s, d), 20, 150, 4),
    "k11_check_inputs": lambda s, d: l.check_gap_inputs(pages(s, d), shots(s, d), mapped(s, d), a.gap_answers(s, d), a.gap_log(s, d).where(k.readable()), 5, 4, MODES),
}

_CK = rp._CK
CTES["descr"] = """
  SELECT l.event_id, l.model, l.resolution, l.creative_id, l.status, l.prompt_tokens, CASE WHEN l.resolution = 'default' THEN 1 + l.event_id % 2 ELSE 1 END AS run_no,
    CASE l.event_id % 6 WHEN 0 THEN '短' WHEN 1 THEN NULL ELSE '一張白色背景的圖，中間有一雙襪子，右下角有按鈕 ' || l.creative_id END AS description FROM rlog l"""
_CALLS = "SELECT run_id, model, creative_id AS item_id, prompt_tokens, output_tokens + coalesce(thoughts_tokens, 0) AS output_tokens, status FROM {} t".format
_flaws = lambda t: f"(SELECT * REPLACE (prompt_tokens + CASE WHEN event_id = 13 THEN 1 ELSE 0 END AS prompt_tokens) FROM (SELECT * FROM {t} x WHERE event_id <> 7 UNION ALL SELECT * FROM {t} x WHERE event_id = 11))"
_bag = lambda name, log, ledger: f"""SELECT '{name}' AS check_name, count(*) AS differing, CASE WHEN count(*) = 0 THEN 'OK' ELSE 'DIFF' END AS ok,
  min(run_id || '|' || model || '|' || item_id || '|' || coalesce(prompt_tokens::VARCHAR, '~') || '|' || output_tokens || '|' || status || ' ' || l || '/' || r) AS evidence FROM (
    SELECT run_id, model, item_id, prompt_tokens, output_tokens, status, sum(l) AS l, sum(r) AS r FROM (SELECT *, 1 AS l, 0 AS r FROM ({_CALLS(log)}) UNION ALL SELECT *, 0, 1 FROM ({_CALLS(ledger)})) GROUP BY ALL HAVING sum(l) <> sum(r))"""  # noqa: E731
_pages = lambda t, keys, size: f"""SELECT {keys}, creative_id, n::INT AS position, ((n - 1) // {size} + 1)::INT AS page FROM (
  SELECT {keys}, creative_id, row_number() OVER (PARTITION BY {keys} ORDER BY ('0x' || substr(md5(creative_id), 1, 15))::BIGINT, creative_id) AS n FROM {t} WHERE creative_id IS NOT NULL)"""  # noqa: E731
_NEW = "(SELECT * FROM bench WHERE source = 'day20')"
ORACLE = {
    "k01_page_map": sql("truth mapped", "SELECT * FROM mapped"),
    "k02_page_summary": sql("truth mapped pgs", """SELECT p.page_id, title, creatives, length(page_text) AS text_chars, screenshots, screenshot_bytes FROM pgs p
      LEFT JOIN (SELECT page_id, count(*) AS creatives FROM mapped GROUP BY 1) a ON a.page_id = p.page_id
      LEFT JOIN (SELECT (page_id % 5)::VARCHAR AS page_id, count(*) AS screenshots, sum(length(html)) AS screenshot_bytes FROM pages WHERE page_id % 4 < 3 GROUP BY 1) s ON s.page_id = p.page_id"""),
    "k03_answer_pages": sql("answers", _pages("answers", "gap_type, ad_keyword", 10)),
    "k10_ad_pages": sql("truth mapped pgs", _pages("mapped", "page_id", 10)),
    "k03_answer_overview": sql("answers", "SELECT gap_type, ad_keyword, count(*) FILTER (WHERE NOT disputed) AS scored, count(*) FILTER (WHERE disputed) AS disputed, string_agg(creative_id, '、' ORDER BY creative_id) AS creatives FROM answers GROUP BY 1, 2"),
    "k04_explode_gaps": gsql("SELECT * FROM fnd"),
    "k05_match_gaps": gsql("SELECT * FROM mat"),
    "k06_gap_verdicts": gsql("SELECT * FROM verd"),
    "k06_verdict_counts": gsql("SELECT mode, verdict, count(*) AS n FROM verd GROUP BY 1, 2"),
    "k07_recall_precision": gsql(_rp("mode")),
    "k08_by_gap_type": gsql(_bt("mode")),
    "k08_misses_and_extras": gsql(_rows("mode", "'miss', 'extra'")),
    "k08_disputed_and_other": gsql(_rows("mode", "'disputed', 'other'")),
    "k09_agreement_matrix": gsql("""SELECT gap_type, count(*) FILTER (WHERE a = 'hit' AND b = 'hit') AS both_hit, count(*) FILTER (WHERE a = 'hit' AND b = 'miss') AS first_only, count(*) FILTER (WHERE a = 'miss' AND b = 'hit') AS second_only,
      count(*) FILTER (WHERE a = 'miss' AND b = 'miss') AS both_miss FROM (SELECT i.gap_type, i.verdict AS a, t.verdict AS b FROM verd i JOIN verd t ON t.mode = 'text' AND t.creative_id = i.creative_id AND t.gap_type = i.gap_type AND t.ad_keyword = i.ad_keyword
      WHERE i.mode = 'image' AND i.verdict IN ('hit', 'miss')) GROUP BY ROLLUP (gap_type)"""),
    "k10_ads_per_page": sql("truth mapped pgs", "SELECT p.page_id, title, count(*) AS creatives, string_agg(creative_id, '、' ORDER BY creative_id) AS creative_ids FROM mapped m JOIN pgs p ON p.page_id = m.page_id GROUP BY 1, 2"),
    "k11_check_consistency": gsql(_CK([
        ("01 successful combinations", "SELECT 2 * count(*) FROM mapped", "SELECT count(*) FROM lat"), ("02 token counts recorded", "0", "0"),
        ("03 ledger rows = log rows", "SELECT count(*) FROM glog", "SELECT count(*) FROM glog WHERE run_id > 'r20240103'"),
        ("04 cut by output cap and never fixed", "0", "SELECT count(*) FROM (SELECT DISTINCT creative_id, mode FROM glog g WHERE finish_reason = 'MAX_TOKENS' AND NOT EXISTS (SELECT 1 FROM lat l WHERE l.mode = g.mode AND l.creative_id = g.creative_id))"),
        ("05 kinds outside options", "0", "0"), ("06 scored answers judged", "SELECT 2 * count(*) FILTER (WHERE NOT disputed) FROM answers", "SELECT count(*) FROM verd WHERE verdict IN ('hit', 'miss')"),
        ("07 answer table unchanged since scoring", "1", "1")])),
    "k12_landing_pages": sql("pgs", "SELECT * FROM pgs"),
    "k12_gap_requests": sql("truth mapped pgs", f"""SELECT creative_id, page_id, mode, i || CASE WHEN mode = 'text' THEN chr(10) || page_text ELSE '' END AS request
      FROM (SELECT m.*, page_text, printf('{k.INTRO}', channel, title) AS i, unnest(['image', 'text']) AS mode FROM mapped m JOIN pgs p ON p.page_id = m.page_id)"""),
    "b01_reuse_replies": sql(BENCH, f"""SELECT creative_id, event_id, 'features' AS task, 'day16' AS source, true AS ok FROM (SELECT * FROM rlog WHERE model = 'm0' AND {rp._COMPLETE}
      QUALIFY row_number() OVER (PARTITION BY creative_id ORDER BY created_us DESC, event_id DESC) = 1) WHERE creative_id NOT IN (SELECT creative_id FROM bench WHERE run_id <= 'r20240105' AND task = 'features' AND model = 'm0' AND ok)"""),
    "b01_source_counts": sql(BENCH, "SELECT task, model, source, count(*) AS call_rows, count(*) FILTER (WHERE ok) AS ok_rows FROM bench GROUP BY 1, 2, 3"),
    "b02_bench_todo": sql("truth " + BENCH + " unsettled", _TODO),
    "b02_pending_counts": sql("truth " + BENCH + " unsettled", f"SELECT task, model, count(*) AS pending FROM ({_TODO}) GROUP BY 1, 2"),
    "b02_strict_todo": sql("truth " + BENCH + " unsettled", f"""SELECT DISTINCT creative_id FROM {_FAILED} l WHERE task = 'features' AND model = 'm1' AND method IS NULL AND NOT EXISTS (SELECT 1 FROM unsettled b WHERE b.task = 'features' AND b.model = 'm1'
      AND b.creative_id = l.creative_id AND (b.ok OR (b.method = 'response_schema' AND b.status = ''))) ORDER BY creative_id LIMIT 15"""),
    "b03_score_cells": sql(CELLS, "SELECT * FROM cells"),
    "b04_score_gaps_by_model": gsql("SELECT * FROM verd", "model"),
    "b05_batch_seconds": sql(BENCH, """
      SELECT b.task, b.model, b.source, b.created_us, b.calls, count(j.event_id) AS jobs_matched, round(max(j.e - j.s) / 1000000, 1) AS seconds FROM (
        SELECT task, model, source, created_us, count(*) AS calls FROM bench GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY task, model ORDER BY count(*) DESC, created_us DESC) = 1) b
      LEFT JOIN (SELECT event_id, epoch_us(ts) - 600000000 AS s, epoch_us(ts) + 1200000000 AS e FROM events WHERE event_type = 'signup') j ON b.created_us BETWEEN j.s AND j.e GROUP BY 1, 2, 3, 4, 5"""),
    "b06_provenance": sql(BENCH, "SELECT task, model, source, coalesce(method, 'main') AS method, count(*) AS call_rows, count(*) FILTER (WHERE ok) AS ok_rows, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE finish_reason = 'MAX_TOKENS') AS cut_by_cap, min(created_us) AS first_us, max(created_us) AS last_us FROM bench GROUP BY 1, 2, 3, 4"),
    "b06_cell_accuracy": sql(CELLS, """SELECT model, count(*) FILTER (WHERE counted) AS cells, count(*) FILTER (WHERE counted AND verdict = 'correct') AS correct, round(count(*) FILTER (WHERE counted AND verdict = 'correct') / nullif(count(*) FILTER (WHERE counted), 0), 3) AS accuracy,
      count(*) FILTER (WHERE field = 'headline') AS headlines, count(*) FILTER (WHERE field = 'headline' AND verdict = 'correct') AS headline_correct, count(*) FILTER (WHERE field <> 'headline' AND NOT coalesce(in_option, false)) AS off_option,
      count(*) FILTER (WHERE review = 'borderline') AS borderline_cells, count(*) FILTER (WHERE review = 'borderline' AND verdict = 'correct') AS borderline_correct, count(*) FILTER (WHERE verdict = 'no_call') AS no_call FROM cells GROUP BY 1"""),
    "b06_cell_accuracy_by_field": sql(CELLS, "SELECT field, model, count(*) FILTER (WHERE counted OR field = 'headline') AS cells, count(*) FILTER (WHERE (counted OR field = 'headline') AND verdict = 'correct') AS correct FROM cells GROUP BY 1, 2"),
    "b06_wrong_cells": sql(CELLS, "SELECT model, creative_id, field, said, spec, review, counted FROM cells WHERE verdict = 'wrong'"),
    "b06_recall_by_model": gsql(_rp("model"), "model"),
    "b06_gap_type_by_model": gsql(_bt("model"), "model"),
    "b06_cost_per_thousand": sql(BENCH, _COST),
    "b06_score_and_cost": gsql(f"""SELECT s.task, s.model, score, rate, twd_per_1000 FROM (
        SELECT 'features' AS task, model, count(*) FILTER (WHERE counted AND verdict = 'correct') || '/' || count(*) FILTER (WHERE counted) AS score, round(count(*) FILTER (WHERE counted AND verdict = 'correct') / nullif(count(*) FILTER (WHERE counted), 0), 3) AS rate FROM cells GROUP BY 2
        UNION ALL SELECT 'gaps', model, count(*) FILTER (WHERE verdict = 'hit') || '/' || count(*) FILTER (WHERE verdict IN ('hit', 'miss')), round(count(*) FILTER (WHERE verdict = 'hit') / nullif(count(*) FILTER (WHERE verdict IN ('hit', 'miss')), 0), 3) FROM verd GROUP BY 2) s
      LEFT JOIN ({_COST}) c ON c.task = s.task AND c.model = s.model""", "model", "review rlog bench cells"),
    "b06_verdict_totals": gsql("SELECT 'features' AS task, model, verdict, count(*) AS n FROM cells GROUP BY 2, 3 UNION ALL SELECT 'gaps', model, verdict, count(*) FROM verd GROUP BY 2, 3", "model", "review rlog bench cells"),
    "b07_check_bench": gsql(_CK([
        ("01 cells = models x images x fields", "SELECT 15 * count(*) FROM truth", "SELECT count(*) FROM cells"), ("02 cells without a call", "0", "SELECT count(*) FROM cells WHERE verdict = 'no_call'"),
        ("03 gap rows = models x answers", "SELECT 4 * count(*) FROM answers", "SELECT count(*) FROM verd WHERE ad_keyword IS NOT NULL"),
        ("04 more than one call per image in a run", "0", "SELECT count(*) FROM (SELECT 1 FROM bench GROUP BY run_id, task, model, creative_id HAVING count(*) > 1)"),
        ("05 more than one success per image", "0", "SELECT count(*) FROM (SELECT 1 FROM bench WHERE ok GROUP BY task, model, creative_id HAVING count(*) > 1)"),
        ("06 verdicts that differ from the earlier mart", "0", "SELECT count(*) FROM verd v JOIN early e ON e.creative_id = v.creative_id AND e.gap_type = v.gap_type AND e.ad_keyword = v.ad_keyword WHERE v.model = 'm1' AND v.verdict <> e.verdict"),
        ("07 prompt version differs", "0", "SELECT count(*) FROM bench WHERE prompt_version = 'v0'"), ("08 successes without token counts", "0", "SELECT count(*) FROM bench WHERE ok AND prompt_tokens IS NULL"),
        ("09 successes with an error status", "0", "0")]), "model", "review rlog bench cells",
        early="SELECT creative_id, gap_type, ad_keyword, verdict FROM (" + gsql("SELECT * FROM verd WHERE mode = 'text' AND ad_keyword IS NOT NULL") + ")"),
    "r17_ledger_bags": sql("rlog dlog", f"""SELECT * FROM (
      {_bag('features, sound', 'rlog', 'rlog')} UNION ALL {_bag('features, flawed', 'rlog', _flaws('rlog'))} UNION ALL {_bag('drafts, sound', 'dlog', 'dlog')}
      UNION ALL {_bag('drafts, flawed', 'dlog', _flaws('dlog'))} UNION ALL {_bag('drafts under another job', 'dlog', '(SELECT * FROM dlog WHERE false)')})"""),
    "r17_check_descriptions": sql("rlog sent descr", _CK([
        ("01 pictures listed", "20", "SELECT count(*) FROM pages"), ("02 all of them jpg", "SELECT count(*) FROM pages", "SELECT count(*) FROM pages"),
        ("03 pictures of the trial are different", "SELECT count(*) FROM pages WHERE page_id % 4 = 0", "SELECT count(DISTINCT page_id % 5) FROM pages WHERE page_id % 4 = 0"),
        ("04 calls", "900", "SELECT count(*) FROM descr"), ("05 rounds", "6", "SELECT count(DISTINCT (model, resolution, run_no)) FROM descr"),
        ("06 rounds without all pictures", "0", "SELECT count(*) FROM (SELECT 1 FROM descr GROUP BY model, resolution, run_no HAVING count(DISTINCT creative_id) <> 150)"),
        ("07 errors", "0", "SELECT count(*) FROM descr WHERE status <> ''"), ("08 empty or short descriptions", "0", "SELECT count(*) FROM descr WHERE description IS NULL OR length(description) < 20"),
        ("09 calls without token counts", "0", "SELECT count(*) FROM descr WHERE prompt_tokens IS NULL"),
        ("10 low resolution is cheaper", "SELECT count(*) FROM dpair", "SELECT count(*) FROM dpair WHERE lo < hi")]),
        dpair="SELECT max(prompt_tokens) FILTER (WHERE resolution = 'low') AS lo, min(prompt_tokens) FILTER (WHERE resolution = 'default' AND run_no = 1) AS hi FROM descr GROUP BY creative_id, model HAVING lo IS NOT NULL AND hi IS NOT NULL"),
    "b07_reconcile_bench": sql("truth review rlog glog bench cells best answers", f"""
      SELECT check_name, differing, CASE WHEN differing = 0 THEN 'OK' ELSE 'DIFF' END AS ok, evidence FROM (
        SELECT '04 reused rows stand in the earlier log' AS check_name, count(*) AS differing, min(model || '|' || creative_id || '|' || created_us || '|' || coalesce(prompt_tokens::VARCHAR, '~') || '|' || (output_tokens + 1) || ' 1/0') AS evidence FROM rlog WHERE event_id = 40
        UNION ALL SELECT check_name, differing, evidence FROM ({_bag('07 new calls and ledger rows', _NEW, _flaws(_NEW))})
        UNION ALL SELECT '08 cut by output cap and never fixed', count(*), min(task || '|' || model || '|' || creative_id) FROM (SELECT DISTINCT task, model, creative_id FROM bench b WHERE finish_reason = 'MAX_TOKENS'
          AND NOT EXISTS (SELECT 1 FROM bench o WHERE o.ok AND o.task = b.task AND o.model = b.model AND o.creative_id = b.creative_id))
        UNION ALL SELECT '09 kinds of gap outside the options', least(count(*), 1), max('gift|' || n) FROM (SELECT count(*) AS n FROM gapkinds WHERE kind = 'gift' HAVING n > 0)
        UNION ALL SELECT '14 answers as they were when scored', 2 * count(*), min('c5|' || gap_type || '|' || ad_keyword || '|fact0|' || disputed || ' 1/0') FROM answers WHERE creative_id = 'c5' AND page_fact = 'fact0'
        UNION ALL SELECT '15 no repeat call after success', count(*), min(task || '|' || model || '|' || creative_id || '|' || run_id || '|' || created_us) FROM bench b WHERE source = 'day20'
          AND EXISTS (SELECT 1 FROM bench o WHERE o.ok AND o.task = b.task AND o.model = b.model AND o.creative_id = b.creative_id AND o.run_id <> b.run_id AND o.created_us < b.created_us)
        UNION ALL SELECT '17 cells of the reused model as in the earlier table', count(*), min(creative_id || '|' || field || '|' || coalesce(said, '~') || ' 1/' || 0) FROM (
          SELECT c.creative_id, c.field, c.said FROM cells c JOIN best f USING (creative_id) WHERE c.model = 'm0' AND f.model = 'm0' AND c.field <> 'headline' AND c.said IS DISTINCT FROM
            CASE c.field WHEN 'has_person' THEN f.has_person::VARCHAR WHEN 'cta_position' THEN f.cta_position WHEN 'dominant_color' THEN f.dominant_color ELSE f.text_density END))""",
        gapkinds="SELECT unnest(list_transform(gl, lambda y: y.t)) AS kind FROM glog WHERE mode = 'text' AND status = '' AND k % 43 <> 0"),
    "r17_check_inputs": sql("creatives rlog truth", _CK([
        ("01 design columns left", "0", "4"), ("02 pictures listed", "20", "SELECT count(*) FROM pages"), ("03 pictures listed once", "SELECT count(*) FROM pages", "SELECT count(DISTINCT (page_id % 5, page_id % 4)) FROM pages"),
        ("04 sampled pictures", "150", "SELECT count(DISTINCT creative_id) FROM smp"), ("05 sampled pictures in the log", "0", "SELECT count(*) FROM smp WHERE creative_id NOT IN (SELECT creative_id FROM rlog)"),
        ("06 pictures without all rounds", "0", "SELECT count(*) FROM (SELECT creative_id FROM rlog GROUP BY 1 HAVING count(DISTINCT event_id % 4) <> 4)")]),
        smp="SELECT creative_id FROM (" + rp.ORACLE["r14_pick_sample"] + ")"),
    "k11_check_inputs": sql("truth mapped pgs answers glog", _CK([
        ("01 landing pages with a text", "5", "SELECT count(*) FROM pgs WHERE length(page_text) > 0"), ("02 screenshots", "20", "SELECT count(DISTINCT (page_id % 5, page_id % 4)) FROM pages"),
        ("03 images mapped to a page", "SELECT count(*) FROM mapped", "SELECT count(*) FROM mapped WHERE page_id IN (SELECT page_id FROM pgs)"), ("04 answers scored/disputed", "SELECT count(*) FROM answers", "SELECT count(*) FROM answers"),
        ("06 successes per mode", "SELECT count(*) || '/' || count(*) FROM mapped", "SELECT count(DISTINCT creative_id) FILTER (WHERE mode = 'image') || '/' || count(DISTINCT creative_id) FILTER (WHERE mode = 'text') FROM glog WHERE ok")])),
}
