from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalogue as cat, replies as r
from ..sources import adapters as a
from . import lift as lp
from .oracle import CTES, K, sql

PRICES = {"m0": (0.33, 2.75), "m1": (0.825, 4.125)}
JOB = "features"
LEX = {"base": tx.CLAIM_TERMS, "base+extra": tx.CLAIM_TERMS + tx.EXTRA_CLAIM_TERMS}
VERSIONS = {"free": "發揮創意", "rules": "只寫事實"}
# Fixed values of the query: lines per feature
NAMES = {"person": "person 畫面有真人", "cta": "cta 按鈕放在右下角", "warm": "warm 主色是暖色", "text": "text 標題之外還有賣點或標籤"}


def log(s, d):
    return r.parse_reply(a.raw_replies(s, d))


def ledger(s, d):
    """Usage rows of all runs but those of the first third of the month, which are still to be copied."""
    x = log(s, d).where(F.col("run_id") > "r20240110")
    return r.append_usage(x, r.reply_log(s, "usage"), JOB, "Day 16", resolution=F.col("resolution"))


CALL = ["event_id", "run_id", "creative_id", "status", "finish_reason", "prompt_tokens", "output_tokens", "thoughts_tokens", "cached_tokens"]


def _gap_replies(s, d):
    return r.parse_reply(a.gap_replies(s, d), "gaps")


def picked(s, d):
    x = log(s, d)
    low = r.latest_success(x.where("resolution = 'low'"), r.complete(), ["creative_id"])
    cols = ["creative_id", *r.FIELDS]
    return r.best_reply(x).select(F.lit("default").alias("resolution"), *cols).unionByName(low.select(F.lit("low").alias("resolution"), *cols))


def truth(s, d):
    return a.image_truth(s, d)


def _todo(s, d):
    items = a.image_truth(s, d).select("creative_id")
    early = log(s, d).where("run_id <= 'r20240105'")
    return r.work_todo(items, {"resolution": ["default", "low"]}, early, r.complete(), ["creative_id", "resolution"])


def _versioned_facts(s, d):
    """``part`` as a product list that has been revised: the size is the revision."""
    return cat.product_facts(a.table(s, d, "part"), "p_brand", ["p_name", "p_type"], F.col("p_size").cast("int"))


def _log_columns(s, d):
    """R-28: every log schema takes the rows that its parser makes; columns that a parser does not make stay empty."""
    made = {"features": r.parse_reply(a.raw_replies(s, d)), "structured": r.parse_reply(a.structured_replies(s, d), "structured"), "describe": r.parse_reply(a.describe_replies(s, d), "describe"),
            "drafts": r.parse_reply(a.draft_replies(s, d), "drafts"), "gaps": r.parse_reply(a.gap_replies(s, d), "gaps")}
    out = []
    for name, df in made.items():
        whole = r.into_log(df.withColumn("created_at", F.timestamp_micros("created_us")), name)
        out.append(whole.agg(F.lit(name).alias("log"), F.lit(len(whole.columns)).alias("columns"), F.count("*").alias("rows"), F.count("creative_id").alias("with_image"), F.count("created_at").alias("with_time")))
    return r.union_all(out)


def _stubborn(s, d):
    """The whole log of images some of which the model describes in words of its own: with strict calls that failed (3), that helped (4), or until the
    last days (5)."""
    n = F.substring("creative_id", 2, 20).cast("bigint") % 10
    strict = F.col("method") == "response_schema"
    off = ~strict & (n.isin(3, 4) | ((n == 5) & (F.col("run_id") < "r20240128")))
    return log(s, d).withColumns({"cta_position": F.when(off, "left").otherwise(F.col("cta_position")), "status": F.when(strict & n.isin(3, 5), "ERROR").otherwise(F.col("status"))})


def _structured(s, d):
    return log(s, d).withColumn("round", F.concat(F.lit("B"), (F.col("event_id") % 4).cast("string")))


def _one_per_round(s, d, name):
    return r.latest_success(_structured(s, d).where(F.col("round") == name), F.col("status") == "", ["creative_id"])


def _files(s, d):
    """Paths and sizes as the file listing gives them, built from ``pages``."""
    p = a.table(s, d, "pages")
    return p.select(F.concat(F.lit("file:/img/c"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("uri"), F.length("html").cast("bigint").alias("size"))


def _sample(s, d):
    t = truth(s, d)
    picks = t.select("creative_id", F.substring("creative_id", 2, 20).cast("int").alias("pick_no"))
    return r.pick_sample(picks, t, _files(s, d))


def _describe(s, d):
    docs = a.table(s, d, "documents")
    i = F.col("doc_id")
    text = F.concat(F.when(i % 2 == 0, "一位").otherwise(""), "text", F.when(i % 3 == 0, "「標語」橘色").otherwise(""))
    return docs.select(F.col("doc_id"), F.concat(F.lit("m"), (i % 2).cast("string")).alias("model"), F.when(i % 3 == 0, "low").otherwise("default").alias("resolution"), text.alias("description"),
                       (100 + i % 50).alias("prompt_tokens"), (i % 40).alias("output_tokens"))


def _demo(s, d):
    picks = a.creatives(s, d).select("creative_id", F.substring("creative_id", 3, 3).cast("int").alias("pick_no"))
    return r.demo_metrics(picks, a.ad_daily(s, d))


def _features24(s, d):
    """One good reply per creative of the lift mart."""
    x = a.creatives(s, d)
    return x.select("creative_id", "has_person", F.regexp_replace("cta_position", "-", "_").alias("cta_position"), "dominant_color", "text_density", F.concat(F.lit("H"), "creative_id").alias("headline"))


def _targets(s, d):
    return r.lowest_ctr_targets(lp.perf(s, d), _features24(s, d), a.creatives(s, d))


def _facts(s, d):
    p = a.table(s, d, "part")
    return p.groupBy(F.col("p_brand").alias("item_id")).agg(F.min("p_name").alias("facts"))


def _prompts(s, d):
    text = r.lift_table_text(lp.lift(s, d), NAMES).select("lift_text").scalar()
    return r.render_draft_prompt(_targets(s, d), _facts(s, d), text, VERSIONS)


def drafts(s, d):
    return r.draft_mart(a.draft_log(s, d), r.best_reply(log(s, d)), lp.lift(s, d))


def _draft_ledger(s, d):
    x = a.draft_log(s, d).where("run_id > 'r20240103'")
    return r.append_usage(x, r.reply_log(s, "usage"), "drafts", "Day 18", "global")


def _versioned(s, d):
    docs = a.table(s, d, "documents")
    return docs.select("doc_id", r.prompt_version(F.col("text")).alias("prompt_version"))


def _guarded(s, d):
    return r.require_prompt_version(a.table(s, d, "documents").select("doc_id", "lang"), "固定的題目", __import__("hashlib").md5("固定的題目".encode()).hexdigest())


def _split(s, d):
    answer, dim = r.split_answer_columns(truth(s, d), {f"i{n}": f"標題{n}" for n in range(15)})
    return r.answer_columns_left(answer, dim)


_L = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
CTES["rlog"] = f"""
  SELECT event_id, run_id, resolution, method, model, creative_id, created_us, status, CASE WHEN ok0 THEN hp END AS has_person, CASE WHEN ok0 THEN cta END AS cta_position,
    CASE WHEN ok0 THEN color END AS dominant_color, CASE WHEN ok0 THEN density END AS text_density, CASE WHEN ok0 THEN head END AS headline,
    CASE WHEN k % 37 <> 0 THEN 1000 + k END AS prompt_tokens, 20 + k % 30 AS output_tokens, CASE WHEN k % 3 = 0 THEN k END AS thoughts_tokens, CASE WHEN k % 4 = 0 THEN 500 ELSE 0 END AS cached_tokens,
    CASE WHEN k % 41 = 0 THEN 'MAX_TOKENS' ELSE 'STOP' END AS finish_reason
  FROM (SELECT *, k % 43 <> 0 AS ok0, CASE WHEN k % 19 <> 0 THEN k % 2 = 0 END AS hp, ({_L(a.REPLY_CTA)})[(event_id // 3) % 9 % 4 + 1] AS cta, CASE WHEN k % 5 < 4 THEN ({_L(a.REPLY_COLOR)})[k % 5 + 1] END AS color,
          ({_L(a.REPLY_DENSITY)})[(k // 2) % 2 + 1] AS density, CASE WHEN k % 23 = 0 THEN '' ELSE 'H ' || (user_id % 5) END AS head, 'r' || strftime(ts, '%Y%m%d') AS run_id,
          CASE WHEN event_id % 3 = 0 THEN 'low' ELSE 'default' END AS resolution, CASE WHEN event_id % 5 = 0 THEN 'response_schema' ELSE 'output_schema' END AS method, 'm' || (k % 2) AS model,
          'c' || user_id AS creative_id, epoch_us(ts) AS created_us, CASE WHEN k % 31 = 0 THEN 'ERROR' ELSE '' END AS status FROM (SELECT *, {K} AS k FROM events))"""
CTES["sent"] = f"""
  SELECT event_id, run_id, l.creative_id, status, finish_reason, prompt_tokens, output_tokens, thoughts_tokens, cached_tokens, user_id AS u, k,
    CASE event_id % 8 WHEN 5 THEN 'recovered' WHEN 6 THEN 'recovered' WHEN 7 THEN 'malformed' ELSE 'whole' END AS reply_state, event_id % 8 < 5 AS whole, event_id % 8 < 7 AS held, status = '' AND finish_reason <> 'MAX_TOKENS' AS sound
  FROM rlog l JOIN (SELECT event_id, user_id, {K} AS k FROM events) e USING (event_id)"""
CTES["sent_gaps"] = f"""
  SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY j) - 1 AS pos, ({_L(a.GAP_KINDS)})[(u + j) % 7 + 1] AS gap_type, '}} "' || ({_L(a.GAP_WORDS)})[(u + j) % 5 + 1] || '" ] \\ ,' AS ad_text, 'e' || k AS page_evidence
  FROM sent, (SELECT unnest([0, 1, 2]) AS j) WHERE held AND CASE j WHEN 0 THEN k % 3 > 0 WHEN 1 THEN k % 2 = 0 ELSE k % 5 = 0 END"""
_CALL = "event_id, run_id, creative_id, status, finish_reason, prompt_tokens, output_tokens, thoughts_tokens, cached_tokens"
_COMPLETE = "(status = '' AND has_person IS NOT NULL AND cta_position IS NOT NULL AND dominant_color IS NOT NULL AND text_density IS NOT NULL AND coalesce(headline, '') <> '')"
_INOPT = "coalesce(cta_position IN ('center', 'bottom_right', 'none') AND dominant_color IN ('warm', 'cool', 'neutral') AND text_density IN ('low', 'high'), false)"
CTES["stubborn"] = """
  SELECT * EXCLUDE (n) REPLACE (CASE WHEN method <> 'response_schema' AND (n IN (3, 4) OR n = 5 AND run_id < 'r20240128') THEN 'left' ELSE cta_position END AS cta_position,
    CASE WHEN method = 'response_schema' AND n IN (3, 5) THEN 'ERROR' ELSE status END AS status) FROM (SELECT *, substr(creative_id, 2)::BIGINT % 10 AS n FROM rlog)"""
CTES["best"] = f"""
  SELECT creative_id, has_person, cta_position, dominant_color, text_density, headline, in_option, model, method, resolution, created_us FROM (SELECT *, {_INOPT} AS in_option FROM rlog)
  WHERE resolution = 'default' AND {_COMPLETE} QUALIFY row_number() OVER (PARTITION BY creative_id ORDER BY in_option DESC, created_us DESC, event_id DESC) = 1"""
CTES["picked"] = f"""
  SELECT 'default' AS resolution, creative_id, has_person, cta_position, dominant_color, text_density, headline FROM best
  UNION ALL SELECT 'low', creative_id, has_person, cta_position, dominant_color, text_density, headline FROM (SELECT * FROM rlog WHERE resolution = 'low' AND {_COMPLETE}
    QUALIFY row_number() OVER (PARTITION BY creative_id ORDER BY created_us DESC, event_id DESC) = 1)"""
CTES["truth"] = f"""
  SELECT 'c' || user_id AS creative_id, user_id % 2 = 0 AS has_person, ({_L(a.REPLY_CTA[:3])})[user_id % 3 + 1] AS cta_position, ({_L(a.REPLY_COLOR[:3])})[user_id % 3 + 1] AS dominant_color,
    ({_L(a.REPLY_DENSITY)})[user_id % 2 + 1] AS text_density, 'H' || (user_id % 5) AS headline, 'i' || (user_id % 20) AS product_focus, user_id FROM (SELECT DISTINCT user_id FROM events)"""
CTES["review"] = "SELECT creative_id, 'dominant_color' AS field, CASE WHEN user_id % 7 = 0 THEN 'disagree' ELSE 'borderline' END AS verdict, 'eye' AS eye_value FROM truth WHERE user_id % 7 < 2"
CTES["dlog"] = f"""
  SELECT event_id, 'r' || strftime(ts, '%Y%m%d') AS run_id, (['free', 'rules'])[k % 2 + 1] AS version, 1 + event_id % 2 AS sample, 'c' || user_id AS creative_id, 'm0' AS model, ({_L(a.DRAFT_WORDS)})[k % 10 + 1] || '標題' AS headline,
    CASE WHEN k % 3 = 0 THEN ({_L(a.DRAFT_WORDS)})[(k + 3) % 10 + 1] END AS subhead, CAST(NULL AS VARCHAR) AS badge, CASE WHEN k % 29 <> 0 THEN '立即選購' END AS cta_text,
    ({_L(a.REPLY_CTA)})[(event_id // 3) % 9 % 4 + 1] AS cta_position, k % 2 = 0 AS has_person, ({_L(a.REPLY_COLOR)})[k % 5 % 4 + 1] AS dominant_color, ({_L(a.REPLY_DENSITY)})[(k // 2) % 2 + 1] AS text_density,
    (['person', 'cta', 'warm', 'text', 'other'])[k % 5 + 1] AS cited_feature, (90 + k % 20)::DOUBLE / 100 AS cited_ratio, '點擊率約 1.0' || (k % 10) || CASE WHEN k % 4 = 0 THEN '，銷量會增加' ELSE '' END AS expected_effect,
    (1000 + k)::BIGINT AS prompt_tokens, (20 + k % 30)::BIGINT AS output_tokens, CASE WHEN k % 3 = 0 THEN k::BIGINT END AS thoughts_tokens, CASE WHEN k % 41 = 0 THEN 'MAX_TOKENS' ELSE 'STOP' END AS finish_reason,
    CASE WHEN k % 31 = 0 THEN 'ERROR' ELSE '' END AS status, epoch_us(ts) AS created_us, CASE WHEN event_id % 5 <> 0 THEN 'response_schema' END AS method
  FROM (SELECT *, {K} AS k FROM events)"""
CTES["dok"] = f"""SELECT *, coalesce(status = '' AND cta_text IS NOT NULL AND {_INOPT} AND cited_feature IN ('person', 'cta', 'warm', 'text') AND method = 'response_schema', false) AS good FROM dlog"""
_TXT = "concat_ws(' ', headline, coalesce(subhead, ''), coalesce(badge, ''), cta_text)"
_HIT = lambda terms, what: "list_distinct(flatten([" + ", ".join(f"CASE WHEN contains({_TXT}, '{t}') THEN ['{t if what == 't' else k}'] ELSE [] END" for t, k in terms) + "]))"
CTES["drafts"] = f"""
  SELECT k.* EXCLUDE (good, claim_terms, claim_kinds), f.has_person AS old_has_person, f.cta_position AS old_cta_position, f.dominant_color AS old_dominant_color, f.text_density AS old_text_density, f.headline AS old_headline,
    k.has_person AND NOT f.has_person AS added_person, k.cta_position = 'bottom_right' AND f.cta_position <> 'bottom_right' AS moved_cta, k.dominant_color = 'warm' AND f.dominant_color <> 'warm' AS turned_warm,
    true AS in_option, CASE WHEN l.ctr2 IS NULL AND l.cvr2 IS NULL THEN 'unknown_feature' WHEN l.ctr2 = l.cvr2 AND round(cited_ratio, 2) = l.ctr2 THEN 'ctr_or_cvr' WHEN round(cited_ratio, 2) = l.ctr2 THEN 'ctr'
      WHEN round(cited_ratio, 2) = l.cvr2 THEN 'cvr' ELSE 'none' END AS cited_match, l.ctr2 AS table_ctr, list_sort(claim_terms) AS claim_terms, list_sort(claim_kinds) AS claim_kinds,
    regexp_matches(coalesce(expected_effect, ''), '{r.SALES_WORDS}') AS mentions_sales
  FROM (SELECT *, {_HIT(tx.CLAIM_TERMS, 't')} AS claim_terms, {_HIT(tx.CLAIM_TERMS, 'k')} AS claim_kinds FROM dok WHERE good
        QUALIFY row_number() OVER (PARTITION BY creative_id, version, sample ORDER BY created_us DESC, event_id DESC) = 1) k
  JOIN best f ON f.creative_id = k.creative_id
  LEFT JOIN (SELECT attr, round(max(stratified) FILTER (WHERE metric = 'ctr'), 2) AS ctr2, round(max(stratified) FILTER (WHERE metric = 'cvr'), 2) AS cvr2 FROM lift GROUP BY 1) l ON l.attr = k.cited_feature"""
LIFT = lp.LIFT
DRAFTS = LIFT + " rlog best dlog dok drafts"
_SQ = lambda x: f"regexp_replace({x}, '\\s', '', 'g')"
_EQ = {"person": "p.has_person = g.has_person", "cta": "p.cta_position = g.cta_position", "color": "p.dominant_color = g.dominant_color", "density": "p.text_density = g.text_density",
       "headline": f"{_SQ('p.headline')} = {_SQ('g.headline')}"}
_FOUR = " AND ".join(_EQ[k] for k in ("person", "cta", "color", "density"))
_ACC = ", ".join(f"count(*) FILTER (WHERE {v}) AS {k}_ok" for k, v in _EQ.items())
_COST = "coalesce(prompt_tokens, 0) * CASE model WHEN 'm0' THEN 0.33::DOUBLE ELSE 0.825 END + (output_tokens + coalesce(thoughts_tokens, 0)) * CASE model WHEN 'm0' THEN 2.75::DOUBLE ELSE 4.125 END"

QUERIES = {
    "r01_work_todo": _todo,
    "r02_off_option_retry": lambda s, d: r.off_option_retry(_stubborn(s, d)),
    "r03_best_reply": lambda s, d: r.best_reply(log(s, d)),
    "r04_append_usage": lambda s, d: r.append_usage(log(s, d), ledger(s, d), JOB, "Day 16", resolution=F.col("resolution")),
    "r05_feature_distribution": lambda s, d: r.feature_distribution(r.best_reply(log(s, d))),
    "r05_color_by_person": lambda s, d: r.color_by_person(r.best_reply(log(s, d))),
    "r06_accuracy_by_field": lambda s, d: r.accuracy_by_field(picked(s, d), truth(s, d)),
    "r07_wrong_cells": lambda s, d: r.wrong_cells(picked(s, d), truth(s, d), a.image_review(s, d)),
    "r08_accuracy_excluding_disputed": lambda s, d: r.accuracy_excluding_disputed(picked(s, d), truth(s, d), a.image_review(s, d)),
    "r09_agreement_between_runs": lambda s, d: r.agreement_between_runs(_one_per_round(s, d, "B1"), _one_per_round(s, d, "B2")),
    "r09_agreement_per_item": lambda s, d: r.agreement_per_item(_one_per_round(s, d, "B1"), _one_per_round(s, d, "B2")),
    "r10_reply_cost_rollup": lambda s, d: r.reply_cost_rollup(log(s, d), ["resolution", "method"], PRICES),
    "r11_off_option_counts": lambda s, d: r.off_option_counts(_structured(s, d), ["round", "method", "model"]),
    "r12_per_item_truth_table": lambda s, d: r.per_item_truth_table(_structured(s, d), truth(s, d), ["event_id", "round", "creative_id"]),
    "r13_split_answer_columns": _split,
    "r14_pick_sample": _sample,
    "r15_keyword_tags": lambda s, d: r.keyword_tags(_describe(s, d), "description").select("doc_id", "says_person", "says_warm", "quoted_texts"),
    "r16_describe_stats": lambda s, d: r.describe_stats(_describe(s, d)),
    "r16_demo_metrics": _demo,
    "r17_check_features_log": lambda s, d: r.check_features_log(log(s, d), r.best_reply(log(s, d)), ledger(s, d), 150, JOB),
    "r17_check_structured_log": lambda s, d: r.check_structured_log(_structured(s, d), ["B0", "B1", "B2", "B3"], 150),
    "r17_repeat_after_success": lambda s, d: r.repeat_after_success(log(s, d), r.complete(), ["creative_id", "resolution", "method"]).select("event_id", "run_id"),
    "r17_check_drafts": lambda s, d: r.check_drafts(a.draft_log(s, d), drafts(s, d), _draft_ledger(s, d), "drafts", truth(s, d)),
    "r18_run_summary": lambda s, d: r.run_summary(log(s, d), ["run_id", "resolution", "method"]),
    "r19_usage_overview": lambda s, d: r.usage_overview(ledger(s, d)),
    "r20_lift_table_text": lambda s, d: r.lift_table_text(lp.lift(s, d), NAMES),
    "r21_lowest_ctr_targets": _targets,
    "r22_draft_prompts": _prompts,
    "r24_draft_mart": drafts,
    "r24_draft_summary": lambda s, d: r.draft_summary(drafts(s, d)),
    "r25_draft_list": lambda s, d: r.draft_list(drafts(s, d)),
    "r25_draft_changes": lambda s, d: r.draft_changes(drafts(s, d)),
    "r25_cited_values": lambda s, d: r.cited_values(drafts(s, d)),
    "r25_term_counts": lambda s, d: r.term_counts(drafts(s, d)),
    "r25_puffery_words": lambda s, d: r.puffery_words(drafts(s, d)),
    "r26_claim_hits_by_lexicon": lambda s, d: r.claim_hits_by_lexicon(a.draft_log(s, d).where("cta_text is not null"), LEX),
    "r23_product_facts": lambda s, d: _versioned_facts(s, d),
    "r23_facts_as_of": lambda s, d: cat.facts_as_of(_versioned_facts(s, d), 30),
    "r26_claim_hits_by_catalogue": lambda s, d: cat.hits_per_version(a.draft_log(s, d).where("cta_text is not null"), ["event_id"], "version", r.draft_text(), cat.claim_catalogue(s, LEX)),
    "r28_reply_logs": _log_columns,
    "r27_gap_replies": lambda s, d: _gap_replies(s, d).select(*CALL, F.array_join("ad_texts", "/").alias("ad_texts"), "gaps", "reply_state", "ok"),
    "r27_gap_elements": lambda s, d: _gap_replies(s, d).select("event_id", F.posexplode("found")).select("event_id", "pos", "col.*"),
    "r27_draft_replies": lambda s, d: r.parse_reply(a.draft_replies(s, d), "drafts").select(*CALL, *r.SHAPES["drafts"].members, "reply_state", "ok"),
    "r27_structured_replies": lambda s, d: r.parse_reply(a.structured_replies(s, d), "structured").select(*CALL, *r.FIELDS, F.length("raw_output").alias("raw_length"), "reply_state", "ok"),
    "r27_describe_replies": lambda s, d: r.parse_reply(a.describe_replies(s, d), "describe").select(*CALL, "description", "ok"),
    "r27_parse_reply": lambda s, d: log(s, d).drop("result", "full_response"),
    "r29_request_grid": lambda s, d: r.request_grid(truth(s, d).select("creative_id"), {"run_no": [1, 2], "model": ["m0", "m1"]}),
    "r30_prompt_version": _versioned,
    "r30_require_prompt_version": _guarded,
}

_RND = "(SELECT *, 'B' || (event_id % 4) AS round FROM rlog)"
_B = lambda n: f"(SELECT * FROM {_RND} WHERE round = '{n}' AND status = '' QUALIFY row_number() OVER (PARTITION BY creative_id ORDER BY created_us DESC, event_id DESC) = 1)"
_DESC = "(SELECT *, 'm' || (doc_id % 2) AS model, CASE WHEN doc_id % 3 = 0 THEN 'low' ELSE 'default' END AS resolution, CASE WHEN doc_id % 2 = 0 THEN '一位' ELSE '' END || text || CASE WHEN doc_id % 3 = 0 THEN '「標語」橘色' ELSE '' END AS description FROM documents)"
_REPEAT = f"""SELECT l.event_id, l.run_id FROM rlog l WHERE EXISTS (SELECT 1 FROM (SELECT * FROM rlog WHERE {_COMPLETE}) e WHERE e.creative_id = l.creative_id AND e.resolution = l.resolution AND e.method = l.method
  AND e.run_id <> l.run_id AND e.created_us < l.created_us)"""
_LEDGER = "SELECT created_us AS logged_us, 'Day 16' AS day, 'features' AS job, run_id, model, 'non-global' AS endpoint_type, resolution AS media_resolution, creative_id AS item_id, prompt_tokens, output_tokens + coalesce(thoughts_tokens, 0) AS output_tokens, status FROM rlog"
_LINE = "CASE attr WHEN 'person' THEN 'person 畫面有真人' WHEN 'cta' THEN 'cta 按鈕放在右下角' WHEN 'warm' THEN 'warm 主色是暖色' ELSE 'text 標題之外還有賣點或標籤' END"
_LIFTTEXT = f"""SELECT string_agg(printf('%s：點擊率 %.2f 倍，轉換率 %.2f 倍（95%% 信賴區間 %.2f–%.2f%s）', {_LINE}, round(ctr, 2), round(cvr, 2), round(lo, 2), round(hi, 2),
    CASE WHEN round(lo, 2) <= 1 AND round(hi, 2) >= 1 THEN '，區間包含 1，看不出差別' ELSE '' END), chr(10) ORDER BY ctr DESC) AS lift_text
  FROM (SELECT attr, max(stratified) FILTER (WHERE metric = 'ctr') AS ctr, max(stratified) FILTER (WHERE metric = 'cvr') AS cvr, max(ci95_low) AS lo, max(ci95_high) AS hi FROM lift GROUP BY 1)"""
_TGT = """SELECT p.creative_id, p.channel, ctr, has_person, replace(cta_position, '-', '_') AS cta_position, dominant_color, text_density, 'H' || p.creative_id AS old_headline, product_focus
  FROM perf p JOIN creatives c ON c.creative_id = p.creative_id WHERE p.audience = 'prospecting' ORDER BY ctr, p.creative_id LIMIT 3"""
_NORM = lambda x: f"lower(regexp_replace({x}, '\\s+', '', 'g'))"
_LEXSQL = lambda n, terms: f"SELECT '{n}' AS lexicon, version, flatten([{', '.join(f"CASE WHEN contains(t, '{tx.normalize_literal(w)}') THEN ['{w}'] ELSE [] END" for w, _ in terms)}]) AS w FROM (SELECT version, {_NORM(_TXT)} AS t FROM dlog WHERE cta_text IS NOT NULL)"
_CK = lambda rows: "SELECT n AS check_name, e AS expected, a AS actual, CASE WHEN e = a THEN 'OK' ELSE 'DIFF' END AS ok FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS n, ({e})::VARCHAR AS e, ({x})::VARCHAR AS a" for n, e, x in rows) + ")"

_FACTS = "SELECT DISTINCT p_size::INT AS version, p_brand AS item_id, unnest(['p_name', 'p_type']) AS field, unnest([p_name, p_type]) AS value FROM part"
_FACTS = f"SELECT * FROM ({_FACTS}) WHERE value IS NOT NULL"

ORACLE = {
    "r01_work_todo": sql("rlog truth", f"""SELECT creative_id, resolution FROM (SELECT creative_id, unnest(['default', 'low']) AS resolution FROM truth) g
      WHERE NOT EXISTS (SELECT 1 FROM rlog l WHERE l.creative_id = g.creative_id AND l.resolution = g.resolution AND run_id <= 'r20240105' AND {_COMPLETE})"""),
    "r02_off_option_retry": sql("rlog stubborn",
        f"""SELECT DISTINCT l.creative_id FROM m l WHERE NOT fine AND NOT EXISTS (SELECT 1 FROM m k WHERE k.creative_id = l.creative_id AND k.fine AND k.created_us > l.created_us)
        AND l.creative_id NOT IN (SELECT creative_id FROM stubborn WHERE resolution = 'default' AND method = 'response_schema' AND {_COMPLETE})""",
        m=f"SELECT *, {_INOPT} AND has_person IS NOT NULL AND coalesce(headline, '') <> '' AS fine FROM stubborn WHERE resolution = 'default' AND method = 'output_schema' AND status = ''"),
    "r03_best_reply": sql("rlog best", "SELECT * FROM best"),
    "r04_append_usage": sql("rlog", _LEDGER + " WHERE run_id <= 'r20240110'"),
    "r05_feature_distribution": sql("rlog best", """SELECT field, value, count(*) AS images FROM (SELECT unnest(['has_person', 'cta_position', 'dominant_color', 'text_density']) AS field,
      unnest([has_person::VARCHAR, cta_position, dominant_color, text_density]) AS value FROM best) GROUP BY 1, 2"""),
    "r05_color_by_person": sql("rlog best", "SELECT dominant_color, has_person, count(*) AS images FROM best GROUP BY 1, 2"),
    "r06_accuracy_by_field": sql("rlog best picked truth", f"SELECT resolution, count(*) AS images, {_ACC}, count(*) FILTER (WHERE {_FOUR}) AS all_four_ok FROM picked p JOIN truth g ON g.creative_id = p.creative_id GROUP BY 1"),
    "r07_wrong_cells": sql("rlog best picked truth review", f"""SELECT resolution, c.creative_id, c.field, said, spec, verdict, eye_value FROM (
      SELECT resolution, p.creative_id, unnest(['has_person', 'cta_position', 'dominant_color', 'text_density', 'headline']) AS field,
        unnest([p.has_person::VARCHAR, p.cta_position, p.dominant_color, p.text_density, {_SQ('p.headline')}]) AS said,
        unnest([g.has_person::VARCHAR, g.cta_position, g.dominant_color, g.text_density, {_SQ('g.headline')}]) AS spec FROM picked p JOIN truth g ON g.creative_id = p.creative_id) c
      LEFT JOIN review r ON r.creative_id = c.creative_id AND r.field = c.field WHERE said IS DISTINCT FROM spec"""),
    "r08_accuracy_excluding_disputed": sql("rlog best picked truth review", """SELECT resolution, count(*) AS all_images, count(*) FILTER (WHERE ok) AS all_ok, count(*) FILTER (WHERE v IS DISTINCT FROM 'disagree') AS clear_images,
      count(*) FILTER (WHERE v IS DISTINCT FROM 'disagree' AND ok) AS clear_ok, count(*) FILTER (WHERE v = 'borderline') AS borderline_images, count(*) FILTER (WHERE v = 'borderline' AND ok) AS borderline_ok
      FROM (SELECT resolution, p.dominant_color = g.dominant_color AS ok, r.verdict AS v FROM picked p JOIN truth g ON g.creative_id = p.creative_id LEFT JOIN review r ON r.creative_id = p.creative_id) GROUP BY 1"""),
    "r09_agreement_between_runs": sql("rlog", f"SELECT count(*) AS images, {', '.join(f'count(*) FILTER (WHERE {v}) AS {k}_same' for k, v in _EQ.items())} FROM {_B('B1')} p JOIN {_B('B2')} g ON g.creative_id = p.creative_id"),
    "r09_agreement_per_item": sql("rlog", f"SELECT p.creative_id, {', '.join(f'{v} AS {k}_same' for k, v in _EQ.items())} FROM {_B('B1')} p JOIN {_B('B2')} g ON g.creative_id = p.creative_id"),
    "r10_reply_cost_rollup": sql("rlog", f"""SELECT resolution, method, grouping(resolution, method) AS level, count(*) AS calls, min(prompt_tokens) AS min_input, max(prompt_tokens) AS max_input, min(output_tokens) AS min_output,
      max(output_tokens) AS max_output, sum(prompt_tokens) AS input_tokens, sum(output_tokens + coalesce(thoughts_tokens, 0)) AS output_tokens, round(sum({_COST}) / 1e6 * 32, 3) AS twd,
      round(avg({_COST}) / 1e6 * 32 * 1000, 1) AS twd_per_1000_calls FROM rlog GROUP BY ROLLUP (resolution, method)"""),
    "r11_off_option_counts": sql("rlog", f"""SELECT round, method, model, count(*) AS calls, count(*) FILTER (WHERE cta_position NOT IN ('center', 'bottom_right', 'none')) AS cta_off_option,
      count(*) FILTER (WHERE dominant_color NOT IN ('warm', 'cool', 'neutral')) AS color_off_option, count(*) FILTER (WHERE text_density NOT IN ('low', 'high')) AS density_off_option,
      count(*) FILTER (WHERE has_person IS NULL OR cta_position IS NULL OR dominant_color IS NULL OR text_density IS NULL OR coalesce(headline, '') = '') AS missing_field,
      min(output_tokens) AS min_out, max(output_tokens) AS max_out FROM {_RND} GROUP BY 1, 2, 3"""),
    "r12_per_item_truth_table": sql("rlog truth", f"SELECT event_id, round, p.creative_id, {', '.join(f'{v} AS {k}_ok' for k, v in _EQ.items())}, p.dominant_color AS said_color, g.dominant_color AS spec_color, p.headline AS said_headline FROM {_RND} p JOIN truth g ON g.creative_id = p.creative_id"),
    "r13_split_answer_columns": sql("truth", "SELECT count(*) AS design_rows, count(*) FILTER (WHERE user_id % 20 >= 15) AS missing_headline, 0 AS design_columns_left_in_dim FROM truth"),
    "r14_pick_sample": sql("truth", """SELECT creative_id, user_id AS pick_no, 'ch' || (user_id % 3) AS channel, 'g' || (user_id % 6) AS ad_group_id, product_focus, 'file:/img/c' || page_id || '.jpg' AS uri, length(html) AS size
      FROM truth JOIN pages ON page_id = user_id"""),
    "r15_keyword_tags": f"SELECT doc_id, regexp_matches(description, '{r.PERSON_WORDS}') AS says_person, regexp_matches(description, '{r.WARM_WORDS}') AS says_warm, len(regexp_extract_all(description, '「[^」]+」')) AS quoted_texts FROM {_DESC}",
    "r16_describe_stats": f"""SELECT model, resolution, min(100 + doc_id % 50) AS min_input, max(100 + doc_id % 50) AS max_input, round(avg(doc_id % 40)) AS avg_output, round(avg(length(description))) AS avg_chars,
      count(DISTINCT description) AS distinct_texts FROM {_DESC} GROUP BY 1, 2""",
    "r16_demo_metrics": sql("ad_daily", "SELECT substr(creative_id, 3)::INT AS pick_no, creative_id, sum(impressions) AS impressions, sum(clicks) AS clicks, round(100 * (sum(clicks) / sum(impressions)), 2) AS ctr_pct, round(sum(cost)::DOUBLE) AS cost_twd FROM ad_daily GROUP BY 1, 2"),
    "r17_check_features_log": sql("rlog best", _CK([
        ("01 default resolution done", "150", f"SELECT count(DISTINCT creative_id) FROM rlog WHERE resolution = 'default' AND {_COMPLETE}"),
        ("02 low resolution done", "150", f"SELECT count(DISTINCT creative_id) FROM rlog WHERE resolution = 'low' AND {_COMPLETE}"),
        ("03 mart one row per image", "150", "SELECT count(*) FROM best"), ("04 mart off-option", "0", "SELECT count(*) FROM best WHERE NOT in_option"),
        ("05 missing field in success rows", "0", f"SELECT count(*) FROM rlog WHERE status = '' AND NOT {_COMPLETE}"), ("06 hit output cap", "0", "0"),
        ("07 missing token usage", "0", "SELECT count(*) FROM rlog WHERE status = '' AND prompt_tokens IS NULL"),
        ("08 every call in the ledger", "SELECT count(*) FROM rlog", "SELECT count(*) FROM rlog WHERE run_id > 'r20240110'"),
        ("09 low resolution cheaper", "SELECT count(*) FROM both_res", "SELECT count(*) FROM both_res WHERE lo < hi"), ("10 no repeat call after success", "0", f"SELECT count(*) FROM ({_REPEAT})")]),
        both_res="SELECT creative_id, min(prompt_tokens) FILTER (WHERE resolution = 'low' AND status = '') AS lo, min(prompt_tokens) FILTER (WHERE resolution = 'default' AND method = 'output_schema' AND status = '') AS hi FROM rlog GROUP BY 1 HAVING lo IS NOT NULL AND hi IS NOT NULL"),
    "r17_check_structured_log": sql("rlog", _CK([
        ("1 rounds", "4", "4"), ("2 every round all images", "0", f"SELECT count(*) FROM (SELECT round FROM {_RND} GROUP BY 1 HAVING count(DISTINCT creative_id) <> 150)"),
        ("3 api_error", "0", "SELECT count(*) FROM rlog WHERE status <> ''"),
        ("4 missing field", "0", "SELECT count(*) FROM rlog WHERE has_person IS NULL OR cta_position IS NULL OR dominant_color IS NULL OR text_density IS NULL OR coalesce(headline, '') = ''"),
        ("5 off-option (enum rounds)", "0", "SELECT count(*) FROM rlog WHERE method = 'response_schema' AND NOT " + _INOPT),
        ("6 missing token usage", "0", "SELECT count(*) FROM rlog WHERE prompt_tokens IS NULL"), ("7 hit output cap", "0", "0")])),
    "r17_repeat_after_success": sql("rlog", _REPEAT),
    "r17_check_drafts": sql(DRAFTS + " truth", _CK([
        ("01 targets without a draft", "0", "SELECT count(*) FROM truth WHERE creative_id NOT IN (SELECT creative_id FROM drafts)"),
        ("02 drafts = successful combinations", "SELECT count(*) FROM (SELECT DISTINCT creative_id, version, sample FROM dok WHERE good)", "SELECT count(*) FROM drafts"),
        ("03 out of options and never fixed", "0", f"SELECT count(*) FROM dok d WHERE status = '' AND NOT coalesce({_INOPT} AND cited_feature <> 'other', false) AND NOT EXISTS (SELECT 1 FROM dok g WHERE g.good AND g.creative_id = d.creative_id AND g.version = d.version AND g.sample = d.sample)"),
        ("04 token counts recorded", "0", "0"), ("05 ledger rows = log rows", "SELECT count(*) FROM dlog", "SELECT count(*) FROM dlog WHERE run_id > 'r20240103'"),
        ("06 cut by output cap and never fixed", "0", "SELECT count(DISTINCT (creative_id, version, sample)) FROM dok d WHERE finish_reason = 'MAX_TOKENS' AND NOT EXISTS (SELECT 1 FROM dok g WHERE g.good AND g.creative_id = d.creative_id AND g.version = d.version AND g.sample = d.sample)")])),
    "r18_run_summary": sql("rlog", "SELECT run_id, resolution, method, count(*) AS calls, count(*) FILTER (WHERE status = '') AS ok, count(*) FILTER (WHERE status <> '') AS failed, sum(prompt_tokens) AS input_tokens, sum(output_tokens) AS output_tokens FROM rlog GROUP BY 1, 2, 3"),
    "r19_usage_overview": sql("rlog", f"SELECT day, job, model, endpoint_type, media_resolution, count(*) AS calls, sum(prompt_tokens) AS input_tokens, sum(output_tokens) AS output_tokens FROM ({_LEDGER} WHERE run_id > 'r20240110') GROUP BY 1, 2, 3, 4, 5"),
    "r20_lift_table_text": sql(LIFT, _LIFTTEXT),
    "r21_lowest_ctr_targets": sql(lp.PERF, _TGT),
    "r22_draft_prompts": sql(LIFT, f"""SELECT creative_id, version, sample, printf('商品資料：%s。', coalesce(facts, '')) || chr(10) || printf('這張圖投放在 %s，點擊率 %.2f%%。', channel, round(100 * ctr, 2)) || chr(10) || lift_text || chr(10)
        || CASE version WHEN 'free' THEN '發揮創意' ELSE '只寫事實' END AS prompt
      FROM (SELECT t.*, facts, unnest(['free', 'free', 'rules', 'rules']) AS version, unnest([1, 2, 1, 2]) AS sample FROM ({_TGT}) t JOIN (SELECT p_brand, min(p_name) AS facts FROM part GROUP BY 1) f ON p_brand = product_focus), ({_LIFTTEXT})"""),
    "r24_draft_mart": sql(DRAFTS, "SELECT * FROM drafts"),
    "r24_draft_summary": sql(DRAFTS, "SELECT version, count(*) AS drafts, count(*) FILTER (WHERE len(claim_terms) > 0) AS with_claims, count(*) FILTER (WHERE cited_match = 'ctr') AS cited_ctr_ok FROM drafts GROUP BY 1"),
    "r25_draft_list": sql(DRAFTS, "SELECT version, creative_id, sample, headline, subhead, length(headline) AS h_len, length(subhead) AS s_len, has_person, cta_position, dominant_color, text_density, cited_feature, cited_ratio, cited_match, array_to_string(claim_terms, '、') AS claims FROM drafts"),
    "r25_draft_changes": sql(DRAFTS, """SELECT version, count(*) AS drafts, count(*) FILTER (WHERE added_person) || '/' || count(*) FILTER (WHERE NOT old_has_person) AS added_person,
      count(*) FILTER (WHERE moved_cta) || '/' || count(*) FILTER (WHERE old_cta_position <> 'bottom_right') AS moved_cta, count(*) FILTER (WHERE turned_warm) || '/' || count(*) FILTER (WHERE old_dominant_color <> 'warm') AS turned_warm,
      count(*) FILTER (WHERE text_density = 'high') AS text_high FROM drafts GROUP BY 1"""),
    "r25_cited_values": sql(DRAFTS, "SELECT version, cited_feature, cited_match, count(*) AS drafts, string_agg(DISTINCT printf('%.2f', cited_ratio), '、' ORDER BY printf('%.2f', cited_ratio)) AS cited_values, min(table_ctr) AS table_ctr FROM drafts GROUP BY 1, 2, 3"),
    "r25_term_counts": sql(DRAFTS, f"""SELECT p.version, drafts, drafts_with_claims, terms FROM (SELECT version, count(*) AS drafts, count(*) FILTER (WHERE len(claim_terms) > 0) AS drafts_with_claims FROM drafts GROUP BY 1) p
      LEFT JOIN (SELECT version, string_agg(kind || ':' || t || '×' || n, '、' ORDER BY n DESC, t) AS terms FROM (SELECT version, t, count(*) AS n FROM (SELECT version, unnest(claim_terms) AS t FROM drafts) GROUP BY 1, 2)
        JOIN (VALUES {', '.join(f"('{t}', '{k}')" for t, k in tx.CLAIM_TERMS)}) v(term, kind) ON term = t GROUP BY 1) w ON w.version = p.version"""),
    "r25_puffery_words": sql(DRAFTS, f"""SELECT version, count(*) AS drafts, count(*) FILTER (WHERE len(f) > 0) AS drafts_with_puffery, count(*) FILTER (WHERE contains(expected_effect, printf('%.2f', table_ctr))) AS promises_ratio,
      array_to_string(list_sort(list_distinct(flatten(list(f)))), '、') AS words FROM (SELECT *, regexp_extract_all({_TXT}, '{r.PUFFERY}') AS f FROM drafts) GROUP BY 1"""),
    "r26_claim_hits_by_lexicon": sql("dlog", f"""SELECT lexicon, version, count(*) AS drafts, count(*) FILTER (WHERE len(w) > 0) AS drafts_flagged, nullif(array_to_string(list_sort(list_distinct(flatten(list(w)))), '、'), '') AS terms_found
      FROM ({' UNION ALL '.join(_LEXSQL(n, t) for n, t in LEX.items())}) GROUP BY 1, 2"""),
    "r23_product_facts": sql("", _FACTS),
    "r23_facts_as_of": sql("", f"SELECT item_id, field, max(version) AS version, min(value) FILTER (WHERE version = newest) AS value FROM (SELECT *, max(version) OVER (PARTITION BY item_id, field) AS newest FROM ({_FACTS}) WHERE version <= 30) GROUP BY 1, 2"),
    "r26_claim_hits_by_catalogue": sql("dlog", " UNION ALL ".join(f"""SELECT version, '{v}' AS lexicon, count(DISTINCT event_id) AS flagged, count(*) AS hits, count(DISTINCT term) AS terms
      FROM dlog JOIN (VALUES {', '.join(str(t) for t in terms)}) x(term, kind) ON contains(headline || ' ' || coalesce(subhead, '') || ' ' || coalesce(badge, '') || ' ' || cta_text, term) WHERE cta_text IS NOT NULL GROUP BY version""" for v, terms in LEX.items())),
    "r28_reply_logs": " UNION ALL ".join(f"SELECT '{n}' AS log, {len(r.LOG_SCHEMAS[n].split(','))}::INT AS columns, count(*) AS rows, count(*) AS with_image, count(*) AS with_time FROM events" for n in ("features", "structured", "describe", "drafts", "gaps")),
    "r27_gap_replies": sql("rlog sent sent_gaps", f"""SELECT {_CALL}, CASE WHEN held THEN ({_L(a.GAP_WORDS)})[u % 5 + 1] || '/立即選購' END AS ad_texts, CASE WHEN held THEN coalesce(n, 0) END AS gaps, reply_state, whole AND sound AS ok
      FROM sent LEFT JOIN (SELECT event_id, count(*) AS n FROM sent_gaps GROUP BY 1) USING (event_id)"""),
    "r27_gap_elements": sql("rlog sent sent_gaps", "SELECT event_id, pos::INT AS pos, gap_type, ad_text, page_evidence FROM sent_gaps"),
    "r27_draft_replies": sql("rlog sent", f"""SELECT *, coalesce(whole AND sound AND cta_text IS NOT NULL AND {_INOPT} AND cited_feature IN ('person', 'cta', 'warm', 'text'), false) AS ok FROM (
      SELECT * EXCLUDE (u, k, held, whole, sound), CASE WHEN held THEN ({_L(a.DRAFT_WORDS)})[k % 10 + 1] || ' "標題"' END AS headline, CASE WHEN held AND k % 3 = 0 THEN ({_L(a.DRAFT_WORDS)})[(k + 3) % 10 + 1] END AS subhead,
        CAST(NULL AS VARCHAR) AS badge, CASE WHEN held AND k % 29 <> 0 THEN '立即選購' END AS cta_text, CASE WHEN held THEN ({_L(a.REPLY_CTA)})[(event_id // 3) % 9 % 4 + 1] END AS cta_position, CASE WHEN held THEN k % 2 = 0 END AS has_person,
        CASE WHEN held THEN ({_L(a.REPLY_COLOR)})[k % 5 % 4 + 1] END AS dominant_color, CASE WHEN held THEN ({_L(a.REPLY_DENSITY)})[(k // 2) % 2 + 1] END AS text_density, CAST(NULL AS VARCHAR) AS composition, CAST(NULL AS VARCHAR) AS image_prompt,
        CASE WHEN held THEN 'a {{b}}' || chr(10) || '[c]' END AS changes, CASE WHEN held THEN (['person', 'cta', 'warm', 'text', 'other'])[k % 5 + 1] END AS cited_feature, CASE WHEN whole THEN 1 + (k % 10)::DOUBLE / 10 END AS cited_ratio,
        CASE WHEN whole THEN 'CTR' END AS expected_effect, whole, sound FROM sent)""").replace("SELECT *, coalesce(whole", "SELECT * EXCLUDE (whole, sound), coalesce(whole"),
    "r27_structured_replies": sql("rlog sent", f"""SELECT * EXCLUDE (whole, sound), coalesce(whole AND sound AND {_INOPT}, false) AS ok FROM (
      SELECT {_CALL}, reply_state, whole, sound, CASE WHEN held THEN k % 2 = 0 END AS has_person, CASE WHEN held THEN cta END AS cta_position, CASE WHEN held THEN color END AS dominant_color, CASE WHEN held THEN density END AS text_density,
        CASE WHEN whole THEN 'H ' || (u % 5) END AS headline, length(CASE event_id % 8 WHEN 3 THEN '```json+' || open || '"}}+```' WHEN 4 THEN '"' || twice || '\\"}}"' WHEN 5 THEN open WHEN 6 THEN '"' || twice || '\\' WHEN 7 THEN 'I cannot see {{any}} "image": [sorry'
          ELSE open || '"}}' END)::INT AS raw_length
      FROM (SELECT *, replace(replace(open, '"', '\\"'), chr(10), '\\n') AS twice FROM (SELECT *, '{{"has_person": ' || (k % 2 = 0) || ', "cta_position" : "' || cta || '", "dominant_color": "' || color || '",' || chr(10) || ' "text_density": "' || density || '", "headline": "H ' || (u % 5) AS open FROM (
        SELECT *, ({_L(a.REPLY_CTA)})[(event_id // 3) % 9 % 4 + 1] AS cta, ({_L(a.REPLY_COLOR)})[k % 5 % 4 + 1] AS color, ({_L(a.REPLY_DENSITY)})[(k // 2) % 2 + 1] AS density FROM sent))))"""),
    "r27_describe_replies": sql("rlog sent", f"""SELECT *, coalesce(length(description) >= 20 AND status = '' AND finish_reason <> 'MAX_TOKENS', false) AS ok FROM (
      SELECT {_CALL}, CASE event_id % 6 WHEN 0 THEN '短' WHEN 1 THEN NULL ELSE '一張白色背景的圖，中間有一雙襪子，右下角有按鈕 ' || creative_id END AS description FROM sent)"""),
    "r27_parse_reply": sql("rlog", f"SELECT *, coalesce({_COMPLETE} AND {_INOPT} AND finish_reason <> 'MAX_TOKENS', false) AS ok FROM rlog"),
    "r29_request_grid": sql("truth", "SELECT creative_id, unnest([1, 1, 2, 2]) AS run_no, unnest(['m0', 'm1', 'm0', 'm1']) AS model FROM truth"),
    "r30_prompt_version": "SELECT doc_id, md5(text) AS prompt_version FROM documents",
    "r30_require_prompt_version": "SELECT doc_id, lang FROM documents",
}
