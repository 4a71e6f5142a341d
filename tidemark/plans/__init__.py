"""Every operator run over the given tables, next to plain SQL that must give the same rows."""

import importlib

FAMILIES = ["attribution", "warehouse", "quality", "anomaly", "lift", "acceptance", "customers", "text_safety", "replies", "consistency", "costs", "operations"]


def _collect(attribute: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        part = getattr(importlib.import_module(f"{__name__}.{family}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"duplicate query names {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


# Integer sums come out of the second engine as 128-bit numbers; these columns are 64-bit in Spark.
WIDE_SUMS = {
    "s05_daily_tables_scan": ["items"],
    "d02_adgroup_week": ["imp", "clk"],
    "d06_site_day": ["clk"],
    "d12_models_side_by_side": ["input_tokens", "output_tokens"],
    "d13_promo_share": ["qty", "promo_qty"],
    "d14_worst_case_cost": ["calls", "input_tokens", "max_output_tokens"],
    "r10_reply_cost_rollup": ["input_tokens", "output_tokens"],
    "r16_demo_metrics": ["impressions", "clicks"],
    "r18_run_summary": ["input_tokens", "output_tokens"],
    "r19_usage_overview": ["input_tokens", "output_tokens"],
    "k02_page_summary": ["screenshot_bytes"],
    "h02_cache_hits_by_round": ["input_tokens", "cached_tokens", "output_tokens"],
    "h02_cache_hits_total": ["input_tokens", "cached_tokens", "output_tokens"],
    "u04_usage_per_article": ["calls", "failed_calls", "prompt_tokens", "output_tokens", "unpriced_calls"],
    "u04_usage_per_day": ["calls", "total_tokens", "unpriced_calls"],
    "u04_usage_per_model": ["calls", "prompt_tokens", "output_tokens"],
    "u04_unpriced": ["calls", "prompt_tokens", "output_tokens"],
    "u06_spend_today": ["prompt_tokens", "output_tokens"],
    "u07_ad_spend": ["impressions", "clicks"],
    "u07_ad_spend_by_channel": ["impressions", "clicks"],
    "e06_answer_costs": ["prompt_tokens", "output_tokens"],
    "e06_mode_costs": ["prompt_tokens", "output_tokens", "thoughts_tokens"],
    "o07_report_cost_total": ["model_calls", "prompt_tokens", "output_tokens"],
}


def oracles() -> dict:
    out = _collect("ORACLE")
    for name, columns in WIDE_SUMS.items():
        casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)
        out[name] = f"SELECT * REPLACE ({casts}) FROM ({out[name]})"
    return out
