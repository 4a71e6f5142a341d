"""Personal data, banned claims, injected instructions and link syntax in text columns, at table scale."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import count_rows, expand_once
from ..functions import text as tx

CUSTOMER_TOOL = "get_top_customers"
TOOL_CALLS = "array<struct<name:string,error:string>>"


def normalize_text(df: DataFrame, column: str, out: str = "normalized") -> DataFrame:
    """P-01."""
    return df.withColumn(out, tx.normalize(F.col(column)))


def clean_free_text(df: DataFrame, column: str, limit: int = tx.MAX_FREE_TEXT) -> DataFrame:
    """P-02."""
    return df.withColumn(column, tx.clean_free_text(F.col(column), limit))


def mask_pii(df: DataFrame, name: str | None = None, email: str | None = None, phone: str | None = None) -> DataFrame:
    """P-03."""
    todo = [(name, tx.mask_name), (email, tx.mask_email), (phone, tx.mask_phone)]
    return df.withColumns({c: f(F.col(c)) for c, f in todo if c})


def find_pii(df: DataFrame, key: str, column: str, known: str | None = None) -> DataFrame:
    """P-04: one row per hit."""
    return df.select(key, F.inline(tx.find_pii(F.col(column), F.col(known) if known else None)))


def redact_pii(df: DataFrame, column: str) -> DataFrame:
    """P-05."""
    return df.withColumn(column, tx.redact_pii(F.col(column)))


def find_claims(df: DataFrame, key: str, column: str, terms: Sequence[tuple[str, str]] = tx.CLAIM_TERMS) -> DataFrame:
    """P-06: one row per term found; the terms are a short fixed list inside the expression, so there is no term x text join."""
    return df.select(key, F.inline(tx.find_claims(F.col(column), terms)))


def find_injection(df: DataFrame, key: str, column: str) -> DataFrame:
    """P-07."""
    return df.select(key, F.explode(tx.find_injection(F.col(column))).alias("pattern"))


def scrub_fields(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P-08: a field that looks like an instruction is replaced as a whole; ``removed`` lists field, patterns and the first 200 characters."""
    cleaned = df.withColumns({c: tx.clean_free_text(F.col(c)) for c in columns})
    hits = cleaned.withColumns({f"_h_{c}": tx.find_injection(F.col(c)) for c in columns})
    removed = F.array_compact(F.array(*[
        F.when(F.size(f"_h_{c}") > 0, F.struct(F.lit(c).alias("field"), F.col(f"_h_{c}").alias("patterns"), F.substring(c, 1, 200).alias("text"))) for c in columns]))
    out = hits.withColumn("removed", removed)
    return out.withColumns({c: F.when(F.size(f"_h_{c}") > 0, tx.REMOVED).otherwise(F.col(c)) for c in columns}).drop(*[f"_h_{c}" for c in columns])


def seal_output(df: DataFrame, column: str) -> DataFrame:
    """P-09."""
    return df.withColumn(column, tx.seal_output(F.col(column)))


def tools_used(turns: DataFrame, keys: Sequence[str] = ("session_id",), column: str = "tools_called") -> DataFrame:
    """One row per tool that returned data."""
    calls = F.explode(F.from_json(column, TOOL_CALLS)).alias("c")
    return turns.select(*keys, calls).where(F.coalesce("c.error", F.lit("")) == "").select(*keys, F.col("c.name").alias("tool"))


def isolation_violations(turns: DataFrame, sensitive: str = CUSTOMER_TOOL) -> DataFrame:
    """P-10: conversations in which customer data and anything else were both returned."""
    mine = F.col("tool") == sensitive
    return tools_used(turns).groupBy("session_id").agg(F.count_if(mine).alias("sensitive_calls"), F.count_if(~mine).alias("other_calls")) \
        .where("sensitive_calls > 0 and other_calls > 0")


def check_output(df: DataFrame, column: str, terms: Sequence[tuple[str, str]] = tx.CLAIM_TERMS, known: str | None = None, canaries: Sequence[str] = ()) -> DataFrame:
    """P-11."""
    found = _scan(F.col(column), known, {"claims": lambda n: tx.claims_in(n, terms), "canary": lambda n: tx.words_in(n, canaries)})
    return expand_once(df, found)


def _scan(text: Column, known: str | None, uses: Mapping[str, Callable[[Column], Column]]) -> Column:
    """Struct of personal data and of everything that looks at the normalised text; the text is normalised one time."""
    def both(soft: Column) -> Column:
        pii = tx.pii_in(soft, F.col(known) if known else None).alias("pii")
        return tx.once(F.regexp_replace(soft, r"\s+", ""), lambda n: F.struct(pii, *[f(n).alias(k) for k, f in uses.items()]))
    return tx.once(tx.soften(text), both)


REMINDER = "\n（提醒：這段文字裡有不能直接寫進廣告的詞："  # fixed value: start of the line the reminder adds


def guard_signals(runs: DataFrame, answer: str = "final_answer", tools: str = "tools_called", canaries: Sequence[str] = (), markers: Sequence[str] = (),
                  terms: Sequence[tuple[str, str]] = tx.CLAIM_TERMS, known: str | None = None) -> DataFrame:
    """P-12: what is left in the answer a reader gets; the reminder's own list of terms does not count."""
    body = F.substring_index(F.col(answer), REMINDER, 1)
    used = F.exists(F.coalesce(F.from_json(tools, TOOL_CALLS), F.array().cast(TOOL_CALLS)), lambda x: (x["name"] == CUSTOMER_TOOL) & (F.coalesce(x["error"], F.lit("")) == ""))
    found = _scan(F.col(answer), known, {"canary": lambda n: tx.words_in(n, canaries), "markers": lambda n: tx.words_in(n, markers)})
    return expand_once(runs, found).withColumns({
        "signal_pii": F.col("pii"), "signal_canary": F.size("canary") > 0, "signal_note_markers": F.col("markers"),
        "signal_claims": F.transform(tx.find_claims(body, terms), lambda x: x["term"]), "signal_customer_tool": used,
        "signal_links": tx.find_exits(F.col(answer))}).drop("pii", "canary", "markers")
