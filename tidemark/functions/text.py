"""Text normalisation and scanning as column expressions.

Everything runs in the JVM except NFKC, which Spark lacks: that single step is an Arrow-batched pandas UDF. Only the short runs of
characters that NFKC may change are sent to it; the rest of a text, and rows without such a character, never cross to Python.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Fixed values -------------------------------------------------------------------------------------------------------------
# Invisible characters outside the Unicode categories Cf, Co, Cn, Cs, Cc.
EXTRA_INVISIBLE = r"\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{2800}\x{3164}\x{FFA0}\x{180B}-\x{180F}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
INVISIBLE = "[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), EXTRA_INVISIBLE) + "]"
MAX_FREE_TEXT = 300
CUT_MARK = "〔以下截斷〕"
REMOVED = "〔這裡原本有一段像是指示的文字，已經移除〕"
URL_REMOVED = "〔網址已移除〕"
EMAIL = r"[a-z0-9][a-z0-9._%+-]*[ \t]*@[ \t]*[a-z0-9-]+(?:\.[a-z0-9-]+)+"
PHONE = r"(?<!\d)(?:\+?886[-\s]?9|09)\d{2}[-\s]?\d{3}[-\s]?\d{3}(?!\d)"
EMAIL_RAW = r"([A-Za-z0-9])[A-Za-z0-9._%+-]*[ \t]*[@＠][ \t]*([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
PHONE_RAW = r"(?<!\d)(?:[+＋]?886[-\s]?9|[0０][9９])(\d{2})[-\s]?\d{3}[-\s]?(\d{3})(?!\d)"
URL = (r"(?i)(?<![a-z0-9])(?:(?:https?|ftp|wss?)\s*:\s*//|//(?=[a-z0-9][a-z0-9-]*\.[a-z])|www\.(?=[a-z0-9-]+\.[a-z]))"
       r"[a-z0-9\-._~:/?#@!$&'()*+;=%]+")
INJECTION_PATTERNS = (
    ("ignore_instructions", r"(忽略|無視|不要管|不用管|不要理會|不必遵守|不用遵守)(你|妳)?(之前|先前|前面|上面|上述|以上|原本|原來|所有|全部|任何)*的?(所有|全部|任何)?(系統)?(指示|指令|規則|規定|規範|限制|提示|內容)"),
    ("forget_instructions", r"(忘記|忘掉|跳過|捨棄)(你|妳)?(之前|先前|前面|上面|上述|以上)+的?(所有|全部|任何)?(系統)?(指示|指令|規則|規定|規範|限制|提示)"),
    ("ignore_instructions_en", r"(ignore|disregard|forget|override)(all|any|the|your)*(previous|prior|above|earlier|system)*(instructions?|prompts?|rules?)"),
    ("reveal_system_prompt", r"(系統指示|系統提示|系統指令|systemprompt|systeminstruction|你的(指示|指令|提示詞|設定)).{0,12}(原文|全文|內容|貼|印|列|顯示|告訴|給我|輸出|複述|重複)"),
    ("reveal_system_prompt_rev", r"(貼出|印出|列出|顯示|輸出|複述|重複|告訴我).{0,12}(系統指示|系統提示|系統指令|systemprompt|systeminstruction|你的(指示|指令|提示詞))"),
    ("role_override", r"(你現在是|從現在起你是|假裝你是|扮演).{0,20}(沒有|不受|無)(任何)?(限制|規則|約束)"),
    ("mode_switch", r"(進入|切換到|啟動|開啟)(維護|開發者|管理員|偵錯|除錯|debug|developer|admin|dan)(模式|mode)"),
    ("fake_system_message", r"(【|\[|<)(系統|system|管理員|admin)(訊息|通知|公告|指示|message|notice)?(】|\]|>)"),
)
CLAIM_TERMS = tuple(
    [(t, "功效") for t in ("抗菌", "殺菌", "抑菌", "除臭", "防臭", "消臭", "防蹣", "除蹣", "防霉", "遠紅外線", "負離子", "血液循環", "排毒")]
    + [(t, "醫療") for t in ("醫療", "醫學", "醫師", "療效", "治療", "消炎", "止癢", "止痛", "抗過敏", "預防")]
    + [(t, "絕對") for t in ("最好", "最強", "最佳", "最舒服", "最柔軟", "最吸水", "第一名", "全台第一", "業界第一", "唯一", "保證", "永不", "絕對", "100% 有效", "No.1")])
EXTRA_CLAIM_TERMS = tuple((t, "誇大") for t in ("極致", "強效", "黃金", "日本級"))
JOINED_GAP = 40  # characters between two ranges of changing characters that are taken as one
# --------------------------------------------------------------------------------------------------------------------------


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed one time per row, however often ``use`` refers to it.

    Catalyst may copy an expression into every place that refers to it; a lambda's argument is never copied.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


@functools.cache
def unstable() -> str:
    """Regex class of all characters that NFKC changes or that may merge with what stands before them; near ranges are joined, as more does no harm.

    A text may be cut before any other character and its pieces normalised one by one (stable code points of UAX 15).
    """
    second = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # vowels and finals of Hangul
    found = set()
    for k in range(0x80, sys.maxunicode + 1):
        ch = chr(k)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(int(parts[1], 16))
        if unicodedata.combining(ch) or unicodedata.normalize("NFKC", ch) != ch:
            found.add(k)
    ranges: list[list[int]] = []
    for k in sorted(found | second):
        if ranges and k - ranges[-1][1] <= JOINED_GAP:
            ranges[-1][1] = k
        else:
            ranges.append([k, k])
    return r"[\x{A0}-\x{10FFFF}&&[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]]"


def nfkc(c: Column) -> Column:
    """The runs that may change, each with the character before it, go to Python as one string parted by U+0000 and are put back in place.

    U+0000 merges with nothing. A text that holds it already goes as a whole.
    """
    zero, some = F.lit("\0"), unstable()
    run = rf"[^\x00]?{some}+"

    def to_send(t: Column) -> Column:
        runs = F.array_join(F.regexp_extract_all(t, F.lit(run), 0), "\0")
        return F.when(t.rlike(some), F.when(F.contains(t, zero), t).otherwise(runs))

    def put_back(x: Column) -> Column:
        kept = F.split(F.regexp_replace(x["text"], run, "\0"), "\0", -1)
        both = F.zip_with(kept, F.split(x["sent"], "\0", -1), lambda k, s: F.concat(k, F.coalesce(s, F.lit(""))))
        return F.when(x["sent"].isNull(), x["text"]).when(F.contains(x["text"], zero), x["sent"]).otherwise(F.array_join(both, ""))
    return once(F.struct(c.alias("text"), _nfkc(once(c, to_send)).alias("sent")), put_back)


def drop_invisible(c: Column) -> Column:
    """Remove characters nobody can see; every kind of space becomes a plain one; line breaks and tabs stay."""
    gone = F.regexp_replace(c, rf"[\p{{Cf}}\p{{Co}}\p{{Cn}}\p{{Cs}}{EXTRA_INVISIBLE}]|[\p{{Cc}}&&[^\n\t]]", "")
    plain = F.regexp_replace(gone, r"[\p{Zs}\p{Zl}\p{Zp}]", " ")
    return F.when(c.rlike(r"[^\x20-\x7E\n\t]"), plain).otherwise(c)


def soften(c: Column) -> Column:
    return F.lower(drop_invisible(nfkc(F.coalesce(c, F.lit("")))))


def normalize(c: Column) -> Column:
    """P-01: full width to half width, nothing invisible, no white space, lower case."""
    return F.regexp_replace(soften(c), r"\s+", "")


def normalize_literal(text: str) -> str:
    """The same for a short fixed term."""
    text = unicodedata.normalize("NFKC", text or "")
    text = "".join(ch for ch in text if ch in "\n\t" or unicodedata.category(ch) not in ("Cf", "Cc", "Co", "Cn", "Cs"))
    text = re.sub(INVISIBLE, "", text)
    return re.sub(r"\s+", "", text).lower()


def clean_free_text(c: Column, limit: int = MAX_FREE_TEXT) -> Column:
    """P-02."""
    t = drop_invisible(F.coalesce(c, F.lit("")))
    return F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit(CUT_MARK)))


def mask_name(c: Column) -> Column:
    """P-03."""
    n = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    stars = F.repeat(F.lit("○"), F.greatest(F.char_length(n) - 1, F.lit(1)))
    return F.when(n == "", "").otherwise(F.concat(F.substring(n, 1, 1), stars))


def mask_email(c: Column) -> Column:
    e = F.coalesce(c, F.lit(""))
    at = F.instr(e, "@")
    local, domain = F.substring(e, F.lit(1), F.greatest(at - 1, F.lit(0))), F.substring(e, at + 1, F.char_length(e))
    return F.when((at > 1) & (domain != ""), F.concat(F.substring(local, 1, 1), F.lit("***@"), domain)).otherwise("")


def mask_phone(c: Column) -> Column:
    d = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return F.when(F.char_length(d) == 10, F.concat(F.substring(d, 1, 4), F.lit("-***-"), F.substring(d, 8, 3))).otherwise("")


def normalize_known(c: Column) -> Column:
    """``normalize`` for the few known values of a row: inside a lambda no Python function can run, so full-width forms are mapped here."""
    wide = "".join(chr(0xFEE0 + k) for k in range(0x21, 0x7F))
    plain = "".join(chr(k) for k in range(0x21, 0x7F))
    return F.lower(F.regexp_replace(drop_invisible(F.translate(c, wide, plain)), r"\s+", ""))


def find_pii(c: Column, known: Column | None = None) -> Column:
    """P-04: (kind, value) hits: values known to belong to somebody first, then whatever looks like an e-mail address or a mobile number.

    ``known`` is an array of raw values per row (the few values looked up for that row).
    """
    return once(soften(c), lambda soft: pii_in(soft, known))


def pii_in(soft: Column, known: Column | None = None) -> Column:
    hit = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    # most texts have no @ at all, which is far cheaper to see than the full pattern
    emails = F.when(F.contains(soft, F.lit("@")), F.regexp_extract_all(soft, F.lit(EMAIL), 0)).otherwise(F.array().cast("array<string>"))
    phones = F.regexp_extract_all(soft, F.lit(PHONE), 0)
    if known is None:
        return F.concat(F.transform(emails, lambda v: hit("email", v)), F.transform(phones, lambda v: hit("phone", v)))
    # raw value and the form it is looked for in; of spellings that mean the same the first one stands for all
    values = F.coalesce(known, F.array().cast("array<string>"))
    both = F.arrays_zip(values.alias("raw"), F.transform(values, lambda v: normalize_known(v)).alias("plain"))

    def found_in(norm: Column) -> Column:
        no_dash = F.replace(norm, F.lit("-"), F.lit(""))
        inside = lambda v: (F.char_length(v) >= 2) & F.when(v.rlike(r"^\d+$"), F.contains(no_dash, v)).otherwise(F.contains(norm, v))
        return F.filter(both, lambda k: k["raw"].isNotNull() & inside(k["plain"]))

    def first_spelling(hits: Column) -> Column:
        return F.filter(hits, lambda k, i: F.array_position(F.transform(hits, lambda o: o["plain"]), k["plain"]) == i + 1)

    found = once(once(F.regexp_replace(soft, r"\s+", ""), found_in), first_spelling)
    seen = F.transform(found, lambda k: k["plain"])
    return F.concat(
        F.transform(found, lambda k: hit("known", k["raw"])),
        F.transform(F.filter(emails, lambda m: ~F.array_contains(seen, F.regexp_replace(m, r"\s", ""))), lambda v: hit("email", v)),
        F.transform(F.filter(phones, lambda m: ~F.array_contains(seen, F.regexp_replace(m, r"\D", ""))), lambda v: hit("phone", v)))


@F.pandas_udf(StringType())
def _redact_wide(s: pd.Series) -> pd.Series:
    """Digits, signs and spaces beyond ASCII, as people type them on wide keyboards; only such rows come here."""
    half = lambda x: unicodedata.normalize("NFKC", x)
    email, phone = re.compile(EMAIL_RAW), re.compile(PHONE_RAW)

    def one(t):
        if t is None:
            return None
        t = email.sub(lambda m: f"{m[1]}***@{m[2]}", t)
        return phone.sub(lambda m: f"09{half(m[1])}-***-{half(m[2])}", t)
    return s.map(one)


def redact_pii(c: Column) -> Column:
    """P-05: full addresses and numbers become their masks; the rest of the text keeps its own punctuation."""
    wide = c.rlike(r"[\p{Nd}\p{Z}\x{85}＠＋&&[^\x00-\x7F]]|[\x1C-\x1F]")
    narrow = F.regexp_replace(F.regexp_replace(c, EMAIL_RAW, "$1***@$2"), PHONE_RAW, "09$1-***-$2")
    return F.when(wide, _redact_wide(F.when(wide, c))).otherwise(narrow)


def find_claims(c: Column, terms: Sequence[tuple[str, str]] = CLAIM_TERMS) -> Column:
    """P-06: banned terms (term, kind) that occur in the normalised text."""
    return once(normalize(c), lambda norm: claims_in(norm, terms))


def claims_in(norm: Column, terms: Sequence[tuple[str, str]]) -> Column:
    rows = [(t, k, normalize_literal(t)) for t, k in terms]
    return F.array_compact(F.array(*[F.when(F.contains(norm, F.lit(n)), F.struct(F.lit(t).alias("term"), F.lit(k).alias("kind"))) for t, k, n in rows if n]))


def find_injection(c: Column, patterns: Sequence[tuple[str, str]] = INJECTION_PATTERNS) -> Column:
    """P-07: names of the patterns that occur in the normalised text."""
    return once(normalize(c), lambda norm: F.array_compact(F.array(*[F.when(norm.rlike(p), F.lit(n)) for n, p in patterns])))


def words_in(norm: Column, words: Sequence[str]) -> Column:
    if not words:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(F.contains(norm, F.lit(normalize_literal(w))), F.lit(w)) for w in words]))


def has_url(c: Column) -> Column:
    """A cheap look for ``//`` or ``www.`` comes before the full pattern."""
    return (F.contains(c, F.lit("//")) | c.rlike(r"(?i)www\.")) & c.rlike(URL)


def seal_output(c: Column) -> Column:
    """P-09: the four bracket characters become full width, visible URLs are replaced; URLs hidden by full-width or invisible
    characters make the whole text half width first."""
    t = F.translate(F.coalesce(c, F.lit("")), "[]<>", "［］＜＞")
    first = F.when(has_url(t), F.regexp_replace(t, URL, URL_REMOVED)).otherwise(t)

    def again(x: Column) -> Column:
        second = F.translate(F.regexp_replace(x["half"], URL, URL_REMOVED), "[]<>", "［］＜＞")
        return F.when(has_url(x["half"]), second).otherwise(x["shown"])
    return once(F.struct(first.alias("shown"), drop_invisible(nfkc(first)).alias("half")), again)


def is_sealed(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"[\[\]<>]")


def find_exits(c: Column) -> Column:
    """P-09: kinds of image, link, tag or URL syntax in a text."""
    raw = drop_invisible(F.coalesce(c, F.lit("")))

    def kinds(x: Column) -> Column:
        found = [("markdown_image", x["raw"].rlike(r"!\s*\[")), ("markdown_link", x["raw"].rlike(r"\]\s*[(\[:]")),
                 ("html_tag", x["raw"].rlike(r"<\s*[a-zA-Z/!?]")), ("url", has_url(x["half"]))]
        return F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in found]))
    return once(F.struct(raw.alias("raw"), nfkc(raw).alias("half")), kinds)
