"""Tolerant reading of JSON that a model has written: fenced, encoded twice, cut off in the middle, or no JSON at all.

Everything is a column expression. A reply that parses as it stands is ``whole``. One that does not is cut back to its longest beginning made
of whole members, and of whole elements of the array it was writing, and closed again: ``recovered``. What gives no member at all is
``malformed``, a missing or blank reply ``empty``.

The beginning is found with one pattern that reads strings with their escapes, so braces and brackets in texts do no harm. Numbers and
true / false / null count as whole only when something follows them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import expand_once

_STRING = r'"(?:[^"\\]++|\\.)*+"'
_SCALAR = rf'(?:{_STRING}|[-+.0-9eE]++|true|false|null)'
_PAIR = rf'{_STRING}\s*+:\s*+{_SCALAR}\s*+'
_FLAT = rf'\{{\s*+(?:{_PAIR}(?:,\s*+{_PAIR})*+)?+\}}'
_ELEMENT = rf'(?:{_SCALAR}|{_FLAT})\s*+'
_ARRAY = rf'\[\s*+(?:{_ELEMENT}(?:,\s*+{_ELEMENT})*+)?+\]'
_MEMBER = rf'{_STRING}\s*+:\s*+(?:{_SCALAR}|{_ARRAY}|{_FLAT})\s*+'
_OPEN = rf'{_STRING}\s*+:\s*+\[\s*+(?:(?:{_STRING}|{_FLAT})\s*+,?+\s*+)*+'
BEGINNING = rf'(?s)^(\s*+\{{\s*+(?:{_MEMBER},\s*+)*+)({_OPEN}|{_STRING}\s*+:\s*+(?:{_STRING}|{_FLAT}|{_ARRAY}))?+'


@dataclass(frozen=True)
class Shape:
    """Members of a reply: texts, lists of texts, and one list of flat objects."""

    fields: tuple[str, ...]
    lists: tuple[str, ...] = ()
    elements: str | None = None
    inside: tuple[str, ...] = ()

    @property
    def ddl(self) -> str:
        parts = [f"{f} string" for f in self.fields] + [f"{f} array<string>" for f in self.lists]
        if self.elements:
            parts.append(f"{self.elements} array<struct<{', '.join(f'{f}: string' for f in self.inside)}>>")
        return ", ".join(parts)

    @property
    def members(self) -> tuple[str, ...]:
        return (*self.fields, *self.lists, *([self.elements] if self.elements else []))


DESIGN = ("has_person", "cta_position", "dominant_color", "text_density", "headline")
# The members that each task asks for.
SHAPES = {
    "features": Shape(DESIGN),
    "structured": Shape(DESIGN),
    "drafts": Shape(("headline", "subhead", "badge", "cta_text", "cta_position", "has_person", "dominant_color", "text_density", "composition", "image_prompt", "changes",
                     "cited_feature", "cited_ratio", "expected_effect")),
    "gaps": Shape((), ("ad_texts",), "gaps", ("gap_type", "ad_text", "page_evidence")),
}


def unwrapped(text: Column) -> Column:
    """The reply without a code fence around it, and decoded if it is itself a JSON string, also one that lacks its end."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```[A-Za-z]*\s*", ""), r"\s*```\s*$", ""))
    decode = lambda t: F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v")
    # an escape that was begun but not finished goes
    kept = F.regexp_replace(bare, r'(?s)^((?:[^\\]|\\[^u]|\\u[0-9A-Fa-f]{4})*+)(?:\\(?:u[0-9A-Fa-f]{0,3})?)?$', "$1")
    inner = F.coalesce(decode(bare), decode(F.concat(kept, F.lit('"'))), bare)
    return F.when(bare.startswith('"'), F.trim(inner)).otherwise(bare)


def beginning(text: Column) -> Column:
    """The longest beginning of whole members and elements, closed; NULL where not even an object was opened."""
    members, rest = F.regexp_extract(text, BEGINNING, 1), F.regexp_extract(text, BEGINNING, 2)
    closed = F.regexp_replace(F.concat(members, rest), r",\s*$", "")
    in_array = rest.rlike(rf"(?s)^{_STRING}\s*+:\s*+\[") & ~rest.rlike(rf"(?s)^{_STRING}\s*+:\s*+{_ARRAY}$")
    return F.when(members != "", F.concat(closed, F.when(in_array, "]").otherwise(""), F.lit("}")))


def read_reply(replies: DataFrame, shape: Shape, column: str = "result", recover: bool = True) -> DataFrame:
    """``replies`` with the members of ``shape`` (texts as they were written) and ``reply_state``.

    Each step is computed once per row. Members that the reply does not have, or has in another form, are NULL.
    """
    ddl = f"{shape.ddl}, _bad string"
    parse = lambda c: F.from_json(c, ddl, {"columnNameOfCorruptRecord": "_bad"})
    out = expand_once(replies, F.struct(unwrapped(F.col(column)).alias("_text")))
    out = expand_once(out, F.struct(parse(F.col("_text")).alias("_w")))
    whole = F.col("_text").startswith("{") & F.col("_w._bad").isNull() & F.col("_w").isNotNull()
    out = out.withColumn("_whole", F.coalesce(whole, F.lit(False)))
    if recover:
        out = expand_once(out, F.struct(F.when(~F.col("_whole"), parse(beginning(F.col("_text")))).alias("_r")))
    else:
        out = out.withColumn("_r", F.lit(None).cast(out.schema["_w"].dataType))
    some = F.lit(False)
    for m in shape.members:
        some = some | F.col(f"_r.{m}").isNotNull()
    state = F.when(F.col("_whole"), "whole").when(F.coalesce(F.col("_text"), F.lit("")) == "", "empty").when(F.col("_r").isNotNull() & some, "recovered").otherwise("malformed")
    got = [F.when(F.col("_whole"), F.col(f"_w.{m}")).otherwise(F.col(f"_r.{m}")).alias(m) for m in shape.members]
    clash = set(shape.members) & set(replies.columns)
    if clash:
        raise ValueError(f"columns of the log that a reply would overwrite: {sorted(clash)}")
    return out.select(*replies.columns, *got, state.alias("reply_state"))
