"""Broken replies: what is kept of them, against Python's own JSON reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import replies as r
from tidemark.operators.reply_json import SHAPES, Shape, read_reply

GAPS = SHAPES["gaps"]


def read(spark, texts, shape=GAPS, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, result string")
    return [row.asDict(recursive=True) for row in read_reply(df, shape, **how).orderBy("i").collect()]


def test_forms(spark):
    body = json.dumps({"ad_texts": ["x"], "gaps": [{"gap_type": "gift", "ad_text": 'a "}]" \\ b', "page_evidence": None}]}, ensure_ascii=False)
    texts = [body, f"```json\n{body}\n```", f"  ```\n{body}", json.dumps(body), "", None, "  ", "sorry", "[1, 2]", "{", '{"gaps', '{"gaps": [', '{"other": 1}', '{"gaps": 5}', "null", '"just text"']
    got = read(spark, texts)
    states = [g["reply_state"] for g in got]
    assert states[:8] == ["whole"] * 4 + ["empty"] * 3 + ["malformed"]
    assert all(g["gaps"] == [{"gap_type": "gift", "ad_text": 'a "}]" \\ b', "page_evidence": None}] and g["ad_texts"] == ["x"] for g in got[:4])
    assert states[8:11] == ["malformed"] * 3 and states[11] == "recovered" and got[11]["gaps"] == [] and states[14:] == ["malformed"] * 2
    assert states[12] == "whole" and got[12]["gaps"] is None and got[13]["gaps"] is None


@pytest.mark.parametrize("twice", [False, True])
def test_every_cut_keeps_the_whole_elements(spark, twice):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice('ab"\\{}[],: é標\n') for _ in range(rng.randrange(6)))
    gaps = [{"gap_type": word(), "ad_text": word(), "page_evidence": word()} for _ in range(3)]
    whole = json.dumps({"ad_texts": [word(), word()], "gaps": gaps}, ensure_ascii=twice)
    sent = json.dumps(whole, ensure_ascii=False) if twice else whole
    cuts = list(range(len(sent)))
    for cut, got in zip(cuts, read(spark, [sent[:c] for c in cuts])):
        if twice:
            # what the part that arrived says once decoded
            part = sent[1:cut]
            while part:
                try:
                    text = json.loads(f'"{part}"')
                    break
                except ValueError:
                    part = part[:-1]
            text = text if part else ""
        else:
            text = whole[:cut]
        done = [k for k in range(4) if text.startswith(whole[:whole.index('"gaps"')]) and len(text) >= len(whole[:whole.index('"gaps"')] + '"gaps": ' + json.dumps(gaps[:k], ensure_ascii=twice)) - (k < 4)]
        want = gaps[:max(done)] if done else None
        have = got["gaps"]
        assert (have or []) == (want or []), (cut, text)


def test_numbers_need_an_end(spark):
    shape = Shape(("a", "b", "c"))
    got = read(spark, ['{"a": 12', '{"a": 12,', '{"a": "x", "b": tru', '{"a": "x", "b": true, "c": {"d": 1}', '{"a": "x", "b": "y"'], shape)
    assert [(g["a"], g["b"], g["c"], g["reply_state"]) for g in got] == [
        (None, None, None, "malformed"), ("12", None, None, "recovered"), ("x", None, None, "recovered"), ("x", "true", '{"d":1}', "recovered"), ("x", "y", None, "recovered")]
    strict = read(spark, ['{"a": "x", "b": tru'], shape, recover=False)
    assert strict[0]["a"] is None and strict[0]["reply_state"] == "malformed"


def test_long_replies_do_not_overflow(spark):
    gaps = [{"gap_type": "g", "ad_text": 'q"' * 200, "page_evidence": "e"} for _ in range(300)]
    text = json.dumps({"ad_texts": [], "gaps": gaps})
    got = read(spark, [text, text[:-5], json.dumps(text)[:-9]])
    assert [len(g["gaps"]) for g in got] == [300, 299, 299]


def test_unknown_task_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "{}", "{}", "")], "i int, result string, full_response string, status string")
    with pytest.raises(ValueError):
        r.parse_reply(df, "poems")
    with pytest.raises(ValueError):
        read_reply(df.withColumn("gaps", F.lit(1)), GAPS)
