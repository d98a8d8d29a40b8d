"""Nested redaction against a plain recursion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scribeflow.sources import redaction as R


def user_text(name):
    low = name.strip().lower()
    return not low.endswith(R.MEASURES) and (name.strip() in R.USER_TEXT or low in R.USER_TEXT)


def one_line(text):
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return f"<redacted: {len(text)} chars>" if "\n" in text or len(text) > 120 else text


def hidden(value):
    if isinstance(value, str):
        return f"<redacted: {len(value)} chars>"
    if isinstance(value, list):
        return f"<redacted: array(len={len(value)})>"
    return "<redacted: object>" if isinstance(value, dict) else "<redacted>"


def plain(value, depth=0):
    if value is None:
        return None
    if depth > 6:
        return "<redacted: max depth>"
    if isinstance(value, str):
        return one_line(value)
    if isinstance(value, list):
        out = [plain(x, depth + 1) for x in value[:80]]
        return out + ([f"<truncated: +{len(value) - 80} items>"] if len(value) > 80 else [])
    if isinstance(value, dict):
        names = sorted(value, key=lambda k: k.encode())
        out = {k: hidden(value[k]) if user_text(k) else plain(value[k], depth + 1) for k in names[:80]}
        return out | ({"<truncatedKeys>": len(names) - 80} if len(names) > 80 else {})
    return value


def made(rng, depth=0):
    kind = rng.random()
    if depth < 10 and kind < 0.45:
        names = ["text", "Text ", "textLength", "segments", "finalText", "FINALTEXT", "note", "", "ü", "raw", "body", "x\"y", "videoId"]
        return {rng.choice(names): made(rng, depth + 1) for _ in range(rng.randrange(4))}
    if depth < 10 and kind < 0.65:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 0, -7, 2.5, "", "short", "two\nlines", "a\r\nb", "q\"\\\t", "é" * 120, "é" * 121, "x" * 5000])


def test_against_recursion(spark):
    rng = random.Random(12)
    values = [made(rng) for _ in range(400)]
    values += [{f"k{i:03}": i for i in range(95)}, list(range(200)), [[["x"] * 81]], {"text": list(range(90))}]
    deep = "end"
    for k in range(12):
        deep = {"d": deep} if k % 2 else [deep]
    values += [deep, {"a": deep}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    got = {r.i: json.loads(r.o) for r in df.select("i", R.redacted_json(F.col("j")).alias("o")).collect()}
    assert got == {i: plain(v) for i, v in enumerate(values)}


@pytest.mark.parametrize("text, want", [("no json", '"no json"'), ("a\nb", '"<redacted: 3 chars>"'), ("", '""'), (None, None), ("null", "null"), ("{", '"{"')])
def test_text_that_is_no_json(spark, text, want):
    df = spark.createDataFrame([(text,)], "j string")
    assert df.select(R.redacted_json(F.col("j"))).first()[0] == want


def test_typed_columns(spark):
    rows = spark.sql("""SELECT named_struct('text', 'secret', 'n', 3, 'none', cast(null AS string), 'list', array(named_struct('prompt', 'p', 'ok', 'fine'))) AS s,
      map('body', 'long', 'rest', 'short') AS m, array('a', 'two\\nlines') AS a, 'words' AS text, cast(null AS string) AS empty, parse_json('{"raw":1}') AS v, 5 AS n""")
    r = R.redacted_columns(rows, "s", "m", "a", "text", "empty", "v").first()
    assert json.loads(r.s) == {"text": "<redacted: 6 chars>", "n": 3, "none": None, "list": [{"prompt": "<redacted: 1 chars>", "ok": "fine"}]}
    assert json.loads(r.m) == {"body": "<redacted: 4 chars>", "rest": "short"} and json.loads(r.a) == ["a", "<redacted: 9 chars>"]
    assert r.text == '"<redacted: 5 chars>"' and r.empty is None and json.loads(r.v) == {"raw": "<redacted>"} and r.n == 5
    plan = R.redacted_columns(rows, "s")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
