"""Borders of sentences and characters against plain versions that walk sign by sign."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from scribeflow.functions import borders, kernels
from scribeflow.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
_NAMES = ["CR", "LF", "Sep", "Extend", "Format", "Sp", "Lower", "Upper", "OLetter", "Numeric", "ATerm", "SContinue", "STerm", "Close"]
_KINDS = [(n, regex.compile(rf"\p{{Sentence_Break={n}}}")) for n in _NAMES]


def kind(c):
    return next((n for n, p in _KINDS if p.match(c)), "Other")


def by_rules(text):
    """Annex 29, rule by rule at every place."""
    raw = [kind(c) for c in text]
    para = {"CR", "LF", "Sep"}
    term = {"STerm", "ATerm"}
    out, start = [], 0
    for i in range(1, len(text)):
        if raw[i - 1] == "CR" and raw[i] == "LF":  # SB3
            continue
        if raw[i - 1] in para:  # SB4
            out.append(text[start:i])
            start = i
            continue
        if raw[i] in ("Extend", "Format"):  # SB5
            continue
        left = [raw[k] for k in range(i) if raw[k] not in ("Extend", "Format") or k == 0 or raw[k - 1] in para]
        right = [raw[k] for k in range(i, len(text)) if raw[k] not in ("Extend", "Format")]
        if left[-1] == "ATerm" and right[0] == "Numeric":  # SB6
            continue
        if len(left) > 1 and left[-2] in ("Upper", "Lower") and left[-1] == "ATerm" and right[0] == "Upper":  # SB7
            continue
        k = len(left) - 1
        ended = left[k] in para
        k -= ended
        spaces = k
        while k >= 0 and left[k] == "Sp":
            k -= 1
        spaces -= k
        while k >= 0 and left[k] == "Close":
            k -= 1
        if k < 0 or left[k] not in term or ended:
            continue
        if left[k] == "ATerm":  # SB8
            word = next((r for r in right if r in {"OLetter", "Upper", "Lower", *para, *term}), None)
            if word == "Lower":
                continue
        if right[0] in {"SContinue", *term}:  # SB8a
            continue
        if right[0] == "Close" and not spaces or right[0] in {"Sp", *para}:  # SB9, SB10
            continue
        out.append(text[start:i])
        start = i
    out.append(text[start:])
    return [s for s in out if s.strip(" \t\n\r\x0b\f\x85\xa0  　")]


def split(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    held = {r.i: r.s for r in rows.select("i", f(F.col("t")).alias("s")).collect()}
    return [held[i] for i in range(len(texts))]


PARTS = ["Dr", "a", "B", "é", "é", "ß", "漢字", "の", "7", "12", ".", ".", "...", "!", "?", "。", "．", "！", " ", " ", "  ", "　", "\n", "\r\n", "\t", '"', "'", "(", ")", "「", "」", "»", ",", "-", ":", ";", "、", "‍", " ", "$", "+", "\x01", "\x01\x03", "U.S.", "e.g.", "🇩🇪"]


def test_unicode_rules(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(0, 26))) for _ in range(3000)]
    got = split(spark, texts, borders.unicode_sentences)
    for t, s in zip(texts, got):
        assert s == by_rules(t), repr(t)


def test_unicode_sentences_of_documents(spark):
    held = {}
    for r in QUERIES["unicode_sentences"](spark, SF).collect():
        held.setdefault(r.doc_id, {})[r.pos] = r.sentence
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        if len(r.text or "") < 1500:  # the plain version is quadratic
            own = held.get(r.doc_id, {})
            assert [own[k] for k in range(len(own))] == by_rules(r.text or "")
    whole = {i: "".join(s[k] for k in range(len(s))) for i, s in held.items()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {i: t for i, t in docs.items() if (t or "").strip() and len(t) >= 1500 and "\n\n" not in t}.items() <= whole.items()


@pytest.mark.parametrize("language", ["en", "ja", None])
def test_sentences_like_the_fold(spark, language):
    rng = random.Random(7)
    parts = ["Dr", "vs", "a", "B", "7", "12", ".", ".", "!", "?", "。", " ", " ", "\n", "U.S.", "A. ", "e.g.", "Prof. ", "went", "\x01\x03"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 30))) for _ in range(2000)] + ["Dr. A. B. went 3.5 km. Then U.S. forces left.", "etc. \n", "3.", "Mr."]
    got = split(spark, texts, lambda t: borders.sentences(t, F.lit(language)))
    for t, s in zip(texts, got):
        assert s == kernels.sentences(t, language or "auto"), repr(t)


def test_defined_cases(spark):
    assert split(spark, [None, "", " \n"], borders.sentences) == [None, [], []]
    assert split(spark, [None, "", " \n"], borders.unicode_sentences) == [None, [], []]
    long = "word. " * 200_000
    assert len(split(spark, [long], borders.unicode_sentences)[0]) == 1
    assert len(split(spark, [long], borders.sentences)[0]) == 200_000
    assert len(split(spark, ["1. " * 200_000 + "a"], borders.unicode_sentences)[0]) == 200_000  # the last "1. a" is one


def test_grapheme_heads(spark):
    family, flag, accent = "👩‍👩‍👧‍👦", "🇯🇵", "é"
    texts = [family + flag + accent + "xyz", "\r\nab", "", None, "ab"]
    assert split(spark, texts, lambda t: borders.grapheme_head(t, 3)) == [family + flag + accent, "\r\nab", "", None, "ab"]
    assert split(spark, texts, lambda t: borders.grapheme_head(t, 0)) == ["", "", "", None, ""]
