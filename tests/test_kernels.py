"""Golden vectors and properties of the sequential folds."""

import random
import re

import pytest

from scribeflow import config
from scribeflow.functions import kernels as K

PLAN = config.cleaning_plan("gpt-4o-transcribe")
GPT = config.model_plan("gpt-4o-transcribe")


def test_jaccard_and_inclusion():
    assert K.jaccard("abcd", "abcd") == 1 and K.jaccard("ab", "cd") == 0 and K.jaccard("abcd", "abce") == 0.5
    assert K.inclusion("abc", "abcd") == 0.75 and K.inclusion("", "") == 1
    rng = random.Random(0)
    for _ in range(50):
        a, b = ("".join(rng.choices("abc ", k=rng.randrange(30))) for _ in "xy")
        assert K.jaccard(a, b) == K.jaccard(b, a) and 0 <= K.jaccard(a, b) <= 1


def test_folding():
    assert K.strict("  ＡＢｃ、カナ！ $+ ") == "abcかな"
    assert K.loose("A-b $+ｶﾅ。") == "ab$+かな"
    text, places = K.indexed("a ﷺb", K._STRICT)
    assert text[0] == "a" and text[-1] == "b" and places[-1] == 3


def test_sentences():
    assert K.sentences("Dr. Smith came. J. R. went. 3.5 is. End", "en") == ["Dr. Smith came. ", "J. R. ", "went. ", "3.5 is. ", "End"]
    assert K.sentences("一。二！三", "ja") == ["一。", "二！", "三"]
    assert K.sentences("   ") == []


def test_phrase_collapse_equals_the_patterns():
    assert K.collapse_phrases("abcdef " * 4) == "abcdef "
    rng = random.Random(2)
    *ranges, flexible = K._phrase_patterns()
    for _ in range(400):
        text = "".join(rng.choice(["ab", "abcde ", "x\n", "  ", "、", "foo bar "]) for _ in range(rng.randrange(40)))
        want = text
        for p in ranges:
            want = p.sub(lambda m: m[1], want)
        assert K.collapse_phrases(text) == flexible.sub(r"\1", want)


def test_long_runs_do_not_break():
    for unit, language in (("Thank you. ", "en"), ("うん、", "ja"), ("네。", "ko"), ("谢谢。", "zh")):
        text, _, matched = K.clean_artefacts(unit * 20_000, language, PLAN)
        assert len(text) < 30 and matched


def test_artefacts():
    for tag, language in (("[음악]", "ko"), ("[音乐]", "zh"), ("[음악]", "auto"), ("[音乐]", "auto")):
        assert tag not in K.clean_artefacts(f"{tag} " + "a" * 200, language, PLAN)[0]
    assert "[Music]" not in K.clean_artefacts("[Music] hello there my friend", "en", PLAN)[0]
    assert K.clean_artefacts("", "auto", PLAN)[0] == ""
    # A phrase pattern stays where it would take too much.
    assert "Thanks for watching" in K.clean_artefacts("Thanks for watching. Bye", "en", PLAN)[0]


def test_collapse_sentences_run_head():
    text = "Same words here. " * 5 + "Other thing now. "
    assert K.collapse_sentences(text, "en", PLAN) == "Same words here. Other thing now."
    two = "Same words here. Same words herE! End of it. "
    assert K.collapse_sentences(two, "en", PLAN).startswith("Same words here. Same words here. ")


def test_paragraph_runs():
    text = "This is the very same line. " * 3 + "Done now."
    assert K.compress_paragraphs(text, "en", PLAN) == "This is the very same line. Done now."


def test_blocks():
    a, b = "A" * 50 + " alpha beta. ", "B" * 50 + " gamma delta. "
    assert K.compress_blocks(a + b + a + b, "en", 80, 20)[0].strip() == (a + b).strip()
    rng = random.Random(3)
    unit = "".join(rng.choices("abcdefghij", k=170))
    assert K.block_text("xy" + unit * 2 + "zz", 80)[0] in ("xy" + unit + "zz", "xy" + unit)
    clean = "".join(rng.choices("abcdefghijklmnop ", k=3000))
    assert K.block_text(clean, 80) == (clean, [])
    once = K.compress_blocks(a + b + a + b, "en", 80, 20)[0]
    assert K.compress_blocks(once, "en", 80, 20)[0] == once


@pytest.mark.parametrize("unit", [1, 2, 4])
def test_tail_loops(unit):
    loop = ["Quick brown fox jumps.", "Zebras yawn daily.", "Mild pink plum.", "Go to bed."][:unit]
    text = "\n\n".join(["An opening paragraph."] + loop * 3)
    got = K.compress_tail(text, "en", PLAN.tail)[0]
    want = "\n\n".join(["An opening paragraph."] + loop)
    assert got == (want if unit * 3 <= 12 else got)
    assert K.compress_tail(got, "en", PLAN.tail)[0] == got


def test_stamped_tail():
    lines = ["[0:00 → 0:05] start"] + [f"[0:{i:02d} → 0:{i + 1:02d}] again and again" for i in range(10, 16)] + ["--- failures"]
    got = K.compress_stamped_tail("\n".join(lines), PLAN.tail)[0].split("\n")
    assert got == [lines[0], lines[6], lines[7]]


def test_enumerations():
    assert K.collapse_enumeration("A、B、A、B、A、B。", 3) == "A、B。"
    assert K.enumeration_period(list("ababab"), 3) == 2 and K.enumeration_period(list("abcdef"), 3) is None
    assert K.is_enumeration("a, b, a, b, a, b") and not K.is_enumeration("a, b, c, d")


def test_short_kana():
    text = "うえ " * 40 + "終わり"
    plan = config.cleaning_plan("gpt-4o-transcribe")
    assert "うえ" not in K.reduce_short_kana(text, len(text), plan)
    assert K.reduce_short_kana(text, len(text), plan, strict_reference=False).count("うえ") == 8


def test_removed_text():
    assert K.removed_text("abcXYdef", "abcdef") == "XY" and K.removed_text("a", "a") == ""


def brute_common(a, b, least, latest, earliest):
    best = None
    for i in range(len(a)):
        for j in range(min(len(b), latest + 1)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
                if n >= least and i + n >= earliest:
                    key = (n, i + n, j + n)
                    best = max(best, key) if best else key
    return (best[0], best[1] - best[0], best[2] - best[0]) if best else None


def test_longest_common():
    rng = random.Random(5)
    for _ in range(120):
        a, b = ("".join(rng.choices("ab ", k=rng.randrange(25))) for _ in "xy")
        args = rng.randrange(1, 4), rng.randrange(12), rng.randrange(12)
        assert K.longest_common(a, b, *args) == brute_common(a, b, *args)


def test_merge_chunks():
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    p, o, q = words(60), words(20), words(60)
    assert K.merge_chunks([(f"{p} {o}", 0, 100), (f"{o} {q}", 70, 200)], GPT) == f"{p} {o} {q}"
    assert K.merge_chunks([(f"{p} {o}", 0, 100), (f"{o} {q}", 100, 200)], GPT) == f"{p} {o}\n\n{o} {q}"
    drift = o.replace(" ", ", ", 3)
    merged = K.merge_chunks([(f"{p} {o}", 0, 100), (f"{drift} {q}", 70, 200)], GPT)
    assert merged == f"{p} {o} {q}"
    assert K.merge_chunks([], GPT) == "" and K.merge_chunks([("x", 0, 1)], GPT) == "x"


def test_segments():
    d = K.dedupe_segments
    assert d([("x", 0, 10), ("x", 5, 12)]) == [("x", 0, 10)]
    assert d([("a", 0, 10), ("b", 8, 20)]) == [("a", 0, 10), ("b", 8, 20)]
    assert d([("a", 0, 10), ("b", 4, 12)]) == [("a b", 0, 12)]
    assert d([("a", 0, 10), ("b", 2, 9)]) == [("a", 0, 10)]
    assert d([]) == []


def test_packing():
    rng = random.Random(7)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "a. ", "\n", "、", "。"]) for _ in range(rng.randrange(200)))
        parts = K.pack_lines(text, 60)
        assert all(len(p) <= 60 for p in parts)
        strip = lambda s: re.sub(r"\s", "", s)
        assert strip("".join(parts)) == strip(text)
        chunks = K.token_chunks(text, 20)
        assert chunks[0][2] == 0 and chunks[-1][3] == len(text)
        assert all(a[3] == b[2] for a, b in zip(chunks, chunks[1:]))


def test_contexts():
    assert K.last_sentences("One. Two. Three.", 11) == "Two. Three."
    assert K.last_sentences("x" * 50, 10) == "x" * 10 and K.last_sentences("", 5) == ""


def test_meta():
    words, context = K.parse_meta("Speakers: A\nB\nKeywords: x, y、z\nloose\nTopic： T")
    assert words == ["x", "y", "z"] and context == "話者: A\nB\n議題: T\nloose"


def test_fuzzy():
    a, b = "0123456789 the quick brown fox jumps over", "xx the quick brown fox jumps over yy"
    i, j, n, like = K.fuzzy_overlap(a, b)
    assert a[i : i + n] == b[j : j + n] and n >= 30 and like == 1
    assert K.fuzzy_overlap("abc", "xyz") is None
    assert K.best_window("brown fox", "the quick brown fox".split())[0] == 2
    assert K.edit_similarity("abc", "abd") == pytest.approx(2 / 3)
    assert K.duplicate_spans("x" * 3 + "abcdefghij" * 2, 10, 0.9).count("abcdefghij") == 1
