"""Text expressions: all built-in functions, no Python on the executors.

Lengths count code points.  Ids in brackets name rows of the operator inventory.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
JAPANESE = "[\\u3040-\\u309F\\u30A0-\\u30FF\\u4E00-\\u9FAF]"
CHINESE = "[\\u4E00-\\u9FFF]"
LATIN = "[a-zA-Z]"
KOREAN = "[\\uAC00-\\uD7AF\\u1100-\\u11FF\\u3130-\\u318F]"
KANA = "[\\u3040-\\u309F\\u30A0-\\u30FF]"


def matches(col: Column, pattern: str) -> Column:
    """How often a pattern matches."""
    return F.regexp_count(col, F.lit(pattern))


def letters(col: Column, kind: str) -> Column:
    """How many characters are of a class: by what removing its runs takes off, which
    has far fewer matches than there are characters."""
    return F.length(col) - F.length(F.regexp_replace(col, f"{kind}+", ""))


#: Letters whose upper case is several letters, and the one letter that some of them have.
_SINGLE_UPPER = {"ß": "ẞ", **{c: c.title() for c in map(chr, range(0x1F80, 0x2000)) if len(c.upper()) > len(c.title()) == 1}}


def upper_by_points(text: Column) -> Column:
    """Upper case of one code point for one, as DuckDB has it; ``upper`` makes SS of ß."""

    def upper(c: Column) -> Column:
        return F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, "".join(_SINGLE_UPPER), "".join(_SINGLE_UPPER.values())))

    return F.array_join(F.transform(F.split(text, ""), upper), "")


def round_half_up(col: Column) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(col + F.lit(0.5))


def detect_language(text: Column) -> Column:
    """Language by script shares (A1): ko, ja, en, zh in this order, else ja."""
    n = F.length(text)
    return (
        F.when(letters(text, KOREAN) > n * 0.1, "ko")
        .when(letters(text, JAPANESE) > n * 0.1, "ja")
        .when(letters(text, LATIN) > n * 0.5, "en")
        .when(letters(text, CHINESE) > n * 0.3, "zh")
        .otherwise("ja")
    )


def language_distribution(text: Column) -> Column:
    """Shares of the scripts; null for an empty text."""
    n = F.length(text)
    ja, zh, en, ko = (letters(text, p) for p in (JAPANESE, CHINESE, LATIN, KOREAN))
    share = lambda c: F.when(n > 0, c / n)
    return F.struct(share(ja).alias("japanese"), share(en).alias("english"), share(zh - ja).alias("chinese"), share(ko).alias("korean"), share(n - ja - en - (zh - ja) - ko).alias("other"))


def contains_script(text: Column, language: str) -> Column:
    if language == "zh":
        return text.rlike(CHINESE) & ~text.rlike(KANA)
    return text.rlike({"ja": JAPANESE, "en": LATIN, "ko": KOREAN}[language])


def base_language(tag: Column) -> Column:
    """The base code of a language tag."""
    return F.lower(F.split_part(F.trim(tag), F.lit("-"), F.lit(1)))


def locale_language(locale: Column) -> Column:
    """A supported language, else auto."""
    base = base_language(locale)
    return F.when(base.isin("en", "ja", "zh", "ko"), base).otherwise("auto")


def resolve_language(requested: Column, detected: Column) -> Column:
    """Explicit base tag, else the first detected language, else auto."""
    asked = base_language(requested)
    return F.coalesce(F.when((asked != "") & (asked != "auto"), asked), F.nullif(base_language(detected), F.lit("")), F.lit("auto"))


def chars_per_token(language: Column) -> Column:
    low = F.lower(language)
    out = F.lit(config.CHARS_PER_TOKEN_OTHER)
    for code, names in config.LANGUAGE_NAMES.items():
        out = F.when(low.isin(*names), config.CHARS_PER_TOKEN[code]).otherwise(out)
    return out


def estimate_tokens(text: Column, language: Column) -> Column:
    return F.ceil(F.length(text) / chars_per_token(language))


def estimate_chars(tokens: Column, language: Column) -> Column:
    return F.floor(tokens * chars_per_token(language))


def safe_max_tokens(text: Column, language: Column) -> Column:
    """Room for an answer: estimate times factor, between a floor and the cap."""
    factor, least = (F.lit(float(config.ANSWER_TOKENS_OTHER[0])), F.lit(config.ANSWER_TOKENS_OTHER[1]))
    for code, (f, n) in config.ANSWER_TOKENS.items():
        factor = F.when(language == code, f).otherwise(factor)
        least = F.when(language == code, n).otherwise(least)
    need = F.ceil(estimate_tokens(text, language) * factor)
    return F.least(F.greatest(need, least.cast("long")), F.lit(config.MAX_ANSWER_TOKENS).cast("long"))


def chunk_token_limit(model: str, language: Column) -> Column:
    factor = F.lit(0.9)
    for code, f in config.CHUNK_TOKEN_FACTORS.items():
        factor = F.when(language == code, f).otherwise(factor)
    return F.floor(F.lit(float(config.CHUNK_TOKEN_LIMITS.get(model, 3000))) * factor)


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n?", "\n")


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t]+", " ")


def cap_newlines(text: Column, limit: int = 3) -> Column:
    return F.regexp_replace(text, f"\\n{{{limit},}}", "\n\n")


def drop_invalid(text: Column) -> Column:
    return F.regexp_replace(text, "[\\uFFF0-\\uFFFF]", "")


def strip(text: Column) -> Column:
    """Trim as wide as the reference's language does: Unicode white space and the BOM."""
    return F.regexp_replace(text, "(?U)\\A[\\s\\uFEFF]+|[\\s\\uFEFF]+\\z", "")


def tidy(text: Column) -> Column:
    """Newlines, blanks, newline cap and outer white space in one expression."""
    return strip(cap_newlines(collapse_blanks(drop_invalid(normalize_newlines(text)))))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, config.ANY_TAG, "")


def strip_meta_brackets(text: Column) -> Column:
    return F.regexp_replace(text, config.META_BRACKETS, "")


def unify_kana(text: Column) -> Column:
    return F.translate(text, KATAKANA, HIRAGANA)


def paragraphs(text: Column) -> Column:
    """Non-empty trimmed paragraphs, between blank lines."""
    return F.filter(F.transform(F.split(text, "\\n\\s*\\n+", -1), strip), lambda p: p != "")


def dedupe_paragraphs(text: Column) -> Column:
    """The first of equal paragraphs stays (F14, J11); array_distinct keeps the order."""
    parts = F.filter(F.transform(F.split(text, "\\n\\n+", -1), strip), lambda p: p != "")
    return F.array_join(F.array_distinct(parts), "\n\n")


def dedupe_lines(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda p: p != "")
    return F.array_join(F.array_distinct(parts), "\n")


def sentences(text: Column) -> Column:
    """Sentences by end marks, the unterminated rest last (F9, without abbreviations)."""
    # Marks are set behind each end, then split: a search for whole sentences would
    # walk the unterminated rest once per character.
    parts = F.split(F.regexp_replace(text, "([。.!?！？]+\\s*)", "$1\u0000"), "\u0000", -1)
    return F.filter(parts, lambda s: F.length(strip(s)) > 0)


def transcript(text: Column) -> Column:
    """Unwrap a transcript tag (F20): struct of text, mode and whether a tag is there."""
    opening, closing = "<TRANSCRIPT>", "</TRANSCRIPT>"
    low = F.lower(text)
    start, end = F.instr(low, opening.lower()), F.instr(low, closing.lower())
    inner = F.regexp_extract(text, "(?is)<TRANSCRIPT>(.*?)</TRANSCRIPT>", 1)
    whole = text.rlike("(?is)<TRANSCRIPT>.*?</TRANSCRIPT>")
    opened = (start > 0) & (start - 1 <= 200)
    closed = (end > 0) & (F.length(text) - (end - 1) <= 200)
    mode = F.when(whole, "full").when(opened, "openOnly").when(closed, "closeOnly").otherwise("none")
    body = (
        F.when(whole, inner)
        .when(opened, F.substring(text, start + len(opening), F.length(text)))
        .when(closed, F.substring(text, F.lit(1), end - 1))
        .otherwise(text)
    )
    return F.struct(strip(body).alias("text"), mode.alias("mode"), ((start > 0) | (end > 0)).alias("had_tags"))


def quoted(text: Column) -> Column:
    """Each line behind '> ', an empty last line kept."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.concat(F.lit("> "), line)), "\n")


def note_body(text: Column, style: str, title: str = "Transcription") -> Column:
    """The text of a note as callout, quote or plain (K1)."""
    if style == "callout":
        return F.concat(F.lit(f"> [!note] {title}\n"), quoted(text))
    return quoted(text) if style == "quote" else text


def preview(text: Column, n: int = 50) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "[/\\\\]", -1), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)\\z", 1))


def safe_file_name(name: Column) -> Column:
    """Reserved characters to underscores (S3)."""
    return F.regexp_replace(name, '[<>:"/\\\\|?*]', "_")


def normalize_path(path: Column) -> Column:
    """Trimmed, repeated separators joined, no separator at the end."""
    joined = F.regexp_replace(F.replace(F.trim(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/")), "/+", "/")
    return F.when(joined == "/", joined).otherwise(F.regexp_replace(joined, "/\\z", ""))


def display_name(model: Column) -> Column:
    """Words of a model name, each with a capital."""
    return F.array_join(F.transform(F.split(model, "-", -1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def fill_template(template: Column, values: Mapping[str, Column]) -> Column:
    """Fill {name} and {name:default}; other defaults are used, the rest dropped."""
    out = template
    for name, value in values.items():
        safe = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "([\\\\$])", "\\\\$1")
        out = F.regexp_replace(out, F.lit(f"\\{{{name}(?::[^}}]*)?\\}}"), safe)
    out = F.regexp_replace(out, "\\{([^:}]+):([^}]*)\\}", "$2")
    return F.regexp_replace(out, "\\{[^}]+\\}", "")


def template_gaps(template: Column, names: Sequence[str]) -> Column:
    """Names that a template asks for and that are not given."""
    asked = F.array_distinct(F.regexp_extract_all(template, F.lit("\\{([^:}]+)(?::[^}]*)?\\}"), 1))
    return F.array_except(asked, F.array(*[F.lit(n) for n in names]).cast("array<string>"))


def truncate_prompt(text: Column, limit: int, suffix: str = "...") -> Column:
    """Cut at the last sentence end or word in the last fifth."""
    room = limit - len(suffix)
    if room <= 0:
        return F.when(F.length(text) <= limit, text).otherwise(F.lit(suffix))
    head = F.substring(text, 1, room)

    def last(mark: str) -> Column:
        back = F.instr(F.reverse(head), mark[::-1])
        return F.when(back > 0, F.length(head) - back - len(mark) + 1 + len(mark) - 1).otherwise(-1)

    end = F.greatest(*[last(m) for m in (". ", "。", "! ", "? ", "！", "？")])
    space = last(" ")
    cut = (
        F.when(end > room * 0.8, F.trim(F.substring(text, F.lit(1), end + 1)))
        .when(space > room * 0.8, F.trim(F.substring(text, F.lit(1), space)))
        .otherwise(F.trim(head))
    )
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(suffix)))


def join_prompt(parts: Sequence[Column], separator: str = "\n\n") -> Column:
    present = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.trim(F.array_join(present, separator))


def indent(text: Column, spaces: int) -> Column:
    lines = F.split(text, "\n", -1)
    return F.array_join(F.transform(lines, lambda s, i: F.when((i == 0) & (F.trim(s) == ""), s).otherwise(F.concat(F.lit(" " * spaces), s))), "\n")


def conversation_labels(text: Column, speakers: Sequence[str] = ("A", "B")) -> Column:
    """Lines in turn behind the speakers' labels."""
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.trim(s) != "")
    names = F.array(*[F.lit(s) for s in speakers])
    return F.array_join(F.transform(lines, lambda s, i: F.concat(F.get(names, i % len(speakers)), F.lit(": "), F.trim(s))), "\n")


def connector(previous: Column, following: Column) -> Column:
    """'' or one space between two pieces of text (M9)."""
    before = F.regexp_replace(F.regexp_replace(previous, "(?U)\\s+\\z", ""), "[」』”’\"'）)\\]】〉》〕］}\\s]+\\z", "")
    after = F.regexp_replace(following, "(?U)\\A\\s+", "")
    spaced = F.length(after) < F.length(following)
    ok = spaced & after.rlike("\\A[A-Za-z0-9]") & before.rlike("[A-Za-z0-9.,!?;:]\\z") & ~previous.rlike("(?U)\\s\\z")
    return F.when(ok, " ").otherwise("")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once: bodies may name it often without copies of its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def removed_in_turn(text: Column, size: Column, rules: Sequence[tuple[str, float]]) -> Column:
    """Patterns removed one after another, each only within its share of ``size``."""
    table = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(float(limit)).alias("most")) for p, limit in rules])

    def step(own: Column, rule: Column) -> Column:
        rest = F.regexp_replace(own, rule["pattern"], F.lit(""))
        return let(rest, lambda r: F.when((F.length(own) - F.length(r)) / size <= rule["most"], r).otherwise(own))

    return F.aggregate(table, text, step)


def budgeted(text: Column, original: Column, patterns: Sequence[tuple[str, str]], phrase_limit: float) -> Column:
    """Pattern removal in order, each phrase pattern only within its share (F16)."""
    rules = [(p, 1.0 if kind == config.REPEAT else phrase_limit) for p, kind in patterns if p != config.KANA_SWITCH]
    return removed_in_turn(text, F.length(original), rules)


def collapse_phrases(text: Column) -> Column:
    """Phrases that repeat at once, by length range, then with gaps."""
    for low, high, times in config.PHRASE_RANGES:
        text = F.regexp_replace(text, f"(.{{{low},{high}}}?)\\1{{{times - 1},}}", "$1")
    low, high = min(r[0] for r in config.PHRASE_RANGES), max(r[1] for r in config.PHRASE_RANGES)
    return F.regexp_replace(text, f"(?U)(.{{{low},{high}}})\\s*\\1+", "$1")


def is_japanese(text: Column, language: Column, rules: config.JapaneseRules) -> Column:
    """Whether the Japanese checks apply."""
    compact = F.regexp_replace(text, "(?U)\\s+", "")
    kana = matches(compact, "[ぁ-ゖァ-ヺ]")
    # One quick look decides for most texts.
    auto = (language == "auto") & text.rlike("[ぁ-ゖァ-ヺ]") & (F.length(compact) > 0) & (kana >= rules.kana_count) & (kana >= F.length(compact) * rules.kana_ratio)
    return (language == "ja") | auto


def japanese_issues(text: Column, original_length: Column, seconds: Column | None, plan: config.CleaningPlan) -> Column:
    """The issues of the Japanese checks, in order, as an array of texts."""
    r = plan.japanese
    n = F.length(text)
    compact = F.length(F.regexp_replace(text, "(?U)\\s+", ""))
    percent = lambda c: round_half_up(c * 100).cast("string")
    many = lambda p, least, start, end: F.when(matches(text, p) > least, F.concat(F.lit(start), matches(text, p).cast("string"), F.lit(end)))
    lost = (original_length - n) / original_length
    out = [
        F.when((original_length > 0) & (original_length != n) & (lost > r.max_reduction), F.concat(F.lit("Excessive text removal: "), percent(lost), F.lit("% of original text removed"))),
        many("(?U)[はがにをでと](?:\\s|\\z)", r.max_incomplete, "Possible incomplete words detected: ", " instances (particles without content)"),
        many("[あ-んア-ン]{1,2}[あ-んア-ン]{5,}", r.max_merged, "Possible merged words detected: ", " instances"),
        F.when(n < r.min_length, F.concat(F.lit("Text too short: only "), n.cast("string"), F.lit(" characters"))),
    ]
    if seconds is not None:
        want = seconds * r.chars_per_second
        out.append(
            F.when(
                seconds.isNotNull() & (compact < want * 0.3),
                F.concat(F.lit("Text significantly shorter than expected: "), compact.cast("string"), F.lit(" chars vs ~"), round_half_up(want).cast("string"), F.lit(" expected")),
            )
        )
    out += [
        many("(.)\\1{10,}", 0, "Character repetition detected: ", " instances"),
        F.when((compact > 100) & (matches(text, "[。！？]") < 2), F.lit("Missing proper sentence endings for Japanese text")),
    ]
    if r.advanced:
        katakana = matches(text, "[ア-ン]") / n
        bare = F.size(F.filter(F.split(text, "[。！？]", -1), lambda s: (F.length(s) > plan.particleless_length) & ~s.rlike("[はがにをでと]")))
        out += [
            F.when(F.abs(matches(text, "[（「『【〈]") - matches(text, "[）」』】〉]")) > 2, F.lit("Unbalanced parentheses or brackets detected")),
            F.when(katakana > plan.katakana, F.concat(F.lit("High katakana ratio: "), percent(katakana), F.lit("% (possible foreign word recognition issues)"))),
            F.when(bare > 2, F.concat(bare.cast("string"), F.lit(" long sentences without particles detected"))),
            *[F.when(text.rlike(p), F.lit(f"Unusual character sequence detected: /{p}/")) for p in ("[あ-ん]{20,}", "[ア-ン]{15,}", "[a-zA-Z]{10,}", "\\d{6,}")],
        ]
    share = lambda p: matches(text, p) / n
    out += [
        F.when(text.contains("�"), F.lit("Unicode replacement characters detected (encoding issues)")),
        F.when(text.rlike("[あ-ん][A-Z][あ-ん]") | text.rlike("[ア-ン][a-z]{5,}[ア-ン]"), F.lit("Unusual mixed writing system patterns detected")),
        F.when(share("[あ-ん]") > plan.hiragana, F.concat(F.lit("Extremely high hiragana ratio: "), percent(share("[あ-ん]")), F.lit("% (possible transcription accuracy issues)"))),
        F.when((share("[一-龯]") < plan.kanji) & (n > 100), F.concat(F.lit("Very low kanji ratio: "), percent(share("[一-龯]")), F.lit("% (unusual for Japanese text)"))),
        F.when(share("[a-zA-Z]") > plan.latin, F.concat(F.lit("High Latin character ratio: "), percent(share("[a-zA-Z]")), F.lit("% (possible language detection issues)"))),
    ]
    return F.array_compact(F.array(*out))


def leak_cleaned(text: Column, plan: config.CleaningPlan, prompts: Sequence[str] = ()) -> Column:
    """Prompt leakage removed (C6): tags, one leading prompt, context lines, repeated paragraphs.

    Where more than the emergency share would go, the text stays as it is.
    """
    n = F.length(text)
    own = removed_in_turn(text, n, [(p, plan.pattern_limit) for _, p in config.LEAK_TAGS])
    own = F.regexp_replace(own, config.ANY_TAG, "")
    known = F.array(*[F.lit(p) for p in (*config.INSTRUCTIONS, *prompts)])

    def without_prompt(t: Column) -> Column:
        first = F.get(F.filter(known, lambda p: F.startswith(t, p)), F.lit(0))
        return F.when(first.isNull(), t).otherwise(strip(F.substring(t, F.length(first) + 1, F.length(t))))

    own = let(own, without_prompt)
    for pattern in config.LEAK_CONTEXTS:
        own = F.regexp_replace(own, pattern, "")
    own = strip(F.regexp_replace(dedupe_paragraphs(own), "\\n{3,}", "\n\n"))
    return let(own, lambda t: F.when(n == 0, t).when((n - F.length(t)) / n > plan.emergency, text).otherwise(t))


def leak_suspect(text: Column) -> Column:
    """Whether leak cleaning could change a text: a cheap gate before the long chain."""
    words = [_w for _w in ("<", "前回", "文脈", "上文", "문맥", "ontext:", "続き", "文字起こし", "してください", "出力に含めない", "\n\n", "\n \n")]
    hit = reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    start = reduce(lambda a, b: a | b, [text.startswith(p) for p in config.INSTRUCTIONS])
    return hit | start | (text != strip(text))


def critical(issues: Column) -> Column:
    """Whether an array of issues has a critical one."""
    return F.exists(issues, lambda i: i.rlike("(?i)emergency fallback|excessive text removal|text significantly shorter than expected|unicode replacement characters|encoding issues"))


def needs_fallback(text: Column, original_length: Column, issues: Column, seconds: Column, plan: config.CleaningPlan) -> Column:
    """Whether a cleaned text asks for a milder pass."""
    n = F.length(text)
    compact = F.length(F.regexp_replace(text, "(?U)\\s+", ""))
    timed = seconds.isNotNull() & (seconds >= plan.fallback_seconds)
    short = n < plan.fallback_length
    ratio = compact / (seconds * plan.japanese.chars_per_second)
    lost = (original_length - n) / original_length
    return (n == 0) | F.coalesce(F.when(timed, short & (ratio < plan.fallback_ratio)).otherwise(short & (lost > 0.9) & critical(issues)), F.lit(False))
