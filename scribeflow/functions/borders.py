"""Borders of sentences and of characters as readers see them, in built-in functions.

Every border becomes a mark behind the place, and the text is split at the marks; a text
that holds the mark itself comes back unchanged.  Patterns look ahead to the next end
mark at most, so a text of any length takes linear time.

Null texts give null, empty ones and white space alone no sentence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPE, _KEPT, _BORDER = "\u0001", "\u0001\u0002", "\u0001\u0003"
#: White space beyond ASCII counts.
SPACE = r"[\s\x0B\p{Z}\x{85}\x{FEFF}]"

# Shortened titles and words whose full stop ends no sentence.
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "mr", "ms", "mrs", "dr", "prof", "sr", "jr", "st")

# Classes of the Unicode sentence rules (Annex 29).
_STERM = r"!?\x{589}\x{61D}-\x{61F}\x{6D4}\x{700}-\x{702}\x{7F9}\x{837}\x{839}\x{83D}\x{83E}\x{964}\x{965}\x{104A}\x{104B}\x{1362}\x{1367}\x{1368}\x{166E}\x{1735}\x{1736}\x{17D4}\x{17D5}\x{1803}\x{1809}\x{1944}\x{1945}\x{203C}\x{203D}\x{2047}-\x{2049}\x{2E2E}\x{2E3C}\x{3002}\x{A4FF}\x{A60E}\x{A60F}\x{FE56}\x{FE57}\x{FF01}\x{FF1F}\x{FF61}"
_ATERM = r".\x{2024}\x{FE52}\x{FF0E}"
_CONTINUE = r",\-:;\x{37E}\x{55D}\x{60C}\x{60D}\x{7F8}\x{1802}\x{1808}\x{2013}\x{2014}\x{3001}\x{FE10}\x{FE11}\x{FE13}\x{FE31}\x{FE32}\x{FE50}\x{FE51}\x{FE55}\x{FE58}\x{FE63}\x{FF0C}\x{FF0D}\x{FF1A}\x{FF64}"
_CLOSE = r"\p{Ps}\p{Pe}\p{Pi}\p{Pf}\"'\x{275B}-\x{2760}"
_PARAGRAPH = r"\n\r\x{85}\x{2028}\x{2029}"
_BLANK = r"\t\x0B\f\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"


def _marked(text: Column) -> Column:
    return F.replace(text, F.lit(_ESCAPE), F.lit(_KEPT))


def _parts(marked: Column) -> Column:
    whole = F.transform(F.split(marked, _BORDER, -1), lambda s: F.replace(s, F.lit(_KEPT), F.lit(_ESCAPE)))
    return F.filter(whole, lambda s: s.rlike(f"[^{SPACE[1:-1]}]"))


def sentences(text: Column, language: Column | None = None) -> Column:
    """Sentences with their trailing white space, by end marks.

    Where the language is ``en``, ``auto`` or not given, a part joins the one before if
    that ends in an abbreviation, in initials, or in the whole part of a number.
    """
    ends = F.regexp_replace(_marked(text), f"([。.!?！？]+{SPACE}*)", f"$1{_BORDER}")
    joined, start = ends, "(?<![A-Za-z0-9_])"
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    for left, right in (
        (rf"(?<![A-Za-z0-9_])[A-Z]\.{SPACE}*", r"[A-Z]\."),  # A. B.
        (rf"[0-9]\.{SPACE}*", "[0-9]"),  # 3.5
        (rf"{start}(?:[A-Z]\.){{2,}}{SPACE}*", ""),  # U.S. forces
        (rf"(?i:{start}(?:{short})\.){SPACE}*", ""),  # Dr. Who
    ):
        ahead = f"(?={right})" if right else rf"(?!\z)"
        joined = F.regexp_replace(joined, f"({left}){_BORDER}{ahead}", "$1")
    if language is not None:
        joined = F.when(F.coalesce(language, F.lit("auto")).isin("en", "auto"), joined).otherwise(ends)
    return _parts(joined)


def unicode_sentences(text: Column) -> Column:
    """Sentences by the Unicode rules (Annex 29), which hold for all of ja, en, zh and ko.

    A full stop ends no sentence before a digit, a capital that follows a letter at
    once, or where the next word begins with a small letter.
    """
    light = r"[\p{M}\p{Cf}]"  # belongs to what stands before it
    x = f"{light}*+"
    letter = r"\p{IsAlphabetic}&&[^\p{M}]"
    lower = r"[\p{IsLowercase}&&[^\p{M}]]"
    upper = r"[\p{IsUppercase}\p{Lt}]"
    line = rf"(?:\r\n|[{_PARAGRAPH}])"
    tail = rf"(?:[{_CLOSE}]{x})*+(?:[{_BLANK}]{x})*+"
    next_mark = rf"(?![{_CONTINUE}{_STERM}{_ATERM}])"
    small_word = rf"(?![^{_PARAGRAPH}{_STERM}{_ATERM}[{letter}]]*+{lower})"
    inner = rf"(?!\p{{Nd}}|(?<=[\p{{IsUppercase}}\p{{Lt}}\p{{IsLowercase}}]{light}{{0,4}}[{_ATERM}]{light}{{0,4}}){upper})"
    full = rf"[{_STERM}]{x}{tail}(?:{line}|{next_mark})"
    stop = rf"[{_ATERM}]{x}{inner}{tail}(?:{line}|{next_mark}{small_word})"
    return _parts(F.regexp_replace(_marked(text), f"({line}|{full}|{stop})", f"$1{_BORDER}"))


def grapheme_head(text: Column, count: int) -> Column:
    """The first characters as readers see them: joined emoji and marks are one with their base."""
    if count <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    return F.regexp_extract(text, rf"(?s)\A\X{{0,{count}}}", 0)
