"""Secret scans: fixed patterns, and values in credential contexts by what they cost to guess.

Three patterns give the base findings (``assign``, ``access``, ``hex``); matches are
leftmost and do not overlap within a kind, and one that fails its length is dropped
after it has taken its place.  A finding's span is that of the whole match, in code
points.

Beside them, what follows a credential word (``pwd: ...``, ``passphrase is ...``,
``Authorization: Bearer ...``) is a secret if it is costly to guess.  The cost in
bits is the least over all divisions of the value into words (by rank in the
corpus, with capitals and look-alike digits), dates, repeats, keyboard walks and
sequences, and brute-force spans, found by dynamic programming from left to right;
each part after the first costs ``JOIN_BITS`` more.  So ``changeme``,
``password2024`` and ``qwertyuiop`` are placeholders and ``t9#Vx!2qLm4w`` is not.  Values of
``LEAST_BITS`` and more become spans of kind ``guess`` where no base span overlaps
them.

Word ranks are counted over all texts: a word is a run of 3 to 32 letters between
white space, sentence marks aside; the ``WORDS`` most frequent ones (ties by their
letters) are the list, whose size is bounded by that parameter.

One scan finds the spans.  Texts that no quick look asks for never become Python
strings; the work on a value is linear in its length.

Defined cases: null and empty texts have a row without spans; repeated rows repeat;
null ids pass through; long texts and values are read whole; an empty table gives
none; an empty word list is one; other columns are ignored by ``secret_table`` and
kept by ``mask_secrets``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import comb, log2

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_whole, scratch_path, slices, write_once, written

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16

_HEAD = r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private)[_-]?key|auth(?:orization)?|credentials?)["']?(?:\x20*[:=]>?\x20*|\x20+is:?\x20+)"""
CONTEXT = re.compile(_HEAD + r"""["'`]?(?:bearer\x20+)?([^\s"'`<>,;|]+)""", re.I | re.A)
#: Quick looks at whole columns; each holds wherever its patterns match.
_LOOKS = ("(?i)" + _HEAD, "AKIA[A-Z0-9]", f"[0-9a-f]{{{HEX_LENGTH}}}")

LEAST_LENGTH = 8
LEAST_BITS = 40.0
JOIN_BITS = 2.0
WORDS = 30_000
SHORTEST_WORD, LONGEST_WORD = 3, 32
LONGEST_UNIT = 8

_LOOK_ALIKE = str.maketrans("@4310!5$7", "aaeioisst")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', r"`1234567890-=[]\;',./")
_KEYS = {c: (y, x + (y > 0)) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
#: Each lower row stands half a key to the right of the one above it.
_STEPS = {(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)}
_TURN_BITS = log2(len(_STEPS))
_DATES = (
    re.compile(r"(?P<y>(?:19|20)\d\d)([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])"),
    re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?P<y>(?:19|20)\d\d)"),
    re.compile(r"(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\1(?P<y>(?:19|20)\d\d)"),
)
_YEAR = re.compile(r"(?:19|20)\d\d")


def char_bits(c: str) -> float:
    """What a character costs in a brute-force search over its class."""
    if "0" <= c <= "9":
        return log2(10)
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return log2(26)
    return log2(33) if c < "\x80" else log2(100)


def word_bits(part: str, rank: int, plain: str) -> float:
    """The cost of a word of the list: its rank, its capitals and the characters replaced."""
    letters = [c for c in part if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    case = 0.0
    if upper:
        simple = upper == len(letters) or upper == 1 and part[0].isupper()
        case = 1.0 if simple else log2(sum(comb(len(letters), k) for k in range(1, min(upper, len(letters) - upper) + 1)) + 1)
    return log2(rank + 1) + case + sum(a != b for a, b in zip(part.lower(), plain))


def _runs(value: str, low: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, bits) of the longest keyboard walk and sequence from each place."""
    n = len(value)
    keys = [_KEYS.get(c.translate(_SHIFTED)) for c in low]
    walk_end = sequence_end = n
    turns, before, slope = 0, None, None
    for i in range(n - 1, -1, -1):
        step = None
        if i + 1 < n and keys[i] and keys[i + 1]:
            step = (keys[i + 1][0] - keys[i][0], keys[i + 1][1] - keys[i][1])
        if step in _STEPS:
            turns += before is not None and step != before
            before = step
        else:
            walk_end, turns, before = i + 1, 0, None
        if walk_end - i >= 3:
            yield i, walk_end, log2(len(_KEYS)) + log2(walk_end - i) + turns * _TURN_BITS
        rise = ord(value[i + 1]) - ord(value[i]) if i + 1 < n else 0
        if rise not in (1, -1):
            sequence_end, slope = i + 1, None
        elif rise != slope:
            sequence_end, slope = i + 2, rise
        if sequence_end - i >= 3:
            yield i, sequence_end, 1 + char_bits(value[i]) + log2(sequence_end - i)


def _repeats(value: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, unit length, times) of the longest repeat of each unit length from each place."""
    n = len(value)
    for unit in range(1, min(LONGEST_UNIT, n // 2) + 1):
        same = 0
        for i in range(n - unit - 1, -1, -1):
            same = same + 1 if value[i] == value[i + unit] else 0
            times = same // unit + 1
            if times >= (3 if unit == 1 else 2):
                yield i, i + unit * times, unit, times


def guess_bits(value: str, ranks: dict[str, int], heads: set[str] | None = None) -> float:
    """The least cost of all divisions of a value, in bits.

    ``heads`` are the first letters of the words, which say where a word can begin.
    """
    n = len(value)
    if not n:
        return 0.0
    heads = {w[:SHORTEST_WORD] for w in ranks} if heads is None else heads
    low = value.lower()
    if len(low) != n:  # a letter that lower-cases to two
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LOOK_ALIKE)
    parts: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + char_bits(c))
    for i in range(n - SHORTEST_WORD + 1):
        for text in {low, plain} if low[i : i + LONGEST_WORD] != plain[i : i + LONGEST_WORD] else (low,):
            if text[i : i + SHORTEST_WORD] in heads:
                for j in range(i + SHORTEST_WORD, min(n, i + LONGEST_WORD) + 1):
                    rank = ranks.get(text[i:j])
                    if rank is not None:
                        parts[i].append((j, word_bits(value[i:j], rank, text[i:j])))
        if "0" <= value[i] <= "3":
            for date in _DATES:
                m = date.match(value, i)
                if m:
                    parts[i].append((m.end(), log2(365) + log2(max(20, abs(int(m["y"]) - 2000))) + (2 if m.end() - i > 8 else 0)))
            m = _YEAR.match(value, i)
            if m:
                parts[i].append((m.end(), log2(max(20, abs(int(m[0]) - 2000)))))
    for i, j, bits in _runs(value, low):
        parts[i].append((j, bits))
    for i, j, unit, times in _repeats(value):
        own = min([brute[i + unit] - brute[i], *(bits for end, bits in parts[i] if end == i + unit)])
        parts[i].append((j, own + log2(times)))
    # Least cost of each prefix, and of those among them that end in a brute-force span.
    least, spanning = [0.0] + [float("inf")] * n, [float("inf")] * (n + 1)
    for i in range(n):
        join = JOIN_BITS if i else 0.0
        spanning[i + 1] = min(spanning[i], least[i] + join) + char_bits(value[i])
        least[i + 1] = min(least[i + 1], spanning[i + 1])
        for j, bits in parts[i]:
            least[j] = min(least[j], least[i] + join + bits)
    return least[n]


Span = tuple[int, int, int, float | None]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end, guess bits) of the fixed patterns; the bits are left out."""
    out: list[Span] = [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    out += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LENGTH]
    return sorted(out, key=lambda x: x[:3])


def spans_of(text: str, ranks: dict[str, int], heads: set[str], least_bits: float = LEAST_BITS) -> list[Span]:
    """All spans of a text by start and kind; ``assign`` and ``guess`` spans with the bits of their values."""
    base = base_spans(text)
    out = [(s, k, e, guess_bits(ASSIGN.match(text, s)[2], ranks, heads) if k == 0 else None) for s, k, e, _ in base]
    # Spans of two kinds may overlap: what they cover together, from left to right.
    covered: list[list[int]] = []
    for s, _, e, _ in base:
        if covered and s < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    at = 0
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".:!?)]}")
        start, end = m.start(1), m.start(1) + len(value)
        if len(value) < LEAST_LENGTH:
            continue
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if at < len(covered) and covered[at][0] < end:
            continue
        bits = guess_bits(value, ranks, heads)
        if bits >= least_bits:
            out.append((start, 3, end, bits))
    return sorted(out, key=lambda x: x[:3])


def count_words(docs: DataFrame, text_col: str = "text", limit: int = WORDS) -> DataFrame:
    """(word, count) of the most frequent words over all texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, text_col, 4 << 20):
            runs = pc.utf8_rtrim(pc.list_flatten(pc.utf8_split_whitespace(b.column(0))), ".,;:!?)")
            size = pc.utf8_length(runs)
            fit = pc.and_(pc.utf8_is_alpha(runs), pc.and_(pc.greater_equal(size, SHORTEST_WORD), pc.less_equal(size, LONGEST_WORD)))
            counts = pc.value_counts(pc.utf8_lower(runs.filter(fit)))
            yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=["word", "count"])

    held = docs.select(F.col(text_col).cast("string").alias(text_col)).where(F.col(text_col).isNotNull())
    counts = held.mapInArrow(run, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))
    counts = written(counts, "word-counts")
    # A histogram of some hundred steps says which counts can be among the most frequent:
    # few more words than are asked for are sorted, however many there are.
    step = F.floor(F.log2("count") * 16)
    found, least = 0, 0
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        found, least = found + r["count"], r["step"]
        if found >= limit:
            break
    return counts.where(step >= least).orderBy(F.desc("count"), "word").limit(limit)


def write_ranks(docs: DataFrame, folder: str, text_col: str = "text", limit: int = WORDS) -> str:
    """The file of the words in order of rank: at most ``limit`` of up to 32 letters."""
    words = [r.word for r in count_words(docs, text_col, limit).collect()]
    uri = f"{folder}/words.txt"
    write_once(uri, "\n".join(words).encode())
    return uri


@lru_cache(maxsize=2)
def ranks_of(uri: str) -> tuple[dict[str, int], set[str]]:
    words = read_whole(uri).decode().split("\n")
    ranks = {w: k for k, w in enumerate(words, 1) if w}
    return ranks, {w[:SHORTEST_WORD] for w in ranks}


def _asked(texts: pa.Array) -> list[int]:
    """Places of the texts in which some pattern can match."""
    seen = None
    for look in _LOOKS:
        hit = pc.match_substring_regex(texts, look)
        seen = hit if seen is None else pc.or_(seen, hit)
    return pc.indices_nonzero(pc.fill_null(seen, False)).to_pylist()


_SPANS = "array<struct<kind:string,start:long,`end`:long,bits:double>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))


def find_secrets(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: kind, start, end and guess bits of all spans in order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        words, heads = ranks_of(ranks)
        for b in slices(batches, "text"):
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for k in _asked(b.column(1)):
                found[k] = [{"kind": KINDS[kind], "start": s, "end": e, "bits": bits} for s, kind, e, bits in spans_of(b.column(1)[k].as_py(), words, heads)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SPAN_ARROW)], names=["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id long, spans {_SPANS}")


def mask_secrets(docs: DataFrame, ranks: str, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The same rows with every span of their texts replaced; spans that overlap are one."""

    def masked(text: str, words: dict[str, int], heads: set[str]) -> str:
        out, done = [], 0
        for s, _, e, _ in spans_of(text, words, heads):
            if s >= done:
                out += [text[done:s], mask]
            done = max(done, e)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]):
        words, heads = ranks_of(ranks)
        for b in slices(batches, text_col):
            at = b.schema.get_field_index(text_col)
            asked = _asked(b.column(at))
            new = pa.array([masked(b.column(at)[k].as_py(), words, heads) for k in asked], pa.string())
            flags = pa.array([False] * b.num_rows).to_numpy(zero_copy_only=False)
            flags[asked] = True
            yield b.set_column(at, b.schema.field(at), pc.replace_with_mask(b.column(at), pa.array(flags), new))

    return docs.mapInArrow(run, docs.schema)


def secret_table(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    ranks = write_ranks(docs, scratch_path(docs.sparkSession, "secret-words"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    bits = F.array_join(F.transform(F.filter("spans", lambda x: x["bits"].isNotNull()), lambda x: F.floor(x["bits"]).cast("string")), ",")
    return find_secrets(docs, ranks).select(
        "doc_id", *(count(k) for k in KINDS[:3]),
        F.sha2(listed(F.filter("spans", lambda x: x["kind"] != "guess")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), count("guess"), bits.alias("bits"),
    )
