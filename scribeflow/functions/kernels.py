"""Sequential folds over one text, as plain Python for Arrow functions.

These compare with a run's head or with text gathered so far, which no window
frame or pattern expresses.  Sentence ends are defined by marks (no dictionary of
a locale); lengths count code points.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex

from .. import config
from ..config import CleaningPlan, ModelPlan, TailRules

_SENTENCE_END = re.compile(r"[。.!?！？]+\s*")
_SPACE = re.compile(r"\s+")
#: White space in a run up to which recurring pieces are listed.
_WIDE_GAP = 64
_DECIMAL = re.compile(r"\d\.$")
_ABBREVIATION = re.compile(r"\b(?:e\.g|i\.e|etc|vs|mr|ms|mrs|dr|prof|sr|jr|st)\.\s*$", re.I)
_INITIALS = re.compile(r"\b(?:[A-Z]\.){2,}\s*$")
_INITIAL = re.compile(r"\b[A-Z]\.\s*$")
# Fixed value: punctuation that loose comparison ignores.
_ANY_KANA = re.compile("[あ-んア-ン]")
_LOOSE = set("。、！？「」『』（）｛｝［］【】〈〉《》・…ー，．：；‐‑‒–—―−.,!?\"'’‘“”(){}[]<>:;_-")


def _kana(c: str) -> str:
    return chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c


def _strict_char(c: str) -> str:
    """A character for strict comparison: folded, without marks, symbols and space."""
    out = ""
    for x in unicodedata.normalize("NFKC", c).lower():
        x = _kana(x)
        if not (x.isspace() or unicodedata.category(x)[0] in "PSZ" or unicodedata.category(x) == "Cf"):
            out += x
    return out


def _loose_char(c: str) -> str:
    """A character for loose comparison: only listed punctuation and space go."""
    return "".join(_kana(x) for x in unicodedata.normalize("NFKC", c).lower() if unicodedata.category(x) != "Cf" and x not in _LOOSE and not x.isspace())


class _Table(dict):
    """Folded characters by code point, filled as they occur; for ``str.translate``."""

    def __init__(self, fold: Callable[[str], str]):
        self.fold = fold

    def __missing__(self, point: int) -> str:
        own = self[point] = self.fold(chr(point))
        return own


_STRICT, _LOOSE_TABLE = _Table(_strict_char), _Table(_loose_char)


def strict(text: str) -> str:
    """Text for comparison without white space, punctuation and symbols (F2)."""
    return _short_strict(text) if len(text) <= 400 else _strict(text)


def _strict(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).translate(_STRICT)


#: Sentences of the text at hand: each stage folds the same ones.
_short_strict = lru_cache(maxsize=1024)(_strict)


def loose(text: str) -> str:
    """Text for comparison without listed punctuation and white space (F1)."""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).translate(_LOOSE_TABLE)


def indexed(text: str, table: _Table) -> tuple[str, list[int]]:
    """Folded characters and the place each comes from."""
    parts = [table[ord(c)] for c in text]
    places = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))
    return "".join(parts), places.tolist()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def repeats_window(codes: np.ndarray, size: int) -> bool:
    """Whether some window of a size may occur twice: equal rolling hashes."""
    n = len(codes) - size + 1
    if n < 2:
        return False
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.full(len(codes), base, np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power)])
    hashes = (sums[size:] - sums[:-size]) * power[::-1][:n]
    return len(np.unique(hashes)) < n


def _echoes(codes: np.ndarray, shift: int, least: int, mask: np.ndarray) -> None:
    """Mark the places from which ``least`` characters recur ``shift`` further on."""
    if shift >= len(codes):
        return
    equal = codes[:-shift] == codes[shift:]
    if np.count_nonzero(equal) < least:
        return
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a >= least:
            mask[a : b - least + 1] = True


def _recurring(codes: np.ndarray, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(shift, place) of the pieces of ``size`` characters that recur up to ``most`` further
    on, by shift, then place.  Equal hashes: a piece too many costs a try of a pattern."""
    n = len(codes) - size + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.zeros(n, np.uint64)
    for i in range(size):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    # Neighbours in this order, then those two apart, while some are near enough.
    shifts, places = [], []
    at, lag = np.flatnonzero(hashes[1:] == hashes[:-1]), 1
    while len(at):
        away = order[at + lag] - order[at]
        near = away <= most
        at, away = at[near], away[near]
        shifts.append(away)
        places.append(order[at])
        lag += 1
        at = at[at + lag < n]
        at = at[hashes[at + lag] == hashes[at]]
    if not shifts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shift, place = np.concatenate(shifts), np.concatenate(places)
    by = np.lexsort((place, shift))
    return shift[by], place[by]


def _echo_mask(n: int, recurring: tuple[np.ndarray, np.ndarray], size: int, least: dict[int, int]) -> np.ndarray:
    """The places from which ``least`` characters of a shift recur that much further on."""
    mask = np.zeros(n, bool)
    shift, place = recurring
    if not len(shift):
        return mask
    edge = np.flatnonzero((np.diff(shift) != 0) | (np.diff(place) != 1)) + 1
    starts = np.concatenate([[0], edge])
    long = np.diff(np.concatenate([starts, [len(shift)]]))
    # A run of n characters is one of n - size + 1 pieces.
    need = np.full(int(shift[-1]) + 1, n + 1, np.int64)
    for s, own in least.items():
        if s < len(need):
            need[s] = own - size + 1
    spare = long - need[shift[starts]]
    for a, k in zip(place[starts[spare >= 0]].tolist(), spare[spare >= 0].tolist()):
        mask[a : a + k + 1] = True
    return mask


def _replace_at(pattern: re.Pattern, text: str, mask: np.ndarray, new: Callable[[re.Match], str]) -> str:
    """``pattern.sub`` that tries the marked places only."""
    out, at = [], 0
    for i in np.flatnonzero(mask).tolist():
        if i < at:
            continue
        m = pattern.match(text, i)
        if m:
            out += (text[at:i], new(m))
            at = m.end()
    return "".join([*out, text[at:]]) if out else text


def inclusion(a: str, b: str) -> float:
    longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
    if not longer:
        return 1.0
    known = set(longer)
    return sum(c in known for c in shorter) / len(longer)


def alike(a: str, b: str, least: float) -> bool:
    return a == b or bool(a and b and inclusion(a, b) >= least)


def jaccard(a: str, b: str, n: int = 3) -> float:
    if a == b:
        return 1.0
    n = min(n, min(len(a), len(b)) // 2)
    if n < 1:
        return 0.0
    x, y = ({t[i : i + n] for i in range(len(t) - n + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def gram_codes(text: str, n: int) -> np.ndarray:
    """The distinct n-grams of a text as numbers: exact up to three characters, else hashes."""
    codes = _codes(text).astype(np.uint64)
    out = np.zeros(max(len(codes) - n + 1, 0), np.uint64)
    for i in range(n):
        out = out * np.uint64(1 << 21 if n <= 3 else 0x9E3779B97F4A7C15) + codes[i : i + len(out)]
    return _distinct(out)


def _distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once: sorted in place, where numpy's own first builds a hash table."""
    values.sort()
    return values[np.concatenate([np.ones(min(len(values), 1), bool), values[1:] != values[:-1]])]


def gram_count(text: str, n: int) -> int:
    """How many distinct n-grams a text has: numbers of the text's own letters, exact
    while they fit 64 bits, pieces of text else."""
    letters, codes = np.unique(_codes(text), return_inverse=True)
    if len(letters) ** n >= 1 << 63:
        return len({text[i : i + n] for i in range(len(text) - n + 1)})
    out = np.zeros(max(len(codes) - n + 1, 0), np.int64)
    for i in range(n):
        out = out * len(letters) + codes[i : i + len(out)]
    return len(np.unique(out))


def start_regions(text: str, size: int, n: int, share: float, most: int) -> list[dict]:
    """Groups of places from ``size`` on that hold a gram of the text's start (J6), in order of
    the grams, then of the places."""
    head: dict[str, int] = {}
    for p in range(0, min(size, len(text)) - n + 1, max(1, n // 2)):
        head.setdefault(text[p : p + n], p)
    out: list[dict] = []
    reach = None
    for gram in head if len(head) * share <= 1 else ():
        at = text.find(gram, size)
        while at >= 0:
            if reach is None or at - (reach + 2 * size) > size:
                if len(out) == most:
                    return out
                out.append({"rank": len(out) + 1, "position": at, "end_position": at + 2 * size})
            out[-1]["end_position"] = max(out[-1]["end_position"], at + 2 * size)
            reach = at if reach is None else max(reach, at)
            at = text.find(gram, at + 1)
    return out


class Sets(NamedTuple):
    """Sets side by side: set i holds ``members[column[ends[i] : ends[i + 1]]]``, in order."""

    members: np.ndarray
    ends: np.ndarray
    column: np.ndarray


def joined_sets(sets: Sequence[np.ndarray], some: int = 1 << 20) -> Sets:
    """Sorted sets with their members numbered; the members are gathered from ``some`` at a time."""
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])
    members, low = np.zeros(0, np.uint64), 0
    while low < len(sets):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + some, "right")) - 1)
        members = _distinct(np.concatenate([members, *sets[low:high]]))
        low = high
    column = np.empty(ends[-1], np.int32)
    for i, s in enumerate(sets):
        column[ends[i] : ends[i + 1]] = np.searchsorted(members, s)
    return Sets(members, ends, column)


def packed_sets(sets: Sets) -> bytes:
    """Sets as bytes: steps from member to member, their bytes by place, compressed."""
    first = sets.ends[:-1][np.diff(sets.ends) > 0]
    step = np.diff(sets.column, prepend=np.int32(0))
    step[first] = sets.column[first]
    sizes = np.array([len(sets.members), len(sets.ends)], "<i8")
    fields = [(np.diff(sets.members, prepend=np.uint64(0)), "<u8"), (np.diff(sets.ends), "<u4"), (step, "<u4")]
    planes = [np.ascontiguousarray(f.astype(kind)).view(np.uint8).reshape(-1, int(kind[2])).T.tobytes() for f, kind in fields]
    raw = b"".join([sizes.tobytes(), *planes])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked_sets(packed: bytes) -> Sets:
    raw = np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    sizes, at = raw[:16].view("<i8"), 16

    def field(count: int, width: int) -> np.ndarray:
        nonlocal at
        at += count * width
        return np.ascontiguousarray(raw[at - count * width : at].reshape(width, count).T).view(f"<u{width}").reshape(-1)

    members = np.cumsum(field(int(sizes[0]), 8), dtype=np.uint64)
    n = field(int(sizes[1]) - 1, 4).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    sums = np.concatenate([[0], np.cumsum(field(int(ends[-1]), 4), dtype=np.int64)])
    return Sets(members, ends, (sums[1:] - np.repeat(sums[ends[:-1]], n)).astype(np.int32))


def _taken(sets: Sets, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all members of some sets, rows counted anew."""
    n = np.diff(sets.ends)[rows]
    starts = np.cumsum(n) - n
    return np.repeat(np.arange(len(rows)), n), sets.column[np.arange(n.sum()) + np.repeat(sets.ends[rows] - starts, n)]


#: A product takes a column of two slabs in about the time in which 1 in so many of their pairs is counted alone.
_DENSE = 1000


def similar_sets(x: Sets, y: Sets | None, rank: np.ndarray, least: float = 0.0, digits: int | None = None, slab: int = 0, columns: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, Jaccard similarity) of all pairs of an x and a y, or within x without y, at
    ``least`` or more after rounding, some at a time.

    Sets are counted through x and y, and a is the one of the lesser rank.  Common members
    that many sets hold are counted by products of 0/1 matrices, those of few by their pairs.
    With ``least``, slabs whose sizes differ too much are left out: their pairs lie below it.
    """
    same = y is None
    slab = slab or (512 if least > 0 else 1024)
    sizes = [np.diff(s.ends) for s in ([x] if same else [x, y])]
    n, shift = np.concatenate(sizes), 0 if same else len(sizes[0])
    # Columns of the members that both sides hold, or two sets of one side.
    held = [np.bincount(s.column, minlength=len(s.members)) for s in ([x] if same else [x, y])]
    at = [np.flatnonzero(held[0] > 1)] * 2 if same else np.intersect1d(x.members, y.members, assume_unique=True, return_indices=True)[1:]
    often = held[0][at[0]].astype(float) * held[-1][at[1]] * _DENSE > float(len(sizes[0])) * len(sizes[-1])
    place = np.where(often, np.cumsum(often) - 1, -2 - np.arange(len(often)))
    width = int(often.sum())
    low = max(least - 1e-6, 0.0)
    bound = low / (1 + low) * (1 - 1e-6)

    def slabs(s: Sets, k: int) -> list[tuple]:
        """Of each slab the sets, places in the matrix of products, and the rare members by column."""
        numbers = np.full(len(s.members), -1, np.int64)
        numbers[at[k]] = place
        order = np.argsort(sizes[k], kind="stable") if least > 0 else np.argsort(rank[k * shift :][: len(sizes[k])], kind="stable")
        out = []
        for p in range(0, len(order), slab):
            row, column = _taken(s, order[p : p + slab])
            column = numbers[column]
            rare = np.flatnonzero(column < -1)
            rare = rare[np.argsort(column[rare], kind="stable")]
            own = column >= 0
            out.append((order[p : p + slab], (row[own].astype(np.int32), column[own].astype(np.int32)), (row[rare].astype(np.int32), -2 - column[rare])))
        return out

    def matrix(part: tuple, low: int) -> np.ndarray:
        row, column = part[1]
        out = np.zeros((len(part[0]), min(columns, width - low)), np.float32)
        if width > columns:
            inside = (column >= low) & (column < low + columns)
            row, column = row[inside], column[inside] - low
        out[row, column] = 1
        return out

    def count_rare(shared: np.ndarray, xs: tuple, ys: tuple, most: int = 1 << 22) -> None:
        (row, column), (other, theirs) = xs[2], ys[2]
        if not len(row) or not len(other):
            return
        first, last = np.searchsorted(-theirs, -column, "left"), np.searchsorted(-theirs, -column, "right")
        many = last - first
        meets = np.flatnonzero(many)
        row, first, many = row[meets].astype(np.int64), first[meets], many[meets]
        total = np.cumsum(many)
        start = 0
        while start < len(row):
            before = int(total[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + most, "right")))
            m = many[start:end]
            found = other[np.arange(m.sum()) + np.repeat(first[start:end] - (total[start:end] - m - before), m)]
            pairs = np.repeat(row[start:end] * shared.shape[1], m) + found
            shared += np.bincount(pairs, minlength=shared.size).reshape(shared.shape)
            start = end

    left = slabs(x, 0)
    right = left if same else slabs(y, 1)
    # The matrices of one side are kept where they are small.
    keep = len(sizes[-1]) * width * 4 <= 64 << 20
    kept: dict[int, np.ndarray] = {}
    for p, xs in enumerate(left):
        own = None
        for q, ys in enumerate(right):
            i, j = xs[0], ys[0] + shift
            if same and q < p or n[i].max() < low * n[j].min() or n[j].max() < low * n[i].min():
                continue
            if width <= columns:
                own = matrix(xs, 0) if own is None else own
                theirs = own if same and p == q else kept[q] if q in kept else matrix(ys, 0)
                if keep:
                    kept[q] = theirs
                shared = own @ theirs.T
            else:
                shared = np.zeros((len(i), len(j)), np.float32)
                for start in range(0, width, columns):
                    m = matrix(xs, start)
                    shared += m @ (m if same and p == q else matrix(ys, start)).T
            count_rare(shared, xs, ys)
            if least > 0:
                near = np.nonzero(shared >= (bound * n[i]).astype(np.float32)[:, None] + (bound * n[j]).astype(np.float32)[None, :])
                a, b, common = i[near[0]], j[near[1]], shared[near].astype(np.float64)
                like = rounded(common / np.maximum(n[a] + n[b] - common, 1), digits)
                found = (like >= least) & ((rank[a] < rank[b]) | (not (same and p == q)))
                a, b, like = a[found], b[found], like[found]
                turned = rank[a] > rank[b]
                yield np.where(turned, b, a), np.where(turned, a, b), like
                continue
            union = np.add.outer(n[i], n[j]).astype(np.float64) - shared
            like = rounded(np.divide(shared, np.maximum(union, 1, out=union), out=union), digits)
            # Both sides go by rank, so that runs of rows have one a and their b ascends.
            for a, b, rows in [(i, j, like)] if same and p == q else [(i, j, like), (j, i, like.T)]:
                start = np.searchsorted(rank[b], rank[a], "right")
                yield np.repeat(a, len(b) - start), np.concatenate([b[s:] for s in start]), np.concatenate([row[s:] for row, s in zip(rows, start)])


def rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    """Numbers of 0 and more rounded half up after scaling, as DuckDB does; Spark's goes through decimal text."""
    if digits is None:
        return values
    scaled = values * 10.0**digits
    whole = np.floor(scaled)
    return (whole + (scaled - whole >= 0.5)) / 10.0**digits


def set_similarities(sets: Sequence[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, least: float, slab: int = 0, columns: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, Jaccard similarity) of all pairs of left and right sets, or within left if
    ``same``, at ``least`` or more, some at a time."""
    x, y = joined_sets([sets[i] for i in left]), None if same else joined_sets([sets[i] for i in right])
    own = left if same else np.concatenate([left, right])
    for a, b, like in similar_sets(x, y, np.arange(len(own)), least, None, slab, columns):
        yield own[a], own[b], like


def sentences(text: str, language: str = "auto") -> list[str]:
    """Sentences with their trailing space; abbreviations and decimals are rejoined."""
    return list(_sentences(text, language))


@lru_cache(maxsize=2)
def _sentences(text: str, language: str) -> list[str]:
    """The sentences of the last texts: stages in turn ask for those of the same one."""
    out, end = [], 0
    for m in _SENTENCE_END.finditer(text):
        if text[end : m.end()].strip():
            out.append(text[end : m.end()])
        end = m.end()
    if text[end:].strip():
        out.append(text[end:])
    if language not in ("en", "auto"):
        return out
    joined: list[str] = []
    for part in out:
        if joined:
            # All patterns end with a full stop and are told by the last characters.
            left = joined[-1].rstrip()[-8:]
            if left.endswith("."):
                right = part.lstrip()
                decimal = _DECIMAL.search(left) and right[:1].isdigit()
                paired = _INITIAL.search(left) and re.match(r"[A-Z]\.", right)
                if right and (decimal or paired or _INITIALS.search(left) or _ABBREVIATION.search(left)):
                    joined[-1] += part
                    continue
        joined.append(part)
    return joined


# --- Runs of sentences -------------------------------------------------------------


def collapse_sentences(text: str, language: str, plan: CleaningPlan) -> str:
    """Runs like their first sentence: a long run leaves one copy, a short one
    copies of the first (W9)."""
    runs: list[list] = []
    for s in sentences(text, language):
        own = s.strip()
        if runs:
            head = runs[-1][0].strip()
            long = min(len(own), len(head)) >= plan.min_similar_length
            if own and (own == head or (long and inclusion(strict(own), strict(head)) >= plan.sentence_similarity)):
                runs[-1][1] += 1
                continue
        runs.append([s, 1])
    out = "".join(s if n >= plan.sentence_repeats else s * n for s, n in runs)
    return re.sub(r"(?:\s*[・。、]\s*){%d,}\Z" % plan.trailing, "。", out).strip()


def head_graphemes(text: str, count: int) -> str:
    """The first characters as readers see them."""
    first = text[: count + 1]
    return first[:count] if first.isascii() and "\r" not in first else _graphemes(count).match(text)[0]


@lru_cache
def _graphemes(count: int) -> regex.Pattern:
    return regex.compile(r"\X{0,%d}" % count)


def compress_paragraphs(text: str, language: str, plan: CleaningPlan) -> str:
    """Runs of sentences with one head and like their predecessor: three or more
    leave the first (W10)."""
    runs: list[list[str]] = []
    head = last = ""
    for s in sentences(text, language):
        own = strict(s)
        near = bool(runs) and head_graphemes(own, plan.head) == head and min(len(own), len(last)) >= plan.min_similar_length and inclusion(last, own) >= plan.paragraph_similarity
        if near:
            runs[-1].append(s)
        else:
            runs.append([s])
            head = head_graphemes(own, plan.head)
        last = own
    return "".join(r[0] if len(r) >= plan.paragraph_repeats else "".join(r) for r in runs)


# --- Blocks that follow themselves ----------------------------------------------------


def _repeats(equal: Callable[[int, int, int], bool], start: int, unit: int, total: int) -> int:
    n = 1
    while start + (n + 1) * unit <= total and equal(start, start + n * unit, unit):
        n += 1
    return n


def block_sentences(text: str, language: str, min_chars: int, max_unit: int) -> tuple[str, list[str]]:
    """Blocks of sentences that repeat at once: one copy stays."""
    parts = sentences(text, language)
    if len(parts) < 2:
        return text, []
    marks = [strict(p) for p in parts]
    sizes = np.cumsum([0, *map(len, marks)])
    same = lambda a, b, n: marks[a : a + n] == marks[b : b + n]
    out, notes, i = [], [], 0
    while i < len(parts):
        best = None
        for unit in range(1, min(max_unit, (len(parts) - i) // 2) + 1):
            if marks[i] != marks[i + unit]:
                continue
            chars = int(sizes[i + unit] - sizes[i])
            if chars < min_chars:
                continue
            n = _repeats(same, i, unit, len(marks))
            if n >= 2:
                best = max(best or (), ((n - 1) * chars, unit, n)) if best else ((n - 1) * chars, unit, n)
        if best:
            _, unit, n = best
            out += parts[i : i + unit]
            notes.append(f"consecutive_block_repeat: unit={unit}, repeats={n}")
            i += unit * n
        else:
            out.append(parts[i])
            i += 1
    return "".join(out), notes


def block_text(text: str, min_chars: int, max_unit: int = 1000) -> tuple[str, list[str]]:
    """Runs of text that repeat at once, wherever they start.

    Where a unit repeats, some place equals the one a unit further on over the
    whole unit; such runs are read off, per unit, from one comparison of the text
    with itself, so that only true starts are tried.
    """
    low = max(20, min_chars)
    folded = text.translate(_STRICT)
    n = len(folded)
    if n < 2 * low:
        return text, []
    codes = _codes(folded)
    if not repeats_window(codes, low):
        return text, []
    starts: dict[int, list[tuple[int, int]]] = {}
    for unit in range(low, min(max_unit, n // 2) + 1):
        equal = codes[:-unit] == codes[unit:]
        if int(np.count_nonzero(equal)) < unit:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= unit:
                starts.setdefault(unit, []).append((a, b))
    if not starts:
        return text, []
    _, places = indexed(text, _STRICT)
    removed, notes, i = [], [], 0
    firsts = sorted({a for spans in starts.values() for a, _ in spans})
    while i <= n - 2 * low:
        best = None
        for unit, spans in starts.items():
            for a, b in spans:
                if a <= i and i + unit <= b:
                    times = (b - i) // unit + 1
                    if times >= (2 if unit >= 160 else 3):
                        found = ((times - 1) * unit, unit, times)
                        best = found if best is None or found > best else best
        if best:
            _, unit, times = best
            start, end = places[i + unit], places[i + unit * times - 1] + 1
            while start > 0 and text[start - 1].isspace():
                start -= 1
            while end < len(text) and text[end].isspace():
                end += 1
            removed.append((start, end))
            notes.append(f"consecutive_text_block_repeat: len={unit}, repeats={times}")
            i += unit * times
            continue
        i += 1
        if not any(a <= i and i + unit <= b for unit, spans in starts.items() for a, b in spans):
            later = [a for a in firsts if a > i]
            if not later:
                break
            i = later[0]
    out, at = [], 0
    for start, end in sorted(removed):
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    out.append(text[at:])
    return "".join(out), notes


def compress_blocks(text: str, language: str, min_chars: int, max_unit: int) -> tuple[str, list[str]]:
    """Sentence blocks, then free text blocks."""
    own = text.replace("\r\n", "\n").replace("\r", "\n")
    if not own.strip():
        return text, []
    own, notes = block_sentences(own, language, min_chars, max_unit)
    own, more = block_text(own, min_chars)
    return own, notes + more


# --- Loops at the end ---------------------------------------------------------------------


def tail_loop(marks: Sequence[str], max_unit: int, rules: TailRules) -> tuple[int, int] | None:
    """(unit, repeats) of the loop at the end that removes most, the smaller unit on a tie."""
    best = None
    for unit in range(1, max_unit + 1):
        pattern, n = marks[-unit:], 1
        while (n + 1) * unit <= len(marks) and all(alike(a, b, rules.similarity) for a, b in zip(marks[len(marks) - (n + 1) * unit :], pattern)):
            n += 1
        if n >= rules.repeats and (best is None or (n - 1) * unit > (best[1] - 1) * best[0]):
            best = unit, n
    return best


def _cut_tail(items: list, marks: list[str], window: int, max_unit: int, rules: TailRules) -> tuple[list, tuple[int, int] | None]:
    first = max(0, len(items) - window)
    tail = marks[first:]
    found = tail_loop(tail, min(max_unit, len(tail) // rules.repeats), rules)
    if not found:
        return items, None
    unit, n = found
    return items[: len(items) - n * unit] + items[len(items) - unit :], found


def compress_tail(text: str, language: str, rules: TailRules) -> tuple[str, list[str]]:
    """The loop at the end of a text, by paragraphs, else by sentences; the last copy stays."""
    own = text.replace("\r\n", "\n").replace("\r", "\n").strip()
    if not own:
        return text, []
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n+", own) if p.strip()]
    for name, items, glue, window, unit in (
        ("paragraph", paragraphs, "\n\n", rules.paragraphs, rules.unit_paragraphs),
        ("sentence", None, "", rules.sentences, rules.unit_sentences),
    ):
        items = sentences(own, language) if items is None else items
        if len(items) < rules.repeats:
            continue
        marks = [""] * (len(items) - window) + [strict(x) for x in items[-window:]] if len(items) > window else [strict(x) for x in items]
        kept, found = _cut_tail(items, marks, window, unit, rules)
        if found:
            return glue.join(kept).strip(), [f"tail_{name}_repeat: unit={found[0]}, repeats={found[1]}, removed={(found[1] - 1) * found[0]}"]
    return own, []


_STAMPED = re.compile(r"\[\d+:\d{2}\s*(?:→|->)\s*\d+:\d{2}\]\s*")


def compress_stamped_tail(text: str, rules: TailRules) -> tuple[str, list[str]]:
    """The same on time-stamped lines; what follows the last of them stays."""
    own = text.replace("\r\n", "\n").replace("\r", "\n").strip()
    blocks = [b.strip() for b in own.split("\n") if b.strip()]
    stamped = [_STAMPED.match(b) for b in blocks]
    last = max((i for i, m in enumerate(stamped) if m), default=-1)
    if last < 0:
        return (own or text), []
    body, rest = blocks[: last + 1], blocks[last + 1 :]
    window = stamped[max(0, last + 1 - rules.blocks) : last + 1]
    n = sum(m is not None for m in window)
    if n < rules.repeats or n / len(window) < rules.timestamped:
        return own, []
    marks = [strict(b[m.end() :] if m else b) for b, m in zip(body, stamped)]
    kept, found = _cut_tail(body, marks, rules.blocks, rules.unit_blocks, rules)
    if not found:
        return own, []
    return "\n".join(kept + rest).strip(), [f"timestamps_tail_repeat: unit={found[0]}, repeats={found[1]}, removed={(found[1] - 1) * found[0]}"]


# --- Phrases, enumerations, short words --------------------------------------------------


def enumeration_period(parts: Sequence[str], least: int) -> int | None:
    """The period of a list that repeats from its start, a partial end allowed."""
    fold = [unicodedata.normalize("NFKC", p.strip()) for p in parts]
    for period in range(2, len(fold) // least + 1):
        whole = len(fold) // period
        run = 1
        while run < whole and fold[run * period : (run + 1) * period] == fold[:period]:
            run += 1
        if run >= least:
            return period
    return None


def collapse_enumeration(text: str, least: int = 3) -> str:
    """Sentences that list the same items over and over keep one round."""
    out = []
    for s in re.split(r"(?<=[。.!?！？])\s*", text):
        mark = re.search("[、,]", s)
        parts = re.split(rf"\s*{re.escape(mark[0])}\s*", s) if mark else []
        if len(parts) < 2 * least:
            out.append(s)
            continue
        end = re.search(r"[。.!?！？]+$", parts[-1])
        if end:
            parts[-1] = parts[-1][: end.start()].strip()
        period = enumeration_period(parts, least)
        out.append(("、" if mark[0] == "、" else ", ").join(parts[:period]) + (end[0] if end else "") if period else s)
    return " ".join(out).strip()


def is_enumeration(text: str, least: int = 3) -> bool:
    """Whether a text is a list of whole rounds of the same items."""
    mark = next((m for m in "、," if m in text), "")
    parts = [p for p in re.split(rf"\s*{re.escape(mark)}\s*", text) if p.strip()] if mark else []
    if len(parts) < 4:
        return False
    for period in range(2, len(parts) // 2 + 1):
        rounds = len(parts) // period
        if rounds >= least and all(parts[i] == parts[i % period] for i in range(rounds * period)):
            return True
    return False


@lru_cache(maxsize=16)
def _phrase_patterns() -> list[re.Pattern]:
    out = [re.compile(r"(.{%d,%d}?)\1{%d,}" % (a, b, n - 1)) for a, b, n in config.PHRASE_RANGES]
    low, high = min(r[0] for r in config.PHRASE_RANGES), max(r[1] for r in config.PHRASE_RANGES)
    return [*out, re.compile(r"(.{%d,%d})\s*\1+" % (low, high))]


def collapse_phrases(text: str, enumerations: int | None = None) -> str:
    """Phrases that repeat at once (W15); lists keep one round where asked for."""
    *ranges, flexible = _phrase_patterns()

    def one(m: re.Match) -> str:
        if enumerations and is_enumeration(m[0], enumerations):
            return collapse_enumeration(m[0], enumerations)
        return m[1]

    # Back-references are tried only where a comparison of the text with itself allows.
    low, high = min(r[0] for r in config.PHRASE_RANGES), max(r[1] for r in config.PHRASE_RANGES)
    gap = max(map(len, _SPACE.findall(text)), default=0)
    known, found = None, None
    for (first, last, times), p in zip(config.PHRASE_RANGES, ranges):
        if text != known:
            known, found = text, _recurring(_codes(text), low, high + min(gap, _WIDE_GAP))
        mask = _echo_mask(len(text), found, low, {unit: unit * (times - 1) for unit in range(first, last + 1)})
        text = _replace_at(p, text, mask, one)
    if text != known:
        gap = max(map(len, _SPACE.findall(text)), default=0)
        found = _recurring(_codes(text), low, high + min(gap, _WIDE_GAP))
    if gap <= _WIDE_GAP:
        mask = _echo_mask(len(text), found, low, {shift: max(low, shift - gap) for shift in range(low, high + gap + 1)})
    else:  # so much white space recurs that the text itself is compared
        codes = _codes(text)
        mask = np.zeros(len(codes), bool)
        for shift in range(low, high + gap + 1):
            _echoes(codes, shift, max(low, shift - gap), mask)
    return _replace_at(flexible, text, mask, lambda m: m[1])


def reduce_short_kana(text: str, original_length: int, plan: CleaningPlan, strict_reference: bool = True) -> str:
    """Short kana words that occur too often.

    As observed, a reduction drops every occurrence, also within longer words;
    with ``strict_reference=False`` it keeps the share that was meant to stay.
    """
    often = plan.base_threshold + original_length // plan.length_divisor * plan.length_factor
    counts: dict[str, int] = {}
    for w in text.split():
        w = re.sub(r"[。、！？]", "", w)
        if 1 <= len(w) <= 4 and re.fullmatch("[あ-んア-ン]+", w):
            counts[w] = counts.get(w, 0) + 1
    for w, n in counts.items():
        if w in config.PARTICLES:
            keep = plan.max_particles if n > plan.max_particles else None
        elif w in config.EXPRESSIONS:
            keep = max(2, int(n * plan.keep_ratio)) if n >= often * 1.5 else None
        else:
            keep = max(1, int(n * plan.keep_ratio)) if n >= often else None
        if keep is None or n <= keep:
            continue
        pattern = re.compile(re.escape(w) + r"[。、]?\s*")
        found = list(pattern.finditer(text))
        if len(found) < n - keep:
            continue
        if strict_reference:
            text = pattern.sub("", text)
        else:
            for m in reversed(found[len(found) - (n - keep) :]):
                text = text[: m.start()] + text[m.end() :]
    return text


def removed_text(before: str, after: str) -> str:
    """What a removal took, by common prefix and suffix."""
    n = min(len(before), len(after))
    start = next((i for i in range(n) if before[i] != after[i]), n)
    end = next((i for i in range(n - start) if before[-1 - i] != after[-1 - i]), n - start)
    return before[start : len(before) - end]


@lru_cache(maxsize=256)
def _python_pattern(java: str) -> re.Pattern:
    """A pattern of the configuration for Python: always Unicode, same possessive groups."""
    m = re.match(r"\(\?([a-zA-Z]+)\)", java)
    flags = 0
    if m:
        java = java[m.end() :]
        flags = (re.I if "i" in m[1] else 0) | (re.M if "m" in m[1] else 0) | (re.S if "s" in m[1] else 0)
    return re.compile(java.replace("\\z", "\\Z"), flags)


def _needle(pattern: str) -> str:
    """Lower-case text without which a pattern cannot match ('' where there is none)."""
    if pattern == config.KANA_SWITCH:
        return ""
    plain = re.sub(r"^\(\?[a-zA-Z]+\)", "", pattern)
    found = re.match(r"\(\?:((?:[^\W_]| )+)", plain) or re.match(r"(?:\\\[)?((?:[^\W_]| |[♪～])+)", plain)
    if found:
        return found[1].lower()
    return "・" if plain.count("・") > 2 else ""


@lru_cache(maxsize=8)
def artefact_rules(language: str) -> list[tuple[str, str, str]]:
    """(pattern, kind, needle) for a language, all of them for auto, instructions
    behind them (F18)."""
    table = config.ARTEFACT_PATTERNS
    order = ("ja", "en", "zh", "ko") if language == "auto" else (language if language in table else "ja",)
    out: list[tuple[str, str, str]] = []
    for code in order:
        out += [(p, kind, _needle(p)) for p, kind in table[code]]
        out += [(f"\\A{re.escape(p)}{config.ENDINGS[code]}?\\s*\\z", config.PHRASE, p.lower()) for p in config.INSTRUCTIONS]
    return out


def clean_artefacts(text: str, language: str, plan: CleaningPlan, with_paragraphs: bool = True) -> tuple[str, list[str], list[str]]:
    """Recogniser artefacts (C5): (text, issues, patterns that matched)."""
    size = len(text)
    matched: list[str] = []
    own = _python_pattern(config.META_BRACKETS).sub("", text)
    if own != text:
        matched.append("META_BRACKET")
    rules = artefact_rules(language)
    for _ in range(plan.iterations):
        start = len(own)
        low = own.lower()
        for pattern, kind, needle in rules:
            if needle not in low:
                continue
            before = len(own)
            if pattern == config.KANA_SWITCH:
                if _ANY_KANA.search(own):
                    own = reduce_short_kana(own, size, plan)
            else:
                rest = _python_pattern(pattern).sub("", own)
                if size and (before - len(rest)) / size <= (1.0 if kind == config.REPEAT else plan.pattern_limit):
                    own = rest
            if len(own) != before:
                matched.append(pattern)
                low = own.lower()
        own = collapse_phrases(own, plan.enumerations)
        if len(own) == start or (start - len(own)) / start > plan.iteration_limit:
            break
    own = re.sub("[￰-￿]", "", own)
    own = re.sub(r"\n{%d,}" % plan.newline_limit, "\n\n", re.sub(r"[ \t]+", " ", own)).strip()
    if with_paragraphs:
        own = compress_paragraphs(own, language, plan)
    own = collapse_sentences(own, language, plan)
    lost = (size - len(own)) / size if size else 0.0
    issues = []
    if lost > plan.excessive:
        issues.append(f"Excessive text reduction: {int(lost * 100 + 0.5)}% removed")
    if len(matched) > plan.high_patterns:
        issues.append(f"High number of hallucination patterns detected: {len(matched)}")
    return own, issues, matched


# --- Overlap between chunks ------------------------------------------------------------------


def longest_common(a: str, b: str, least: int, latest_start: int, earliest_end: int) -> tuple[int, int, int] | None:
    """(length, place in a, place in b) of the longest common run that starts early
    enough in b and ends late enough in a; the later one on a tie (M6).

    Runs grow from common pieces of the least length, of which most pairs of texts have
    few; texts that repeat themselves go by the table.
    """
    if not a or not b:
        return None
    hits = common_pieces(a, b, least, max(0, earliest_end - least))
    if hits is None:
        return longest_common_by_table(a, b, least, latest_start, earliest_end)
    best, runs, last = None, {}, None
    for at, places in hits:
        i, before = at + least, runs if last == at - 1 else {}
        runs, last = {}, at
        for place in places:
            j = place + least
            n = before.get(j - 1, 0) + 1
            if n == 1:
                n = least
                while n < i and n < j and a[i - n - 1] == b[j - n - 1]:
                    n += 1
            runs[j] = n
            if j - n <= latest_start and (best is None or (n, i, j) > best):
                best = (n, i, j)
    return (best[0], best[1] - best[0], best[2] - best[0]) if best else None


def common_pieces(a: str, b: str, size: int, first: int = 0) -> list[tuple[int, list[int]]] | None:
    """(place in a, places in b) of common pieces of a size, from a place in a on; None
    where there are so many that a table of both texts is cheaper."""
    if size < 1:
        return None
    index: dict[str, list[int]] = {}
    for j in range(len(b) - size + 1):
        index.setdefault(b[j : j + size], []).append(j)
    hits = [(i, index[g]) for i in range(first, len(a) - size + 1) if (g := a[i : i + size]) in index]
    return hits if sum(len(places) for _, places in hits) <= 20 * (len(a) + len(b)) else None


def longest_common_by_table(a: str, b: str, least: int, latest_start: int, earliest_end: int) -> tuple[int, int, int] | None:
    """``longest_common``, all diagonals at once: one comparison per character of a, no table kept."""
    x = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    y = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(1, len(y) + 1)
    run = np.zeros(len(y) + 1, np.int32)
    best = None
    for i in range(1, len(x) + 1):
        run[1:] = np.where(y == x[i - 1], run[:-1] + 1, 0)
        if i < earliest_end:
            continue
        ok = (run[1:] >= max(least, best[0] if best else 0)) & (place - run[1:] <= latest_start)
        if ok.any():
            n = int(run[1:][ok].max())
            j = int(place[ok & (run[1:] == n)].max())
            if best is None or (n, i, j) > best:
                best = (n, i, j)
    return (best[0], best[1] - best[0], best[2] - best[0]) if best else None


def inline_connector(previous: str, following: str) -> str:
    """'' or a space, the latter between Latin words that were apart (M9)."""
    rest = following.lstrip()
    if not previous or previous[-1].isspace() or not rest or len(rest) == len(following):
        return ""
    before = previous.rstrip().rstrip("」』”’\"'）)]】〉》〕］}")
    return " " if before and re.match("[A-Za-z0-9]", rest) and re.match("[A-Za-z0-9.,!?;:]", before[-1]) else ""


def _skip(text: str, at: int) -> int:
    while at < len(text) and not _LOOSE_TABLE[ord(text[at])]:
        at += 1
    return at


def _common(previous: str, current: str, least: int, plan: ModelPlan, soft: bool, folded: bool) -> tuple[str, str] | None:
    """(rest, connector) behind a common run of the end of one and the start of the other."""
    tail = previous[-max(500, plan.max_overlap) :]
    head = current[: max(500, plan.search_range)]
    latest = 250 if soft else max(60, len(head) // 4)
    trailing = 200 if soft else max(200, int(len(tail) * 0.8))
    if folded:
        (a, _), (b, places) = indexed(tail, _LOOSE_TABLE), indexed(head, _LOOSE_TABLE)
    else:
        a, b, places = tail, head, range(len(head))
    found = longest_common(a, b, max(20, least), latest, max(0, len(a) - trailing))
    if not found:
        return None
    n, _, at = found
    end = places[at + n - 1] + 1
    if folded:
        end = _skip(current, end)
    raw = current[end:]
    return raw.lstrip(), inline_connector(previous, raw)


def _trim_residue(previous: str, rest: str, least: int, plan: ModelPlan) -> str:
    """What is left of an overlap at the seam, twice at most (M8)."""
    for _ in range(2):
        for folded in (False, True):
            found = _common(previous, rest, least, plan, False, folded)
            if found and len(found[0]) < len(rest):
                rest = found[0]
                break
        else:
            return rest
    return rest


def _scan(candidate: str, text: str, until: int, plan: ModelPlan) -> int | None:
    """The end of the last like window of the candidate's length."""
    size = len(candidate)
    n = 2 if size < 50 else 3 if size < 200 else 4
    folded = loose(candidate)
    at, found = 0, None
    while at <= until - size:
        if jaccard(folded, loose(text[at : at + size]), n) >= plan.similarity:
            found = at + size
            at += size // 2
        at += 1
    return found


def find_overlap(previous: str, current: str, plan: ModelPlan) -> tuple[str, str, str]:
    """(rest of current, connector, kind): the ladder from exact to like (M5)."""
    if not previous or not current:
        return current or "", " ", "none"
    soft = max(20, plan.min_match)
    ladder = [("exact", plan.min_overlap, False, False), ("folded", plan.min_overlap, False, True)]
    if soft < plan.min_overlap:
        ladder += [("soft", soft, True, False), ("soft folded", soft, True, True)]
    for kind, least, gaps, folded in ladder:
        found = _common(previous, current, least, plan, gaps, folded)
        if found:
            return _trim_residue(previous, found[0], soft, plan), found[1], kind
    until = min(plan.search_range, len(current))
    for size in range(plan.max_overlap, plan.min_overlap - 1, -plan.step):
        candidate = previous[-size:]
        if len(candidate) < plan.min_overlap or len(candidate) > until:
            continue
        end = _scan(candidate, current, until, plan)
        if end is not None:
            raw = current[end:]
            return _trim_residue(previous, raw.lstrip(), soft, plan), inline_connector(previous, raw), "like"
    return current, " ", "none"


def merge_chunks(chunks: Iterable[tuple[str, float, float]], plan: ModelPlan, separator: str = "\n\n", remove: bool = True) -> str:
    """Left fold over (text, start, end): overlaps in time are sought in all text so far (M2)."""
    out, previous = None, None
    for text, start, end in chunks:
        if out is None:
            out = text
        elif remove and min(previous[1], end) - max(previous[0], start) > 0:
            rest, glue, kind = find_overlap(out, text, plan)
            out += (separator if kind == "none" else glue) + rest
        else:
            out += separator + text
        previous = (start, end)
    return (out or "").strip()


Segment = tuple[str, float, float]


def next_segment(last: Segment | None, new: Segment, window: float = 30.0, ratio: float = 0.5) -> tuple[Segment, bool]:
    """The open segment after a new one, and whether the last one is closed by it (M4).

    Repeats within the window and contained segments go; a half overlap extends.
    """
    if last is None:
        return new, False
    (before, first, until), (text, start, end) = last, new
    if text.strip() == before.strip() and start - first <= window:
        return last, False
    if start < until:
        if end <= until:
            return last, False
        if (until - start) / (end - start) >= ratio:
            return (f"{before} {text}", first, end), False
    return new, True


def dedupe_segments(segments: Iterable[Segment], window: float = 30.0, ratio: float = 0.5) -> list[Segment]:
    """Ordered segments without repeats and containments (M4)."""
    out, last = [], None
    for new in segments:
        before = last
        last, closed = next_segment(last, new, window, ratio)
        if closed:
            out.append(before)
    return out + [last] if last else out


class ChunkMachine:
    """Chunks from frame labels by length and silence (W2, P17, T4), frame by frame.

    A chunk after the first starts an overlap before the end of the last one kept;
    chunks below the least length are dropped and move nothing.
    """

    def __init__(self, plan: ModelPlan, frame_seconds: float = 0.03, state: tuple | None = None):
        self.plan, self.frame_seconds = plan, frame_seconds
        self.start, self.kept_end, self.silent, self.end, self.made = state or (None, 0.0, 0.0, 0.0, 0)

    @property
    def state(self) -> tuple:
        return self.start, self.kept_end, self.silent, self.end, self.made

    def close(self) -> tuple[int, float, float, bool] | None:
        """The open chunk as (id, start, end, has overlap), if it is long enough."""
        start, self.start = self.start, None
        if start is None or self.end - start < self.plan.min_chunk:
            return None
        self.made += 1
        return self.made - 1, start, self.end, self.end > self.kept_end + self.plan.overlap_seconds

    def step(self, frame: int, t: float, label: int, last: bool) -> tuple[int, float, float, bool] | None:
        """Take a frame; returns the chunk that it ends."""
        if label < 0:
            return None
        plan = self.plan
        self.silent = 0.0 if label == 1 else self.silent + self.frame_seconds
        if self.start is None:
            self.start = t if frame == 0 else self.kept_end
        self.end = t + self.frame_seconds
        size = self.end - self.start
        wish = plan.chunk_seconds
        quiet = label != 1 and ((size >= wish and self.silent >= plan.min_silence) or (size >= wish + plan.force_after and self.silent > plan.min_silence / 5))
        if last or size >= wish + plan.variance_seconds or (size >= wish - plan.variance_seconds and quiet):
            made = self.close()
            if made:
                self.kept_end = self.end - plan.overlap_seconds
            return made
        return None


def duplicate_spans(text: str, least: int, similarity: float, reach: int = 1000) -> str:
    """Later repeats of passages within reach removed (W24; off in every plan).

    Every place within reach of a passage is compared by the grams of the folded text.
    Only those are measured whose grams occur often enough in the passage: the number
    of such places is a running sum, and no likeness can exceed it.
    """
    if len(text) < 2 * least:
        return text
    size = 3 if least < 100 else 5 if least < 500 else 7
    folded, places = indexed(text, _LOOSE_TABLE)
    # Where the folded text of a place starts; its end is the start of the next one.
    first = np.searchsorted(np.array(places, np.int64), np.arange(len(text) + 1))
    known: dict[str, int] = {}
    grams = np.array([known.setdefault(folded[i : i + size], len(known)) for i in range(len(folded) - size + 1)], np.int64)
    mark = np.zeros(len(known) + 1, bool)
    gone: list[tuple[int, int]] = []
    covered = np.zeros(len(text) + 1, bool)
    i = 0
    while i < len(text) - least:
        if covered[i]:
            i += 1
            continue
        own = grams[first[i] : max(first[i], first[i + least] - size + 1)]
        starts = np.arange(i + least, min(i + reach, len(text)) - least + 1)
        if len(own) and len(starts):
            mark[own] = True
            inside = np.concatenate([[0], np.cumsum(mark[grams])])
            low, high = first[starts], np.maximum(first[starts], first[starts + least] - size + 1)
            near = starts[inside[high] - inside[low] >= similarity * len(np.unique(own))]
            mark[own] = False
            after = 0
            for s in near.tolist():
                if s < after or covered[s] or jaccard(loose(text[i : i + least]), loose(text[s : s + least]), size) < similarity:
                    continue
                end = s + least
                while end < len(text) and text[i + end - s] == text[end]:
                    end += 1
                if jaccard(loose(text[i : i + end - s]), loose(text[s:end]), size) >= similarity:
                    gone.append((s, end))
                    covered[s:end] = True
                    after = end
        i += 1
    return "".join(c for c, g in zip(text, covered) if not g) if gone else text


# --- Fuzzy overlap (library function) ---------------------------------------------------------

# A character and its variants in loose transcription.
VARIANTS = {"ー": "〜～―", "、": "，,", "。": "．.", " ": "　\t"}
_VARIANT_OF = {ord(v): ord(base) for base, own in VARIANTS.items() for v in own}


def fuzzy_equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether code points are equal, one kana in both scripts, or a listed variant (F8)."""
    hira = lambda x, y: (x >= 0x3040) & (x <= 0x309F) & (y == x + 0x60)
    own = (a == b) | hira(a, b) | hira(b, a)
    for variant, base in _VARIANT_OF.items():
        own |= (a == variant) & (b == base) | (a == base) & (b == variant)
    return own


@lru_cache(maxsize=1)
def _fuzzy_pairs() -> frozenset[tuple[str, str]]:
    """Different characters that ``fuzzy_equal`` takes for one, in both orders."""
    own = [(chr(c), chr(c + 0x60)) for c in range(0x3040, 0x30A0)] + [(chr(v), chr(k)) for v, k in _VARIANT_OF.items()]
    return frozenset(own + [(q, p) for p, q in own])


def fuzzy_run(x: np.ndarray, y: np.ndarray, chars: tuple[str, str], i: int, j: int, step: int, near: int = 64) -> int:
    """How many characters from places i and j on are fuzzily equal, ahead or back: the
    nearest ones by hand, as most runs end there, then all at once."""
    (a, b), pairs = chars, _fuzzy_pairs()
    most = min(len(a) - i, len(b) - j) if step > 0 else min(i, j) + 1
    n = 0
    while n < most and n < near:
        p, q = a[i + step * n], b[j + step * n]
        if p != q and (p, q) not in pairs:
            return n
        n += 1
    if n == most:
        return n
    same = fuzzy_equal(x[i + n :][: most - n], y[j + n :][: most - n]) if step > 0 else fuzzy_equal(x[i - most + 1 : i - n + 1][::-1], y[j - most + 1 : j - n + 1][::-1])
    return n + (len(same) if same.all() else int(same.argmin()))


def fuzzy_overlap(a: str, b: str, least: int = 20, similarity: float = 0.8, size: int = 3, screen: bool = True) -> tuple[int, int, int, float] | None:
    """(place in a, place in b, length, similarity) of the best fuzzy common run.

    With ``screen``, common n-grams are seeds, in order of their places; one within 50
    characters of the last seed taken, in both texts, is passed over.  A seed grows both
    ways while characters are fuzzily equal; of the runs of ``least`` or more whose
    n-gram similarity is enough, the one with the largest similarity times length wins,
    the first among equals.  Without it, see ``aligned_overlap``.
    """
    if len(a) < least or len(b) < least:
        return None
    x, y = _codes(a).astype(np.int64), _codes(b).astype(np.int64)
    if not screen:
        return aligned_overlap(x, y, least, similarity)
    chars = a, b
    index: dict[str, list[int]] = {}
    for j in range(len(b) - size + 1):
        index.setdefault(b[j : j + size], []).append(j)
    best, taken = None, None
    for i in range(len(a) - size + 1):
        for j in index.get(a[i : i + size], ()):
            if taken and abs(i - taken[0]) <= 50 and abs(j - taken[1]) <= 50:
                continue
            taken = i, j
            lead = fuzzy_run(x, y, chars, i - 1, j - 1, -1)
            n = lead + fuzzy_run(x, y, chars, i, j, 1)
            if n < least:
                continue
            like = jaccard(a[i - lead : i - lead + n], b[j - lead : j - lead + n], size)
            if like >= similarity and (best is None or like * n > best[2] * best[3]):
                best = (i - lead, j - lead, n, like)
    return best


def aligned_overlap(x: np.ndarray, y: np.ndarray, least: int, similarity: float, window: int = 200) -> tuple[int, int, int, float] | None:
    """The aligned run of up to ``window`` characters with most fuzzily equal ones, at
    least 80 % of them, whatever lies between; the first place in a, then in b."""
    best = None
    for shift in range(-(len(x) - least), len(y) - least + 1):
        i0, j0 = max(0, -shift), max(0, shift)
        same = fuzzy_equal(x[i0:][: len(y) - j0], y[j0:][: len(x) - i0])
        sums = np.concatenate([[0], np.cumsum(same)])
        for n in range(least, min(window, len(same)) + 1):
            hits = sums[n:] - sums[:-n]
            k = int(hits.argmax())
            share = hits[k] / n
            if share >= max(0.8, similarity):
                found = (int(hits[k]), -(i0 + k), -(j0 + k), -n, float(share))
                best = max(best, found) if best else found
    return (-best[1], -best[2], -best[3], best[4]) if best else None


def exact_duplicate(a: str, b: str, least: int = 10, window: int = 500) -> tuple[int, int, int] | None:
    """(length, place in a, place in b) of the longest text that starts in the last
    ``window`` characters of a and in the first of b; the first among equals (M12)."""
    hits = common_pieces(a, b[: window + least - 1], least, max(0, len(a) - window))
    if hits is None:
        return exact_duplicate_by_table(a, b, least, window)
    best, runs, last = None, {}, None
    for i, places in reversed(hits):
        after = runs if last == i + 1 else {}
        runs, last = {}, i
        for j in places:
            n = after.get(j + 1, 0) + 1
            if n == 1:
                n = least
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
            runs[j] = n
            if best is None or (n, -i, -j) > best:
                best = (n, -i, -j)
    return (best[0], -best[1], -best[2]) if best else None


def exact_duplicate_by_table(a: str, b: str, least: int, window: int) -> tuple[int, int, int] | None:
    """``exact_duplicate`` by a comparison per character of a."""
    x, y = _codes(a), _codes(b)
    run = np.zeros(len(y) + 1, np.int64)
    best = None
    for i in range(len(x) - 1, max(0, len(x) - window) - 1, -1):
        # How far both texts agree from i and each place of b on.
        run[:-1] = np.where(y == x[i], run[1:] + 1, 0)
        head = run[: min(len(y), window)]
        if len(head) and head.max() >= max(least, best[0] if best else 0):
            best = (int(head.max()), i, int(head.argmax()))
    return best


def best_window(segment: str, words: Sequence[str]) -> tuple[int, float] | None:
    """Start and similarity of the window of words most like a segment."""
    n = len(segment.split())
    if not n or not words:
        return None
    scores = [(edit_similarity(segment, " ".join(words[i : i + n])), -i) for i in range(max(1, len(words) - n + 1))]
    score, at = max(scores)
    return -at, score


def edit_similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return (longest - row[-1]) / longest


# --- Packing and splitting ----------------------------------------------------------------------


_CUT_MARKS = [re.compile(p) for p in ("[。！？]", "[.!?]", "[、,]")]


def split_line(line: str, most: int) -> list[str]:
    """A long line cut behind the last sentence end, else comma, else hard.

    The places of all marks are known beforehand; a cut is the last place of the
    strongest kind within reach, and the space behind it goes with the mark.
    """
    marks = [[m.start() for m in p.finditer(line)] for p in _CUT_MARKS]
    out, at, end = [], 0, len(line)
    while end - at > most:
        reach, cut = at + most, at + most
        for places in marks:
            k = bisect_left(places, reach) - 1
            if k >= 0 and places[k] >= at:
                cut = places[k] + 1
                while cut < reach and line[cut].isspace():
                    cut += 1
                break
        out.append(line[at:cut])
        rest = line[cut:end]
        at, end = cut + len(rest) - len(rest.lstrip()), end - (len(rest) - len(rest.rstrip()))
    return [*out, line[at:end]] if at < end else out


def pack_lines(text: str, most: int) -> list[str]:
    """Lines packed greedily into segments of at most ``most`` characters."""
    out, own, size = [], "", 0
    for line in text.split("\n"):
        need = len(line) + 1
        if size + need <= most:
            own += ("\n" if own else "") + line
            size += need
            continue
        if own:
            out.append(own)
        if need > most:
            *full, last = split_line(line, most) or [""]
            out += full
            own, size = last, len(last)
        else:
            own, size = line, need
    return [*out, own] if own else out


def token_chunks(text: str, max_tokens: int = 3000) -> list[tuple[str, int, int, int]]:
    """(text, tokens, start, end) of pieces within a token budget.

    A piece ends behind a blank line in its last 30 %, else behind the last sentence
    in its first 70 %.  The overlap of the interface has no effect, as observed.
    """
    whole = int(-(-len(text) // config.CHARS_PER_TOKEN["auto"]))
    if whole <= max_tokens:
        return [(text, whole, 0, len(text))]
    cuts = token_cuts(text, max_tokens)
    return [(text[a:b].strip(), -(-(b - a) // 4), a, b) for a, b in zip(cuts, cuts[1:])]


def token_cuts(text: str, max_tokens: int) -> list[int]:
    """Where the pieces of a text beyond the budget start, and its end."""
    size = int(max_tokens * config.CHARS_PER_TOKEN["auto"])
    blanks = [m.start() for m in re.finditer(r"\n(?=\n)", text)]
    ends = list(re.finditer(r"[.!?。！？]\s+", text))
    starts = [m.start() for m in ends]
    cuts = [0]
    while cuts[-1] < len(text):
        at, reach = cuts[-1], cuts[-1] + size
        blank = bisect_left(blanks, reach - 1) - 1
        mark = bisect_right(starts, at + int(size * 0.7)) - 1
        if reach >= len(text):
            cut = len(text)
        elif blank >= 0 and blanks[blank] - at > size * 0.7:
            cut = blanks[blank] + 2
        elif mark >= 0 and starts[mark] >= at and starts[mark] + 1 < reach:
            cut = min(ends[mark].end(), reach)
        else:
            cut = reach
        cuts.append(cut)
    return cuts


def last_sentences(text: str, most: int) -> str:
    """The last whole sentences within a length, else the end of the text."""
    kept, size = [], 0
    for s in reversed(re.split(r"(?<=[。.!?！？\n])", text)):
        s = s.strip()
        if not s:
            continue
        need = len(s) + (1 if kept else 0)
        if size + need > most:
            break
        kept.insert(0, s)
        size += need
    return " ".join(kept) or (text[-most:] if most else text)


def continuation(text: str, language: str = "auto") -> str:
    """The text that may go on as context: blocks and loops at the end taken out."""
    own = compress_blocks(text.strip(), language, 120, 20)[0]
    return compress_tail(own, language, TailRules(paragraphs=8, sentences=20, unit_paragraphs=3, unit_sentences=5))[0].strip()


def user_pattern(pattern: str) -> tuple[str, bool]:
    """A pattern given by a user, as the pattern to run and whether it is a literal.

    ``/body/flags`` is taken as it says; else signs of a pattern make it one, line by
    line where it has anchors or line feeds, case-blind where it mixes cases; what does
    not compile, and all else, is literal text.
    """
    given = re.fullmatch(r"/(.*)/([gimuy]*)", pattern, re.S)
    if given and given[1]:
        flags = "".join(f for f in "im" if f in given[2])
        return (f"(?{flags})" if flags else "") + given[1], False
    if not given and re.search(r"[\^$\\.*+?\[\]{}()|]", pattern):
        flags = "i" * bool(re.search("[a-z]", pattern) and re.search("[A-Z]", pattern)) + "m" * any(x in pattern for x in ("^", "$", "\\n"))
        try:
            re.compile(pattern)
            return (f"(?{flags})" if flags else "") + pattern, False
        except re.error:
            pass
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", pattern), True


# --- Meta information ------------------------------------------------------------------------------
# Labels by field, tried in this order, longer labels first.
META_LABELS = {
    "speakers": "話者|発言者|参加者|Speakers?|发言人|參加者|화자|발언자",
    "topic": "トピック・議題|トピック|議題|主題|Topics?|Agenda|主题|议题|議題|주제|안건|의제",
    "datetime": "日時|日付|時間|Date/Time|Date|Time|日期时间|日期時間|일시|날짜|시간",
    "location": "場所|会場|Location|Place|地点|地點|장소|회장",
    "keywords": "キーワード|Keywords?|关键词|關鍵詞|키워드",
    "summary": "要約|概要|Summary|摘要|개요|요약",
    "notes": "その他|備考|メモ|Notes?|Other|备注|備註|기타|비고|메모",
}
META_TITLES = {"speakers": "話者", "topic": "議題", "datetime": "日時", "location": "場所", "summary": "要約", "notes": "備考"}


@lru_cache(maxsize=1)
def _labels() -> list[tuple[str, re.Pattern]]:
    return [(k, re.compile(rf"(?:{v})[：:]?\s*", re.I)) for k, v in META_LABELS.items()]


def parse_meta(raw: str, most_keywords: int = 30) -> tuple[list[str], str]:
    """Keywords and context of labelled lines.

    A label opens a section, which has the lines up to the next label.  Sections become
    fields, the last of a name counts; lines before the first label and those behind
    the line of the keywords are context.
    """
    lines = [x for x in map(str.strip, raw.split("\n")) if x]
    found = [next(((name, m.end()) for name, p in _labels() if (m := p.match(x))), None) for x in lines]
    opens = [i for i, f in enumerate(found) if f]
    context = lines[: opens[0]] if opens else lines
    fields: dict[str, str] = {}
    for i, until in zip(opens, [*opens[1:], len(lines)]):
        name, cut = found[i]
        first, rest = lines[i][cut:].strip(), lines[i + 1 : until]
        fields[name] = first if name == "keywords" else "\n".join([first, *rest]).strip()
        context = context + rest if name == "keywords" else context
    words = [w.strip() for w in re.split("[,、，]", fields.get("keywords", "")) if w.strip()]
    told = [f"{title}: {fields[k]}" for k, title in META_TITLES.items() if fields.get(k)]
    return words[:most_keywords], "\n".join(told + context)
