"""Language identification by cross-parsing with suffix automata.

A bounded sample of labelled text per language becomes a suffix automaton, which
accepts exactly the substrings of the sample.  Its edges take a bounded table for
frequent letters and a sorted list for others, whatever the script.  A text is parsed greedily against
each automaton: a phrase is the longest match from the current place (a letter
unknown to the sample is a phrase of its own).  The fewer phrases a language
needs per letter, the lower the cross entropy; the language with the fewest
normalised phrases wins, the smallest name among equals.

Texts are lower-cased; runs of anything but letters and marks become one space.  They are
parsed in segments of ``SEGMENT`` characters, each of which starts a new phrase,
so that all segments of a block advance together, a character a step, in arrays.

Labels are learned from rows whose crc32 of the decimal ``doc_id`` is not
divisible by 5, ``SAMPLE_CHARS`` folded characters per language, drawn by a hash
of the id: the parameter bounds the automata.  Each automaton is built once, on an
executor, and written as arrays to the shared folder.  Workers read ``ROUND``
languages at a time and parse every block of texts in rounds, so that hundreds of
languages take no more memory than sixteen.

Defined cases: a null text, or one without letters, is ``und`` with score 0; a
null language is never learned; without any labelled text all rows are ``und``;
null ids are never learned from and not held out; an empty table gives an empty
result; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fraction_hash, read_whole, scratch_path, slices, write_once, written
from .toxicity import held_out

SAMPLE_CHARS = 40_000
#: Most characters that one row gives to a sample: samples mix many rows.
ROW_CHARS = 2_000
SEGMENT = 1_024
#: Letters of a language with a column of their own in the table of moves.
DENSE = 40
#: Languages whose automata a worker holds at once.
ROUND = 16
#: Up to so many languages, their sizes are sent to all executors; beyond, texts are shuffled to them.
BROADCAST_LANGUAGES = 10_000
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def folded(text: str | None) -> str:
    """Lower-cased letters and the marks on them, with one space for each run of anything else.

    Numerals of all kinds are no letters.  Without any letter the result is empty.
    """
    held = _OTHER.sub(" ", (text or "").lower()).strip()
    return held if _LETTER.search(held) else ""


class Automaton:
    """Suffix automaton of a text: its edges as arrays of state, letter (code point) and state."""

    def __init__(self, text: str):
        moves: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in map(ord, text):
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p != -1:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.size = len(moves)
        sizes = np.fromiter(map(len, moves), np.int64, len(moves))
        self.source = np.repeat(np.arange(self.size), sizes)
        self.letter = np.fromiter(chain.from_iterable(moves), np.int64, int(sizes.sum()))
        self.target = np.fromiter(chain.from_iterable(m.values() for m in moves), np.int64, int(sizes.sum()))


def pack(text: str, dense: int = DENSE) -> bytes:
    """The automaton of a sample as arrays: a table of moves for the ``dense`` most
    frequent letters, and a sorted list of edges by others."""
    own = Automaton(text)
    common = sorted(Counter(text).items(), key=lambda x: (-x[1], x[0]))
    letters = np.array([ord(c) for c, _ in common], np.int64)
    # Column 0: a letter that the sample lacks; the last: one of the sorted list.
    columns = np.minimum(np.arange(len(common)) + 1, dense + 1)
    code = np.zeros(0x110000, np.int64)
    code[letters] = columns
    column = code[own.letter]
    few = column == dense + 1
    table = np.full((own.size, dense + 2), -1, np.int32)
    table[own.source[~few], column[~few]] = own.target[~few]
    keys = own.source[few] << 21 | own.letter[few]
    order = np.argsort(keys)
    out = io.BytesIO()
    np.savez(out, table=table, letters=letters, columns=columns, keys=keys[order], targets=own.target[few][order])
    return out.getvalue()


class Parser:
    """The automata of some languages in one table.

    Each language has columns for its own ``DENSE`` most frequent letters; edges by its
    other letters are a sorted list of (state, letter).  So a state takes as much for
    a language of thousands of signs as for one of thirty letters.
    """

    def __init__(self, packed: list[bytes]):
        own = [np.load(io.BytesIO(x)) for x in packed]
        tables = [x["table"] for x in own]
        starts = np.cumsum([0, *[len(t) for t in tables]])
        self.roots = starts[:-1]
        self.width = tables[0].shape[1]
        self.rare = self.width - 1
        self.code = np.zeros((len(own), 0x110000), np.uint8 if self.width < 256 else np.uint16)
        # -1 stands for no move; the state of a language is its own plus the start.
        kind = np.int32 if starts[-1] < 1 << 31 else np.int64
        self.flat = np.concatenate([np.where(t < 0, -1, t.astype(kind) + kind(start)).ravel() for t, start in zip(tables, starts)])
        for k, x in enumerate(own):
            self.code[k, x["letters"]] = x["columns"]
        # Sorted within a language, and languages in order of their states.
        self.keys = np.concatenate([x["keys"] + (int(start) << 21) for x, start in zip(own, starts)])
        self.targets = np.concatenate([x["targets"] + start for x, start in zip(own, starts)]).astype(kind)

    def moves(self, state: np.ndarray, column: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The next state for each text and language, -1 where there is none."""
        move = self.flat[state * self.width + column]
        if len(self.keys):
            text, language = np.nonzero(column == self.rare)
            if len(text):
                key = state[text, language] << 21 | points[text].astype(np.int64)
                at = np.searchsorted(self.keys, key)
                at[at == len(self.keys)] = 0
                move[text, language] = np.where(self.keys[at] == key, self.targets[at], -1)
        return move

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each folded text in each language: (texts, languages)."""
        out = np.zeros((len(texts), len(self.roots)), np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        per = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), per)
        nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        start = np.repeat(np.cumsum(sizes) - sizes, per) + nth * SEGMENT
        length = np.minimum(SEGMENT, sizes[owner] - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        k = len(self.roots)
        state = np.tile(self.roots, (len(order), 1))
        count = np.ones((len(order), k), np.int32)  # the phrase that is open
        active = np.searchsorted(-length, -np.arange(SEGMENT), "left")  # segments longer than a step
        for step in range(int(length[0]) if len(length) else 0):
            n = int(active[step])
            letter = points[start[:n] + step]
            column = self.code[:, letter].T
            move = self.moves(state[:n], column, letter)
            broken = move < 0
            if broken.any():
                fresh = state[:n] == self.roots
                count[:n] += broken & ~fresh
                again = self.moves(np.broadcast_to(self.roots, (n, k)), column, letter)
                move = np.where(broken, again, move)
                # An unknown letter is a phrase by itself: the next starts behind it.
                alone = move < 0
                count[:n] += alone
                move = np.where(alone, self.roots, move)
            state[:n] = move
        # A phrase that was only opened behind an unknown last letter is none.
        count -= state == self.roots
        np.add.at(out, owner, count)
        return out


@lru_cache(maxsize=1)
def parser(files: tuple[str, ...]) -> Parser:
    """The automata of a round of languages; a worker keeps the last round between tasks."""
    return Parser([read_whole(x) for x in files])


@dataclass(frozen=True)
class Languages:
    """Learned languages: their names in order, and the files of their automata."""

    names: tuple[str, ...]
    files: tuple[str, ...]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the winner's share of the letters per phrase of all languages."""
        clean = [folded(t) for t in texts]
        named, score = ["und"] * len(texts), np.zeros(len(texts))
        at = [i for i, t in enumerate(clean) if t]
        if not at or not self.names:
            return named, score
        own = [clean[i] for i in at]
        rounds = [parser(self.files[k : k + ROUND]).phrases(own) for k in range(0, len(self.files), ROUND)]
        # Normalised by the letters, as phrases per letter.
        rate = np.concatenate(rounds, 1) / np.array([len(t) for t in own])[:, None]
        best = rate.argmin(1)
        total = (1 / rate).sum(1)
        for i, b, r, s in zip(at, best.tolist(), rate, total):
            named[i] = self.names[b]
            score[i] = (1 / r[b]) / s
        return named, score


def sampled(texts: list[str], chars: int = SAMPLE_CHARS) -> str:
    """A folded sample from the texts of a language, in their order."""
    held = ""
    for text in texts:
        if len(held) >= chars:
            break
        held = (held + " " + folded(text))[:chars]
    return held.strip()


def learn(docs: DataFrame, folder: str, chars: int = SAMPLE_CHARS) -> Languages:
    """A bounded folded sample of each language becomes an automaton in a file of its own.

    A language's sample is drawn and its automaton built in one task; the driver sees
    names and files.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    size = F.least(F.length("text"), F.lit(ROW_CHARS))
    sizes = written(rows.groupBy("lang").agg(F.sum(size).alias("size")), "language-sizes")
    # A rate per language draws about three times what is needed, on any input size.
    drawn = rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGUAGES else sizes, "lang").where(fraction_hash(F.col("doc_id"), seed=8) * F.col("size") < 3.0 * chars + 3 * ROW_CHARS)
    piece = drawn.select("lang", F.substring("text", 1, ROW_CHARS).alias("text"), F.xxhash64("doc_id").alias("draw"), "doc_id")

    def build(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        text = sampled(own.sort_by([("draw", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])["text"].to_pylist(), chars)
        if not text:
            return pa.table({"lang": pa.array([], pa.string()), "file": pa.array([], pa.string())})
        name = f"{folder}/{hashlib.sha256(lang.encode()).hexdigest()}.npz"
        write_once(name, pack(text))
        return pa.table({"lang": [lang], "file": [name]})

    held = sorted((r.lang, r.file) for r in written(piece.groupBy("lang").applyInArrow(build, "lang string, file string"), "languages").collect())
    return Languages(tuple(n for n, _ in held), tuple(f for _, f in held))


def identify(docs: DataFrame, languages: Languages, text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every text."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, text_col, 8 << 20):
            named, score = languages.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(named, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_table(docs: DataFrame) -> DataFrame:
    out = identify(docs, learn(docs, scratch_path(docs.sparkSession, "automata")))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
