"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs without white space, reduced to their letters and digits and
lower-cased; runs without any are no tokens.  Letters of scripts that are written
without spaces (Thai to Khmer, Chinese, kana) are a token each.  Fixed masks look
at 7 of 8 to 10 consecutive tokens and ignore the rest.  Hashes of the test items
under each mask are joined with those of the training texts; each hit fixes a
diagonal (text position less item position), and the aligned tokens on it are
compared.

A text holds a passage of an item if some ``WINDOW`` aligned tokens agree in all
but ``MISMATCHES`` places.  The masks are lossless for that: any 2 substitutions
in 13 tokens leave a mask untouched somewhere.  Items of fewer than 13 tokens must
occur whole, without substitution; those below ``SHORTEST`` are looked up by a hash
of all their tokens.  Items of fewer than ``ALONE`` tokens are found in any prose:
they count where they are the whole text.

Test items are a stated query set.  They are indexed in blocks of bounded size,
written to the shared folder with their sorted tables; the texts are read and
hashed once, and a task takes each block once for all texts it holds, so no text is
shuffled and no item passes through the driver.  Hits on passages that repeat
themselves are cut to the ends of the runs (``ItemIndex``).

Defined cases: null and empty texts have no hits; null items and items without
tokens are ignored; items with equal ``item_id`` are separate items whose best hit
counts; repeated texts give repeated rows; null ids pass through as null; other
columns are ignored by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import whitespace_runs
from .common import read_whole, scratch_path, slices, write_once, written

# Fixed masks; a family without gap for 13 tokens with 2 substitutions.
MASKS = ("11101111", "1110100111", "1100111011", "1111001011")
WINDOW = 13
MISMATCHES = 2
#: Items below it are looked up whole; below the second, as whole texts only.
SHORTEST, ALONE = 10, 5
#: The masks, and for items too short for them one of each length.
TABLES = (*MASKS, *("1" * n for n in range(1, SHORTEST)))
#: Characters of test items that share a block of the index.
ITEM_BLOCK_CHARS = 4 << 20
#: Bytes of text that meet a block together, and of those that are held while the blocks go by.
TEXT_BYTES = 8 << 20
HELD_BYTES = 64 << 20
#: Blocks that a worker keeps.
KEPT_BLOCKS = 2
FILTER_BITS = 22
#: Letters that are a token each: Thai to Myanmar, Khmer, CJK and kana, and their supplements.
UNSPACED = "[\u0e00-\u109f\u1780-\u17ff\u2e80-\u9fff\ua000-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff]"


def token_value(run: str) -> int:
    """A 64-bit value of a token, 0 for a run without letters and digits."""
    if not run.isalnum():
        run = "".join([c for c in run if c.isalnum()])
        if not run:
            return 0
    return xxhash.xxh3_64_intdigest(run.lower().encode("utf-8", "surrogatepass")) or 1


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token counts of some texts and all token values, end to end."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(texts, UNSPACED)).as_py():
        texts = pc.replace_substring_regex(texts, f"({UNSPACED})", " \\1 ")
    counts, flat = whitespace_runs(texts)
    coded = flat.dictionary_encode()
    values = np.array([token_value(x) for x in coded.dictionary.to_pylist()], np.uint64)
    stream = values[coded.indices.to_numpy()] if len(values) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    real = stream != 0
    return np.bincount(owner[real], minlength=len(counts)), stream[real]


def mask_hashes(stream: np.ndarray, mask: str) -> np.ndarray:
    """The hash under a mask at every place where the mask fits in the stream."""
    n = len(stream) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(int("1" + mask, 2)))
    for k, on in enumerate(mask):
        if on == "1":
            out = (out ^ stream[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def _with_before(h: np.ndarray, at: np.ndarray, first: np.ndarray, none: int) -> np.ndarray:
    """A mix of the hash at each place and of that at the place before; ``first`` places have ``none`` before."""
    before = np.where(first, np.uint64(none), h[np.maximum(at - 1, 0)])
    out = (h[at] ^ before * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(32)


class ItemIndex:
    """Mask hashes of a block of test items, sorted, with their places.

    A hit whose predecessor on the same diagonal is a hit as well says nothing new.
    Places are therefore sorted by their hash and the hash before: a place of a text
    meets those of its hash that have *another* hash before them, two ranges of the
    table.  In periodic passages, where all hashes recur, these are the ends of the
    runs alone: hits grow with the lengths and not with their product.
    """

    def __init__(self, item_ids: np.ndarray, known: np.ndarray, stream: np.ndarray, length: np.ndarray, tables: list[tuple[np.ndarray, ...]]):
        self.item_ids, self.known, self.stream, self.length, self.tables = item_ids, known, stream, length, tables
        self.start = np.cumsum(length) - length
        self.owner = np.repeat(np.arange(len(length)), length)
        self.known_bits = np.zeros(1 << FILTER_BITS, bool)
        for hashes, *_ in tables:
            self.known_bits[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    @classmethod
    def of(cls, item_ids: list[int | None], texts: pa.Array) -> ItemIndex:
        counts, stream = tokens_of(texts)
        owner, start = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
        tables = []
        for mask in TABLES:
            h = mask_hashes(stream, mask)
            at = np.flatnonzero(owner[: len(h)] == owner[len(mask) - 1 :]) if len(h) else np.zeros(0, np.int64)
            size = counts[owner[at]]
            at = at[size >= SHORTEST] if mask in MASKS else at[size == len(mask)]
            mixed = _with_before(h, at, at == start[owner[at]], 0) if len(at) else np.zeros(0, np.uint64)
            order = np.lexsort((mixed, h[at]))
            at, mixed = at[order], mixed[order]
            # Runs of equal mixes, in order of the mix: where each lies in the table.
            first = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]])) if len(at) else np.zeros(0, np.int64)
            by_mix = np.argsort(mixed[first], kind="stable")
            tables.append((h[at], at, mixed[first][by_mix], first[by_mix], np.append(first, len(at))[1:][by_mix]))
        return cls(np.array([i or 0 for i in item_ids], np.int64), np.array([i is not None for i in item_ids], bool), stream, counts, tables)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        tables = {f"t{k}_{j}": x for k, t in enumerate(self.tables) for j, x in enumerate(t)}
        np.savez(out, item_ids=self.item_ids, known=self.known, stream=self.stream, length=self.length, **tables)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> ItemIndex:
        held = np.load(io.BytesIO(data))
        return cls(*(held[k] for k in ("item_ids", "known", "stream", "length")), [tuple(held[f"t{k}_{j}"] for j in range(5)) for k in range(len(TABLES))])

    def hits(self, counts: np.ndarray, stream: np.ndarray) -> np.ndarray:
        """Distinct (text, item, diagonal) of all seed hits."""
        owner = np.repeat(np.arange(len(counts)), counts)
        starts = np.cumsum(counts) - counts
        found = []
        for mask, (hashes, places, mixes, first, last) in zip(TABLES, self.tables):
            if not len(places):
                continue
            h = mask_hashes(stream, mask)
            at = np.flatnonzero(self.known_bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            at = at[owner[at] == owner[at + len(mask) - 1]]
            if len(mask) < ALONE:
                at = at[counts[owner[at]] == len(mask)]
            low, high = (np.searchsorted(hashes, h[at], side) for side in ("left", "right"))
            at, low, high = (x[high > low] for x in (at, low, high))
            if not len(at):
                continue
            # Of the range of the hash, the part before and behind those with the same hash before.
            mixed = _with_before(h, at, at == starts[owner[at]], 1)
            run = np.minimum(np.searchsorted(mixes, mixed), len(mixes) - 1)
            same = (mixes[run] == mixed) & (first[run] >= low) & (last[run] <= high)
            left, right = np.where(same, first[run], high), np.where(same, last[run], high)
            for begin, each in ((low, left - low), (right, high - right)):
                total = int(each.sum())
                if total:
                    place = places[np.arange(total) + np.repeat(begin - (np.cumsum(each) - each), each)]
                    where = np.repeat(at, each)
                    text, item = owner[where], self.owner[place]
                    found.append(np.unique(np.stack([text, item, (where - starts[text]) - (place - self.start[item])], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def verify(self, tokens: np.ndarray, item: int, diagonal: int) -> tuple[int, int] | None:
        """(matched, text position) of the best window on a diagonal, if it passes."""
        own = self.stream[self.start[item] : self.start[item] + self.length[item]]
        low, high = max(0, -diagonal), min(len(own), len(tokens) - diagonal)
        window = min(WINDOW, len(own))
        if high - low < window:
            return None
        same = own[low:high] == tokens[low + diagonal : high + diagonal]
        sums = np.cumsum(np.concatenate([[0], same]))
        sums = sums[window:] - sums[:-window]
        best = int(sums.argmax())
        if sums[best] < window - (MISMATCHES if window == WINDOW else 0):
            return None
        return int(sums[best]), low + diagonal + best

    def leaks(self, counts: np.ndarray, stream: np.ndarray) -> Iterator[tuple[tuple[int, int | None], tuple[int, int, int]]]:
        """((text, item_id), (-matched, position, window)) of each verified hit that betters those of its text and item.

        Diagonals go by the first place that they can have in the text, and end with
        the first that is equal throughout: no later one can be better.
        """
        starts = np.cumsum(counts) - counts
        hits = self.hits(counts, stream)
        hits = hits[np.lexsort((hits[:, 2], np.maximum(hits[:, 2], 0), hits[:, 1], hits[:, 0]))]
        pair, best = None, None
        for text, item, diagonal in hits.tolist():
            if (text, item) != pair:
                pair, best, window = (text, item), None, min(WINDOW, int(self.length[item]))
            if best and best[0] == -window and best[1] <= max(0, diagonal):
                continue
            got = self.verify(stream[starts[text] : starts[text] + counts[text]], item, diagonal)
            if got and (best is None or (-got[0], got[1]) < best[:2]):
                best = (-got[0], got[1], window)
                yield (text, int(self.item_ids[item]) if self.known[item] else None), best


@lru_cache(maxsize=KEPT_BLOCKS)
def block_of(uri: str) -> ItemIndex:
    """A block of the index; a small test set stays in its worker between tasks."""
    return ItemIndex.from_bytes(read_whole(uri))


def write_index(items: DataFrame, folder: str, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Index the items in blocks below ``folder``; returns the files, one per millions of characters."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if not total:
        return []
    limit = ITEM_BLOCK_CHARS

    def build(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, n, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block() -> pa.RecordBatch:
            uri = f"{folder}/items-{part:05d}-{n:05d}.npz"
            write_once(uri, ItemIndex.of(ids, pa.array(texts, pa.string())).to_bytes())
            return pa.RecordBatch.from_arrays([pa.array([uri])], names=["file"])

        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if texts and size + len(text) > limit:
                    yield block()
                    n, ids, texts, size = n + 1, [], [], 0
                ids.append(item)
                texts.append(text)
                size += len(text)
        if texts:
            yield block()

    dealt = rows.repartition(int(total // limit) + 1)
    return sorted(r.file for r in written(dealt.mapInArrow(build, "file string"), "item-files").collect())


Leak = tuple[int, int | None, int, int, int]


def leaks_of(batches: Iterator[pa.RecordBatch], text_col: str, files: list[str]) -> Iterator[tuple[pa.RecordBatch, list[Leak]]]:
    """Each piece of the batches with its leaks: (row, item_id, matched, window, position), the best per row and item id.

    Pieces are gathered and every block is read once for all of them, unless the
    worker keeps all blocks anyhow.
    """

    def met(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Leak]]]:
        tokens = [tokens_of(b.column(b.schema.get_field_index(text_col))) for b in held]
        best: list[dict[tuple[int, int | None], tuple[int, int, int]]] = [{} for _ in held]
        for uri in files:
            for own, (counts, stream) in zip(best, tokens):
                for key, new in block_of(uri).leaks(counts, stream):
                    if key not in own or new < own[key]:
                        own[key] = new
        for b, own in zip(held, best):
            yield b, [(t, i, -m, w, p) for (t, i), (m, p, w) in sorted(own.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0))]

    limit = TEXT_BYTES if len(files) <= KEPT_BLOCKS else HELD_BYTES
    held: list[pa.RecordBatch] = []
    size = 0
    for b in slices(batches, text_col, TEXT_BYTES):
        if held and size + b.nbytes > limit:
            yield from met(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield from met(held)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, window, position) of all verified passages.

    A row per text and item: the tokens that agree in the best window, its length
    and its place in the text's tokens (the first among equals).
    """
    files = write_index(items, scratch_path(docs.sparkSession, "items"))
    schema = "doc_id long, item_id long, matched int, window int, position long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias(text_col))
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int32()), ("window", pa.int32()), ("position", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b, got in leaks_of(batches, text_col, files):
            doc = b.column(0).to_pylist()
            columns = [[doc[r[0]] for r in got], *([r[k] for r in got] for k in range(1, 5))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The texts without any verified passage, all their columns kept."""
    files = write_index(items, scratch_path(docs.sparkSession, "items"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b, got in leaks_of(batches, text_col, files):
            keep = np.ones(b.num_rows, bool)
            keep[[r[0] for r in got]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


# Of 13 places with 2 that differ some 4 in a row agree: equal runs of 4 tokens give all
# diagonals.  For items of 4 tokens or more in texts written with spaces.
LEAK_SQL = r"""
WITH runs AS (
  SELECT 'd' AS kind, doc_id AS id, unnest(regexp_split_to_array(text, '[\s\x0B\x1C-\x1F\x85\pZ]+')) AS run, generate_subscripts(regexp_split_to_array(text, '[\s\x0B\x1C-\x1F\x85\pZ]+'), 1) AS i FROM documents
  UNION ALL
  SELECT 'i', item_id, unnest(regexp_split_to_array(text, '[\s\x0B\x1C-\x1F\x85\pZ]+')), generate_subscripts(regexp_split_to_array(text, '[\s\x0B\x1C-\x1F\x85\pZ]+'), 1) FROM benchmark),
clean AS (SELECT kind, id, i, lower(regexp_replace(run, '[^\pL\pN]', '', 'g')) AS token FROM runs),
tokens AS (SELECT kind, id, token, row_number() OVER (PARTITION BY kind, id ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY kind, id) AS n FROM clean WHERE token <> ''),
grams AS (
  SELECT kind, id, pos, n, token || ' ' || lead(token, 1) OVER w || ' ' || lead(token, 2) OVER w || ' ' || lead(token, 3) OVER w AS gram
  FROM tokens WINDOW w AS (PARTITION BY kind, id ORDER BY pos)),
diagonals AS (
  SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.pos - i.pos AS shift, i.n AS n, least(13, i.n) AS size
  FROM grams d JOIN grams i ON d.gram = i.gram AND d.kind = 'd' AND i.kind = 'i' WHERE i.n >= 5 OR d.n = i.n),
same AS (
  SELECT g.doc_id, g.item_id, g.shift, g.n, g.size, i.pos, d.pos IS NOT NULL AS inside, coalesce(i.token = d.token, false)::INT AS hit
  FROM diagonals g JOIN tokens i ON i.kind = 'i' AND i.id = g.item_id
  LEFT JOIN tokens d ON d.kind = 'd' AND d.id = g.doc_id AND d.pos = i.pos + g.shift),
windows AS (
  SELECT a.doc_id, a.item_id, a.size, a.pos + a.shift AS position, sum(b.hit) AS matched, bool_and(b.inside) AS whole
  FROM same a JOIN same b ON b.doc_id = a.doc_id AND b.item_id = a.item_id AND b.shift = a.shift AND b.pos BETWEEN a.pos AND a.pos + a.size - 1
  WHERE a.pos <= a.n - a.size GROUP BY ALL),
good AS (SELECT * FROM windows WHERE whole AND matched >= size - CASE WHEN size = 13 THEN 2 ELSE 0 END)
SELECT doc_id, item_id, max(matched)::INT AS matched, any_value(size)::INT AS window, arg_min(position, (-matched, position))::BIGINT AS position
FROM good GROUP BY doc_id, item_id
"""
