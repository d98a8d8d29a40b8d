"""Line deduplication by a sharded minimal perfect hash.

Every document gives the 128-bit hashes of its distinct line keys, written once.  A
grouped count with partial aggregation keeps the hashes found in two documents or
more, with their smallest document.  These go to shards by the top bits of the
hash; each shard task builds a minimal perfect hash (levels of bit arrays) and
writes it with three arrays: fingerprint, count and first document.  The hashes of
the documents (24 bytes a line, no text) are then dealt in order of the shards and
probe the arrays: a task holds one shard at a time and reads each of its shards
once.  A hash that very many documents have is dealt to several tasks, as order
within a shard is by document.  The marks of lines that go are joined to the
documents by ``doc_id``.  What is read of the index grows with the lines, not with
lines times shards.

A hash in one document only never loses a line, so it need not be indexed; the
fingerprint (64 further bits) tells it from the indexed ones.

Defined cases: null or empty text is one empty line; short keys never match; a
repeated line in one document only stays; rows with null ``doc_id`` are not
counted and lose no line; rows that share a ``doc_id`` count as one document and
each keeps or loses lines alike; an empty table gives an empty result; other
columns pass through, but for those with the names of the three that are added,
which are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_BYTES, read_whole, scratch_path, slices, write_once, written

MIN_KEY_CHARS = 10
#: Keys per shard: a shard of so many takes about 6 MB while it is probed.
SHARD_KEYS = 1 << 18
#: Line hashes that one task probes, about: 24 bytes each.
PROBE_LINES = 1 << 20
MIX = 0x9E3779B97F4A7C15


def line_key(line: bytes) -> bytes:
    """A UTF-8 line stripped of ASCII white space, A-Z lower-cased."""
    return line.strip(SPACE_BYTES).lower()


def _long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (len(key) >= 4 * chars or len(key.decode("utf-8", "surrogatepass")) >= chars)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: bit arrays tried in turn.

    A key sits on the first level where it alone claims a bit; its slot is the
    number of set bits before that one.  Keys left after the last level are kept
    as a sorted list behind the others.
    """

    LEVELS, GAMMA = 48, 2.0

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray, int]], rest: np.ndarray, size: int):
        self.levels, self.rest, self.size = levels, rest, size

    @staticmethod
    def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        x = keys ^ np.uint64((MIX * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (x ^ (x >> np.uint64(33))) % np.uint64(bits)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels, base = keys.astype(np.uint64), [], 0
        for level in range(cls.LEVELS):
            if not len(left):
                break
            bits = -(-max(64, int(len(left) * cls.GAMMA)) // 64) * 64
            place = cls._place(left, level, bits)
            alone = np.bincount(place.astype(np.int64), minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.uint64)
            levels.append((bits, words, np.cumsum(ones) - ones, base))
            base += int(ones.sum())
            left = left[~alone[place]]
        return cls(levels, np.sort(left), len(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; keys never indexed get any slot, or -1."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        base = 0
        for level, (bits, words, before, base) in enumerate(self.levels):
            place = self._place(keys[left], level, bits)
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            hit = (words[word] >> bit & np.uint64(1)).astype(bool)
            w, b = word[hit], bit[hit]
            below = np.bitwise_count(words[w] & ((np.uint64(1) << b) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = base + before[w].astype(np.int64) + below
            left = left[~hit]
        if len(self.rest) and len(left):
            at = np.searchsorted(self.rest, keys[left])
            at[at == len(self.rest)] = 0
            hit = self.rest[at] == keys[left]
            out[left[hit]] = self.size - len(self.rest) + at[hit]
        return out

    def to_bytes(self) -> bytes:
        out = [struct.pack("<QQQ", self.size, len(self.levels), len(self.rest))]
        for bits, words, before, base in self.levels:
            out += [struct.pack("<QQ", bits, base), words.tobytes(), before.tobytes()]
        return b"".join([*out, self.rest.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[PerfectHash, int]:
        size, n, rest = struct.unpack_from("<QQQ", data, at)
        at, levels = at + 24, []
        for _ in range(n):
            bits, base = struct.unpack_from("<QQ", data, at)
            k = bits // 64
            words = np.frombuffer(data, np.uint64, k, at + 16)
            before = np.frombuffer(data, np.uint64, k, at + 16 + 8 * k)
            levels.append((bits, words, before, base))
            at += 16 + 16 * k
        return cls(levels, np.frombuffer(data, np.uint64, rest, at), size), at + 8 * rest


def _shard_bytes(h: np.ndarray, f: np.ndarray, count: np.ndarray, first: np.ndarray) -> bytes:
    mph = PerfectHash.build(h)
    slot = mph.slots(h)
    arrays = [np.empty(len(h), t) for t in (np.uint64, np.uint8, np.int64)]
    arrays[0][slot], arrays[1][slot], arrays[2][slot] = f, np.minimum(count, 255), first
    return mph.to_bytes() + b"".join(a.tobytes() for a in arrays)


class Shard:
    def __init__(self, data: bytes):
        self.mph, at = PerfectHash.from_bytes(data)
        n = self.mph.size
        self.mark = np.frombuffer(data, np.uint64, n, at)
        self.count = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.first = np.frombuffer(data[at + 9 * n :], np.int64, n)

    def probe(self, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document counts (0: not indexed; 255: that many or more) and first documents."""
        slot = self.mph.slots(h)
        known = (slot >= 0) & (self.mark[slot] == f)
        return np.where(known, self.count[slot], 0), np.where(known, self.first[slot], 0)


def _hashes(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit halves of the 128-bit hash of each key."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(k) for k in keys]), "<u8").reshape(-1, 2)


def line_hashes(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h, f, doc): the hash of each distinct long enough line key of each row."""

    def keys(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, text_col, 8 << 20):
            docs, found = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if doc is None or not text:
                    continue
                own = {k for k in map(line_key, text.encode("utf-8", "surrogatepass").split(b"\n")) if _long_enough(k, min_chars)}
                found += own
                docs += [doc] * len(own)
            h = _hashes(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs, pa.int64())], names=["h", "f", "doc"])

    return df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias(text_col)).mapInArrow(keys, "h long, f long, doc long")


def _shard(bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")


def shard_file(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:010d}.mph"


def build_index(lines: DataFrame, folder: str, shard_keys: int) -> tuple[int, DataFrame]:
    """Write the shards; returns the number of shard bits and a row (shard) for each."""
    grouped = lines.groupBy("h", "f").agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    # Rows that share a doc_id are one document.
    shared = written(grouped.where("n > 1 and first <> last").drop("last"), "lines-shared")
    bits = max(0, int(shared.count() // shard_keys).bit_length())

    def build(batches: Iterator[pa.RecordBatch]):
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(5)]
            for s in np.unique(cols[4]).tolist():
                parts.setdefault(s, []).append(tuple(c[cols[4] == s] for c in cols[:4]))
        for s, held in parts.items():
            h, f, n, first = (np.concatenate(x) for x in zip(*held))
            write_once(shard_file(folder, s), _shard_bytes(h.view(np.uint64), f.view(np.uint64), n, first))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64())], names=["shard"])

    dealt = shared.withColumn("shard", _shard(bits)).repartition(1 << bits, "shard").select("h", "f", "n", "first", "shard")
    return bits, written(dealt.mapInArrow(build, "shard long"), "shards")


def probe(lines: DataFrame, folder: str, bits: int) -> DataFrame:
    """(doc, h) of the lines that go: indexed, and first in another document."""
    parts = int(lines.count() // PROBE_LINES) + 1
    asked = lines.withColumn("shard", _shard(bits))
    asked = asked.repartitionByRange(parts, "shard", F.xxhash64("doc", "h")).sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]):
        held: tuple[int, Shard | None] = (-1, None)
        for b in batches:
            h, f, doc, shard = (b.column(i).to_numpy() for i in range(4))
            gone = np.zeros(len(h), bool)
            for part in np.split(np.arange(len(h)), np.flatnonzero(np.diff(shard)) + 1) if len(h) else ():
                s = int(shard[part[0]])
                if s != held[0]:
                    held = (s, load_shard(shard_file(folder, s)))  # one shard at a time
                if held[1] is not None:
                    n, first = held[1].probe(h[part].view(np.uint64), f[part].view(np.uint64))
                    gone[part] = (n > 1) & (first != doc[part])
            yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(h[gone])], names=["doc", "h"])

    return asked.select("h", "f", "doc", "shard").mapInArrow(run, "doc long, h long")


def load_shard(uri: str) -> Shard | None:
    """A shard, or None where no shared line falls into it."""
    try:
        return Shard(read_whole(uri))
    except FileNotFoundError:
        return None


def dedup_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_KEY_CHARS,
    shard_keys: int = SHARD_KEYS,
    columns: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped"),
) -> DataFrame:
    """Add the kept text, the lines before and the lines dropped to each row.

    A line stays unless its key is long enough, is in two documents or more, and
    this is not the smallest ``id_col`` that holds it.
    """
    spark = df.sparkSession
    folder = scratch_path(spark, "line-index")
    lines = written(line_hashes(df, id_col, text_col, min_chars), "line-hashes")
    bits, _ = build_index(lines, folder, shard_keys)
    # A document has no more marks than lines.
    marks = written(probe(lines, folder, bits).groupBy("doc").agg(F.collect_list("h").alias("marks")), "line-marks")
    df = df.drop(*columns)
    schema = T.StructType([*df.schema.fields, T.StructField(columns[0], T.StringType()), T.StructField(columns[1], T.LongType()), T.StructField(columns[2], T.LongType())])
    # Rows without doc_id are dealt by their text: they find no mark.
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), key.alias("key"), F.col(id_col).isNotNull().alias("known"))
    # The marks are the small side of each partition: no text is sorted.
    joined = rows.join(marks.hint("shuffle_hash"), (F.col("key") == F.col("doc")) & F.col("known"), "left").select("row.*", F.col("marks").alias("scribeflow:marks"))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, text_col, 8 << 20):
            texts, held = pc.fill_null(b.column(at).cast(pa.string()), ""), b.column(b.num_columns - 1)
            counts = pc.add(pc.count_substring(texts, "\n"), 1).to_numpy()
            kept, dropped = texts.to_pylist() if held.null_count < len(held) else texts, np.zeros(len(texts), np.int64)
            for i in np.flatnonzero(held.is_valid()).tolist():
                own = kept[i].split("\n")
                wanted = [line_key(x.encode("utf-8", "surrogatepass")) for x in own]
                gone = np.isin(_hashes(wanted)[:, 0].view(np.int64), held[i].values.to_numpy()) if wanted else np.zeros(0, bool)
                dropped[i] = gone.sum()
                kept[i] = "\n".join([x for x, g in zip(own, gone.tolist()) if not g])
            out = [*b.columns[:-1], pa.array(kept, pa.string()) if isinstance(kept, list) else kept, pa.array(counts, pa.int64()), pa.array(dropped)]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)


def line_table(df: DataFrame) -> DataFrame:
    """The digest of what stays, per document."""
    kept = dedup_lines(df.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


LINE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT rid, doc_id, i, lines[i] AS line,
         translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM docs, unnest(generate_series(1, len(lines))) AS u(i)),
shared AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 AND doc_id IS NOT NULL
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT rid, doc_id, i, line, coalesce(doc_id <> first, false) AS gone
  FROM lines LEFT JOIN shared USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
