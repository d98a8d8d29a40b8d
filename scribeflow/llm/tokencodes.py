"""Token-id files of directly addressable codes.

Ids are cut into chunks of ``CHUNK_BITS`` bits.  Level 0 holds the low chunk of
every id, level k the next chunk of the ids that go on; a bitmap per level says
which ids go on, and a rank directory (ones before each 512-bit block) turns the
place of an id on one level into its place on the next.  Any token is read from
its position with one look per level, without decoding a block.

One file holds the documents of one range of ``doc_id`` in ascending order, with
an index of document ids and local starts.  A manifest table names the files that
committed and their token counts; global starts come from its prefix sums, taken
in Spark.  A file's name follows from its part, so that a task that runs again
writes the same file.

Defined cases: null text counts as empty; an empty text has the end id only;
documents with null ``doc_id`` come first; those with equal or null ``doc_id`` are
ordered by a hash of their text, equal ones as read; an empty table writes no
file and reads back as no row; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WORD_END, PairIndexCodec
from .common import read_whole, scratch_path, slices, write_once

MAGIC = b"DACT0001"
CHUNK_BITS = 8
RANK_BLOCK = 512
#: Bytes of text that a file covers, about.
FILE_BYTES = 16 << 20
#: Files whose token counts are summed together before the sums over groups.
GROUP_FILES = 4096
#: Distinct words remembered by one worker, and words of one question to the library.
CACHE_WORDS, ASKED_WORDS = 500_000, 4_000


class AddressableIds:
    """Chunk levels, continuation bitmaps and rank directories of an id array."""

    def __init__(self, size: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.size, self.levels = size, levels

    @classmethod
    def build(cls, ids: np.ndarray) -> AddressableIds:
        rest, levels = ids.astype(np.uint32), []
        while True:
            chunk = (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8)
            rest = rest >> CHUNK_BITS
            on = rest > 0
            bits = np.packbits(on, bitorder="little")
            bits = np.append(bits, np.zeros(-len(bits) % (RANK_BLOCK // 8), np.uint8))
            ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, RANK_BLOCK // 64).sum(1, dtype=np.uint64)
            levels.append((chunk, bits, np.concatenate([[0], np.cumsum(ones)]).astype(np.uint64)))
            rest = rest[on]
            if not len(rest):
                return cls(len(ids), levels)

    def __getitem__(self, i: int) -> int:
        """One token by its position."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for k, (chunk, bits, rank) in enumerate(self.levels):
            value |= int(chunk[i]) << (CHUNK_BITS * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BLOCK
            inner = np.unpackbits(bits[block * RANK_BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BLOCK]
            i = int(rank[block]) + int(inner.sum())
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The tokens of a range, addressed level by level."""
        value = np.zeros(stop - start, np.uint32)
        at, low, high = np.arange(stop - start), start, stop
        for k, (chunk, bits, rank) in enumerate(self.levels):
            value[at] |= chunk[low:high].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            first = low // RANK_BLOCK * RANK_BLOCK
            on = np.unpackbits(bits[first >> 3 : (high + 7) >> 3], bitorder="little")[: high - first].astype(bool)
            before = int(rank[first // RANK_BLOCK]) + int(on[: low - first].sum())
            on = on[low - first :]
            at = at[on]
            if not len(at):
                break
            low, high = before, before + len(at)
        return value

    def to_bytes(self) -> bytes:
        out = [struct.pack("<QI", self.size, len(self.levels))]
        for chunk, bits, rank in self.levels:
            out.append(struct.pack("<QQQ", len(chunk), len(bits), len(rank)))
            out += [chunk.tobytes(), bits.tobytes(), rank.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: memoryview) -> AddressableIds:
        size, n = struct.unpack_from("<QI", data)
        at, levels = 12, []
        for _ in range(n):
            a, b, c = struct.unpack_from("<QQQ", data, at)
            at += 24
            chunk = np.frombuffer(data, np.uint8, a, at)
            bits = np.frombuffer(data, np.uint8, b, at + a)
            rank = np.frombuffer(data, np.uint64, c, at + a + b)
            levels.append((chunk, bits, rank))
            at += a + b + 8 * c
        return cls(size, levels)


def pack_file(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: magic, document index (ids, null marks, local starts), codes."""
    ends = np.cumsum(counts).astype(np.uint64)
    head = MAGIC + struct.pack("<Q", len(doc_ids)) + doc_ids.astype(np.int64).tobytes() + known.astype(np.uint8).tobytes() + ends.tobytes()
    return head + AddressableIds.build(ids).to_bytes()


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, AddressableIds]:
    view = memoryview(data)
    if bytes(view[:8]) != MAGIC:
        raise ValueError("not a token-id file")
    n = struct.unpack_from("<Q", view, 8)[0]
    doc_ids = np.frombuffer(view, np.int64, n, 16)
    known = np.frombuffer(view, np.uint8, n, 16 + 8 * n).astype(bool)
    ends = np.frombuffer(view[16 + 9 * n :], np.uint64, n).astype(np.int64)
    return doc_ids, known, ends, AddressableIds.from_bytes(view[16 + 17 * n :])


class LibraryEncoder(PairIndexCodec):
    """The tokenizers library, asked once for each distinct word of a block.

    Words are split as for pair merging, and some thousands are put to the library
    as one text; the ids of a word end at the token that carries the mark of a word's
    end.  A text has the ids of its words, end to end.
    """

    cache_entries = CACHE_WORDS

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        super().__init__(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.closes = np.zeros(len(self.token_strings), bool)
        self.closes[[i for i, s in self.tokens.items() if s.endswith(WORD_END)]] = True

    def merge_block(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for at in range(0, len(words), ASKED_WORDS):
            block = b" ".join(words[at : at + ASKED_WORDS]).decode()
            own = np.array(self.library.encode_batch_fast([block], add_special_tokens=False)[0].ids, np.int32)
            stops = np.flatnonzero(self.closes[own]) + 1
            if len(stops) != len(words[at : at + ASKED_WORDS]):
                raise ValueError("the library splits words further than the reader of texts")
            lengths.append(np.diff(stops, prepend=0))
            ids.append(own)
        return np.concatenate(lengths), np.concatenate(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _with_end(counts: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return counts + 1, np.insert(ids, np.cumsum(counts), end_id)


def with_starts(files: DataFrame) -> DataFrame:
    """Add the tokens before each file: prefix sums within groups of files, then over the groups."""
    files = files.withColumn("_group", F.floor(F.col("part") / GROUP_FILES))
    inner = Window.partitionBy("_group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = files.groupBy("_group").agg(F.sum("n_tokens").alias("_sum"))
    # One row per thousands of files: the only step that takes them in one task.
    outer = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_group", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    out = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(groups, "_group")
    return out.withColumn("start", (F.col("start") + F.col("_before")).cast("long")).drop("_group", "_before")


def write_tokens(df: DataFrame, path: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files in ascending document order; returns the manifest.

    The manifest (file, part, n_docs, n_tokens, start) is a table in ``folder``.
    Rows of one ``doc_id`` (or none) are dealt by a hash of their text and their place
    as well, so that no range has more than its share however often an id repeats.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_at": F.monotonically_increasing_id()})
    order = ["doc_id", "_hash", "_at"]
    ordered = rows.repartitionByRange(int(total // FILE_BYTES) + 1, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        own, docs, known, counts, ids = encoder(path), [], [], [], []
        for b in slices(batches, "text", 8 << 20):
            c, i = _with_end(*own.encode_block(b.column(1)), end_id)
            docs.append(pa.compute.fill_null(b.column(0), 0).to_numpy())
            known.append(pa.compute.is_valid(b.column(0)).to_numpy(zero_copy_only=False))
            counts.append(c)
            ids.append(i.astype(np.uint32))
        if docs:
            part = TaskContext.get().partitionId()
            name = f"{folder}/tokens-{part:07d}.dac"
            counts = np.concatenate(counts)
            write_once(name, pack_file(np.concatenate(docs), np.concatenate(known), counts, np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([part], pa.int32()), pa.array([len(counts)], pa.int64()), pa.array([int(counts.sum())], pa.int64())],
                names=["file", "part", "n_docs", "n_tokens"],
            )

    files = ordered.select("doc_id", "text").mapInArrow(run, "file string, part int, n_docs long, n_tokens long")
    files.write.parquet(f"{folder}/files")
    spark = df.sparkSession
    with_starts(spark.read.schema(files.schema).parquet(f"{folder}/files")).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    n = max(1, manifest.count())

    def run(batches):
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc_ids, known, ends, codes = unpack_file(read_whole(name))
                starts = np.concatenate([[0], ends[:-1]])
                crc = []
                for lo in range(0, len(ends), 4096):
                    hi = min(lo + 4096, len(ends))
                    first = int(starts[lo])
                    ids = codes.slice(first, int(ends[hi - 1])).astype("<u4").tobytes()
                    crc += [zlib.crc32(ids[4 * (s - first) : 4 * (e - first)]) for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=~known), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return manifest.select("file", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(manifest: DataFrame, position: int) -> int:
    """One token of the whole corpus by its global position."""
    row = manifest.where((F.col("start") <= position) & (F.col("start") + F.col("n_tokens") > position)).first()
    if row is None:
        raise IndexError(position)
    return unpack_file(read_whole(row["file"]))[3][position - row["start"]]


def token_table(df: DataFrame, path: str) -> DataFrame:
    """Write all documents, then read the files back."""
    return read_tokens(write_tokens(df, path, scratch_path(df.sparkSession, "tokens")))
