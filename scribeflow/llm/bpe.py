"""BPE encoding and decoding with a pair occurrence index.

All distinct words of a block are laid out as one row of symbols.  An index maps
each adjacent pair to all its positions; active ranks leave a heap in ascending
order; a merge visits the positions of its pair only and updates the lists of
the pairs it makes.  A word is merged once per block and remembered after that.

Defined cases: null text counts as empty; an empty text has no ids and decodes to
the empty string; texts of any length are encoded whole; ids
outside the vocabulary are left out by decoding; repeated rows give repeated
results; other columns of the input are passed through by ``encode``/``decode``
and may have any names but that of the output.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Entries kept in the caches of one worker before they start afresh.
CACHE_ENTRIES = 300_000
#: Distinct words merged together: the index of one block holds their places.
BLOCK_WORDS = 400_000
#: Bytes of text that share a block.
BLOCK_BYTES = 4 << 20
WORD_END = "</w>"
_SPLIT_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\w²³¹¼½¾\n]|_)+|\n")
_WHITE = re.compile(r"[\t-\r\x20\x85\xa0  -     　]+")
_BEYOND = re.compile(r"[ɐ-\U0010ffff]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def gather(counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expand codes into their runs of values; counts are of codes, then of values."""
    starts = np.cumsum(lengths) - lengths
    each = lengths[codes]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    where = np.arange(total) + np.repeat(starts[codes] - (ends - each), each)
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return np.diff(bounds), values[where]


def whitespace_runs(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many runs without Unicode white space each text has, and the runs."""
    texts = pa.compute.fill_null(texts, "")
    runs = pa.compute.utf8_split_whitespace(texts)
    # Arrow also cuts at four control characters that are not white space.
    if pa.compute.any(pa.compute.match_substring_regex(texts, "[\\x1c-\\x1f]")).as_py():
        runs = pa.array([[x for x in _WHITE.split(t) if x] for t in texts.to_pylist()], pa.list_(pa.string()))
    return np.diff(runs.offsets.to_numpy()), runs.flatten()


class PairIndexCodec:
    """Encoder and decoder for a byte-level BPE vocabulary with word ends."""

    cache_entries = CACHE_ENTRIES

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as src:
            spec = json.load(src)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokens = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        size = max(self.tokens) + 1
        self.token_strings = pa.array([self.tokens.get(i, "") for i in range(size)], pa.string())
        self.number_strings = pa.array([str(i) for i in range(size)], pa.string())
        merged = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merged]
        table = np.array(self.merges, np.int64)
        keys = (table[:, 0] << 32) | table[:, 1]
        self.pair_ranks = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_ranks]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + WORD_END] for s in symbols], np.int32)
        self.from_symbol = {s: b for b, s in enumerate(symbols)}
        # Only the normaliser and the splitter of the library serve rare characters.
        self.library = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        """Empty the cache: the place of each word met, and the runs of their ids."""
        self.words: dict[str | bytes | int, int] = {}
        self.word_lengths = np.zeros(0, np.int64)
        self.word_ids = np.zeros(0, np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where no merge exists."""
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge_block(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words of a block together by ascending rank: lengths, and ids end to end."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        ends = np.cumsum([len(w) for w in words])
        # Slot n stands for "outside the word" on either side; no pair has symbol -1.
        symbol = np.append(self.inner[data], -1).astype(np.int32)
        symbol[ends - 1] = self.final[data[ends - 1]]
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        after[ends - 1] = n
        before[0] = n
        before[ends[:-1]] = n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(places: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks >= 0
            places, ranks = places[known], ranks[known]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, p in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts) if len(cuts) else (places,)):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)

        inside = np.flatnonzero(after[:n] < n).astype(np.int32)
        add(inside, self._ranks(symbol[inside], symbol[after[inside]]))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            a, b, made = self.merges[r]
            places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            places = places[(symbol[places] == a) & (symbol[after[places]] == b)]
            if a == b and len(places) > 1:
                # In a run of one symbol every second place merges, from the left.
                places = np.unique(places)
                fresh = np.append(True, after[places[:-1]] != places[1:])
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - first) % 2 == 0]
            if not len(places):
                continue
            gone = after[places]
            beyond = after[gone]
            symbol[places] = made
            symbol[gone] = -1
            after[places] = beyond
            before[beyond] = places
            ahead, beyond = before[places], after[places]
            side = np.concatenate([ahead, places])
            add(side, self._ranks(symbol[side], symbol[np.concatenate([places, beyond])]))
        alive = symbol[:n] >= 0
        return np.diff(np.cumsum(alive)[ends - 1], prepend=0), symbol[:n][alive]

    def _odd_chunk(self, chunk: str) -> list[bytes | int]:
        """Words and special ids of a run with special tokens or rare characters."""
        code, out = self.from_symbol, []
        for part in self.special_split.split(chunk) if self.special_split else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                low = self.library.normalizer.normalize_str(part)
                out.extend(bytes([code[c] for c in w]) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(low))
        return out

    def _word_ids(self, words: list[str | bytes | int]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids, end to end, of distinct words; merges those not yet known."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > self.cache_entries:
            self._forget()
            new = words
        lengths, ids = [self.word_lengths], [self.word_ids]
        asked = [w for w in new if not isinstance(w, int)]
        for at in range(0, len(asked), BLOCK_WORDS):
            n, own = self.merge_block([w if isinstance(w, bytes) else w.encode() for w in asked[at : at + BLOCK_WORDS]])
            lengths.append(n)
            ids.append(own)
        special = dict.fromkeys(w for w in new if isinstance(w, int))
        if new:
            first = len(self.words)
            self.words.update(zip(chain(asked, special), range(first, first + len(asked) + len(special))))
            self.word_lengths = np.concatenate([*lengths, np.ones(len(special), np.int64)])
            self.word_ids = np.concatenate([*ids, np.fromiter(special, np.int32, len(special))])
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        return self.word_lengths[at], gather(np.ones(len(at), np.int64), at, self.word_lengths, self.word_ids)[1]

    def _chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids, end to end, of distinct runs without white space."""
        joined = "\n".join(chunks)
        odd = [i for i, c in enumerate(chunks) if "<|" in c or _BEYOND.search(c)] if "<|" in joined or _BEYOND.search(joined) else []
        if odd:
            plain = list(chunks)
            for i in odd:
                plain[i] = ""
            joined = "\n".join(plain)
        parts = _SPLIT_LATIN.findall(joined.lower()) + ["\n"]
        coded = pa.array(parts, pa.string()).dictionary_encode()
        words: list[str | bytes | int] = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy()
        stop = words.index("\n")
        ends = np.flatnonzero(codes == stop)
        counts = np.diff(ends, prepend=-1) - 1
        codes = np.delete(codes, ends).astype(np.int64)
        if odd:
            place = {}
            extra = [self._odd_chunk(chunks[i]) for i in odd]
            for w in chain.from_iterable(extra):
                if w not in place:
                    place[w] = len(words)
                    words.append(w)
            at = np.concatenate([[0], np.cumsum(counts)])[odd]
            codes = np.insert(codes, np.repeat(at, [len(x) for x in extra]), [place[w] for w in chain.from_iterable(extra)])
            counts[odd] = [len(x) for x in extra]
        words[stop] = 0  # any id: the separator itself is never asked for
        lengths, ids = self._word_ids(words)
        return gather(counts, codes, lengths, ids)

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token counts and ids, end to end, of an array of texts (null: empty)."""
        counts, flat = whitespace_runs(texts)
        # Splitting leaves empty runs at both ends of a text that white space borders.
        coded = flat.dictionary_encode()
        lengths, ids = self._chunk_ids(coded.dictionary.to_pylist())
        return gather(counts, coded.indices.to_numpy().astype(np.int64), lengths, ids)

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        counts, ids = self.encode_block(pa.array(texts, pa.string()))
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def decode_block(self, counts: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The decoded text of each run of ids, end to end; see ``decode``."""
        return self._joined(self.token_strings, counts, ids)

    def numbers_block(self, counts: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The decimal ids of each run, joined by one space."""
        return self._joined(self.number_strings, counts, ids)

    @staticmethod
    def _joined(strings: pa.Array, counts: np.ndarray, ids: np.ndarray) -> pa.Array:
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        taken = pa.compute.take(strings, pa.array(ids, pa.int32()))
        return pa.compute.binary_join(pa.ListArray.from_arrays(offsets, taken), " ")

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by a space, as a vocabulary without a decoder asks."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@lru_cache(maxsize=2)
def codec(path: str) -> PairIndexCodec:
    """One codec per worker process and vocabulary; its caches live between tasks."""
    return PairIndexCodec(path)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the token ids of every text; an existing ``ids_col`` is replaced."""
    df = df.drop(ids_col)
    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        own = codec(path)
        for b in slices(batches, text_col, BLOCK_BYTES):
            counts, ids = own.encode_block(_column(b, text_col))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            held = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, held], names=[*b.schema.names, ids_col])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the decoded text of an array of ids; null ids decode to the empty text."""
    df = df.drop(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType(), False)])

    def run(batches):
        own = codec(path)
        for b in batches:
            text = pa.array([own.decode(x or ()) for x in _column(b, ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], names=[*b.schema.names, text_col])

    return df.mapInArrow(run, schema)


def _sha256(strings: pa.Array) -> pa.Array:
    offsets = np.frombuffer(strings.buffers()[1], np.int64 if pa.types.is_large_string(strings.type) else np.int32)
    offsets = offsets[strings.offset : strings.offset + len(strings) + 1].tolist()
    data = memoryview(strings.buffers()[2] or b"")
    return pa.array([hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(offsets, offsets[1:])], pa.string())


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode, decode what was encoded, and keep digests of both sides per row."""

    def run(batches):
        own = codec(path)
        for b in slices(batches, text_col, BLOCK_BYTES):
            counts, ids = own.encode_block(_column(b, text_col))
            shas = _sha256(own.numbers_block(counts, ids)), _sha256(own.decode_block(counts, ids))
            columns = [_column(b, id_col), pa.array(counts, pa.int64()), *shas]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return df.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, schema)
