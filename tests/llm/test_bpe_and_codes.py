"""BPE and token codes against the tokenizers library and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from scribeflow.llm import bpe, tokencodes
from scribeflow.llm.queries import word_vocabulary

ODD = [
    None,
    "",
    "   \n ",
    "it's DON'T we'Ll 123 x²½ªº µ ß_a __ a_b \x1c\x1fz",
    "İstanbul ΑΣΣ Σ é éx \xa0y\x85z",
    "<|endoftext|>a<|startoftext|> <|x|> 漢字かな 한국 😀😀 ​ q̀",
    "aaaaaaaaa!!!!!!''''s 'S",
    "a" * 5000,
    "ab" * 3000 + "!",
    "a" * 5000,
]


def _random_texts(n=300):
    rng = random.Random(3)
    draw = lambda: chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(32, 127), rng.randrange(0x250, 0xD800), rng.randrange(0x1F000, 0x1FFFF)]))
    return ["".join(draw() for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(word_vocabulary())


def test_pair_index_equals_the_library(library):
    codec = bpe.codec(word_vocabulary())
    texts = ODD + _random_texts()
    got = codec.encode_batch(texts)
    for text, ids in zip(texts, got):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids == want, text
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_overlapping_equal_pairs(library):
    codec = bpe.codec(word_vocabulary())
    for n in range(1, 40):
        for c in "ao!e":
            assert codec.encode_batch([c * n])[0] == library.encode(c * n, add_special_tokens=False).ids


def test_round_trip_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "text without id"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as n_tokens")
    out = bpe.round_trip(df, word_vocabulary()).collect()
    assert len(out) == len(rows)
    have = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i is None, i or 0, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert have == sorted(want)
    encoded = bpe.encode(df, word_vocabulary())
    back = {r.doc_id: r.decoded for r in bpe.decode(encoded, word_vocabulary()).where("doc_id < 3").collect()}
    assert back == {0: "", 1: "", 2: ""}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(empty, word_vocabulary()).count() == 0
    assert tokencodes.token_table(empty, word_vocabulary()).count() == 0


def test_addressable_ids_random_access():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 256, 700), rng.integers(0, 49408, 3000), rng.integers(0, 1 << 32, 400), [0, 255, 256, 65535, 65536, (1 << 32) - 1]]).astype(np.uint32)
    rng.shuffle(ids)
    for part in (ids, ids[:0], ids[:1], ids[:513]):
        codes = tokencodes.AddressableIds.from_bytes(memoryview(tokencodes.AddressableIds.build(part).to_bytes()))
        assert [codes[i] for i in range(len(part))] == part.tolist()
        for _ in range(50):
            a, b = sorted(rng.integers(0, len(part) + 1, 2).tolist())
            assert codes.slice(a, b).tolist() == part[a:b].tolist()
        with pytest.raises(IndexError):
            codes[len(part)]


def test_token_files(spark, library, monkeypatch):
    monkeypatch.setattr(tokencodes, "FILE_BYTES", 4000)
    monkeypatch.setattr(tokencodes, "GROUP_FILES", 3)
    rows = [(i * 3 % 31, t) for i, t in enumerate(ODD + _random_texts(60))] + [(None, "lost"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as start")
    folder = tokencodes.scratch_path(spark, "t")
    manifest = tokencodes.write_tokens(df, word_vocabulary(), folder)
    assert manifest.count() > 1
    out = sorted(tokencodes.read_tokens(manifest).collect(), key=lambda r: r.start)
    order = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in df.orderBy("doc_id", F.xxhash64("text")).collect()]
    start, stream = 0, []
    for r, (i, ids) in zip(out, order, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    for k in (0, 5, start // 2, start - 1):
        assert tokencodes.token_at(manifest, k) == stream[k]
    with pytest.raises(IndexError):
        tokencodes.token_at(manifest, start)


def test_many_rows_of_one_id_spread_over_files(spark, monkeypatch):
    monkeypatch.setattr(tokencodes, "FILE_BYTES", 800)
    df = spark.createDataFrame([(None, "same words here")] * 300 + [(7, f"text {i}") for i in range(300)], "doc_id long, text string")
    manifest = tokencodes.write_tokens(df, word_vocabulary(), tokencodes.scratch_path(spark, "t"))
    sizes = [r.n_docs for r in manifest.collect()]
    assert sum(sizes) == 600 and max(sizes) < 120
    out = sorted(tokencodes.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None] * 300 + [7] * 300
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))
