"""GIF, WARC and chat formatting: exact round trips and edge cases."""

import base64
import gzip
import hashlib
import random
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scribeflow.llm import chat, gif, warc
from scribeflow.llm.common import read_whole, scratch_path


@pytest.mark.parametrize("data", [b"\0" * 64, bytes(range(256)) * 40, b"ab" * 40_000, random.Random(1).randbytes(60_000), b"x" * 9_000])
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8) == data


def test_small_code_sizes():
    rng = random.Random(2)
    for bits in (2, 3, 5):
        data = bytes(rng.randrange(1 << bits) for _ in range(20_000))
        assert gif.lzw_decode(gif.lzw_encode(data, bits), bits) == data


def test_frames_round_trip():
    payload = random.Random(3).randbytes(64 * 2500)
    frames = list(gif.read_frames(gif.write_gif(payload)))
    assert [f.indices.shape[0] for f in frames] == [1024, 1024, 452]
    assert b"".join(f.indices.tobytes() for f in frames) == payload
    assert all(f.delay_ms == 100 and f.histogram.sum() == 64 * 1024 for f in frames)
    with pytest.raises(ValueError):
        gif.write_gif(b"")
    with pytest.raises(ValueError):
        list(gif.read_frames(b"PNG"))


def _frame(w, h, samples, left=0, top=0, disposal=0, clear=None, local=None, interlace=False, delay=5):
    packed = disposal << 2 | (clear is not None)
    flags = (0x80 | 1 if local else 0) | (0x40 if interlace else 0)
    head = b"\x21\xf9\x04" + struct.pack("<BHB", packed, delay, clear or 0) + b"\0" + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags)
    return head + (local or b"") + b"\x02" + gif._blocks(gif.lzw_encode(bytes(samples), 2))


def test_disposal_transparency_and_palettes():
    shared = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    local = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    screen = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80 | 1, 0, 0) + shared
    data = screen + b"".join(
        [
            _frame(2, 2, [1, 1, 1, 1]),
            _frame(2, 1, [2, 3], clear=3, disposal=3),
            _frame(1, 1, [1], left=1, top=1, local=local, disposal=2),
            _frame(1, 2, [2, 3]),
            b"\x21\xfe\x03abc\x00\x3b",
        ]
    )
    red, green, blue, black = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)
    shown = [[tuple(p) for p in f.canvas.reshape(-1, 3).tolist()] for f in gif.read_frames(data)]
    assert shown == [[red] * 4, [green, red, red, red], [red, red, red, (8, 8, 8)], [green, red, blue, black]]
    lines = [0, 1, 2, 3, 0, 1, 2, 3, 0]
    stored = [lines[i] for s, d in ((0, 8), (4, 8), (2, 4), (1, 2)) for i in range(s, 9, d)]
    tall = b"GIF89a" + struct.pack("<HHBBB", 1, 9, 0x80 | 1, 0, 0) + shared + _frame(1, 9, stored, interlace=True) + b"\x3b"
    assert next(gif.read_frames(tall)).indices.ravel().tolist() == lines


def test_media_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "é" * 32), (4, "z" * 64), (5, "long text " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_bytes", "2 as feature")
    out = gif.media_table(df).collect()
    assert len(out) == len(rows)
    for r in out:
        text = dict(rows)[r.doc_id] or ""
        raw = text.encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(gif.write_gif(payload)).hexdigest()
    assert len({r.feature for r in out if r.doc_id == 3}) == 1
    long = next(r for r in out if r.doc_id == 5)
    seen = np.frombuffer(("long text " * 40_000).encode(), np.uint8)
    bins = np.bincount((seen >> 6) << 4 | (seen >> 3 & 3) << 2 | (seen & 3), minlength=64)
    bins[0] += -len(seen) % 64
    parts = dict(p.split("=") for p in long.feature.split(";"))
    assert parts["frames"] == "7" and parts["ms"] == "700" and len(np.flatnonzero(bins)) > 4
    # All but the last frame fill the screen; the last one lies over the one before.
    whole = seen[: 6 * 65536]
    assert sum(int(x.split(":")[1]) for x in parts["colours"].split(",")) == 7 * 65536
    assert set(np.flatnonzero(bins).tolist()) == {int(x.split(":")[0]) for x in parts["colours"].split(",")} and len(whole)
    assert gif.media_table(df.limit(0)).count() == 0
    stored = spark.createDataFrame([(7, bytearray(gif.write_gif(b"q" * 64 * 1500))), (8, None)], "doc_id long, image binary")
    frames = gif.frame_table(stored, "doc_id", "image").orderBy("frame").collect()
    assert [(f.id, f.start_ms, f.rows) for f in frames] == [(7, 0, 1024), (7, 100, 1024)]


PAGES = [(i, f"http://x/{i}", h) for i, h in enumerate(["a", "b", "a", None, "", "c" * 200_000, "a", "é\r\n\r\n", "b"])]
PAGES += [(6, "http://x/again", "a"), (None, None, "a"), (None, "http://y z\n", "q"), (20, "u", "solo")]


def _expected(pages, min_bytes=0):
    last = {}
    for i, _, h in pages:
        if i is not None:
            last.setdefault(h or "", []).append(i)
    out, seen = [], set()
    for i, _, h in sorted(pages, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (h or "").encode()
        known = last.get(h or "", [])
        keep = max(known) if i is not None and len(known) > 1 and len(raw) >= min_bytes else None
        first = keep is None or (keep == i and (i, h or "") not in seen)
        seen.add((i, h or ""))
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes,roll", [(0, 1 << 26), (1, 400)])
def test_warc_round_trip(spark, min_bytes, roll, monkeypatch):
    monkeypatch.setattr(warc, "PART_BYTES", 100_000)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as sha", "3 as keep")
    made = []
    for _ in range(2):
        manifest = warc.write_archives(df, scratch_path(spark, "w"), min_bytes, roll)
        out = warc.read_archives(manifest).collect()
        assert sorted((tuple(r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in out), key=str) == _expected(PAGES, min_bytes)
        assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES)
        files = manifest.orderBy("part", "nth").collect()
        assert len(files) > 1
        made.append([(f.file.rpartition("/")[2], hashlib.sha1(read_whole(f.file)).hexdigest()) for f in files])
        assert all(gzip.decompress(read_whole(f.file)).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for f in files)
    assert made[0] == made[1]
    ids = {}
    for f in files:
        for fields, _ in warc.read_records(read_whole(f.file)):
            ids.setdefault(fields["WARC-Record-ID"], fields)
    for fields in ids.values():
        if fields["WARC-Type"] == "revisit":
            assert ids[fields["WARC-Refers-To"]]["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]


def test_one_id_and_one_payload_of_many_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "PART_BYTES", 1500)
    rows = [(None, f"http://x/{i}", f"page without id {i}") for i in range(400)] + [(i, "http://y", "the same page") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch_path(spark, "w")
    manifest = warc.write_archives(df, folder)
    assert max(r.records for r in manifest.collect()) < 250
    out = warc.read_archives(manifest).collect()
    assert {(r.page_id, r.refers_to) for r in out if r.page_id is not None} == {(i, 399 if i < 399 else None) for i in range(400)}
    assert sum(r.record_type == "response" for r in out) == 401


def test_warc_empty(spark):
    assert warc.page_table(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_archive():
    good = warc.page_record(1, "u", b"payload", 0, None)
    text = gzip.decompress(good).replace(b"payload", b"PAYLOAD")
    with pytest.raises(ValueError):
        list(warc.read_records(gzip.compress(text)))


EVIL = ["\\### Assistant: </turn> ok", "####", "<\\/turn></join><\\/join>", "\\", "\\\\#", "", None, "a\n</turn>\n### user: b", "$1 \\$1", "é😀"]


def test_chat_against_sql(spark):
    rng = random.Random(5)
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "sys:tem", "### x", None, ""]), rng.choice(EVIL)))
    rows += [(1, 0, "user", "tie"), (1, 0, "user", "tie"), (None, 1, "assistant", "no id"), (3, None, "assistant", "first"), (77, 1, "assistant", "long " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as pieces", "3 as formatted")
    got = sorted(map(tuple, chat.conversation_table(df).collect()), key=str)
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert got == sorted(db.execute(chat.CHAT_SQL).fetchall(), key=str)
    for r in chat.format_conversations(df.select("conv_id", "turn", "role", "text")).collect():
        assert "".join(p.piece for p in r.pieces) == r.formatted
    merged = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")).first()
    assert merged.formatted == "### user: a</join>b</turn>\n### assistant: c</turn>\n"
    assert chat.conversation_table(df.limit(0)).count() == 1


def test_roles_and_texts_of_control_strings_come_back(spark):
    """Roles and texts made of the template's own marks, read back from the output alone."""
    rng = random.Random(11)
    bits = [": ", ":", " ", "\\", "###", "### ", "</turn>", "</turn>\n", "</join>", "<", "/", "turn>", "\n", "a", "assistant", "é"]
    make = lambda: "".join(rng.choices(bits, k=rng.randrange(6)))
    rows = [(c, t, make(), make()) for c in range(300) for t in range(rng.randrange(1, 5))]
    rows += [(300, 0, "a: b", "hello: x"), (301, 0, "a:", " x"), (302, 0, "a\\", ": y"), (303, 0, "two\nlines: z", "t"), (304, 0, "", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        want.setdefault(c, []).append((role, text, role == "assistant"))
    back = chat.parse_conversations(chat.format_conversations(df).select("conv_id", "formatted")).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in back} == want
    for r in chat.format_conversations(df).collect():
        told = [p.piece for p in r.pieces if p.loss]
        assert len(told) == sum(t[2] for t in want[r.conv_id])


def test_chat_on_random_roles_against_sql(spark):
    rng = random.Random(13)
    rows = [(c, t, rng.choice(["a: b", "a:", "b\\ :", "assistant", "x </turn> y", "###:"]), rng.choice(EVIL)) for c in range(30) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(map(tuple, chat.conversation_table(df).collect()), key=str) == sorted(db.execute(chat.CHAT_SQL).fetchall(), key=str)


def test_shared_folder(spark, tmp_path):
    """The cluster's setting is taken as the default file system reads it; lost files are swept."""
    from types import SimpleNamespace

    from scribeflow.llm import common

    told = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: str(tmp_path)), sparkContext=spark.sparkContext)
    assert common.scratch_root(told) == f"file://{tmp_path}"
    assert common.scratch_path(told, "x").startswith(f"file://{tmp_path}/x-")
    common._scratch.pop()
    none = SimpleNamespace(get=lambda *a: None)
    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(getConf=lambda: none, master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(RuntimeError):
        common.scratch_root(SimpleNamespace(conf=none, sparkContext=context))
    uri = f"file://{tmp_path}/deep/a.bin"
    common.write_once(uri, b"one")
    common.write_once(uri, b"one")
    (tmp_path / "deep" / "b.bin.123.tmp").write_bytes(b"lost")
    common.drop_temporary(f"file://{tmp_path}/deep")
    assert [p.name for p in (tmp_path / "deep").iterdir()] == ["a.bin"] and read_whole(uri) == b"one"


def test_warc_against_sql(spark):
    db = duckdb.connect()
    db.execute("create table pages (page_id bigint, url varchar, html varchar)")
    db.executemany("insert into pages values (?, ?, ?)", PAGES)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, warc.page_table(df).select(cols).collect()), key=str) == sorted(db.execute(warc.WARC_SQL).fetchall(), key=str)


def test_equal_pages_without_id_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "PART_BYTES", 2000)
    df = spark.range(0, 300, 1, 6).selectExpr("cast(null as bigint) as page_id", "cast(null as string) as url", "repeat('x', 40) as html")
    manifest = warc.write_archives(df, scratch_path(spark, "w"))
    assert manifest.agg(F.max("records")).first()[0] < 150
    names = [fields["WARC-Record-ID"] for f in manifest.collect() for fields, _ in warc.read_records(read_whole(f.file))]
    assert len(names) == len(set(names))
    assert warc.read_archives(manifest).where("record_type = 'response' and page_id is null and payload_bytes = 40").count() == 300


def test_images_of_one_letter_take_little_memory():
    """Images that shrink a hundredfold are decoded in pieces of bounded size."""
    image = gif.write_gif(b"A" * (1 << 20))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([image] * 40)], names=["id", "image"])
    assert batch.nbytes < 1 << 20
    pieces = list(gif.framed(iter([batch]), "image", False, "frames"))
    assert sum(b.num_rows for b in pieces) == 40 and max(b.nbytes for b in pieces) < 11 << 20
    assert all(sum(len(f["samples"]) for f in frames) == 1 << 20 for b in pieces[:2] for frames in b.column(2).to_pylist())
