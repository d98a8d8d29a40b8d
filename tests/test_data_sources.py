"""The data sources: byte ranges, pruning, commits, lost tasks, restarts."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribeflow.sources import audio
from scribeflow.sources.single_files import FileWriter, SingleFiles
from scribeflow.sources.wav import WavReader, read_header, read_wav, to_samples
from scribeflow.streaming.recorded import RecordedSession


def wav(x, rate=8000, bits=16, channels=1, before=b""):
    """A WAV file of raw sample values, with sections before them."""
    body = np.asarray(x).astype("<i2" if bits == 16 else np.uint8).tobytes()
    width = channels * bits // 8
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * width, width, bits)
    return b"RIFF" + struct.pack("<I", 4 + len(form) + len(before) + 8 + len(body)) + b"WAVE" + form + before + b"data" + struct.pack("<I", len(body)) + body


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(2)
    held = {"long": rng.integers(-32768, 32768, 5000), "sub/short": rng.integers(-32768, 32768, 3), "exact": rng.integers(-32768, 32768, 300), "none": np.zeros(0)}
    (tmp_path / "sub").mkdir()
    for k, v in held.items():
        (tmp_path / f"{k}.wav").write_bytes(wav(v, before=b"LIST" + struct.pack("<I", 5) + b"abcde\0" if k == "exact" else b""))
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path, held


def gathered(df):
    out = {}
    for r in df.orderBy("path", "block").collect():
        held = out.setdefault(r.path.rsplit("/", 1)[1][:-4], [])
        assert len(held) == r.block * 100 and r.total > len(held)
        held += r.samples
    return out


@pytest.mark.parametrize("range_bytes", [64, 150, 1000, 1 << 20])
def test_ranges_give_every_block_once(spark, folder, range_bytes):
    path, held = folder
    df = read_wav(spark, str(path), blockSamples=100, rangeBytes=range_bytes)
    assert gathered(df) == {k.split("/")[-1]: pytest.approx((v / 32768).tolist()) for k, v in held.items() if len(v)}
    if range_bytes == 1000:
        assert df.rdd.getNumPartitions() > 10  # one file, many tasks
        assert max(len(r.samples) for r in df.collect()) == 100


def test_as_the_array_form(spark, folder):
    path, held = folder
    for k in ("long", "sub/short"):
        data = (path / f"{k}.wav").read_bytes()
        assert [float(x) for x in audio.wav_samples(data)] == pytest.approx((held[k] / 32768).tolist())


def test_channels_depths_and_cut_files(spark, tmp_path):
    stereo = np.array([[100, -300], [200, 500], [32767, -32768]])
    (tmp_path / "s.wav").write_bytes(wav(stereo.ravel(), channels=2))
    (tmp_path / "byte.wav").write_bytes(wav([0, 128, 255], bits=8))
    (tmp_path / "cut.wav").write_bytes(wav(np.arange(50))[:-31])
    get = lambda **o: {r.path.rsplit("/", 1)[1]: r for r in read_wav(spark, str(tmp_path), **o).collect()}
    assert get()["s.wav"].samples == pytest.approx((stereo[:, 0] / 32768).tolist()) and get()["s.wav"].channels == 2
    assert get(channel="mix")["s.wav"].samples == pytest.approx((stereo.mean(1) / 32768).tolist(), abs=1e-7)
    assert get()["byte.wav"].samples == [-1.0, 0.0, pytest.approx(127 / 128)] and get()["cut.wav"].total == 34 == len(get()["cut.wav"].samples)
    heads = get(samples="false")
    assert {k: (r.total, r.samples) for k, r in heads.items()} == {"s.wav": (3, None), "byte.wav": (3, None), "cut.wav": (34, None)}
    (tmp_path / "bad.wav").write_bytes(b"RIFF0000WAVEjunk")
    with pytest.raises(Exception, match="Invalid WAV"):
        read_wav(spark, str(tmp_path)).count()
    assert read_wav(spark, str(tmp_path), mode="DROPMALFORMED").count() == 3
    deep = read_header(__import__("pyarrow").BufferReader(data := wav([0] * 6, bits=16)), len(data))
    deep.bits = 24
    assert to_samples(bytes(12), deep, 0).tolist() == [0.0] * 4


def test_comparisons_are_applied_before_reading(spark, folder):
    path, held = folder
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = read_wav(spark, str(path), blockSamples=100, rangeBytes=1000)
        some = df.where((F.col("block") >= 7) & (F.col("block") < 10) & F.col("path").startswith(f"{path}/l"))
        assert sorted(r.block for r in some.collect()) == [7, 8, 9]
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "Filter" not in plan.split("BatchScan")[0]
        assert df.where("block > 48 and sampleRate > 5").count() == 1 and df.where("block <= 0").count() == 3
        assert df.where(F.col("path").isin(f"{path}/exact.wav")).count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = WavReader({"path": str(path), "blocksamples": "100"})
    assert len(reader.partitions()) == 1 and len(reader.partitions()[0].files) == 4


def names(path):
    return sorted(p.name for p in path.iterdir())


def test_files_come_back(spark, tmp_path):
    spark.dataSource.register(SingleFiles)
    rows = spark.createDataFrame([("a.md", bytearray(b"1")), ("b é.md", bytearray(b"")), ("c.md", None)], "name string, content binary").repartition(3)
    out = tmp_path / "out"
    rows.write.format("single_files").mode("append").save(str(out))
    assert names(out) == ["a.md", "b é.md", "c.md"]
    assert {(r.name, bytes(r.content)) for r in spark.read.format("single_files").load(str(out)).collect()} == {("a.md", b"1"), ("b é.md", b""), ("c.md", b"")}
    text = spark.createDataFrame([("a.md", "ü"), ("d.md", "x")], "name string, content string")
    with pytest.raises(Exception, match="there already"):
        text.write.format("single_files").mode("append").save(str(out))
    assert (out / "a.md").read_bytes() == b"1" and names(out) == ["a.md", "b é.md", "c.md"]
    text.write.format("single_files").mode("overwrite").save(str(out))
    assert (out / "a.md").read_text() == "ü" and (out / "c.md").exists()


@pytest.mark.parametrize("bad, told", [("twice.md", "named"), ("x/../y", "not a file name"), ("", "not a file name"), (None, "not a file name"), ("_hidden", "not a file name")])
def test_bad_names_leave_nothing(spark, tmp_path, bad, told):
    spark.dataSource.register(SingleFiles)
    rows = spark.createDataFrame([("ok.md", "1"), ("twice.md", "2"), (bad, "3")], "name string, content string").repartition(2)
    with pytest.raises(Exception, match=told):
        rows.write.format("single_files").mode("append").save(str(tmp_path))
    assert names(tmp_path) == []


def test_a_lost_task_leaves_no_file(spark, tmp_path):
    """A task that dies in the middle, and one whose report does not count."""
    spark.dataSource.register(SingleFiles)

    def failing(batches):
        for pdf in batches:
            if (pdf["id"] == 700).any():
                raise RuntimeError("lost")
            yield pdf.assign(name=[f"{k}.md" for k in pdf["id"]], content="x")[["name", "content"]]

    rows = spark.range(0, 1000, 1, 4).mapInPandas(failing, "name string, content string")
    with pytest.raises(Exception, match="lost"):
        rows.write.format("single_files").mode("append").save(str(tmp_path))
    assert names(tmp_path) == []
    writer = FileWriter(str(tmp_path), False)
    stray = tmp_path / writer.staged / "9-1-x"
    stray.mkdir(parents=True)
    (stray / "0").write_text("half")
    writer.commit([None])
    assert names(tmp_path) == []


def test_a_file_that_was_not_written_whole(tmp_path):
    from scribeflow.sources.single_files import Written

    writer = FileWriter(str(tmp_path), False)
    (tmp_path / writer.staged).mkdir()
    (tmp_path / writer.staged / "0").write_text("short")
    with pytest.raises(OSError, match="whole"):
        writer.commit([Written([(f"{tmp_path}/{writer.staged}/0", "a.md", 99)])])
    assert names(tmp_path) == []


def test_a_stream_starts_anew_between_two_batches(spark, tmp_path):
    spark.dataSource.register(RecordedSession)
    source = tmp_path / "in"
    source.mkdir()

    def record(part, n):
        lines = [json.dumps({"type": "speech", "event_id": f"{part}-{k}"}, ensure_ascii=False) for k in range(n)]
        (source / f"part-{part:03}.jsonl").write_text("\n".join([*lines, "no json"]), encoding="utf-8")

    def run():
        rows = spark.readStream.format("recorded_session").load(str(source)).select("file", "line", F.get_json_object("json", "$.event_id").alias("id"))
        stream = rows.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(path=f"{tmp_path}/out", format="parquet")
        stream.awaitTermination()
        return sum(p.numInputRows for p in stream.recentProgress)

    record(0, 5000)
    record(1, 3)
    assert run() == 5005
    assert run() == 0
    record(2, 10)
    assert run() == 11
    # The last batch again, as after a loss before its commit was noted.
    last = max(int(p.name) for p in (tmp_path / "state/commits").iterdir() if p.name.isdigit())
    (tmp_path / "state/commits" / str(last)).unlink()
    (tmp_path / "state/commits" / f".{last}.crc").unlink(missing_ok=True)
    record(3, 1)
    run()  # what was open
    run()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.distinct().count() == 5005 + 11 + 2
    assert {r.file: r.n for r in out.groupBy("file").agg(F.count("id").alias("n")).collect()} == {"part-000.jsonl": 5000, "part-001.jsonl": 3, "part-002.jsonl": 10, "part-003.jsonl": 1}
