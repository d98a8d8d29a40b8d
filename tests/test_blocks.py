"""Blocked audio against the forms that hold a file as one array."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scribeflow.functions import signal as S
from scribeflow.operators import blocks as B
from scribeflow.operators import chunking
from scribeflow.sources import audio

SIZE = 37


@pytest.fixture(scope="module")
def files(spark):
    rng = np.random.default_rng(5)
    loud = rng.uniform(-1, 1, 1000)
    loud[300:520] *= 0.001
    loud[600:740] = 0
    held = {"a": loud, "b": rng.uniform(-0.01, 0.01, 37), "c": rng.uniform(-1, 1, 74), "d": np.zeros(230), "one": np.array([0.5])}
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in held.items()]
    return spark.createDataFrame(rows, "file_id string, samples array<float>").cache()


@pytest.fixture(scope="module")
def blocks(files):
    return B.placed(files.select("file_id", F.lit(0).cast("long").alias("at"), "samples"), "file_id", SIZE).cache()


def whole(blocks):
    """The samples of each file again, and that all blocks but the last are full."""
    out = {}
    for r in blocks.orderBy("file_id", "block").collect():
        held = out.setdefault(r.file_id, [])
        assert len(held) == r.block * SIZE and 0 < len(r.samples) <= SIZE
        held += r.samples
    return out


def arrays(df, column="samples"):
    return {r.file_id: list(r[column]) for r in df.collect() if r[column]}


def test_blocks_hold_the_files(files, blocks):
    assert whole(blocks) == arrays(files)


def test_pieces_of_any_length(spark, files, monkeypatch):
    monkeypatch.setattr(B, "GROUP", 3)
    pieces, want = [], arrays(files)
    for k, samples in want.items():
        cuts = sorted(np.random.default_rng(1).integers(0, len(samples) + 1, 12).tolist())
        for i, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(samples)])):
            pieces.append((k, 5 * i - 7, samples[lo:hi]))
    df = spark.createDataFrame(pieces, "file_id string, pos long, samples array<float>").orderBy(F.rand(1))
    assert whole(B.joined_pieces(df, "file_id", "pos", size=SIZE)) == want
    assert B.joined_pieces(df.where("false"), "file_id", "pos").count() == 0


def test_energy(spark, files, blocks):
    got = {r.file_id: r.energy for r in B.rms_of_files(blocks, "file_id").collect()}
    want = {r.file_id: r.e for r in files.select("file_id", S.rms(F.col("samples")).alias("e")).collect()}
    assert got == pytest.approx(want)
    windows = spark.createDataFrame([("a", 0, 0, 1000), ("a", 1, 36, 38), ("a", 2, 990, 1200), ("a", 3, 1000, 1100), ("a", 4, 5, 5), ("b", 0, -5, 37), ("none", 0, 0, 9)], "file_id string, pos long, low long, high long")
    out = {(r.file_id, r.pos): r.energy for r in B.rms_of_windows(blocks, windows, "file_id", SIZE).collect()}
    held = arrays(files)
    for key, low, high in (((r.file_id, r.pos), r.low, r.high) for r in windows.collect()):
        part = np.array(held.get(key[0], [])[max(low, 0) : max(high, 0)], float)
        assert out[key] == (pytest.approx(np.sqrt(np.mean(part**2))) if len(part) else None)


def test_sums_give_any_run_of_steps(blocks, files, monkeypatch):
    monkeypatch.setattr(B, "GROUP", 4)
    sums = B.energy_sums(blocks, "file_id", 11, SIZE)
    windows = sums.alias("x").join(sums.alias("y"), (F.col("x.file_id") == F.col("y.file_id")) & (F.col("x.step") <= F.col("y.step"))).select("x.file_id", F.monotonically_increasing_id().alias("pos"), F.col("x.step").alias("first"), F.col("y.step").alias("last")).where("last - first < 9")
    held = arrays(files)
    rows = B.rms_of_steps(sums, windows.cache(), "file_id").collect()
    assert len(rows) > 500
    for r in rows:
        part = np.array(held[r.file_id][r["first"] * 11 : r["last"] * 11], float)
        assert r.energy == (pytest.approx(np.sqrt(np.mean(part**2)), abs=1e-7) if len(part) else None)


def test_frames_and_waveforms(files, blocks):
    got = {(r.file_id, r.frame): (round(r.t, 9), r.label) for r in B.labelled_frames(blocks, "file_id", 25, 100, 0.05, SIZE).collect()}
    want = {(r.file_id, r.frame): (round(r.t, 9), r.label) for r in audio.energy_labels(files, "file_id", "samples", 25, 100, 0.05).collect()}
    assert got == want and {v[1] for v in want.values()} == {0, 1}
    for width in (1, 7, 100, 400):
        got = {(r.file_id, r.bucket): (r.low, r.high) for r in B.waveforms(blocks, "file_id", width, SIZE).collect()}
        rows = files.select("file_id", F.posexplode(S.waveform(F.col("samples"), width)).alias("bucket", "w")).collect()
        assert got == {(r.file_id, r.bucket): (r.w.low, r.w.high) for r in rows}


def test_many_files_are_joined_by_shuffle(blocks, monkeypatch):
    want = sorted(map(tuple, B.waveforms(blocks, "file_id", 9, SIZE).collect()))
    monkeypatch.setattr(B, "FEW_FILES", 1)
    assert sorted(map(tuple, B.waveforms(blocks, "file_id", 9, SIZE).collect())) == want


def test_extracts_and_slices(spark, files, blocks):
    parts = [("a", 0, 0.105, 0.9), ("a", 1, 0.9, 0.9), ("a", 2, 2.0, 30.0), ("b", 5, 0.0, 0.001), ("c", 0, 5.0, 6.0), ("d", 0, 1.0, 1.5), ("d", 1, 0.5, 2.0)]
    segments = spark.createDataFrame(parts, "file_id string, pos long, start double, `end` double")
    gathered = segments.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end"))).alias("segments"))
    want = arrays(files.join(gathered, "file_id").select("file_id", S.extract(F.col("samples"), F.col("segments"), 100).alias("samples")))
    assert whole(B.extracted(blocks, segments, "file_id", 100, SIZE)) == want
    for start, end in ((None, None), (0.25, 0.0), (0.305, 0.995), (9.0, None)):
        one = files.select("file_id", F.lit(0).cast("long").alias("pos"), F.lit(start).cast("double").alias("start"), F.lit(end).cast("double").alias("end"))
        want = arrays(files.select("file_id", S.time_slice(F.col("samples"), 100, F.lit(start).cast("double"), F.lit(end).cast("double")).alias("samples")))
        assert whole(B.extracted(blocks, one, "file_id", 100, SIZE, whole=False)) == want


@pytest.mark.parametrize("source, target", [(48_000, 16_000), (44_100, 16_000), (8_000, 16_000), (16_000, 16_000), (3, 2)])
def test_resampling(files, blocks, source, target):
    for clamp in (True, False):
        got = whole(B.resampled(blocks, "file_id", source, target, clamp, SIZE))
        want = arrays(files.select("file_id", S.resample(F.col("samples"), source, target, clamp).alias("samples")))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("rate", [10, 20, 33, 7])
def test_silence(spark, files, blocks, rate):
    """Rates whose tenth does not divide them cut windows into unequal units."""
    rows = [(k, p, t) for k in ("a", "b", "c", "d", "one") for p, t in enumerate([0.0, 3.0, 5.05, 20.0, 29.3, 90.0])]
    targets = spark.createDataFrame(rows, "file_id string, pos long, target double")
    for threshold in (0.01, 0.4, 0.7):
        want = {(r.file_id, r.pos): round(r.snapped, 9) for r in chunking.silence_snap(files, targets, rate, threshold=threshold).collect()}
        got = {(r.file_id, r.pos): round(r.snapped, 9) for r in B.silence_snapped(blocks, targets, "file_id", rate, threshold, SIZE).collect()}
        assert got == want


def test_rows_stay_small(spark):
    """A file of two million samples: no row above 1 MB, in none of the results."""
    df = spark.range(1).selectExpr("'long' as file_id", "0L as at", "transform(sequence(1, 2000000), x -> cast(sin(x) as float)) as samples")
    blocks = B.placed(df, "file_id")
    more = B.resampled(blocks, "file_id", 16_000, 8_000)
    segments = spark.createDataFrame([("long", 0, 1.0, 100.0)], "file_id string, pos long, start double, `end` double")
    cut = B.extracted(blocks, segments, "file_id", 16_000)
    for rows, total in ((blocks, 2_000_000), (more, 1_000_000), (cut, 99 * 16_000)):
        sizes = rows.select(F.size("samples").alias("n")).toPandas()["n"]
        assert isinstance(sizes, pd.Series) and sizes.max() * 8 <= 1 << 20 and sizes.sum() == total
