"""Queries over audio in blocks: the vectors of a label, end to end, are one recording.

Blocks have 1,024 samples here, so that windows cross borders at every table size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as S
from ..operators import blocks as B
from .registry import query, table

_SIZE = 1024
_X = "x AS (SELECT label AS file_id, flatten(list(embedding ORDER BY vec_id)) AS s FROM embeddings GROUP BY label)"


def _blocks(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").alias("file_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("samples"))
    return B.joined_pieces(rows, "file_id", "pos", size=_SIZE)


def _windows(blocks, step, length):
    """Windows of ``length`` samples every ``step`` ones; the last ones end behind the file."""
    sizes = B.file_sizes(blocks, "file_id")
    pos = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / step)))
    return sizes.select("file_id", pos.alias("pos")).withColumns({"low": F.col("pos") * step, "high": F.col("pos") * step + length})


@query("audio_blocks", f"WITH {_X} SELECT file_id, b::BIGINT AS block, s[b * {_SIZE} + 1 : (b + 1) * {_SIZE}] AS samples FROM (SELECT file_id, s, unnest(generate_series(0, (len(s) - 1) // {_SIZE})) AS b FROM x)")
def audio_blocks(spark, d):
    return _blocks(spark, d)


@query(
    "rms_blocks",
    f"""WITH {_X}, w AS (SELECT file_id, s, unnest(generate_series(0, len(s) // 333)) AS pos FROM x), p AS (SELECT file_id, pos, s[pos * 333 + 1 : pos * 333 + 700] AS part FROM w)
 SELECT file_id, pos::BIGINT AS pos, CASE WHEN len(part) > 0 THEN round(sqrt(list_sum([v::DOUBLE * v::DOUBLE for v in part]) / len(part)), 6) END AS energy FROM p""",
)
def rms_blocks(spark, d):
    blocks = _blocks(spark, d)
    return B.rms_of_windows(blocks, _windows(blocks, 333, 700), "file_id", _SIZE).select("file_id", "pos", F.round("energy", 6).alias("energy"))


@query(
    "rms_steps",
    f"""WITH {_X}, w AS (SELECT file_id, s, unnest(generate_series(0, (len(s) - 1) // 30)) AS pos FROM x), p AS (SELECT file_id, pos, s[pos * 30 + 1 : (pos + 17) * 30] AS part FROM w WHERE (pos + 17) * 30 < len(s) + 30)
 SELECT file_id, pos::BIGINT AS pos, round(sqrt(list_sum([v::DOUBLE * v::DOUBLE for v in part]) / len(part)), 6) AS energy FROM p""",
)
def rms_steps(spark, d):
    sums = B.energy_sums(_blocks(spark, d), "file_id", 30, _SIZE)
    windows = sums.select("file_id", F.col("step").alias("pos"), F.col("step").alias("first"), (F.col("step") + 17).alias("last"))
    return B.rms_of_steps(sums, windows, "file_id").select("file_id", "pos", F.round("energy", 6).alias("energy"))


@query("file_rms", f"WITH {_X} SELECT file_id, round(sqrt(list_sum([v::DOUBLE * v::DOUBLE for v in s]) / len(s)), 6) AS energy FROM x")
def file_rms(spark, d):
    return B.rms_of_files(_blocks(spark, d), "file_id").select("file_id", F.round("energy", 6).alias("energy"))


@query(
    "waveform_blocks",
    f"""WITH {_X}, w AS (SELECT file_id, unnest(generate_series(0, 99)) AS bucket, s, ceil(len(s) / 100.0)::BIGINT AS step FROM x), p AS (SELECT file_id, bucket, s[bucket * step + 1 : (bucket + 1) * step] AS part FROM w)
 SELECT file_id, bucket::BIGINT AS bucket, round(coalesce(list_min(part)::DOUBLE, 1), 6) AS low, round(coalesce(list_max(part)::DOUBLE, -1), 6) AS high FROM p""",
)
def waveform_blocks(spark, d):
    rows = B.waveforms(_blocks(spark, d), "file_id", 100, _SIZE)
    return rows.select("file_id", "bucket", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "silence_blocks",
    f"""WITH {_X}, t AS (SELECT file_id, s, pos, pos * 3.7::DOUBLE AS target, floor(pos * 3.7::DOUBLE * 105)::BIGINT AS mid FROM x, generate_series(0, 9) AS g(pos)),
 e AS (SELECT file_id, pos, i, round(sqrt(list_sum([v::DOUBLE * v::DOUBLE for v in s[i + 1 : i + 105]]) / 105), 12) AS energy FROM (SELECT *, unnest(generate_series(greatest(mid - 525, 0), least(len(s), mid + 525) - 106, 10)) AS i FROM t)),
 b AS (SELECT file_id, pos, arg_min(i, (energy, i)) AS best FROM e WHERE energy < 0.12 GROUP BY file_id, pos)
 SELECT file_id, pos, target, round(coalesce(best, mid) / 105.0::DOUBLE, 6) AS snapped FROM t LEFT JOIN b USING (file_id, pos)""",
)
def silence_blocks(spark, d):
    blocks = _blocks(spark, d)
    targets = B.file_sizes(blocks, "file_id").select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("pos")).withColumn("target", F.col("pos") * 3.7)
    rows = B.silence_snapped(blocks, targets, "file_id", 105, 0.12, _SIZE)
    return rows.withColumn("snapped", F.round("snapped", 6))


@query("speech_frames_blocks", f"WITH {_X}, w AS (SELECT file_id, s, unnest(generate_series(0, len(s) // 48 - 1)) AS frame FROM x) SELECT file_id, frame::BIGINT AS frame, (sqrt(list_sum([v::DOUBLE * v::DOUBLE for v in s[frame * 48 + 1 : frame * 48 + 48]]) / 48) >= 0.12)::INT AS label FROM w")
def speech_frames_blocks(spark, d):
    return B.labelled_frames(_blocks(spark, d), "file_id", 48, 1600, 0.12, _SIZE).select("file_id", "frame", "label")


@query(
    "speech_extract_blocks",
    f"""WITH {_X}, y AS (SELECT file_id, flatten([s[floor(k * 6.13::DOUBLE * 100)::BIGINT + 1 : least(len(s), ceil((k * 6.13::DOUBLE + 4.007) * 100)::BIGINT)] for k in generate_series(0, len(s) // 613)]) AS s FROM x)
 SELECT file_id, b::BIGINT AS block, s[b * {_SIZE} + 1 : (b + 1) * {_SIZE}] AS samples FROM (SELECT file_id, s, unnest(generate_series(0, (len(s) - 1) // {_SIZE})) AS b FROM y)""",
)
def speech_extract_blocks(spark, d):
    blocks = _blocks(spark, d)
    pos = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / 613)))
    segments = B.file_sizes(blocks, "file_id").select("file_id", pos.alias("pos")).withColumns({"start": F.col("pos") * 6.13, "end": F.col("pos") * 6.13 + 4.007})
    return B.extracted(blocks, segments, "file_id", 100, _SIZE)


@query("range_slice_blocks", f"WITH {_X}, y AS (SELECT file_id, s[151 : 2100] AS s FROM x) SELECT file_id, b::BIGINT AS block, s[b * {_SIZE} + 1 : (b + 1) * {_SIZE}] AS samples FROM (SELECT file_id, s, unnest(generate_series(0, (len(s) - 1) // {_SIZE})) AS b FROM y WHERE len(s) > 0)")
def range_slice_blocks(spark, d):
    blocks = _blocks(spark, d)
    segments = B.file_sizes(blocks, "file_id").select("file_id", F.lit(0).cast("long").alias("pos"), F.lit(1.5).alias("start"), F.lit(21.0).alias("end"))
    return B.extracted(blocks, segments, "file_id", 100, _SIZE, whole=False)


@query(
    "resample_blocks",
    f"""WITH {_X}, y AS (SELECT file_id, [round(s[floor(i * 1.5)::BIGINT + 1]::DOUBLE * (1 - (i * 1.5::DOUBLE - floor(i * 1.5))) + s[least(floor(i * 1.5)::BIGINT + 2, len(s))]::DOUBLE * (i * 1.5::DOUBLE - floor(i * 1.5)), 6) for i in generate_series(0, floor(len(s) / 1.5)::BIGINT - 1)] AS s FROM x)
 SELECT file_id, b::BIGINT AS block, s[b * {_SIZE} + 1 : (b + 1) * {_SIZE}] AS samples FROM (SELECT file_id, s, unnest(generate_series(0, (len(s) - 1) // {_SIZE})) AS b FROM y)""",
)
def resample_blocks(spark, d):
    rows = B.resampled(_blocks(spark, d), "file_id", 24_000, 16_000, size=_SIZE)
    return rows.withColumn("samples", F.transform("samples", lambda x: S.rounded(x)))
