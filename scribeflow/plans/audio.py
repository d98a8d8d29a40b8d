"""Audio plans: decode, range, speech intervals, chunk rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import signal as S
from ..operators import chunking as C
from ..operators import intervals as I
from ..sources import audio as A


def preprocess(files: DataFrame, start: float = 0.0, end: float | None = None, max_silence: float = 0.5, padding: float = 0.2, min_speech: float = 0.3, threshold: float = 0.01) -> DataFrame:
    """Files to compacted speech (C13): decode, range slice, frame labels, intervals,
    kept samples, WAV.  A file without speech keeps its (sliced) samples."""
    decoded = A.decode_wav(files).withColumn("pcmData", S.time_slice(F.col("pcmData"), config.SAMPLE_RATE, F.lit(start), F.lit(end).cast("double")))
    labels = A.energy_labels(decoded, "path", threshold=threshold)
    kept = I.bridge_gaps(I.speech_intervals(labels, "path"), "path", max_silence, padding, min_speech)
    gathered = kept.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("segments"))
    rows = decoded.join(gathered, "path", "left")
    speech = F.when(F.col("segments").isNull(), F.col("pcmData")).otherwise(S.extract(F.col("pcmData"), F.col("segments"), config.SAMPLE_RATE))
    return A.encode_wav(rows.withColumn("pcmData", speech))


def audio_pipeline(files: DataFrame, model: str) -> DataFrame:
    """Files to chunk rows with samples (C14): validate, decode, plan, chunk."""
    plan = config.model_plan(model)
    decoded = A.decode_wav(files)
    planned = C.with_plan(decoded.withColumn("mb", (44 + F.size("pcmData") * 2) / (1024 * 1024)), "duration", "mb", plan.chunk_seconds, plan.overlap_seconds, plan.max_file_mb, plan.max_duration if plan.max_duration != float("inf") else 1e18)
    rows = C.audio_chunks(C.chunk_starts(planned, "path"), "path")
    return rows.join(decoded.select("path", "sampleRate", "pcmData"), "path").withColumn("pcmData", F.slice("pcmData", (F.floor(F.col("startTime") * F.col("sampleRate")) + 1).cast("int"), F.floor((F.col("endTime") - F.col("startTime")) * F.col("sampleRate")).cast("int")))


def segments_and_chunks(frames: DataFrame, model: str, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """Speech intervals and chunks of the same frames."""
    return I.speech_intervals(frames, key), C.adaptive_chunks(frames, config.model_plan(model), key)
