"""Time intervals: islands, bridges, gaps, neighbours, nearest boundaries.

Every operator works on one window per file or document, ordered by time with a
position as tie-breaker; nothing is gathered beyond one island.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME_SECONDS = 0.03


def speech_intervals(frames: DataFrame, key: str = "file_id", frame_seconds: float = FRAME_SECONDS) -> DataFrame:
    """Labels of frames (key, frame, t, label) to intervals (key, seg, start, end).

    Frames with a negative label are skipped and close nothing.
    """
    order = Window.partitionBy(key).orderBy("frame")
    known = frames.where("label >= 0").withColumn("speech", F.col("label") == 1)
    opens = F.col("speech") & ~F.coalesce(F.lag("speech").over(order), F.lit(False))
    marked = known.withColumn("seg", F.sum(opens.cast("int")).over(order)).where("speech")
    return marked.groupBy(key, "seg").agg(F.min("t").alias("start"), (F.max("t") + frame_seconds).alias("end"))


def islands(rows: DataFrame, key: str, start: Column, end: Column, max_gap: float, order: str | None = None) -> DataFrame:
    """Add ``island``: rows whose gap to all before is below ``max_gap`` share one."""
    by = Window.partitionBy(key).orderBy(start, *([F.col(order)] if order else [end]))
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = before.isNull() | (start - before >= max_gap)
    return rows.withColumn("island", F.sum(fresh.cast("int")).over(by))


def bridge_gaps(segments: DataFrame, key: str = "file_id", max_silence: float = 0.5, padding: float = 0.2, min_speech: float = 0.3) -> DataFrame:
    """Join intervals over short gaps, pad both ends, then drop short ones.

    A gap equal to ``max_silence`` stays; starts are clamped at zero, ends are not.
    """
    joined = islands(segments, key, F.col("start"), F.col("end"), max_silence)
    joined = joined.groupBy(key, "island").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"))
    padded = joined.select(key, "island", F.greatest(F.lit(0.0), F.col("start") - padding).alias("start"), (F.col("end") + padding).alias("end"))
    return padded.where(F.col("end") - F.col("start") >= min_speech).drop("island")


def gap_midpoints(segments: DataFrame, key: str = "file_id", min_gap: float = 0.5) -> DataFrame:
    """Middles of the gaps between neighbours."""
    after = F.lead("start").over(Window.partitionBy(key).orderBy("start", "end"))
    gaps = segments.withColumn("after", after).where(F.col("after") - F.col("end") >= min_gap)
    return gaps.select(key, ((F.col("end") + F.col("after")) / 2).alias("boundary"))


def speech_statistics(segments: DataFrame, totals: DataFrame, key: str = "file_id") -> DataFrame:
    """Shares of speech and silence, count and mean length, per file.

    ``totals`` has (key, duration); files without segments have zeros.
    """
    sums = segments.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("speech"), F.count("*").alias("n"))
    rows = totals.join(sums, key, "left")
    speech, n = F.coalesce("speech", F.lit(0.0)), F.coalesce("n", F.lit(0))
    share = F.when(F.col("duration") > 0, speech / F.col("duration")).otherwise(0.0)
    return rows.select(
        key,
        share.alias("speech_ratio"),
        (1 - share).alias("silence_ratio"),
        n.cast("long").alias("total_segments"),
        F.when(n > 0, speech / n).otherwise(0.0).alias("average_segment"),
        (1 - share).alias("compression_ratio"),
    )


def neighbour_overlap(chunks: DataFrame, key: str = "doc_id", order: str = "id") -> DataFrame:
    """Overlap in time of each row with its predecessor by start."""
    by = Window.partitionBy(key).orderBy("startTime", order)
    first, last = F.lag("startTime").over(by), F.lag("endTime").over(by)
    shared = F.least(last, F.col("endTime")) - F.greatest(first, F.col("startTime"))
    return chunks.withColumn("overlap", F.coalesce(F.greatest(F.lit(0.0), shared), F.lit(0.0)))


def span_seconds(start: str = "startTime", end: str = "endTime") -> Column:
    """Latest end less earliest start, at least zero: an aggregate (A4)."""
    return F.greatest(F.lit(0.0), F.max(end) - F.min(start))


def snap(targets: DataFrame, boundaries: DataFrame, key: str = "file_id", tolerance: float = 5.0, pinned: bool = True) -> DataFrame:
    """Each target to the nearest boundary closer than the tolerance, else itself.

    Time is cut into cells as wide as the tolerance, so that the join is on equal
    cells: a boundary goes to its own cell and both neighbours.  The earlier boundary
    wins a tie.  With ``pinned`` the first target is zero and the last ``duration``.
    Targets have (key, pos, target[, duration]), boundaries (key, boundary).
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    spread = boundaries.select(key, "boundary", F.explode(F.array(cell("boundary") - 1, cell("boundary"), cell("boundary") + 1)).alias("cell"))
    near = targets.withColumn("cell", cell("target")).join(spread, [key, "cell"])
    near = near.where(F.abs(F.col("boundary") - F.col("target")) < tolerance)
    best = near.groupBy(key, "pos").agg(F.min_by("boundary", F.struct(F.abs(F.col("boundary") - F.col("target")), "boundary")).alias("near"))
    out = targets.join(best, [key, "pos"], "left")
    snapped = F.coalesce("near", "target")
    if pinned:
        by = Window.partitionBy(key)
        snapped = F.when(F.col("pos") == F.min("pos").over(by), 0.0).when(F.col("pos") == F.max("pos").over(by), F.col("duration")).otherwise(snapped)
    return out.withColumn("snapped", snapped).drop("near")
