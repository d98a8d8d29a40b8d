"""Structured Streaming forms of the interval operators.

Extensions: the reference has no event time.  Spark's session windows also join at
a gap equal to the limit, and are built of points; the exact form is a fold of
intervals with state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import ModelPlan
from ..functions import kernels


def frames(events: DataFrame, time: str = "ts", key: str = "user_id", length: str = "30 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Tumbling frames."""
    return events.withWatermark(time, late).groupBy(key, F.window(time, length)).agg(F.count("*").alias("n"))


def hops(events: DataFrame, length: str, step: str, time: str = "ts", key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Overlapping windows."""
    return events.withWatermark(time, late).groupBy(key, F.window(time, length, step)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, time: str = "ts", key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Sessions by silence (T3, T6); on a table or a stream alike."""
    out = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def adaptive_sessions(intervals: DataFrame, max_gap: float, key: str = "file_id", time: str | None = None, late: str = "10 seconds") -> DataFrame:
    """Intervals (key, start, end) joined while gaps are below the limit.

    State per key: the open interval.  A later one closes it and is kept open; rows
    of a batch are taken by start, so sources must be ordered across batches.  With
    ``time``, a timestamp column of the ends, the open interval is given out as soon
    as the watermark is a gap behind it; without it, the last one of a key stays open.
    """
    schema = f"{key} string, start double, end double"
    names = [key, "start", "end"]

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(own[0], *held[:2])], columns=names)
            return
        out = []
        for pdf in batches:
            for s, e, ms in pdf.sort_values("start")[["start", "end", "ms"]].itertuples(index=False):
                if held is None:
                    held = (s, e, ms)
                elif s - held[1] < max_gap:
                    held = (held[0], max(held[1], e), max(held[2], ms))
                else:
                    out.append((own[0], *held[:2]))
                    held = (s, e, ms)
        if held is not None:
            state.update(held)
            if time:
                state.setTimeoutTimestamp(max(int(held[2] + max_gap * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    if time:
        intervals = intervals.withWatermark(time, late)
    ms = F.unix_millis(F.col(time)) if time else F.lit(0).cast("long")
    rows = intervals.select(F.col(key).cast("string").alias(key), "start", "end", ms.alias("ms"), *([time] if time else []))
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(run, schema, "start double, end double, ms long", "append", timeout)


def adaptive_chunk_stream(frames: DataFrame, plan: ModelPlan, key: str = "file_id", frame_seconds: float = 0.03) -> DataFrame:
    """Chunks of a stream of frames (key, frame, t, label, last) (T4): the machine's
    state is the group's state.  The frame marked ``last`` closes the file."""
    schema = f"{key} string, id int, startTime double, endTime double, hasOverlap boolean"

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = kernels.ChunkMachine(plan, frame_seconds, (lambda x: (None if x[5] else x[0], *x[1:5]))(state.get) if state.exists else None)
        out, done = [], False
        for pdf in batches:
            for frame, t, label, last in pdf.sort_values("frame")[["frame", "t", "label", "last"]].itertuples(index=False):
                made = machine.step(int(frame), t, int(label), bool(last))
                out += [(own[0], *made)] if made else []
                done |= bool(last)
        if done:
            made = machine.close()
            out += [(own[0], *made)] if made else []
            if state.exists:
                state.remove()
        else:
            start, kept_end, silent, end, n = machine.state
            state.update((start or 0.0, kept_end, silent, end, n, start is None))
        yield pd.DataFrame(out, columns=[key, "id", "startTime", "endTime", "hasOverlap"])

    rows = frames.select(F.col(key).cast("string").alias(key), "frame", "t", "label", "last")
    kind = "start double, kept_end double, silent double, end double, made int, idle boolean"
    return rows.groupBy(key).applyInPandasWithState(run, schema, kind, "append", GroupStateTimeout.NoTimeout)


def partial_results(chunks: DataFrame, cancelled_after: str) -> DataFrame:
    """What a cancelled run gives: rows behind the mark fail, none is lost."""
    late = F.col("id") >= F.col(cancelled_after)
    return chunks.withColumns({"success": F.col("success") & ~late, "error": F.when(late, F.lit("cancelled")).otherwise(F.col("error"))})
