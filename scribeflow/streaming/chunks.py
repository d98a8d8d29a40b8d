"""The chunk machine on streams whose frames arrive in any order (T4).

State per file: a list of the frames that the watermark has not passed, and the
machine.  A timer at the earliest waiting frame gives all frames behind the
watermark to the machine in order.  Frames that arrive twice count once.  A file ends
with the frame marked ``last``, or when no frame has come for ``idle`` seconds of
event time; its state goes then, and frames of it that come later start a new file.

Needs the RocksDB state store (``rocksdb_state``).  What a key holds is bounded by
the watermark's delay, however long the file is.  An element of the list is not a frame
but the packed frames of one batch: each element is pickled and carried over by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import ModelPlan
from ..functions import kernels

COLUMNS = ["id", "startTime", "endTime", "hasOverlap"]
FRAME = np.dtype([("frame", "<i8"), ("t", "<f8"), ("label", "<i4"), ("last", "?"), ("ms", "<i8")])
#: Frames of a packed element at most.
PACK = 1 << 16
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class ChunkProcessor(StatefulProcessor):
    """Waiting frames and the machine of one file."""

    def __init__(self, plan: ModelPlan, key: str, frame_seconds: float, idle: float):
        self.plan, self.key, self.frame_seconds, self.idle_ms = plan, key, frame_seconds, int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.pick, self.row = handle, None, Row(self.key, *COLUMNS)
        self.waiting = handle.getListState("waiting", "frames binary")
        self.machine = handle.getValueState("machine", "start double, kept_end double, silent double, end double, made int, frame long, latest long, wake long")

    def close(self) -> None:
        pass

    def _wake(self, state: tuple, frame: int, latest: int, before: int | None, wake: int) -> None:
        """Keep the machine, and one timer: at the earliest waiting frame, or at the end of the idle time."""
        if before != wake:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(wake)
        self.machine.update((*state, frame, latest, wake))

    def _packed(self, frames: np.ndarray) -> list[tuple]:
        return [(frames[k : k + PACK].tobytes(),) for k in range(0, len(frames), PACK)]

    def _came(self, rows: Iterator[Row], frame: int) -> Iterator[tuple]:
        """Rows of frames behind the last one that the machine has had, as tuples."""
        for row in rows:
            if self.pick is None:
                self.pick = itemgetter(*[row.__fields__.index(c) for c in FRAME.names])
            x = self.pick(row)
            if x[0] is not None and x[0] > frame:
                yield x

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        *state, frame, latest, wake = self.machine.get() or (None, 0.0, 0.0, 0.0, 0, -1, 0, None)
        came = np.fromiter(self._came(rows, frame), FRAME)
        if len(came):
            idle = wake is None or wake == latest + self.idle_ms
            first = int(came["ms"].min())
            self.waiting.appendList(self._packed(came))
            # The newest time of all is taken from the list when the timer expires; until then the
            # earliest waiting one stands for it, so that the timer is not taken for the idle one.
            if idle or first < wake:
                self._wake(tuple(state), frame, max(latest, first), wake, first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        *state, frame, latest, wake = self.machine.get()
        machine = kernels.ChunkMachine(self.plan, self.frame_seconds, tuple(state))
        waiting = np.concatenate([np.empty(0, FRAME), *(np.frombuffer(x[0], FRAME) for x in self.waiting.get())])[::-1]
        latest = max(latest, int(waiting["ms"].max(initial=latest)))
        # In order; of a frame that came twice, the one that came last.
        waiting = waiting[np.unique(waiting["frame"], return_index=True)[1]]
        ready, rest = waiting[waiting["ms"] <= mark].tolist(), waiting[waiting["ms"] > mark]
        made, done = [], not ready
        for frame, t, label, last, _ in ready:
            made.append(machine.step(frame, t, label, last))
            done |= last
        if done:
            made.append(machine.close())
            self.machine.clear()
            self.waiting.clear()
        else:
            if len(rest):
                self.waiting.put(self._packed(rest))
            else:
                self.waiting.clear()
            # The timer that has expired is gone.
            self._wake(machine.state, frame, latest, None, int(rest["ms"].min()) if len(rest) else latest + self.idle_ms)
        return iter([self.row(key[0], *m) for m in made if m])


def unordered_chunks(frames: DataFrame, plan: ModelPlan, time: str, key: str = "file_id", late: str = "10 seconds", frame_seconds: float = 0.03, idle: float = 600.0) -> DataFrame:
    """Chunks (key, id, startTime, endTime, hasOverlap) of a stream of frames (key, frame, t, label, last, ``time``).

    ``time`` is a timestamp that ascends with the frames of a file; frames more than
    ``late`` behind the newest of any file are lost (``late.py`` keeps such rows).
    """
    rows = frames.withWatermark(time, late).select(F.col(key).cast("string").alias(key), F.col("frame").cast("long"), F.coalesce(F.col("t").cast("double"), F.lit(float("nan"))).alias("t"), "label", "last", F.unix_millis(time).alias("ms"), time)
    schema = f"{key} string, id int, startTime double, endTime double, hasOverlap boolean"
    return rows.groupBy(key).transformWithState(ChunkProcessor(plan, key, frame_seconds, idle), schema, "append", "EventTime")
