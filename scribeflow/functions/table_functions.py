"""Table functions for SQL: folds over rows in order, without an array per key.

``register(spark)`` names them for the session; then, for instance::

    SELECT * FROM gap_runs(TABLE(SELECT user_id AS key, ts AS at, value FROM events)
                           PARTITION BY key ORDER BY at, 21600.0)

Spark shuffles and sorts the rows; a function gets them one by one and holds one
run.  (Several columns of an order stand in parentheses.)  ``LATERAL`` joins call the same functions per row.

Rows without a time begin no run of their own: they are counted in the run that is open, or
in the first one.  A null value adds nothing.  A key without rows has no run.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="key string, run int, start timestamp, end timestamp, n long, total double, gap double")
class GapRuns:
    """Runs of rows (key, at, value) whose times are at most ``limit`` seconds apart.

    ``total`` sums the values; ``gap`` is the silence that ended the run, null for the last.
    """

    def __init__(self):
        self.number, self.open = 0, None

    def _told(self, gap: float | None) -> tuple:
        key, start, end, n, total = self.open
        self.number += 1
        return key, self.number - 1, start, end, n, total, gap

    def eval(self, row: Row, limit: float) -> Iterator[tuple]:
        key, at, value = row["key"], row["at"], row["value"]
        if self.open and at is not None and self.open[2] is not None:
            gap = (at - self.open[2]).total_seconds()
            if gap > limit:
                yield self._told(gap)
                self.open = None
        if self.open is None:
            self.open = [None if key is None else str(key), at, at, 0, 0.0]
        if at is not None:
            self.open[1] = self.open[1] or at
            self.open[2] = at
        self.open[3] += 1
        self.open[4] += value or 0.0

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            yield self._told(None)


@udtf(returnType="pos int, start double, end double")
class ChunkTimes:
    """Chunk times of a length of audio: ``seconds`` each, ``overlap`` shared; for LATERAL."""

    def eval(self, duration: float, seconds: float, overlap: float) -> Iterator[tuple]:
        if duration is None or duration <= 0 or seconds is None or not overlap < seconds:
            return
        pos, start = 0, 0.0
        while True:
            end = min(start + seconds, duration)
            yield pos, start, end
            if end >= duration:
                return
            pos += 1
            start = pos * (seconds - overlap)


def register(spark: SparkSession) -> None:
    """Name the functions ``gap_runs`` and ``chunk_times`` for SQL."""
    spark.udtf.register("gap_runs", GapRuns)
    spark.udtf.register("chunk_times", ChunkTimes)
