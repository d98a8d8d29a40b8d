"""A cache of a few sources for each reader, first in first out.

A source is named by its path and its time of change, so a changed file is another
source.  What is kept lies in a versioned table (at most ``size`` rows a reader), and a
run changes it once: the reads of the run and what the run before has kept meet in one
shuffle, sorted by reader and order, and are folded row by row.  Memory holds ``size``
names, whatever the number of reads of one reader; that fold is in order by definition,
so a reader's reads are one task's, which sorts them with spilling.

Cases: a read without path or time of change is a miss and is not kept; null is a reader
of its own; of reads with equal order those with the smaller path, then time, come first;
without reads the cache stays as it is.  A second writer in between fails and changes nothing.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versioned import VersionedTable

#: Fixed value: sources that are kept for a reader.
KEPT = 5
_HELD = "reader string, place long, path string, changed long"
_TOLD = f"{_HELD}, at long, state string, gone_path string, gone_changed long"
_ARROW = pa.schema([("reader", pa.string()), ("place", pa.int64()), ("path", pa.string()), ("changed", pa.int64()), ("at", pa.int64()), ("state", pa.string()), ("gone_path", pa.string()), ("gone_changed", pa.int64())])


def _fold(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[tuple, None] = OrderedDict()
        own: list = []  # the reader whose reads come

        def closing() -> list[tuple]:
            return [(own[0], k, *source, None, "held", None, None) for k, source in enumerate(kept)]

        for batch in batches:
            out = []
            for reader, at, path, changed in zip(*(batch.column(c).to_pylist() for c in ("reader", "at", "path", "changed"))):
                if own != [reader]:
                    out += closing() if own else []
                    own[:] = [reader]
                    kept.clear()
                source = (path, changed)
                if at is None:  # kept by the run before
                    kept[source] = None
                    continue
                hit, gone = source in kept, (None, None)
                if not hit and None not in source:
                    if len(kept) >= size:
                        gone, _ = kept.popitem(last=False)
                    kept[source] = None
                out.append((reader, None, path, changed, at, "hit" if hit else "miss", *gone))
            yield _batch(out)
        if own:
            yield _batch(closing())

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


class SourceCache:
    """The cache in a shared folder; ``size`` must stay the same from run to run."""

    def __init__(self, spark: SparkSession, folder: str, size: int = KEPT):
        if size < 1:
            raise ValueError("a cache keeps one source at least")
        self.spark, self.folder, self.size = spark, folder.rstrip("/"), size
        self.table = VersionedTable(spark, f"{self.folder}/kept")

    def held(self) -> DataFrame:
        """(reader, place, path, changed): what is kept, the oldest first."""
        newest = self.table.latest()
        return self.table.read(newest) if newest else self.spark.createDataFrame([], _HELD)

    def replay(self, reads: DataFrame) -> DataFrame:
        """Reads (reader, at, path, changed) in order of ``at``, each a hit or a miss.

        Gives the reads with ``state``, and ``gone_path`` and ``gone_changed`` of the source
        that left for it; changes what is kept.  Reads without ``at`` are an error.
        """
        before = self.table.latest()
        asked = reads.select(F.col("reader").cast("string"), F.lit(None).cast("long").alias("place"), "path", F.col("changed").cast("long"), F.coalesce(F.col("at").cast("long"), F.raise_error("a read without an order").cast("long")).alias("at"))
        rows = self.held().withColumn("at", F.lit(None).cast("long")).unionByName(asked)
        rows = rows.repartition("reader").sortWithinPartitions("reader", F.col("at").asc_nulls_first(), "place", "path", "changed")
        run = f"{self.folder}/run-{uuid.uuid4().hex}"
        rows.mapInArrow(_fold(self.size), _TOLD).write.parquet(run)
        told = self.spark.read.schema(_TOLD).parquet(run)
        self.table.write(told.where("state = 'held'").select("reader", "place", "path", "changed"), before)
        return told.where("state <> 'held'").drop("place")
