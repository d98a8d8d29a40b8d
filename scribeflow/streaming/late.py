"""Rows behind the watermark as a table, beside those that count and those that came twice.

Spark drops what is behind the watermark.  Here each micro-batch is dealt to three
tables: ``kept``, ``double`` (a row of its ids was kept before, or earlier in the
batch) and ``late`` (its time is more than the delay behind the newest one of all
earlier batches).  Every row of the input is in one of them.  A batch's share is
written under its number in place of what an attempt before has left, so that batches may run
again; what a batch needs of earlier ones is the newest time, one row per batch, and the
ids of kept rows within the delay, for which only the folders of that time are read.

A batch is one window over its ids and one write: the tables are partitions of it, and
before the write rows of a folder meet, so that files grow with the rows and not with
tasks times folders.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TABLES = ("kept", "double", "late")
_ADAPTIVE = "spark.sql.adaptive.enabled"


@contextmanager
def adaptive(spark: SparkSession) -> Iterator[None]:
    """Shuffles within are merged and split by size, which the session of a stream has switched off."""
    before = spark.conf.get(_ADAPTIVE)
    spark.conf.set(_ADAPTIVE, "true")
    try:
        yield
    finally:
        spark.conf.set(_ADAPTIVE, before)


def without_doubles(stream: DataFrame, ids: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The stream without rows whose ids came before within the delay; late rows are dropped unseen."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(ids)


class LateRows:
    """Deals the batches of a stream to the three tables below ``folder``."""

    def __init__(self, folder: str, ids: list[str], time: str, delay_seconds: float):
        self.folder, self.ids, self.time, self.delay = folder.rstrip("/"), ids, time, delay_seconds
        #: Microseconds of a folder of kept rows: an hour, or a quarter of a long delay.
        self.span = int(max(3600, delay_seconds / 4) * 1_000_000)

    def _read(self, spark: SparkSession, name: str, holds: str, schema: str | None = None) -> DataFrame | None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{holds}")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
            return None
        reader = spark.read.option("basePath", f"{self.folder}/{name}")
        return (reader.schema(schema) if schema else reader).parquet(f"{self.folder}/{name}")

    def batch(self, rows: DataFrame, number: int) -> None:
        with adaptive(rows.sparkSession):
            self._deal(rows, number)

    def _deal(self, rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        micros = F.unix_micros(F.col(self.time).cast("timestamp"))
        marks = self._read(spark, "marks", "batch=*", "newest long, batch long")
        newest = marks.where(F.col("batch") < number).agg(F.max("newest")).first()[0] if marks is not None else None
        # Rows without a time are never late; they count as of the mark.
        mark = None if newest is None else newest - round(self.delay * 1e6)
        late = F.lit(False) if mark is None else F.coalesce(micros < mark, F.lit(False))
        span = F.coalesce(F.floor(micros / self.span), F.lit(0 if mark is None else mark // self.span)).cast("long")
        dealt = rows.withColumns({"_late": late, "_span": span, "_place": F.monotonically_increasing_id(), "_known": F.lit(False)})
        before = self._read(spark, "rows", "batch=*/_table=kept")
        if before is not None and mark is not None:
            # Ids that are known go first, so that each row of the batch behind them is a double.
            held = before.where((F.col("_table") == "kept") & (F.col("_span") >= mark // self.span) & (F.col("batch") < number))
            held = held.select(*self.ids).withColumns({"_late": F.lit(False), "_known": F.lit(True)})
            dealt = dealt.unionByName(held, allowMissingColumns=True)
        at = F.row_number().over(Window.partitionBy(*self.ids, "_late").orderBy(F.col("_known").desc(), F.col(self.time).asc_nulls_last(), "_place"))
        where = F.when(F.col("_late"), "late").when(F.col("_at") > 1, "double").otherwise("kept")
        dealt = dealt.withColumn("_at", at).where(~F.col("_known")).withColumn("_table", where)
        # Only kept rows are sought by their time.
        dealt = dealt.withColumn("_span", F.when(F.col("_table") == "kept", F.col("_span")).otherwise(0)).drop("_known", "_late", "_place", "_at")
        out = dealt.hint("rebalance", F.col("_table"), F.col("_span"))
        out.write.mode("overwrite").partitionBy("_table", "_span").parquet(f"{self.folder}/rows/batch={number}")
        top = rows.agg(F.max(micros).alias("newest")).select(F.greatest("newest", F.lit(newest).cast("long")).alias("newest"))
        top.write.mode("overwrite").parquet(f"{self.folder}/marks/batch={number}")

    def start(self, stream: DataFrame, **trigger: object) -> StreamingQuery:
        """Run the stream; its place is kept below the same folder."""
        return stream.writeStream.option("checkpointLocation", f"{self.folder}/state").trigger(**(trigger or {"availableNow": True})).foreachBatch(self.batch).start()

    def table(self, spark: SparkSession, name: str, columns: list[str]) -> DataFrame | None:
        """One of the three tables; none as long as no batch has had such a row."""
        rows = self._read(spark, "rows", f"batch=*/_table={name}")
        return None if rows is None else rows.where(F.col("_table") == name).select(*columns, "batch")
