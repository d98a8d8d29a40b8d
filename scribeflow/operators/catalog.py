"""Files, history and settings: small tables around the texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T


def supported_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Audio and video files by extension."""
    return files.where(P.is_supported(T.extension(F.col(path))))


def search_files(files: DataFrame, query: str, limit: int | None = None, cols: Sequence[str] = ("name", "path")) -> DataFrame:
    """Case-blind search over columns, in order of the path."""
    out = files.where(P.found_in(query, *[F.col(c) for c in cols])).orderBy(cols[-1])
    return out.limit(limit) if limit else out


def notes_of(files: DataFrame, stamp: str, column: str = "transcription_timestamp", extension: str = "extension") -> DataFrame:
    """Notes whose front matter holds a time stamp."""
    return files.where((F.lower(extension) == "md") & F.col(column).contains(stamp))


def sort_files(files: DataFrame, by: str, ascending: bool = False, tie: str = "path") -> DataFrame:
    """Times from new to old and names from A to Z; ``ascending`` turns both around (O2)."""
    times = by in ("ctime", "mtime")
    down = times != ascending
    key = F.col(by) if times else F.lower(by)
    return files.orderBy(key.desc() if down else key.asc(), tie)


def newest(tasks: DataFrame, limit: int = 50, by: str = "startTime", tie: str = "id") -> DataFrame:
    """The newest rows of a history."""
    return tasks.orderBy(F.col(by).desc(), tie).limit(limit)


def last_state(events: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    """The last event of each task."""
    return events.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in cols])


def lookup(history: DataFrame, files: DataFrame) -> DataFrame:
    """File of each history row by path, else by a name that is unique."""
    names = files.withColumn("_n", F.count("*").over(Window.partitionBy("name"))).where("_n = 1")
    by_path = files.select(F.col("path").alias("inputFilePath"), F.col("path").alias("_path"))
    by_name = names.select(F.col("name").alias("inputFileName"), F.col("path").alias("_named"))
    out = history.join(by_path, "inputFilePath", "left").join(by_name, "inputFileName", "left")
    return out.withColumn("found", F.coalesce("_path", "_named")).drop("_path", "_named")


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Stored values over defaults, one level deep."""
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in rows.columns else F.lit(v) for k, v in defaults.items()})


def overlay_maps(values: Column, defaults: Column) -> Column:
    """A map over a map of defaults."""
    kept = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(values, k))
    return F.map_concat(kept, values)


def localised(keys: DataFrame, catalogue: DataFrame, locale: str) -> DataFrame:
    """A message by key: the locale, else English, else the key itself."""
    own = catalogue.where(F.col("locale") == locale).select("key", F.col("message").alias("_own"))
    english = catalogue.where("locale = 'en'").select("key", F.col("message").alias("_en"))
    out = keys.join(own, "key", "left").join(english, "key", "left")
    return out.select(*keys.columns, F.coalesce("_own", "_en", "key").alias("message"))


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def set_at(rows: DataFrame, position: str, index: int, **values: object) -> DataFrame:
    """Update one row by position."""
    return rows.withColumns({k: F.when(F.col(position) == index, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def status_summary(tasks: DataFrame) -> DataFrame:
    """Tasks, chunks and cost by status."""
    return tasks.groupBy("status").agg(F.count("*").alias("tasks"), F.sum("totalChunks").alias("chunks"), F.sum("completedChunks").alias("done"), F.sum("estimatedCost").alias("cost"))
