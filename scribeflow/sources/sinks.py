"""Notes, events and logs as rows and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import predicates as P
from ..functions import text as T
from .versioned import content_digest


def notes(results: DataFrame, style: str = "callout", text: str = "text", time: str = "startTime", name: str = "inputFileName") -> DataFrame:
    """File name and body of a note per result (K1)."""
    file = F.concat(F.regexp_replace(T.file_name(F.col(name)), "\\.[^.]+\\z", ""), F.lit("-"), N.file_stamp(F.col(time)), F.lit(".md"))
    return results.withColumns({"note": T.safe_file_name(file), "body": T.note_body(F.col(text), style)})


def front_matter(results: DataFrame, model: str, text: str = "text", time: str = "startTime", status: str = "status", source: str = "inputFilePath") -> DataFrame:
    """Add the note's metadata as a struct (K2)."""
    held = F.struct(
        F.col(status).alias("status"),
        F.date_format(F.timestamp_millis(F.col(time).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.col(source).alias("source"),
        F.lit(model).alias("model"),
        F.length(text).alias("characters"),
    )
    return results.withColumn("meta", held)


def note_text(rows: DataFrame) -> DataFrame:
    """Metadata block and body as one text."""
    lines = [F.concat(F.lit(f"{k}: "), F.col(f"meta.{k}").cast("string")) for k in ("status", "timestamp", "source", "model", "characters")]
    return rows.withColumn("content", F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.col("body")))


def write_notes(rows: DataFrame, folder: str, key: str = "note") -> int:
    """Write notes as a table and compare its content with theirs; a mismatch is an error (K4)."""
    rows.write.mode("overwrite").parquet(folder)
    written = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    wanted, found = content_digest(rows), content_digest(written)
    if wanted != found or written.where(F.col(key).isNull()).limit(1).count():
        raise OSError(f"{found[0]} notes were written, and not all as the {wanted[0]} that were to be")
    return found[0]


def write_text(rows: DataFrame, folder: str, column: str = "content") -> None:
    """One text file line block per row (K1)."""
    rows.select(column).write.mode("overwrite").text(folder)


def events(results: DataFrame, key: str) -> DataFrame:
    """Completion events as JSON, and those that ask for translation (K3)."""
    done = results.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(F.lit("completed").alias("type"), F.col(key).alias("id"), F.length("text").alias("length"))).alias("value"))
    ready = results.where(T.estimate_tokens(F.col("text"), F.lit("auto")) > 0).select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(F.lit("ready-for-translation").alias("type"), F.col(key).alias("id"), T.estimate_tokens(F.col("text"), F.lit("auto")).alias("tokens"))).alias("value"))
    return done.unionByName(ready)


def audit_log(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Fields as (field, value) with what may be user text redacted."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), P.redacted(F.lit(f), F.col(f).cast("string")).alias("value")) for f in fields])
    return rows.select(F.explode(pairs).alias("p")).select("p.*")


def masked(value, depth: int = 0, most_depth: int = 3, most_items: int = 20, name: str = ""):
    """Recursive masking of a nested value for logs, bounded in depth and width (R)."""
    sensitive = name.strip().lower() in P.SENSITIVE
    if isinstance(value, str):
        return f"<redacted: {len(value)} chars>" if sensitive else value
    if depth >= most_depth and isinstance(value, (dict, list)):
        return f"<{type(value).__name__} of {len(value)}>"
    if isinstance(value, dict):
        kept = {k: masked(v, depth + 1, most_depth, most_items, k) for k, v in list(value.items())[:most_items]}
        return kept | ({"...": len(value) - most_items} if len(value) > most_items else {})
    if isinstance(value, list):
        return [masked(v, depth + 1, most_depth, most_items, name) for v in value[:most_items]] + ([f"... {len(value) - most_items} more"] if len(value) > most_items else [])
    return value


def expired(files: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """Files that a cleanup may remove: below its folder only (K9)."""
    root = prefix.rstrip("/") + "/"
    return files.where(F.col(path).startswith(root) & ~F.col(path).contains("/../"))
