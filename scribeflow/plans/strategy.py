"""From planned chunks and their results to one row per recording.

A row has the merged text, the segments in order of time, and what went wrong as
columns: an interrupted recording is a row with a header, not an exception.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.numbers import progress, remaining_ms
from ..operators import merging

# Labels of partial results.
LABELS = {
    "partialResult": "Partial transcription result",
    "completed": "Completed",
    "partialSummary": "{processed}/{total} chunks processed.",
    "partialCancelled": "Transcription cancelled. Completed {processed} out of {total} chunks.",
    "partialError": "Partial transcription due to error: {error}. Completed {processed} out of {total} chunks.",
    "partialNoChunks": "Transcription was cancelled before any chunks were processed.",
    "noTranscriptionResults": "No transcription results obtained",
}
# A message with one of these means that the user has stopped the run.
CANCELLED = ("cancelled", "aborted")


def _filled(label: str, **values: Column) -> Column:
    out = F.lit(label)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def with_figures(results: DataFrame, name: str = "strategy") -> tuple[DataFrame, Observation]:
    """The results, and figures that the pass over them leaves: chunks, failures, characters, seconds, rows with segments."""
    seen = Observation(name)
    figures = (
        F.count("*").alias("chunks"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failed"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), F.coalesce(F.sum(F.col("endTime") - F.col("startTime")), F.lit(0.0)).alias("seconds"),
        F.count_if(F.col("segments").isNotNull()).alias("segmented"),
    )
    return results.observe(seen, *figures), seen


def strategy_result(
    planned: DataFrame,
    results: DataFrame,
    key: str = "doc_id",
    timestamps: bool = False,
    labels: Mapping[str, str] = LABELS,
    merge: Callable[[DataFrame], DataFrame] | None = None,
    post_processing: bool = False,
) -> DataFrame:
    """A row per planned recording.

    ``planned``: (key, total chunks, stopped), ``stopped`` being the message of what ended
    the run, null where nothing did; optionally ``elapsed_ms``.  ``results``: (key, id, text,
    startTime, endTime, success, error, segments).  ``merge`` takes the results and
    returns (key, text), by default the texts joined in order of time; for long recordings
    give one that removes overlaps.

    Columns: key, outcome (complete, partial, cancelled or failed), text, segments (where
    ``timestamps`` asks for them and there are any), partial, error, processed, total,
    percentage, remaining_ms.

    The results of one recording meet in one row, as its text is one.  Results without a
    plan are left out; a repeated plan is one plan, the largest total of it.  A null
    ``success`` is a failure, a null text empty, a missing total counts as 0.
    """
    results = results.withColumns({"success": F.coalesce("success", F.lit(False)), "text": F.coalesce("text", F.lit(""))})
    good = F.col("success")
    listed = F.when(good & F.col("segments").isNotNull(), F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))))
    figures = [F.count("*").alias("came"), F.count_if(good).alias("processed")]
    if timestamps:
        figures.append(F.array_sort(F.flatten(F.collect_list(listed))).alias("segments"))
    if merge is None:
        piece = F.when(good, F.struct("startTime", "id", "text"))
        figures.append(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "\n\n").alias("merged"))
    told = results.groupBy(key).agg(*figures)
    if merge is not None:
        told = told.join(merge(results).select(key, F.col("text").alias("merged")), key, "left")
    timed = "elapsed_ms" in planned.columns
    elapsed = F.max("elapsed_ms") if timed else F.lit(None)
    plan = planned.groupBy(key).agg(F.coalesce(F.max("total"), F.lit(0)).cast("long").alias("total"), F.max("stopped").alias("stopped"), elapsed.cast("double").alias("_elapsed"))
    rows = plan.join(told, key, "left").withColumns({"came": F.coalesce("came", F.lit(0)), "processed": F.coalesce("processed", F.lit(0)), "merged": F.coalesce("merged", F.lit(""))})

    stopped = F.col("stopped")
    by_user = F.coalesce(F.exists(F.array(*[F.lit(w) for w in CANCELLED]), lambda w: stopped.contains(w)), F.lit(False))
    some, short = F.col("came") > 0, F.col("processed") < F.col("total")
    partial = F.when(some, short | stopped.isNotNull()).otherwise(by_user)
    counts = {"processed": F.col("processed").cast("string"), "total": F.col("total").cast("string")}
    head = F.concat(F.lit(labels["partialResult"] + "\n"), _filled(labels["partialSummary"], **counts), F.lit("\n\n"), F.col("merged"))
    text = F.when(some & partial, head).when(some, F.col("merged")).when(by_user, F.lit(labels["partialResult"] + "\n\n" + labels["partialNoChunks"]))
    message = F.when(stopped == "", "error").otherwise(stopped)
    error = (
        F.when(some & by_user, _filled(labels["partialCancelled"], **counts))
        .when(some & stopped.isNotNull(), _filled(labels["partialError"], **counts, error=message))
        .when(~some & by_user, F.lit(labels["partialNoChunks"]))
        .when(~some, F.coalesce(message, F.lit(labels["noTranscriptionResults"])))
    )
    outcome = F.when(by_user, "cancelled").when(~some, "failed").when(partial, "partial").otherwise("complete")
    segments = [F.when(F.size("segments") > 0, F.col("segments")).alias("segments")] if timestamps else []
    done = F.when(some, 100).otherwise(progress(F.col("came"), F.col("total"), post_processing)).cast("int")
    return rows.select(
        key, outcome.alias("outcome"), text.alias("text"), *segments, partial.alias("partial"), error.alias("error"),
        F.col("processed"), F.col("total"), done.alias("percentage"), remaining_ms(F.col("_elapsed"), F.col("processed"), F.col("total")).alias("remaining_ms"),
    )


def with_failures(out: DataFrame, results: DataFrame, key: str = "doc_id") -> DataFrame:
    """The report of failed chunks behind each text, where there are any."""
    report = merging.failure_report(results, key).select(key, "report")
    return out.join(report, key, "left").withColumn("text", F.when(F.col("report").isNotNull() & F.col("text").isNotNull(), F.concat("text", F.lit("\n\n---\n"), "report")).otherwise(F.col("text"))).drop("report")
