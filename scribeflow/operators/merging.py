"""Many chunk rows to one text per document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ModelPlan
from ..functions import kernels
from ..functions.numbers import full_clock, minutes_seconds

ONE_FAILED = "**処理に失敗したチャンク:**"
MANY_FAILED = ("**処理に失敗した", "個のチャンク:**")


def ordered_join(value: Column, order: list[str | Column], separator: str) -> Column:
    """String aggregation in a given order."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    pairs = F.array_sort(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], value.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), separator)


def simple_merge(results: DataFrame, key: str, separator: str = "\n\n") -> DataFrame:
    """Texts of successful rows by start, joined (M1)."""
    good = results.where("success")
    return good.groupBy(key).agg(ordered_join(F.col("text"), ["startTime", "id"], separator).alias("text"))


def failure_line() -> Column:
    return F.concat(
        F.lit("- チャンク "),
        F.col("id").cast("string"),
        F.lit(" ("),
        minutes_seconds(F.col("startTime")),
        F.lit(" - "),
        minutes_seconds(F.col("endTime")),
        F.lit("): "),
        F.coalesce("error", F.lit("Unknown error")),
    )


def failure_report(results: DataFrame, key: str) -> DataFrame:
    """A heading and a line per failed row."""
    failed = results.where("not success").withColumn("line", failure_line())
    out = failed.groupBy(key).agg(F.count("*").alias("n"), ordered_join(F.col("line"), ["startTime", "id"], "\n").alias("lines"))
    head = F.when(F.col("n") == 1, ONE_FAILED).otherwise(F.concat(F.lit(MANY_FAILED[0]), F.col("n").cast("string"), F.lit(MANY_FAILED[1])))
    return out.select(key, F.col("n").alias("failed"), F.concat(head, F.lit("\n"), F.col("lines")).alias("report"))


def placeholder() -> Column:
    """What stands for a failed chunk in a merged text."""
    return F.concat(F.lit("【欠損: チャンク"), (F.col("id") + 1).cast("string"), F.lit(" ("), full_clock(F.col("startTime")), F.lit("–"), full_clock(F.col("endTime")), F.lit(")】\n"), F.coalesce(F.nullif("error", F.lit("")), F.lit("error")))


def with_placeholders(results: DataFrame) -> DataFrame:
    return results.withColumn("text", F.when(F.col("success"), F.col("text")).otherwise(placeholder())).withColumn("success", F.lit(True))


def split_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successful and failed rows."""
    return results.where("success"), results.where("not success")


def outcome(results: DataFrame, key: str) -> DataFrame:
    """complete, partial or failed, with counts."""
    good = F.count_if("success")
    kind = F.when(good == 0, "failed").when(good < F.count("*"), "partial").otherwise("complete")
    return results.groupBy(key).agg(F.count("*").alias("chunks"), good.alias("succeeded"), kind.alias("outcome"))


def overlap_merge(results: DataFrame, plan: ModelPlan, key: str = "doc_id", separator: str = "\n\n", include_failures: bool = False, remove: bool = True) -> DataFrame:
    """Overlap-removing merge (M2, M5): (key, text).

    A document of one chunk, or without neighbours that overlap in time, is joined by
    built-in functions; only the others go to the fold, one document a group.
    """
    from .intervals import neighbour_overlap

    good = results.where("success")
    marked = neighbour_overlap(good.select(key, "id", "text", "startTime", "endTime"), key)
    gathered = marked.groupBy(key).agg(
        F.max(F.col("overlap") > 0).alias("folds"),
        F.array_sort(F.collect_list(F.struct("startTime", "id", "endTime", F.coalesce("text", F.lit("")).alias("text")))).alias("chunks"),
    )
    plain = gathered.where(~F.col("folds") | F.lit(not remove))
    joined = F.transform("chunks", lambda c: c["text"])
    plain = plain.select(key, F.regexp_replace(F.array_join(joined, separator), "(?U)\\A\\s+|\\s+\\z", "").alias("text"))
    kind = dict(results.dtypes)[key]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [kernels.merge_chunks([(c["text"], c["startTime"], c["endTime"]) for c in chunks], plan, separator) for chunks in pdf["chunks"]]
            yield pd.DataFrame({key: pdf[key], "text": texts})

    out = plain
    if remove:
        out = out.unionByName(gathered.where("folds").select(key, "chunks").mapInPandas(fold, f"{key} {kind}, text string"))
    if include_failures:
        report = failure_report(results, key).select(key, "report")
        out = out.join(report, key, "full_outer").select(
            key,
            F.when(F.col("text").isNull(), F.col("report")).when(F.col("report").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n\n---\n"), "report")).alias("text"),
        )
    return out


def flatten_segments(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Segments of successful rows in order of time: (key, pos, text, start, end)."""
    rows = results.where("success and segments is not null").select(key, "id", F.posexplode("segments").alias("at", "s"))
    return rows.select(key, "id", "at", F.col("s.text").alias("text"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def dedupe_segments(segments: DataFrame, key: str, order: list[str], window: float = 30.0, ratio: float = 0.5) -> DataFrame:
    """Ordered segments without repeats and containments.

    Rows arrive sorted and only the open segment of a key is held, so a key of any
    length takes no more memory than a batch.
    """
    kind = dict(segments.dtypes)[key]
    rows = segments.select(key, "text", "start", "end", *order)
    rows = rows.repartition(key).sortWithinPartitions(key, "start", *order).select(key, "text", "start", "end")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last, pos, any_row = None, None, 0, False
        for pdf in batches:
            out = []
            for k, text, start, end in pdf.itertuples(index=False):
                if not any_row or k != own:
                    if last is not None:
                        out.append((own, pos, *last))
                    own, last, pos, any_row = k, None, 0, True
                before = last
                last, closed = kernels.next_segment(last, (text, start, end), window, ratio)
                if closed:
                    out.append((own, pos, *before))
                    pos += 1
            yield pd.DataFrame(out, columns=[key, "pos", "text", "start", "end"])
        if last is not None:
            yield pd.DataFrame([(own, pos, *last)], columns=[key, "pos", "text", "start", "end"])

    return rows.mapInPandas(fold, f"{key} {kind}, pos int, text string, start double, end double")


def stamped_line() -> Column:
    """[m:ss → m:ss] text, white space joined (M3)."""
    text = F.regexp_replace(F.regexp_replace("text", "(?U)\\s+", " "), "\\A | \\z", "")
    return F.concat(F.lit("["), minutes_seconds(F.col("start")), F.lit(" → "), minutes_seconds(F.col("end")), F.lit("] "), text)


def timed_merge(results: DataFrame, key: str = "doc_id", stamped: bool = False, include_failures: bool = False, separator: str = "\n\n") -> DataFrame:
    """Merge by segments (M3).  Where a document has any, rows without are left out,
    as observed; a document without any is merged by chunks."""
    segments = flatten_segments(results, key)
    kept = dedupe_segments(segments, key, ["id", "at"])
    value = stamped_line() if stamped else F.col("text")
    timed = kept.groupBy(key).agg(F.trim(ordered_join(value, ["pos"], "\n" if stamped else " ")).alias("text"))
    rest = simple_merge(results.join(segments.select(key).distinct(), key, "left_anti"), key, separator)
    out = timed.unionByName(rest)
    if include_failures:
        report = failure_report(results, key).select(key, "report")
        out = out.join(report, key, "left").select(key, F.concat("text", F.coalesce(F.concat(F.lit("\n\n---\n"), "report"), F.lit(""))).alias("text"))
    return out


def translated(pieces: DataFrame, key: str) -> DataFrame:
    """Translated pieces by index, empty ones left out."""
    trimmed = F.regexp_replace("text", "(?U)\\A\\s+|\\s+\\z", "")
    return pieces.where(F.length(trimmed) > 0).groupBy(key).agg(ordered_join(trimmed, ["index"], "\n\n").alias("text"))


def overlay(results: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """Processed text and confidence over results where there is one."""
    new = processed.select(*keys, F.col("text").alias("_text"), F.col("confidence").alias("_confidence"))
    out = results.join(new, keys, "left")
    return out.withColumns({"text": F.coalesce("_text", "text"), "confidence": F.coalesce("_confidence", "confidence")}).drop("_text", "_confidence")


def chunk_context(results: DataFrame, key: list[str], order: str, most: int, cleaned: bool = True) -> DataFrame:
    """Add the context for each chunk: the last sentences of its predecessor in the
    group, empty after a failure (W20); ``cleaned`` ones without loops and repeated blocks (C8)."""
    from pyspark.sql import Window

    before = F.lag(F.when(F.col("success"), F.col("text"))).over(Window.partitionBy(*key).orderBy(order))
    own = kernels.continuation if cleaned else str.strip
    tail = F.pandas_udf(lambda s: s.map(lambda t: kernels.last_sentences(own(t), most) if t else ""), "string")
    return results.withColumn("_before", before).withColumn("context", F.when(F.col("_before").isNull(), F.lit("")).otherwise(tail("_before"))).drop("_before")


def seam_overlaps(pairs: DataFrame, keys: list[str], least: int = 20, similarity: float = 0.8) -> DataFrame:
    """Fuzzy and exact overlap of two neighbouring texts.

    ``pairs`` has ``previous`` and ``current``; a row per pair, null where none is found.
    """
    fuzzy = "struct<previous_start:int,current_start:int,length:int,similarity:double>"
    exact = "struct<length:int,previous_start:int,current_start:int>"

    @F.pandas_udf(f"fuzzy {fuzzy}, exact {exact}")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b):
            near = kernels.fuzzy_overlap(x or "", y or "", least, similarity)
            same = kernels.exact_duplicate(x or "", y or "")
            out.append((dict(zip(("previous_start", "current_start", "length", "similarity"), near)) if near else None, dict(zip(("length", "previous_start", "current_start"), same)) if same else None))
        return pd.DataFrame(out, columns=["fuzzy", "exact"])

    return pairs.withColumn("_seam", run("previous", "current")).select(*keys, F.col("_seam.fuzzy").alias("fuzzy"), F.col("_seam.exact").alias("exact"))
