"""The flagship report: texts tidied, classed by script, measured, per language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.repeats import collapse_equal_lines


def measured(docs: DataFrame) -> DataFrame:
    """A row per document; one scan, no shuffle, no Python."""
    tidy = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tidy", T.tidy(F.col("text")))
    lines = collapse_equal_lines(tidy, "tidy", "collapsed")
    kept = F.length("collapsed")
    # The class is bound once: its patterns count over the whole text.
    told = T.let(T.detect_language(F.col("collapsed")), lambda d: F.struct(d.alias("detected"), T.estimate_tokens(F.col("collapsed"), d).alias("tokens")))
    rows = lines.select("doc_id", F.length("text").alias("chars"), kept.alias("kept"), told.alias("told"))
    return rows.select("doc_id", "told.detected", "chars", "kept", "told.tokens")


def language_report(docs: DataFrame) -> DataFrame:
    """Documents, characters, tokens and reduction per detected language."""
    rows = measured(docs)
    return rows.groupBy("detected").agg(
        F.count("*").alias("documents"),
        F.sum("chars").alias("chars"),
        F.sum("kept").alias("kept"),
        F.sum("tokens").alias("tokens"),
        F.round(F.avg(F.when(F.col("chars") > 0, (F.col("chars") - F.col("kept")) / F.col("chars")).otherwise(0.0)), 6).alias("reduction"),
    )
