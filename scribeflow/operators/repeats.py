"""Repetition operators on a text column.

Rule R1: a cheap built-in gate decides which rows can change at all; only those go
to an Arrow function, the others keep their text without leaving the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CleaningPlan, TailRules
from ..functions import kernels
from ..functions.arrow import row_function
from ..functions import text as T


def arrow_text(fold: Callable[[str], str]):
    """An Arrow function of one text; null stays null."""
    return row_function(lambda t: None if t is None else fold(t), pa.string(), "string")


def routed(df: DataFrame, text: str, out: str, gate: Column, fold: Callable[[str], str]) -> DataFrame:
    """Apply a fold to the rows that pass the gate.

    The gate nulls the function's input: other rows cost a null on the wire.
    """
    held = F.when(gate, F.col(text))
    return df.withColumn("_in", held).withColumn("_out", arrow_text(fold)("_in")).withColumn(out, F.coalesce("_out", text)).drop("_in", "_out")


def collapse_equal_lines(df: DataFrame, text: str = "text", out: str = "collapsed") -> DataFrame:
    """Runs of equal lines to one: a fold within the row, by built-in functions."""
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))
    return df.withColumn(out, F.array_join(kept, "\n"))


def line_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of equal lines as rows (key, run, line, n), by gaps and islands."""
    rows = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    by = Window.partitionBy(key).orderBy("pos")
    fresh = F.lag("line").over(by).isNull() | (F.lag("line").over(by) != F.col("line"))
    marked = rows.withColumn("run", F.sum(fresh.cast("int")).over(by))
    return marked.groupBy(key, "run").agg(F.first("line").alias("line"), F.count("*").alias("n"))


def tail_run(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 3) -> DataFrame:
    """(key, line, n): equal non-empty lines at the end, where there are enough (W13, unit 1)."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), T.strip), lambda x: x != "")
    # Named, so that a line's comparison does not split and strip the text anew.
    def run(back: Column, line: Column) -> Column:
        other = F.array_position(F.transform(back, lambda x: x != line), True)
        return T.let(other, lambda at: F.struct(line.alias("line"), F.when(at > 0, at - 1).otherwise(F.size(back)).cast("long").alias("n")))

    found = T.let(F.reverse(lines), lambda back: T.let(F.get(back, F.lit(0)), lambda line: run(back, line)))
    return df.select(key, found.alias("_run")).select(key, "_run.line", "_run.n").where(F.col("n") >= least)


def collapse_phrases(df: DataFrame, text: str = "text", out: str = "collapsed", enumerations: int | None = None) -> DataFrame:
    """Phrase repetition (W15); lists keep one round where asked for.

    A vectorised comparison of each text with itself, in the Arrow function, decides
    whether the back-reference patterns run: they cost far more than the transfer.
    """
    return routed(df, text, out, F.length(text) >= 10, lambda t: kernels.collapse_phrases(t, enumerations))


def sentence_marks(text: Column) -> Column:
    return T.matches(text, "[。.!?！？]+\\s*")


def collapse_sentences(df: DataFrame, plan: CleaningPlan, text: str = "text", out: str = "collapsed", language: str = "auto") -> DataFrame:
    return routed(df, text, out, sentence_marks(F.col(text)) > 0, lambda t: kernels.collapse_sentences(t, language, plan))


def compress_paragraphs(df: DataFrame, plan: CleaningPlan, text: str = "text", out: str = "collapsed", language: str = "auto") -> DataFrame:
    gate = sentence_marks(F.col(text)) >= plan.paragraph_repeats - 1
    return routed(df, text, out, gate, lambda t: kernels.compress_paragraphs(t, language, plan))


def compress_blocks(df: DataFrame, plan: CleaningPlan, text: str = "text", out: str = "collapsed", language: str = "auto") -> DataFrame:
    gate = (F.length(text) >= 2 * plan.block_chars) | F.col(text).contains("\r")
    return routed(df, text, out, gate, lambda t: kernels.compress_blocks(t, language, plan.block_chars, plan.block_sentences)[0])


def compress_tail(df: DataFrame, rules: TailRules, text: str = "text", out: str = "collapsed", language: str = "auto") -> DataFrame:
    gate = (sentence_marks(F.col(text)) >= rules.repeats - 1) | T.strip(F.col(text)).contains("\n") | (F.col(text) != T.strip(F.col(text)))
    return routed(df, text, out, gate, lambda t: kernels.compress_tail(t, language, rules)[0])


def compress_stamped_tail(df: DataFrame, rules: TailRules, text: str = "text", out: str = "collapsed") -> DataFrame:
    gate = F.col(text).rlike("\\[\\d+:\\d{2}") | (F.col(text) != T.strip(F.col(text))) | F.col(text).contains("\r")
    return routed(df, text, out, gate, lambda t: kernels.compress_stamped_tail(t, rules)[0])


def folded(df: DataFrame, text: str = "text", out: str = "folded", loose: bool = False) -> DataFrame:
    """Text for comparison: compatibility forms, case, kana, marks (F1, F2)."""
    return df.withColumn(out, arrow_text(kernels.loose if loose else kernels.strict)(text))


def folded_places(df: DataFrame, text: str = "text", out: str = "places") -> DataFrame:
    """The place in the text of each character of its strict fold."""
    places = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else kernels.indexed(t, kernels._STRICT)[1]).astype(object), "array<long>")
    return df.withColumn(out, places(text))


def reduce_short_kana(df: DataFrame, plan: CleaningPlan, text: str = "text", out: str = "reduced", strict_reference: bool = True) -> DataFrame:
    """Short kana words that occur too often."""
    fold = lambda t: kernels.reduce_short_kana(t, len(t), plan, strict_reference)
    return routed(df, text, out, F.col(text).rlike("[あ-んア-ン]"), fold)


def without_duplicates(df: DataFrame, least: int, similarity: float, reach: int = 1000, text: str = "text", out: str = "collapsed") -> DataFrame:
    """Later repeats of passages within reach removed."""
    return routed(df, text, out, F.length(text) >= 2 * least, lambda t: kernels.duplicate_spans(t, least, similarity, reach))


def removed(df: DataFrame, before: str = "before", after: str = "after", out: str = "removed") -> DataFrame:
    """What a removal took from a text, by common start and end."""
    taken = F.pandas_udf(lambda a, b: a.combine(b, lambda x, y: None if x is None or y is None else kernels.removed_text(x, y)).astype(object), "string")
    return df.withColumn(out, taken(before, after))
