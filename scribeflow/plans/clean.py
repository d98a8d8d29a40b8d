"""The cleaning pipeline: stages by strategy, audit, and two milder passes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..config import CleaningPlan
from ..functions import kernels
from ..functions import text as T
from ..functions.arrow import row_function

STAGE_SCHEMA = "array<struct<cleaner:string,before:int,after:int,issues:array<string>,patterns:array<string>>>"

_STAGES = pa.list_(pa.struct([("cleaner", pa.string()), ("before", pa.int32()), ("after", pa.int32()), ("issues", pa.list_(pa.string())), ("patterns", pa.list_(pa.string()))]))
_RAN = pa.struct([("text", pa.string()), ("stages", _STAGES)])


@dataclass(frozen=True)
class Stage:
    """A cleaner of one text: (text, language) to (text, issues, patterns).

    The extension point of the pipeline: any such function can be a stage.
    """

    name: str
    clean: Callable[[str, str], tuple[str, list[str], list[str]]]


def artefact_stage(plan: CleaningPlan, paragraphs: bool = True) -> Stage:
    return Stage("artefacts", lambda t, lang: kernels.clean_artefacts(t, lang, plan, paragraphs))


def tail_stage(plan: CleaningPlan) -> Stage:
    def run(t, lang):
        own, notes = kernels.compress_tail(t, lang, plan.tail)
        return own, [], notes

    return Stage("tail", run)


def stamped_tail_stage(plan: CleaningPlan) -> Stage:
    def run(t, lang):
        own, notes = kernels.compress_stamped_tail(t, plan.tail)
        return own, [], notes

    return Stage("stamped tail", run)


def block_stage(plan: CleaningPlan, min_chars: int | None = None) -> Stage:
    def run(t, lang):
        own, notes = kernels.compress_blocks(t, lang, min_chars or plan.block_chars, plan.block_sentences)
        return own, [], notes

    return Stage("blocks", run)


def stages_of(plan: CleaningPlan, artefacts: bool = True, paragraphs: bool = True) -> list[Stage]:
    """The Python stages of a strategy in order (C2, C3); 'standard' has none.

    Leak removal stands before them and the Japanese checks behind, both as
    built-in expressions.
    """
    if plan.pipeline == "gpt4o":
        rest = [tail_stage(plan), block_stage(plan)]
    elif plan.pipeline == "whisper":
        rest = [stamped_tail_stage(plan), tail_stage(plan)]
    else:
        return []
    return ([artefact_stage(plan, paragraphs)] if artefacts else []) + rest


def run_stages(df: DataFrame, stages: Sequence[Stage], text: str, language: str, out: str, audit: str) -> DataFrame:
    """All stages in one Arrow function (C1): the text and a row of audit per stage.

    A stage that fails keeps the text and leaves an issue.
    """
    if not stages:
        return df.withColumns({out: F.col(text), audit: F.array().cast(STAGE_SCHEMA)})

    run = row_function(lambda t, lang: dict(zip(("text", "stages"), staged(t, lang, stages))), _RAN, f"text string, stages {STAGE_SCHEMA}", 2)
    ran = run(text, language)
    return df.withColumn("_ran", ran).withColumns({out: F.col("_ran.text"), audit: F.col("_ran.stages").cast(STAGE_SCHEMA)}).drop("_ran")


def staged(text: str | None, language: str | None, stages: Sequence[Stage]) -> tuple[str | None, list[dict]]:
    """A text through stages, and a row of audit for each."""
    rows = []
    for stage in stages if text is not None else ():
        before = len(text)
        try:
            text, issues, patterns = stage.clean(text, language or "auto")
        except Exception as error:  # a broken stage must not lose the text
            issues, patterns = [f"{stage.name} failed: {error}"], []
        rows.append({"cleaner": stage.name, "before": before, "after": len(text), "issues": issues, "patterns": patterns})
    return text, rows


def with_milder(df: DataFrame, plan: CleaningPlan, asked: Column) -> DataFrame:
    """Both milder passes over the rows that ask for one, in one function: their texts
    and stages.  Its input is null for nearly all rows, and so is its answer."""
    second, third = stages_of(plan, paragraphs=False), stages_of(plan, artefacts=False)

    def both(t, lang):
        return {name: None if t is None else dict(zip(("text", "stages"), staged(t, lang, s))) for name, s in (("two", second), ("three", third))}

    run = row_function(both, pa.struct([("two", _RAN), ("three", _RAN)]), f"two struct<text:string,stages:{STAGE_SCHEMA}>, three struct<text:string,stages:{STAGE_SCHEMA}>", 2)
    ran = df.withColumn("_ran", run(F.when(asked, F.col("_lead")), F.when(asked, F.col("_lang"))))
    parts = {f"_{c}{n}": F.col(f"_ran.{name}.{k}") for n, name in ((2, "two"), (3, "three")) for c, k in (("text", "text"), ("stages", "stages"))}
    return ran.withColumns(parts).drop("_ran")


def clean(df: DataFrame, model: str, text: str = "text", language: str | None = None, seconds: str | None = None) -> DataFrame:
    """Clean a text column by a model's strategy (C4).

    Adds ``cleaned``, ``stages``, ``issues`` and ``pass`` (1, or 2 and 3 for the
    milder passes: without paragraph compression, then without artefact removal), all
    of the pass that was chosen.  Each pass is judged by the same rule on its own text
    and issues; milder passes run on the rows that ask for them only.
    """
    plan = config.cleaning_plan(model)
    spoken = F.col(language) if language else F.lit("auto")
    long = F.col(seconds).cast("double") if seconds else F.lit(None).cast("double")
    base = df.withColumns({"_text": F.coalesce(F.col(text), F.lit("")), "_lang": F.coalesce(spoken, F.lit("auto")), "_secs": long})
    if plan.pipeline == "gpt4o":
        base = base.withColumn("_lead", F.when(T.leak_suspect(F.col("_text")), T.leak_cleaned(F.col("_text"), plan)).otherwise(F.col("_text")))
    else:
        base = base.withColumn("_lead", F.col("_text"))

    def judged(rows: DataFrame, nth: int, asked: Column) -> tuple[DataFrame, Column]:
        """Issues of a pass on the rows that ask for it, and which of them ask for a milder one."""
        text, issues = F.col(f"_text{nth}"), f"_issues{nth}"
        found = T.japanese_issues(text, F.length("_text"), F.col("_secs"), plan)
        checks = F.when(asked & T.is_japanese(text, F.col("_lang"), plan.japanese), found).otherwise(F.array().cast("array<string>"))
        rows = rows.withColumn(issues, F.concat(F.flatten(F.transform(f"_stages{nth}", lambda s: s["issues"])), checks))
        bad = T.needs_fallback(text, F.length("_text"), F.col(issues), F.col("_secs"), plan) & (F.length("_text") > 0)
        return rows.withColumn(f"_bad{nth}", F.coalesce(asked & bad, F.lit(False))), F.col(f"_bad{nth}")

    out, bad1 = judged(run_stages(base, stages_of(plan), "_lead", "_lang", "_text1", "_stages1"), 1, F.lit(True))
    out, bad2 = judged(with_milder(out, plan, bad1), 2, bad1)
    out, _ = judged(out, 3, bad2)
    chosen = lambda name: F.when(bad2, F.col(f"{name}3")).when(bad1, F.col(f"{name}2")).otherwise(F.col(f"{name}1"))
    nth = F.when(bad2, F.lit(3)).when(bad1, F.lit(2)).otherwise(F.lit(1))
    out = out.withColumns({"cleaned": chosen("_text"), "stages": chosen("_stages"), "issues": chosen("_issues"), "pass": nth})
    return out.select(*[c for c in df.columns if c not in ("cleaned", "stages", "issues", "pass")], "cleaned", "stages", "issues", "pass")


def audit(df: DataFrame, key: str) -> DataFrame:
    """A row per text: stages, patterns, first ten of them, issues, lengths."""
    patterns = F.flatten(F.transform("stages", lambda s: s["patterns"]))
    before = F.element_at("stages", 1)["before"]
    return df.select(
        key,
        F.size("stages").alias("stages"),
        F.array_join(F.transform("stages", lambda s: s["cleaner"]), " -> ").alias("sequence"),
        F.size(patterns).alias("patterns"),
        F.slice(patterns, 1, 10).alias("sample"),
        F.size("issues").alias("issues"),
        F.length("cleaned").alias("final_length"),
        F.when(before > 0, (before - F.length("cleaned")) / before).alias("reduction"),
    )


def contamination(text: Column) -> Column:
    """low, medium or high by kinds of leakage found."""
    score = (
        F.when(text.rlike(config.ANY_TAG), 2).otherwise(0)
        + F.when(F.exists(F.array(*[F.lit(p) for p in config.INSTRUCTIONS]), lambda p: text.contains(p)), 3).otherwise(0)
        + F.when(text.rlike("(?i)(context|前の文脈|上文|이전 문맥|続き)\\s*[:：]"), 1).otherwise(0)
    )
    return F.when(score >= 4, "high").when(score >= 2, "medium").otherwise("low")
