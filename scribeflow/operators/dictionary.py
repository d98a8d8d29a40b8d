"""Dictionary correction: ranked rules, ordered replacement, hints.

Rules are rows (lang, kind, ord, pat_ord, pattern, replacement, category, priority,
context_keywords).  A dictionary is small by nature (its limits are below), and its
size is checked before it becomes a constant of an expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.predicates import has_keyword

RULE_SCHEMA = "lang string, kind string, ord int, pat_ord int, pattern string, replacement string, category string, priority int, context_keywords array<string>"


def top_rules(rules: DataFrame) -> DataFrame:
    """The first rules by priority of each language and kind, order kept on ties (O3).

    Limits count entries, not their patterns: 50 definite, 150 contextual, 20 plain.
    """
    limit = F.when(F.col("kind") == "definite", config.MAX_DEFINITE).when(F.col("kind") == "contextual", config.MAX_CONTEXTUAL).otherwise(config.MAX_PLAIN_RULES)
    by = Window.partitionBy("lang", "kind").orderBy(F.coalesce("priority", F.lit(config.DEFAULT_PRIORITY)).desc(), "ord")
    return rules.withColumn("_rank", F.dense_rank().over(by)).where(F.col("_rank") <= limit).drop("_rank")


def rules_for(rules: DataFrame, language: str) -> DataFrame:
    """Rules of a language, or of all; the Korean ones only in auto, as observed."""
    if language == "auto":
        return rules
    return rules.where(F.col("lang").isin(language, "multi") & (F.lit(language) != "ko"))


def literal(pattern: str) -> str:
    return "(?iu)" + re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", pattern)


def replace_all(text: Column, pattern: str, replacement: str) -> Column:
    """Case-blind literal replacement; ``$`` and backslash of the replacement are text."""
    safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, F.lit(literal(pattern)), F.lit(safe))


def corrected(text: Column, rules: Sequence[Row]) -> Column:
    """All rules in order; a condition looks at the text corrected so far.

    One fold over a constant array of rules: the expression grows with their number,
    not with its powers.
    """
    if not rules:
        return text
    table = F.array(
        *[
            F.struct(
                F.lit(literal(r["pattern"])).alias("pattern"),
                F.lit(r["replacement"].replace("\\", "\\\\").replace("$", "\\$")).alias("new"),
                F.lit(r["kind"] == "contextual").alias("asks"),
                F.array(*[F.lit(w) for w in r["context_keywords"] if r["kind"] == "contextual"] if r["context_keywords"] is not None else []).cast("array<string>").alias("words"),
            )
            for r in rules
        ]
    )
    return F.aggregate(table, text, lambda own, r: F.when(~r["asks"] | has_keyword(own, r["words"]), F.regexp_replace(own, r["pattern"], r["new"])).otherwise(own))


def correct(docs: DataFrame, rules: DataFrame, text: str = "text", out: str = "corrected", most: int = 2_000) -> DataFrame:
    """Add the corrected text; more than ``most`` rules are an error, not cut short."""
    held = rules.orderBy("kind", "ord", "pat_ord").limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} rules")
    held = sorted(held, key=lambda r: ({"definite": 0, "contextual": 1}.get(r["kind"], 2), r["ord"], r["pat_ord"]))
    return docs.withColumn(out, corrected(F.col(text), held))


def hints(rules: DataFrame) -> DataFrame:
    """A line per category, in order of first use: 【category】from→to、…."""
    pair = F.concat("pattern", F.lit("→"), "replacement")
    rows = rules.withColumn("category", F.coalesce("category", F.lit("other")))
    place = F.struct("ord", "pat_ord")
    out = rows.groupBy("lang", "category").agg(F.min(place).alias("first"), F.array_sort(F.collect_list(F.struct("ord", "pat_ord", pair.alias("p")))).alias("all"))
    line = F.concat(F.lit("【"), F.col("category"), F.lit("】"), F.array_join(F.transform("all", lambda x: x["p"]), "、"))
    return out.select("lang", "category", line.alias("hint"), F.row_number().over(Window.partitionBy("lang").orderBy("first", "category")).alias("line_no"))


def relevant(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text", block: int = 50_000) -> DataFrame:
    """Contextual rules whose keywords occur in each text (J4, J10): (key, ord, pat_ord).

    The keywords become one automaton, and a text is read once for all of them.  More
    than ``block`` keywords are taken in blocks, each in a scan of its own: no join of
    texts with keywords.
    """
    words = rules.where("kind = 'contextual'").select("ord", "pat_ord", F.explode("context_keywords").alias("word")).where("word is not null").distinct()
    kind = dict(docs.dtypes)[key]
    rows, out = docs.select(key, text), None
    for held in _blocks(words, block):
        part = rows.mapInPandas(_keyword_scan(held, key, text), f"{key} {kind}, ord int, pat_ord int")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _blocks(words: DataFrame, size: int) -> Iterator[list[tuple[int, int, str]]]:
    """Keywords in blocks of bounded size; one empty block where there are none."""
    held: list[tuple[int, int, str]] = []
    some = False
    for r in words.toLocalIterator():
        held.append((r["ord"], r["pat_ord"], r["word"]))
        if len(held) == size:
            yield held
            held, some = [], True
    if held or not some:
        yield held


def _keyword_scan(words: Sequence[tuple[int, int, str]], key: str, text: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        own: dict[str, list[tuple[int, int]]] = {}
        for o, p, w in words:
            own.setdefault(w, []).append((o, p))
        always = own.pop("", [])  # every text contains the empty word
        found = ahocorasick.Automaton()
        for w, at in own.items():
            found.add_word(w, at)
        found.make_automaton()
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[text]):
                if t is not None:
                    hits = set(always).union(*(at for _, at in found.iter(t))) if own else set(always)
                    out += [(k, o, p) for o, p in hits]
            yield pd.DataFrame(out, columns=[key, "ord", "pat_ord"])

    return run


def flattened(entries: DataFrame) -> DataFrame:
    """Entries (lang, kind, ord, from[], to, …) to a row per pattern."""
    return entries.select("lang", "kind", "ord", F.posexplode("from").alias("pat_ord", "pattern"), F.col("to").alias("replacement"), "category", "priority", "context_keywords")


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace those of the same key."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.distinct(), keys.columns, "left_anti")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Import by merging: new rows behind the old ones, repeats kept."""
    last = old.groupBy("lang", "kind").agg((F.max("ord") + 1).alias("_next"))
    shifted = new.join(last, ["lang", "kind"], "left").withColumn("ord", F.col("ord") + F.coalesce("_next", F.lit(0))).drop("_next")
    return old.unionByName(shifted.select(*old.columns))


def rules_frame(spark, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), RULE_SCHEMA)
