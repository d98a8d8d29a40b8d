"""JSON state, dictionaries and history: scans with defaults, migration, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "struct<from:array<string>,to:string,category:string,priority:int,contextKeywords:array<string>>"
LISTS = f"struct<definiteCorrections:array<{ENTRY}>,contextualCorrections:array<{ENTRY}>>"
TASK = "struct<id:string,inputFileName:string,inputFilePath:string,startTime:bigint,endTime:bigint,totalChunks:int,completedChunks:int,status:string,estimatedCost:double,preview:string>"
STATE = f"version int, updatedAt string, settings map<string,string>, dictionaries map<string,{LISTS}>, history array<{TASK}>, _corrupt_record string"
LANGUAGES = ("ja", "en", "zh", "ko", "multi")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """A state document as one row; what is missing gets its default."""
    rows = spark.read.schema(STATE).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    defaults = {
        "version": F.coalesce("version", F.lit(1)),
        "settings": F.coalesce("settings", F.create_map().cast("map<string,string>")),
        "history": F.coalesce("history", F.array().cast(f"array<{TASK}>")),
    }
    return rows.withColumns(defaults)


def write_state(rows: DataFrame, path: str) -> None:
    """Write a state with a new stamp; absent fields stay absent (K5)."""
    stamped = rows.drop("_corrupt_record").withColumn("updatedAt", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    stamped.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def split_names(text: Column) -> Column:
    """'a, b ,,c' to its trimmed non-empty parts: the older form of ``from``."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_dictionary(rows: DataFrame, raw: str = "json") -> DataFrame:
    """Rules of a dictionary document in either form.

    Rows (lang, kind, ord, from, to, category, priority, context_keywords); entries
    without a pattern or a replacement are left out.
    """
    doc = F.try_parse_json(raw)
    parts = []
    for lang in LANGUAGES:
        for kind, name in (("definite", "definiteCorrections"), ("contextual", "contextualCorrections")):
            for place in (f"$.dictionaries.{lang}.{name}", f"$.{lang}.{name}"):
                parts.append(F.struct(F.lit(lang).alias("lang"), F.lit(kind).alias("kind"), F.try_variant_get(doc, place, "array<variant>").alias("entries")))
    lists = rows.select(F.explode(F.array(*parts)).alias("p")).where("p.entries is not null")
    entries = lists.select("p.lang", "p.kind", F.posexplode("p.entries").alias("ord", "e"))
    get = lambda path, kind: F.try_variant_get("e", path, kind)
    names = F.coalesce(get("$.from", "array<string>"), split_names(get("$.from", "string")))
    out = entries.select(
        "lang",
        "kind",
        "ord",
        F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "").alias("from"),
        get("$.to", "string").alias("to"),
        get("$.category", "string").alias("category"),
        get("$.priority", "int").alias("priority"),
        get("$.contextKeywords", "array<string>").alias("context_keywords"),
    )
    return out.where((F.size("from") > 0) & F.col("to").isNotNull())


def dictionary_document(entries: DataFrame) -> DataFrame:
    """One JSON document (version 2) of all entries, or no row without any (K7)."""
    item = F.struct("ord", F.struct(F.col("from"), "to", "category", "priority", F.col("context_keywords").alias("contextKeywords")).alias("e"))
    lists = entries.groupBy("lang").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, item))), lambda x: x["e"]).alias(n) for k, n in (("definite", "definiteCorrections"), ("contextual", "contextualCorrections"))]
    )
    whole = lists.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", F.struct("definiteCorrections", "contextualCorrections").alias("l"))))).alias("dictionaries"), F.count("*").alias("n"))
    return whole.where("n > 0").select(F.to_json(F.struct(F.lit(2).alias("version"), "dictionaries")).alias("json"))


def history_rows(state: DataFrame) -> DataFrame:
    return state.select(F.explode("history").alias("t")).select("t.*")


def write_history(tasks: DataFrame, path: str, limit: int = 50) -> None:
    """The newest tasks, as JSON lines (K6)."""
    from ..operators.catalog import newest

    newest(tasks, limit).coalesce(1).write.mode("overwrite").json(path)
