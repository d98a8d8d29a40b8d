"""Nested values for logs, without what may be user text (R, K10).

One expression walks a VARIANT to a fixed depth, and so takes values whose shape is
known only row by row; typed structs, maps and arrays become VARIANTs first.  The
result is JSON text.  Rules, level by level:

* under a name that tells of user text, a string leaves its length, an array its
  size, an object and anything else a mark; names of measures (``textLength``) do not count;
* other strings stay unless they have several lines or more than ``MOST_CHARS`` characters;
* of objects and arrays the first ``MOST_ITEMS`` entries stay, and a note of how
  many are left out; names come in byte order;
* below ``MOST_DEPTH`` everything but null is a mark.

Lengths count characters, line ends as one.  Null is null.  Text that is no JSON is a
string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MOST_CHARS = 120
MOST_ITEMS = 80
MOST_DEPTH = 6
USER_TEXT = (
    "text", "transcription", "transcript", "content", "prompt", "originalPrompt", "previousText", "currentText",
    "mergedText", "originalText", "cleanedText", "finalText", "segment", "segments", "raw", "body",
)
MEASURES = ("length", "count", "ratio", "size", "duration", "seconds", "ms", "index", "id")


def names_user_text(name: Column) -> Column:
    """Whether a field's name tells of user text."""
    held = F.trim(name)
    low = F.lower(held)
    measure = F.lit(False)
    for ending in MEASURES:
        measure |= F.endswith(low, F.lit(ending))
    return F.coalesce(~measure & (held.isin(*USER_TEXT) | low.isin(*USER_TEXT)), F.lit(False))


def _quoted(text: Column) -> Column:
    held = F.to_json(F.array(text))
    return F.substr(held, F.lit(2), F.length(held) - 2)


def _one_line_ends(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _chars(text: Column) -> Column:
    return F.concat(F.lit('"<redacted: '), F.length(text).cast("string"), F.lit(' chars>"'))


def _string(text: Column) -> Column:
    held = _one_line_ends(text)
    return F.when(F.contains(held, F.lit("\n")) | (F.length(held) > MOST_CHARS), _chars(held)).otherwise(_quoted(held))


def _is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _hidden(value: Column) -> Column:
    """What is left of a value under a name that tells of user text."""
    items = F.try_variant_get(value, "$", "array<variant>")
    return (
        F.when(_is_string(value), _chars(F.try_variant_get(value, "$", "string")))
        .when(items.isNotNull(), F.concat(F.lit('"<redacted: array(len='), F.size(items).cast("string"), F.lit(')>"')))
        .when(F.try_variant_get(value, "$", "map<string,variant>").isNotNull(), F.lit('"<redacted: object>"'))
        .otherwise(F.lit('"<redacted>"'))
    )


def _shown(value: Column, depth: int) -> Column:
    nothing = F.is_variant_null(value)
    if depth > MOST_DEPTH:
        return F.when(nothing, "null").otherwise(F.lit('"<redacted: max depth>"'))
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    items = F.try_variant_get(value, "$", "array<variant>")
    # Entries of an object have a name, those of an array none.
    entries = F.coalesce(
        F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))),
        F.transform(items, lambda x: F.struct(F.lit(None).cast("string").alias("name"), x.alias("value"))),
    )
    told = F.transform(
        F.slice(entries, 1, MOST_ITEMS),
        lambda e: F.concat(
            F.when(e["name"].isNotNull(), F.concat(_quoted(e["name"]), F.lit(":"))).otherwise(""),
            F.when(names_user_text(e["name"]), _hidden(e["value"])).otherwise(_shown(e["value"], depth + 1)),
        ),
    )
    # The walk goes on in one place only, or the expression would grow with its powers.
    more = (F.size(entries) - MOST_ITEMS).cast("string")
    named = fields.isNotNull()
    note = F.when(named, F.concat(F.lit(',"<truncatedKeys>":'), more)).otherwise(F.concat(F.lit(',"<truncated: +'), more, F.lit(' items>"')))
    note = F.when(F.size(entries) > MOST_ITEMS, note).otherwise("")
    whole = F.concat(F.when(named, "{").otherwise("["), F.array_join(told, ","), note, F.when(named, "}").otherwise("]"))
    return (
        F.when(nothing, "null")
        .when(entries.isNotNull(), whole)
        .when(_is_string(value), _string(F.try_variant_get(value, "$", "string")))
        .otherwise(F.to_json(value))
    )


def redacted_variant(value: Column) -> Column:
    """JSON text of a VARIANT without what may be user text."""
    return F.when(value.isNotNull(), _shown(value, 0))


def redacted_json(text: Column) -> Column:
    """The same of JSON text; what is no JSON is a string."""
    value = F.try_parse_json(text)
    return F.when(text.isNull(), None).when(value.isNotNull(), _shown(value, 0)).otherwise(_string(text))


def redacted_columns(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with columns of any type as redacted JSON text; a column's own name counts as well."""
    kinds = dict(rows.dtypes)
    out = {}
    for name in columns:
        value = F.col(name)
        if kinds[name] != "variant":
            held = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
            value = F.when(value.isNotNull(), F.try_variant_get(F.try_parse_json(held), "$.v", "variant"))
        whole = F.when(value.isNotNull(), F.when(names_user_text(F.lit(name)), _hidden(value)).otherwise(_shown(value, 0)))
        out[name] = whole
    return rows.withColumns(out)
