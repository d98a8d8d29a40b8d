"""Predicates and classifications as expressions; filters that scans can take over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

KEY_PATTERN = "\\Ask-[a-zA-Z0-9\\-_]{20,200}\\z"


def is_audio(ext: Column) -> Column:
    return F.lower(ext).isin(*config.AUDIO_EXTENSIONS)


def is_video(ext: Column) -> Column:
    return F.lower(ext).isin(*config.VIDEO_EXTENSIONS)


def is_supported(ext: Column) -> Column:
    return F.lower(ext).isin(*config.AUDIO_EXTENSIONS, *config.VIDEO_EXTENSIONS)


def mime_type(ext: Column) -> Column:
    """MIME type with a default."""
    table = F.create_map(*[F.lit(x) for kv in config.MIME_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(ext)), F.lit(config.DEFAULT_MIME))


def found_in(query: str, *cols: Column) -> Column:
    """Case-blind substring search over columns; an empty query finds all."""
    if not query:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.lower(c).contains(query.lower()) for c in cols])


def chunk_error(message: Column) -> Column:
    """cancelled, rate_limit, timeout, server or unknown, in this order."""
    low = F.lower(message)
    return (
        F.when(message.isNull() | (message == ""), "unknown")
        .when(low.rlike("cancelled|aborted"), "cancelled")
        .when(low.rlike("\\b429\\b|api error 429|rate limit"), "rate_limit")
        .when(low.rlike("api error 408|timeout|timed out"), "timeout")
        .when(low.rlike("\\bapi error 5\\d\\d\\b"), "server")
        .otherwise("unknown")
    )


def error_kind(message: Column) -> Column:
    """Taxonomy by word lists, first list that hits."""
    low = F.lower(message)
    out = F.lit("generic")
    for kind, words in reversed(config.ERROR_WORDS.items()):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), kind).otherwise(out)
    return out


def retryable(status: Column) -> Column:
    return (status >= 500) | status.isin(429, 408)


def has_keyword(text: Column, keywords: Column) -> Column:
    """Whether any keyword occurs, case kept; no keywords: no."""
    return F.coalesce(F.exists(keywords, lambda k: text.contains(k)), F.lit(False))


def looks_like_key(text: Column) -> Column:
    return text.rlike(KEY_PATTERN)


def key_problem(text: Column) -> Column:
    """Why a key is not valid, or null."""
    return F.when(text.isNull() | (F.trim(text) == ""), "missing").when(~F.trim(text).rlike(KEY_PATTERN), "format")


def masked_key(text: Column) -> Column:
    return F.when(text.isNull() | (F.length(text) < 10), "").otherwise(F.concat(F.substring(text, 1, 7), F.lit("*" * 40)))


SENSITIVE = ("text", "content", "prompt", "transcription", "transcript", "result", "response", "context", "apikey", "api_key", "token", "password", "preview")


def sensitive_field(name: Column) -> Column:
    """Whether a field may hold user text; measures of it do not."""
    low = F.lower(F.trim(name))
    measure = low.rlike("(length|count|ratio|size|duration|seconds|ms|index|id)\\z")
    return (low != "") & ~measure & low.isin(*SENSITIVE)


def redacted(name: Column, value: Column) -> Column:
    """A field's value, or only its length (K10, R)."""
    hidden = F.concat(F.lit("<redacted: "), F.length(value).cast("string"), F.lit(" chars>"))
    return F.when(sensitive_field(name) | looks_like_key(value), hidden).otherwise(value)


def time_range_problem(start: Column, end: Column, duration: Column) -> Column:
    """Why a time range is not valid, or null."""
    return F.when(start < 0, "negative start").when(end <= start, "end before start").when(end > duration, "end beyond duration")


def clamped_range(start: Column, end: Column, duration: Column) -> Column:
    """A range within [0, duration] with end behind start (P5)."""
    zero = F.lit(0.0)
    low = F.least(F.greatest(start, zero), duration)
    return F.struct(low.alias("start"), F.greatest(low, F.least(F.greatest(end, zero), duration)).alias("end"))


def admission_errors(ext: Column, size: Column, seconds: Column, language: Column, plan: config.ModelPlan) -> Column:
    """All reasons against a request."""
    mb = size / (1024 * 1024)
    return F.array_compact(
        F.array(
            F.when(~is_supported(ext), F.concat(F.lit("Unsupported format: "), F.lower(ext))),
            F.when(mb > plan.max_file_mb, F.format_string(f"File size %.1fMB exceeds maximum {plan.max_file_mb:g}MB", mb)),
            F.when(seconds > plan.max_duration, F.format_string(f"Duration %.0fs exceeds maximum {plan.max_duration:g}s", seconds)) if plan.max_duration != float("inf") else F.lit(None).cast("string"),
            F.when(~language.rlike("\\A(auto|[a-z]{2}(-[A-Za-z]{2,4})?)\\z"), F.concat(F.lit("Unsupported language: "), language)),
        )
    )
