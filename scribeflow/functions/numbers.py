"""Numbers, times and sizes as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import round_half_up


def two(col: Column) -> Column:
    return F.lpad(col.cast("string"), 2, "0")


def minutes_seconds(seconds: Column) -> Column:
    """m:ss; minutes go on beyond an hour."""
    whole = F.floor(seconds)
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), two(whole % 60))


def clock(seconds: Column) -> Column:
    """h:mm:ss from an hour on, else m:ss."""
    h, m, s = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60), F.floor(seconds % 60)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s)))


def full_clock(seconds: Column) -> Column:
    """hh:mm:ss with zeros; negative and null times are zero."""
    total = F.floor(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0)))
    return F.concat(F.lpad(F.floor(total / 3600).cast("string"), 2, "0"), F.lit(":"), two(F.floor((total % 3600) / 60)), F.lit(":"), two(total % 60))


def duration_label(ms: Column) -> Column:
    seconds = F.floor(ms / 1000)
    return F.when(seconds >= 60, F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), two(seconds % 60))).otherwise(F.concat(seconds.cast("string"), F.lit("s")))


def stamp(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd HH:mm")


def file_stamp(ms: Column) -> Column:
    """ISO time with dashes, fit for a file name (K1)."""
    return F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd'T'HH-mm-ss")


def parse_time(text: Column, decimal_minutes: bool = False) -> Column:
    """Seconds of a tolerant time text: full-width digits, any separator, MMSS from 100.

    A dot is a separator, as observed; with ``decimal_minutes`` one dot alone
    means decimal minutes.
    """
    t = F.translate(F.coalesce(text, F.lit("")), "０１２３４５６７８９：", "0123456789:")
    plain = F.regexp_replace(t, "(?U)\\s+", "")
    t = F.regexp_replace(plain, "[.．、。]", ":")
    parts = F.filter(F.split(t, ":", -1), lambda p: p != "")
    number = lambda i, p="\\A\\d+": F.coalesce(F.expr("null"), F.nullif(F.regexp_extract(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), f"({p})", 1), F.lit("")).cast("double"), F.lit(0.0))
    cap = lambda c: F.least(c, F.lit(59.0))
    one = number(0)
    short = F.when(one >= 100, F.floor(one / 100) * 60 + cap(one % 100)).otherwise(one)
    n = F.size(parts)
    out = F.when(n == 1, short).when(n == 2, number(0) * 60 + cap(number(1))).when(n == 3, number(0) * 3600 + cap(number(1)) * 60 + cap(number(2))).otherwise(0.0)
    if decimal_minutes:
        minutes = plain.cast("double")
        out = F.when(plain.rlike("\\A\\d+\\.\\d+\\z"), F.floor(minutes) * 60 + round_half_up((minutes - F.floor(minutes)) * 60)).otherwise(out)
    return out.cast("double")


def size_label(size: Column) -> Column:
    """Bytes with a unit of 1024, two places."""
    k = F.least(F.floor(F.log(1024.0, size)), F.lit(3))
    value = round_half_up(size / F.pow(F.lit(1024.0), k) * 100) / 100
    text = F.regexp_replace(F.format_string("%.2f", value), "\\.?0+\\z", "")
    return F.when(size == 0, "0 Bytes").otherwise(F.concat(text, F.lit(" "), F.element_at(F.array(*[F.lit(u) for u in ("Bytes", "KB", "MB", "GB")]), (k + 1).cast("int"))))


def cost_of_size(size: Column, rate: Column) -> Column:
    """1.2 minutes a MB at a price, two places."""
    return round_half_up(size / (1024 * 1024) * 1.2 * rate * 100) / 100


def cost_of_seconds(seconds: Column, rate: Column, places: int = 2) -> Column:
    return round_half_up(seconds / 60 * rate * 10**places) / 10**places


def backoff_ms(attempt: Column, base: int = 2000, most: int = 15000) -> Column:
    """min(most, base * 2^(attempt-1))."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1))


def progress(done: Column, total: Column, post_processing: bool) -> Column:
    """10 to 70 or 90 per cent in steps of ten."""
    span = (70 if post_processing else 90) - 10
    share = F.least(done / F.greatest(total, F.lit(1)), F.lit(1.0))
    return round_half_up((10 + span * share) / 10) * 10


def remaining_ms(elapsed: Column, done: Column, total: Column) -> Column:
    """Elapsed over done times what is left (W25); null before the first."""
    return F.when(done > 0, elapsed / done * (total - done))


def processing_seconds(chunks: Column, parallel: bool = False) -> Column:
    return chunks * 30 * (0.5 if parallel else 1.0)


def expected_chars(seconds: Column, rate: float) -> Column:
    return round_half_up(seconds * rate)
