"""Samples as arrays: mixing, slices, energy, resampling, 16-bit values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 6) -> Column:
    """A double rounded as DuckDB does: scaled in doubles, halves away from zero, and what
    becomes zero keeps its sign.  ``round`` goes by decimal digits and has no negative zero."""
    scaled = value * 10.0**digits
    whole = F.rint(scaled)
    return F.when(F.abs(scaled - whole) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(whole) / 10.0**digits


def mono(left: Column, right: Column) -> Column:
    """The mean of two channels."""
    return F.zip_with(left, right, lambda a, b: (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))) / 2)


def mono_all(channels: Column) -> Column:
    """The mean of all channels of an array of arrays."""
    n = F.size(channels)
    first = F.transform(F.element_at(channels, 1), lambda x: x.cast("double"))
    rest = F.slice(channels, 2, F.greatest(n - 1, F.lit(0)))
    total = F.aggregate(rest, first, lambda acc, c: F.zip_with(acc, c, lambda a, b: a + F.coalesce(b.cast("double"), F.lit(0.0))))
    return F.transform(total, lambda x: x / n)


def rms(samples: Column) -> Column:
    """Root mean square (A9); null for no samples."""
    total = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples)))


def pcm16(samples: Column, rounded: bool = False) -> Column:
    """16-bit values: times 32768 below zero, 32767 above, clipped; cut or rounded (K8)."""
    x = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double")))
    scaled = lambda v: F.when(x(v) < 0, x(v) * 32768).otherwise(x(v) * 32767)
    return F.transform(samples, lambda v: (F.floor(scaled(v) + 0.5) if rounded else scaled(v)).cast("int"))


def pcm16_floor(samples: Column) -> Column:
    """The variant for live sessions: floor of the scaled value."""
    x = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double")))
    return F.transform(samples, lambda v: F.floor(F.when(x(v) < 0, x(v) * 32768).otherwise(x(v) * 32767)).cast("int"))


def time_slice(samples: Column, rate: int, start: Column, end: Column) -> Column:
    """Samples of a time range; an end of zero or null is the end of the array (P5)."""
    low = F.floor(F.coalesce(start, F.lit(0.0)) * rate).cast("int")
    high = F.when(F.coalesce(end, F.lit(0.0)) > 0, F.least(F.floor(end * rate).cast("int"), F.size(samples))).otherwise(F.size(samples))
    return F.slice(samples, low + 1, F.greatest(high - low, F.lit(0)))


def extract(samples: Column, segments: Column, rate: int) -> Column:
    """Samples of all segments, end to end: floor of starts, ceil of ends."""

    def part(s: Column) -> Column:
        low = F.floor(s["start"] * rate).cast("int")
        high = F.least(F.size(samples), F.ceil(s["end"] * rate).cast("int"))
        return F.slice(samples, low + 1, F.greatest(high - low, F.lit(0)))

    return F.flatten(F.transform(segments, part))


def resample(samples: Column, source: int, target: int, clamp: bool = True) -> Column:
    """Linear interpolation; beyond the last sample it repeats (clamp) or so does the current one."""
    if source == target:
        return samples
    ratio = source / target
    n = F.floor(F.size(samples) / ratio).cast("int")

    def at(i: Column) -> Column:
        place = i * ratio
        low = F.floor(place).cast("int")
        part = place - low
        now = F.coalesce(F.get(samples, low), F.lit(0.0)).cast("double")
        after = F.get(samples, F.least(low + 1, F.size(samples) - 1) if clamp else low + 1).cast("double")
        return F.when(part == 0, now).otherwise(now * (1 - part) + F.coalesce(after, now) * part)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)).otherwise(F.array().cast("array<double>"))


def waveform(samples: Column, width: int) -> Column:
    """Minimum and maximum of each of ``width`` buckets; an empty one is (1, -1) (A10)."""
    step = F.ceil(F.size(samples) / width).cast("int")

    def bucket(i: Column) -> Column:
        part = F.slice(samples, i * step + 1, step)
        return F.struct(F.coalesce(F.array_min(part).cast("double"), F.lit(1.0)).alias("low"), F.coalesce(F.array_max(part).cast("double"), F.lit(-1.0)).alias("high"))

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), bucket)
