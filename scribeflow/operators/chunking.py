"""Chunk plans, chunk rows, groups and concurrency."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import kernels
from ..functions.text import round_half_up

MIN_LAST = 15.0


def chunk_seconds(duration: Column, size_mb: Column, most_seconds: float, most_mb: float, preferred: float | None = None) -> Column:
    """Length of a chunk: by duration and size, at least 60 s, in tens."""
    own = F.least(F.lit(float(most_seconds)), duration)
    by_size = duration * (most_mb / size_mb) * 0.9
    own = F.when((size_mb > most_mb) & (by_size < own), by_size).otherwise(own)
    own = round_half_up(F.greatest(own, F.lit(60.0)) / 10) * 10.0
    if preferred is None:
        return own
    fits = size_mb / F.ceil(duration / preferred) <= most_mb
    return F.lit(float(most_seconds)) if preferred > most_seconds else F.when(fits, float(preferred)).otherwise(own)


def with_plan(rows: DataFrame, duration: str = "duration", size_mb: str | None = None, most_seconds: float = 60, overlap: float = 5, most_mb: float = 50, longest: float = 600, preferred: float | None = None) -> DataFrame:
    """Add needs_chunking, total_chunks, chunk_duration, overlap_duration and reason."""
    d = F.col(duration)
    mb = F.col(size_mb) if size_mb else (44 + d * config.SAMPLE_RATE * 2) / (1024 * 1024)
    long, large = d > most_seconds, mb > most_mb * 0.9
    needs = long | large
    length = chunk_seconds(d, mb, most_seconds, most_mb, preferred)
    step = length - overlap
    n = F.ceil(d / step)
    n = F.when((d - (n - 1) * step < MIN_LAST) & (n > 1), n - 1).otherwise(n)
    reason = F.when((d > longest) & large, "both").when(long, "duration").when(large, "file_size")
    return rows.withColumns(
        {
            "needs_chunking": needs,
            "total_chunks": F.when(needs, n).otherwise(F.lit(1).cast("long")),
            "chunk_duration": F.when(needs, length).otherwise(d),
            "overlap_duration": F.when(needs, float(overlap)).otherwise(0.0),
            "reason": F.when(needs, reason),
        }
    )


def chunk_starts(plans: DataFrame, key: str, duration: str = "duration") -> DataFrame:
    """A row (key, pos, start, chunk_duration, overlap_duration, duration) per chunk."""
    step = F.col("chunk_duration") - F.col("overlap_duration")
    # Another start follows while a whole chunk from the current one ends too early.
    more = F.ceil((F.col(duration) - F.col("chunk_duration")) / step)
    n = F.when(F.col("needs_chunking"), F.least(F.col("total_chunks"), F.greatest(more, F.lit(0)) + 1)).otherwise(1)
    rows = plans.select(key, F.col(duration).alias("duration"), "chunk_duration", "overlap_duration", step.alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("pos"))
    return rows.withColumn("start", F.col("pos") * F.col("step")).drop("step")


def audio_chunks(starts: DataFrame, key: str, boundary: str = "start", min_seconds: float = 0.1) -> DataFrame:
    """Overlapping chunks (key, id, startTime, endTime, hasOverlap, overlapDuration)."""
    by = Window.partitionBy(key).orderBy("pos")
    after = F.lead(boundary).over(by)
    end = F.coalesce(after + F.col("overlap_duration"), F.col("duration"))
    rows = starts.select(key, "pos", F.col(boundary).alias("startTime"), end.alias("endTime"), after.isNotNull().alias("hasOverlap"), "overlap_duration")
    rows = rows.where(F.col("endTime") - F.col("startTime") >= min_seconds)
    return rows.select(
        key,
        (F.row_number().over(by) - 1).alias("id"),
        "startTime",
        "endTime",
        "hasOverlap",
        F.when(F.col("hasOverlap"), F.col("overlap_duration")).otherwise(0.0).alias("overlapDuration"),
    )


def text_chunks(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text", rate: float = 15.0) -> DataFrame:
    """Texts as overlapping windows with times at ``rate`` characters a second."""
    step, n = size - overlap, F.length(text)
    last = F.greatest(F.ceil((n - overlap) / step), F.lit(1)) - 1
    rows = docs.where(n > 0).select(key, text, F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("id"))
    start = F.col("id") * step
    piece = F.substring(text, (start + 1).cast("int"), F.lit(size))
    return rows.select(key, "id", piece.alias("text"), (start / rate).alias("startTime"), ((start + F.length(piece)) / rate).alias("endTime"))


def wave_sizes(items: Column, least: int = 3, most: int = 5) -> Column:
    """Sizes of groups within [least, most], larger ones last; else one group."""
    n = F.ceil(items / most)
    base, extra = F.floor(items / n), items % n
    sizes = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), lambda i: base + F.when(i > n - extra, 1).otherwise(0))
    fits = (F.array_min(sizes) >= least) & (F.array_max(sizes) <= most)
    one = F.array(items.cast("long"))
    return F.when(items <= 0, F.array().cast("array<bigint>")).when((items <= most) | ~fits, one).otherwise(sizes)


def wave_concurrency(seconds: Column, groups: Column, cap: int = 4) -> Column:
    """Groups that run at once: two, three from 45 minutes, four from two hours."""
    want = F.when(seconds >= 7200, 4).when(seconds >= 2700, 3).otherwise(2)
    return F.when(groups <= 1, 1).otherwise(F.least(want, F.lit(max(1, cap)), groups)).cast("int")


def in_waves(chunks: DataFrame, key: str, order: str = "id", least: int = 3, most: int = 5) -> DataFrame:
    """Add the group and the place in it of every chunk of a key."""
    by = Window.partitionBy(key).orderBy(order)
    n = F.count("*").over(Window.partitionBy(key))
    rows = chunks.withColumn("_sizes", wave_sizes(n, least, most)).withColumn("_at", F.row_number().over(by) - 1)
    ends = F.transform(F.sequence(F.lit(1), F.size("_sizes")), lambda i: F.aggregate(F.slice("_sizes", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    group = F.size(F.filter(ends, lambda e: e <= F.col("_at")))
    rows = rows.withColumn("group", group)
    first = F.coalesce(F.get(ends, F.col("group") - 1), F.lit(0))
    return rows.withColumn("place", F.col("_at") - first).drop("_sizes", "_at")


def adaptive_chunks(frames: DataFrame, plan: config.ModelPlan, key: str = "file_id", frame_seconds: float = 0.03) -> DataFrame:
    """Chunks from frame labels by length and silence (W2, P17): see ``ChunkMachine``.

    Frames arrive sorted and only the machine's state is held, so that a file of any
    length takes no more memory than a batch.
    """
    kind = dict(frames.dtypes)[key]
    names = [key, "id", "startTime", "endTime", "hasOverlap", "overlapDuration"]
    total = frames.groupBy(key).agg(F.max("frame").alias("_total"))
    rows = frames.select(key, "frame", "t", "label").join(total, key)
    rows = rows.repartition(key).sortWithinPartitions(key, "frame")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, machine = None, None

        def told(made) -> list[tuple]:
            return [(own, *made, plan.overlap_seconds if made[3] else 0.0)] if made else []

        for pdf in batches:
            out = []
            for k, frame, t, label, last in zip(pdf[key], pdf["frame"], pdf["t"], pdf["label"], pdf["_total"]):
                if machine is None or k != own:
                    out += told(machine.close()) if machine else []
                    own, machine = k, kernels.ChunkMachine(plan, frame_seconds)
                out += told(machine.step(frame, t, label, frame == last))
            yield pd.DataFrame(out, columns=names)
        if machine:
            yield pd.DataFrame(told(machine.close()), columns=names)

    return rows.mapInPandas(fold, f"{key} {kind}, id int, startTime double, endTime double, hasOverlap boolean, overlapDuration double")


def silence_snap(samples: DataFrame, targets: DataFrame, rate: int, key: str = "file_id", threshold: float = 0.01) -> DataFrame:
    """Each target to the quietest second within five on either side.

    ``samples`` has (key, samples); only seconds below the threshold count, the first
    of equals wins.  The target zero moves too, as observed.
    """
    rows = targets.join(samples, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            out = []
            for own, pos, target, data in zip(pdf[key], pdf["pos"], pdf["target"], pdf["samples"]):
                x = np.asarray(data, np.float64)
                at = int(np.floor(target * rate))
                best, low = at, np.inf
                end = min(len(x), at + 5 * rate)
                for i in range(max(0, at - 5 * rate), end - rate, max(1, rate // 10)):
                    # Each window by itself: equal windows have equal energies.
                    energy = np.sqrt(np.mean(np.square(x[i : i + rate])))
                    if energy < low and energy < threshold:
                        best, low = i, energy
                out.append((own, pos, target, best / rate))
            yield pd.DataFrame(out, columns=[key, "pos", "target", "snapped"])

    kind = dict(targets.dtypes)
    return rows.select(key, "pos", "target", "samples").mapInPandas(run, f"{key} {kind[key]}, pos {kind['pos']}, target double, snapped double")
