"""Audio as blocks: files of any length as rows of bounded size.

A blocked table has (key, block, samples): the block's number within its file and at
most ``BLOCK`` samples; all blocks of a file but the last are full.  Ten hours at
16 kHz are 8,800 rows of 256 KB.  Operators that look across a border join each
window with the few blocks it touches (``spans``) and add up what the parts give,
or give partial sums per block and add those; no operator holds a file.
Whatever works on single samples (``signal.mono``, ``signal.pcm16``) works on the
arrays of blocks as it stands.

Positions are whole samples.  A file without samples has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config

#: Samples of a block.
BLOCK = 65_536
#: Rows of a file whose sizes are added up in one window, before the windows are.
GROUP = 4096
#: Files up to which a table of one row per file is sent to all executors.
FEW_FILES = 100_000


def _squares(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))


def running_before(rows: DataFrame, key: str, order: str, value: Column, out: str) -> DataFrame:
    """Add the sum of ``value`` over the key's rows of a smaller whole number ``order``.

    Sums within groups of neighbouring numbers, then over the groups' sums: a key with
    very many rows is not one task.
    """
    held = rows.withColumns({"_value": value, "_group": F.floor(F.col(order) / GROUP)})
    inner = Window.partitionBy(key, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(F.col(key).alias("_key"), F.col("_group").alias("_part")).agg(F.sum("_value").alias("_sum"))
    sums = sums.withColumn("_earlier", F.coalesce(F.sum("_sum").over(outer), F.lit(0))).drop("_sum")
    held = held.withColumn("_inside", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    held = held.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_group") == F.col("_part")))
    return held.withColumn(out, F.col("_inside") + F.col("_earlier")).drop("_value", "_group", "_key", "_part", "_inside", "_earlier")


def placed(parts: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """Blocks of runs of samples (key, at, samples) that lie end to end without overlap."""
    n = F.size("samples")
    rows = parts.where(n > 0).withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + n - 1) / size))))
    low = F.greatest(F.col("block") * size - F.col("at"), F.lit(0)).cast("int")
    high = F.least((F.col("block") + 1) * size - F.col("at"), n.cast("long")).cast("int")
    cut = rows.select(key, "block", (F.col("at") + low).alias("at"), F.slice("samples", low + 1, high - low).alias("samples"))
    gathered = F.array_sort(F.collect_list(F.struct("at", "samples")))
    return cut.groupBy(key, "block").agg(F.flatten(F.transform(gathered, lambda x: x["samples"])).alias("samples"))


def joined_pieces(pieces: DataFrame, key: str, order: str, samples: str = "samples", size: int = BLOCK) -> DataFrame:
    """Blocks of a file's pieces, whatever their lengths, end to end in order."""
    sizes = running_before(pieces.select(key, order, F.size(samples).cast("long").alias("n")), key, order, F.col("n"), "at").select(F.col(key).alias("_key"), F.col(order).alias("_order"), "at")
    rows = pieces.join(sizes, F.col(key).eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_order")))
    return placed(rows.select(key, "at", F.col(samples).alias("samples")), key, size)


def file_sizes(blocks: DataFrame, key: str) -> DataFrame:
    """(key, total): the samples of each file."""
    return blocks.groupBy(key).agg(F.sum(F.size("samples")).cast("long").alias("total"))


def with_total(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Add the file's samples to rows; samples are not shuffled while there are few files."""
    sizes = sizes.withColumnRenamed(key, "_file")
    few = sizes.limit(FEW_FILES + 1).count() <= FEW_FILES
    return rows.join(F.broadcast(sizes) if few else sizes, F.col(key).eqNullSafe(F.col("_file"))).drop("_file")


def spans(blocks: DataFrame, windows: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """The samples of each window (key, ..., low, high), a row per block it touches.

    Adds ``at``, the place of the first sample of ``part`` in the file.  What lies
    outside of the file is left out, and with it windows that have no sample.
    """
    asked = windows.where("low < high").withColumn("_block", F.explode(F.sequence(F.floor(F.greatest("low", F.lit(0)) / size), F.floor(F.greatest(F.col("high") - 1, F.lit(0)) / size))))
    held = blocks.select(F.col(key).alias("_file"), F.col("block").alias("_number"), "samples")
    rows = asked.join(held, F.col(key).eqNullSafe(F.col("_file")) & (F.col("_block") == F.col("_number")))
    first = F.col("_block") * size
    low = F.greatest(F.col("low") - first, F.lit(0)).cast("int")
    high = F.least(F.col("high") - first, F.size("samples").cast("long")).cast("int")
    rows = rows.where(low < high).withColumns({"at": first + low, "part": F.slice("samples", low + 1, high - low)})
    return rows.drop("_block", "_file", "_number", "samples")


def rms_of_files(blocks: DataFrame, key: str) -> DataFrame:
    """Root mean square of each file."""
    sums = blocks.groupBy(key).agg(F.sum(_squares(F.col("samples"))).alias("s"), F.sum(F.size("samples")).alias("n"))
    return sums.select(key, F.sqrt(F.col("s") / F.col("n")).alias("energy"))


def rms_of_windows(blocks: DataFrame, windows: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """Root mean square of windows (key, pos, low, high) at any place (A9); null without samples."""
    sums = spans(blocks, windows, key, size).groupBy(key, "pos").agg(F.sum(_squares(F.col("part"))).alias("s"), F.sum(F.size("part")).alias("n"))
    sums = sums.withColumnsRenamed({key: "_file", "pos": "_pos"})
    rows = windows.join(sums, F.col(key).eqNullSafe(F.col("_file")) & (F.col("pos") == F.col("_pos")), "left")
    return rows.select(*windows.columns, F.sqrt(F.col("s") / F.col("n")).alias("energy"))


def energies(blocks: DataFrame, key: str, step: int, size: int = BLOCK) -> DataFrame:
    """(key, step, n, squares): the sum of squares of every ``step`` samples.

    A step that a border cuts gets a share from each of its blocks.
    """
    first, n = F.col("block") * size, F.size("samples")
    rows = blocks.select(key, "block", "samples", F.explode(F.sequence(F.floor(first / step), F.floor((first + n - 1) / step))).alias("step"))
    low = F.greatest(F.col("step") * step - first, F.lit(0)).cast("int")
    high = F.least((F.col("step") + 1) * step - first, n.cast("long")).cast("int")
    part = rows.select(key, "step", (high - low).cast("long").alias("n"), _squares(F.slice("samples", low + 1, high - low)).alias("squares"))
    return part.groupBy(key, "step").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"))


def energy_sums(blocks: DataFrame, key: str, step: int, size: int = BLOCK) -> DataFrame:
    """(key, step, n_before, squares_before): sums over all earlier steps, and behind the last step.

    The energy of any run of steps is the difference of two rows.
    """
    rows = energies(blocks, key, step, size)
    last = rows.groupBy(key).agg((F.max("step") + 1).alias("step")).select(key, "step", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("squares"))
    rows = rows.unionByName(last)
    rows = running_before(rows, key, "step", F.col("squares"), "squares_before")
    return running_before(rows, key, "step", F.col("n"), "n_before").select(key, "step", "n_before", "squares_before")


def rms_of_steps(sums: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Root mean square of windows (key, pos, first, last) of whole steps, from their sums: two look-ups each."""
    rows = windows
    for side in ("first", "last"):
        held = sums.select(F.col(key).alias("_file"), F.col("step").alias("_step"), F.col("n_before").alias(f"_n_{side}"), F.col("squares_before").alias(f"_s_{side}"))
        rows = rows.join(held, F.col(key).eqNullSafe(F.col("_file")) & (F.col(side) == F.col("_step"))).drop("_file", "_step")
    n, s = F.col("_n_last") - F.col("_n_first"), F.greatest(F.col("_s_last") - F.col("_s_first"), F.lit(0.0))
    return rows.select(*windows.columns, F.when(n > 0, F.sqrt(s / n)).alias("energy"))


def labelled_frames(blocks: DataFrame, key: str, frame: int = config.FRAME_SAMPLES, rate: int = config.SAMPLE_RATE, threshold: float = 0.01, size: int = BLOCK) -> DataFrame:
    """(key, frame, t, label) by energy, as ``audio.energy_labels`` of whole files; frames that do not fill are left out."""
    rows = energies(blocks, key, frame, size).where(F.col("n") == frame)
    return rows.select(key, F.col("step").alias("frame"), (F.col("step") * (frame / rate)).alias("t"), (F.sqrt(F.col("squares") / frame) >= threshold).cast("int").alias("label"))


def waveforms(blocks: DataFrame, key: str, width: int, size: int = BLOCK) -> DataFrame:
    """(key, bucket, low, high): extremes of each of ``width`` buckets of a file; an empty one is (1, -1) (A10)."""
    sizes = file_sizes(blocks, key)
    rows = with_total(blocks, sizes, key)
    step, first, n = F.ceil(F.col("total") / width), F.col("block") * size, F.size("samples")
    rows = rows.withColumn("bucket", F.explode(F.sequence(F.floor(first / step), F.floor((first + n - 1) / step))))
    low = F.greatest(F.col("bucket") * step - first, F.lit(0)).cast("int")
    high = F.least((F.col("bucket") + 1) * step - first, n.cast("long")).cast("int")
    part = F.slice("samples", low + 1, high - low)
    met = rows.groupBy(key, "bucket").agg(F.min(F.array_min(part)).cast("double").alias("low"), F.max(F.array_max(part)).cast("double").alias("high"))
    met = met.withColumnsRenamed({key: "_file", "bucket": "_bucket"})
    every = sizes.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("bucket"))
    out = every.join(met, F.col(key).eqNullSafe(F.col("_file")) & (F.col("bucket") == F.col("_bucket")), "left")
    return out.select(key, "bucket", F.coalesce("low", F.lit(1.0)).alias("low"), F.coalesce("high", F.lit(-1.0)).alias("high"))


def extracted(blocks: DataFrame, segments: DataFrame, key: str, rate: int, size: int = BLOCK, whole: bool = True) -> DataFrame:
    """Blocks of the samples of a file's segments (key, pos, start, end), end to end.

    Starts are cut to whole samples, ends are raised to the next (not ``whole``: cut as
    well, and null or 0 is the file's end: a range slice, P5).
    """
    sizes = file_sizes(blocks, key).withColumnRenamed(key, "_file")
    rows = segments.join(sizes, F.col(key).eqNullSafe(F.col("_file"))).drop("_file")
    low = F.floor(F.coalesce("start", F.lit(0.0)) * rate)
    end = F.ceil(F.col("end") * rate) if whole else F.when(F.coalesce("end", F.lit(0.0)) > 0, F.floor(F.col("end") * rate)).otherwise(F.col("total"))
    rows = rows.select(key, "pos", low.alias("low"), F.least(end, "total").alias("high")).where("low < high")
    rows = running_before(rows, key, "pos", F.col("high") - F.col("low"), "out")
    parts = spans(blocks, rows, key, size)
    return placed(parts.select(key, (F.col("out") + F.col("at") - F.col("low")).alias("at"), F.col("part").alias("samples")), key, size)


def resampled(blocks: DataFrame, key: str, source: int, target: int, clamp: bool = True, size: int = BLOCK) -> DataFrame:
    """Blocks at another rate by linear interpolation, as ``signal.resample`` of whole files.

    Between the last sample of a block and the first of the next one, that one is
    looked up: one narrow row per block.
    """
    if source == target:
        return blocks
    ratio = source / target
    heads = blocks.select(F.col(key).alias("_file"), (F.col("block") - 1).alias("_number"), F.get("samples", F.lit(0)).alias("_next"))
    rows = with_total(blocks, file_sizes(blocks, key), key).join(heads, F.col(key).eqNullSafe(F.col("_file")) & (F.col("block") == F.col("_number")), "left")
    first, n = F.col("block") * size, F.size("samples")
    end = first + n - 1
    count = F.floor(F.col("total") / ratio)
    near = F.sequence(F.greatest(F.floor(first / ratio) - 1, F.lit(0)), F.ceil((end + 1) / ratio) + 1)
    mine = F.filter(near, lambda i: (F.floor(i * ratio) >= first) & (F.floor(i * ratio) <= end) & (i < count))

    def at(i: Column) -> Column:
        place = i * ratio
        low = F.floor(place)
        inside = (low - first).cast("int")
        now = F.coalesce(F.get("samples", inside), F.lit(0.0)).cast("double")
        last = now if clamp else F.lit(None).cast("double")
        after = F.when(inside + 1 < n, F.get("samples", inside + 1).cast("double")).otherwise(F.coalesce(F.col("_next").cast("double"), last))
        return now * (1 - (place - low)) + F.coalesce(after, now) * (place - low)

    rows = rows.withColumn("_mine", mine).where(F.size("_mine") > 0)
    return placed(rows.select(key, F.get("_mine", F.lit(0)).alias("at"), F.transform("_mine", at).alias("samples")), key, size)


def silence_snapped(blocks: DataFrame, targets: DataFrame, key: str, rate: int, threshold: float = 0.01, size: int = BLOCK) -> DataFrame:
    """Each target (key, pos, target) to the quietest second within five on either side.

    As ``chunking.silence_snap`` of whole files.  Windows of a second start every tenth
    of one; they are cut at all their starts and ends into units, whose sums of squares
    are added up across borders once, and a window is a run of units.  Energies are
    equal if they agree in 12 digits; the first of equals wins.
    """
    hop = max(1, rate // 10)
    rest = rate % hop
    cuts, run = (2, 2 * (rate // hop) + 1) if rest else (1, rate // hop)
    middle = F.floor(F.col("target") * rate)
    asked = targets.select(key, "pos", "target", middle.alias("middle"), F.greatest(middle - 5 * rate, F.lit(0)).alias("low"), (middle + 5 * rate).alias("high"))
    parts = spans(blocks, asked, key, size)
    # Unit 2q is the first ``rest`` samples of the q-th tenth, unit 2q + 1 what follows.
    offset, n = F.col("at") - F.col("low"), F.size("part")

    def unit(x: Column) -> Column:
        q = F.floor(x / hop)
        return 2 * q + F.when(x - q * hop < rest, 0).otherwise(1) if rest else q

    def begin(u: Column) -> Column:
        q = F.floor(u / cuts)
        return q * hop + (F.when(u % 2 == 1, rest).otherwise(0) if rest else 0)

    rows = parts.withColumn("unit", F.explode(F.sequence(unit(offset), unit(offset + n - 1))))
    low = F.greatest(begin(F.col("unit")) - offset, F.lit(0)).cast("int")
    high = F.least(begin(F.col("unit") + 1) - offset, n.cast("long")).cast("int")
    units = rows.groupBy(key, "pos", "low", "unit").agg(F.sum(_squares(F.slice("part", low + 1, high - low))).alias("squares"), F.max(F.col("at") + high).alias("end"))
    own = Window.partitionBy(key, "pos").orderBy("unit")
    of_target = Window.partitionBy(key, "pos")
    energy = F.round(F.sqrt(F.sum("squares").over(own.rowsBetween(0, run - 1)) / rate), 12)
    windows = units.select(key, "pos", "unit", (F.col("low") + begin(F.col("unit"))).alias("start"), energy.alias("energy"), F.max("end").over(of_target).alias("end"))
    fit = windows.where((F.col("unit") % cuts == 0) & (F.col("start") < F.col("end") - rate) & (F.col("energy") < threshold))
    best = fit.groupBy(F.col(key).alias("_file"), F.col("pos").alias("_pos")).agg(F.min(F.struct("energy", "start"))["start"].alias("best"))
    out = targets.join(best, F.col(key).eqNullSafe(F.col("_file")) & (F.col("pos") == F.col("_pos")), "left")
    return out.select(key, "pos", "target", (F.coalesce("best", middle) / rate).alias("snapped"))
