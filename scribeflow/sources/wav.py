"""WAV files as a Spark data source: blocks of samples, read by byte ranges.

``read_wav(spark, folder)``, or ``spark.dataSource.register(WavSource)`` and then
``spark.read.format("wav").load(folder)``, gives (path, block, sampleRate, channels,
bits, total, samples), the form that ``operators.blocks`` works on.  Planning lists names and sizes only.  A partition is a
byte range of a large file or a number of small files; its task reads the header once
and then its own blocks, so a file of hours is read by many tasks and none holds more
than a block.

Options: ``blockSamples``; ``rangeBytes`` (bytes of a partition); ``channel`` (its
number, or ``mix`` for the mean of all); ``samples`` = ``false`` for a row per file
without its samples; ``mode`` = ``DROPMALFORMED`` leaves out files that are no WAV
files, which are errors otherwise; ``pushdown`` = ``true`` applies comparisons of
``path`` and ``block`` with constants before anything is read.  Spark asks for
``spark.sql.python.filterPushdown.enabled`` beside it; ``read_wav`` goes by that setting.

8 and 16 bits are read; samples of other depths are silence.  Sections before the
samples are passed over, whatever their number.  A file that is cut short gives the
samples it has; one without samples has no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from .storage import listed, opened

SCHEMA = "path string, block long, sampleRate int, channels int, bits int, total long, samples array<float>"
_ARROW = pa.schema([("path", pa.string()), ("block", pa.int64()), ("sampleRate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("total", pa.int64()), ("samples", pa.list_(pa.float32()))])


@dataclass
class Header:
    rate: int
    channels: int
    bits: int
    #: The place of the samples in the file, and how many there are in each channel.
    start: int
    total: int


def read_header(src: pa.NativeFile, size: int) -> Header:
    """Walk the sections of a WAV file up to its samples."""
    head = src.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("Invalid WAV file format")
    at, form = 12, None
    while at + 8 <= size:
        src.seek(at)
        kind, length = struct.unpack("<4sI", src.read(8))
        if kind == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", src.read(16))
            form = (rate, channels, bits)
        elif kind == b"data":
            if not form or not all(form):
                break
            rate, channels, bits = form
            return Header(rate, channels, bits, at + 8, min(length, size - at - 8) // (channels * (bits // 8)) if bits >= 8 else 0)
        at += 8 + length + (length & 1)
    raise ValueError("Invalid WAV file format")


def to_samples(data: bytes, header: Header, channel: int | None) -> np.ndarray:
    """Samples in [-1, 1) of one channel, or the mean of all."""
    width = header.channels * (header.bits // 8)
    n = len(data) // width
    if header.bits == 16:
        x = np.frombuffer(data, "<i2", n * header.channels).reshape(n, -1) / np.float32(32768)
    elif header.bits == 8:
        x = (np.frombuffer(data, np.uint8, n * header.channels).reshape(n, -1).astype(np.float32) - 128) / 128
    else:
        return np.zeros(n, np.float32)
    return (x.mean(1) if channel is None else x[:, channel]).astype(np.float32)


@dataclass
class Ranges(InputPartition):
    """(URI, bytes of the file, first byte, end) of one large file or of several small ones."""

    files: list[tuple[str, int, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.block = int(options.get("blocksamples", 65_536))
        self.bytes = int(options.get("rangebytes", 64 << 20))
        channel = options.get("channel", "0")
        self.channel = None if channel == "mix" else int(channel)
        self.samples = options.get("samples", "true").lower() == "true"
        self.strict = options.get("mode", "FAILFAST").upper() != "DROPMALFORMED"
        self.paths: list = []
        self.low, self.high = 0, None

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for path, length in listed(self.path, ".wav"):
            if not all(keep(path) for keep in self.paths):
                continue
            if self.samples and length > self.bytes:
                out += [Ranges([(path, length, k, min(k + self.bytes, length))]) for k in range(0, length, self.bytes)]
                continue
            cost = length if self.samples else 4096
            if held and size + cost > self.bytes:
                out.append(Ranges(held))
                held, size = [], 0
            held.append((path, length, 0, length))
            size += cost
        return [*out, Ranges(held)] if held else out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, length, first, end in partition.files:
            fs, name = opened(path)
            with fs.open_input_file(name) as src:
                try:
                    header = read_header(src, length)
                    if self.channel is not None and self.channel >= header.channels:
                        raise ValueError(f"there is no channel {self.channel}")
                except ValueError as error:
                    if self.strict:
                        raise ValueError(f"{path}: {error}") from error
                    continue
                yield from self.blocks(src, path, header, first, end)

    def blocks(self, src: pa.NativeFile, path: str, header: Header, first: int, end: int) -> Iterator[pa.RecordBatch]:
        def row(block: int, samples: np.ndarray | None) -> pa.RecordBatch:
            held = pa.nulls(1, pa.list_(pa.float32())) if samples is None else pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples))
            return pa.RecordBatch.from_arrays([*(pa.array([v], f.type) for v, f in zip((path, block, header.rate, header.channels, header.bits, header.total), _ARROW)), held], schema=_ARROW)

        if not self.samples:
            if self.low == 0 and (self.high is None or self.high > 0):
                yield row(0, None)
            return
        width = header.channels * (header.bits // 8) * self.block
        # A block belongs to the range in which its first byte lies; the header to the first.
        low = max(self.low, -(-max(first - header.start, 0) // width))
        high = -(-max(end - header.start, 0) // width)
        high = min(high, -(-header.total // self.block), *([self.high] if self.high is not None else []))
        for block in range(low, high):
            src.seek(header.start + block * width)
            n = min(self.block, header.total - block * self.block)
            yield row(block, to_samples(src.read(n * width // self.block), header, self.channel))


class PushingWavReader(WavReader):
    def pushFilters(self, filters):
        """Take comparisons of paths and of block numbers; leave the rest to Spark."""
        for f in filters:
            match f:
                case EqualTo(("path",), value):
                    self.paths.append(lambda p, v=value: p == v)
                case In(("path",), values):
                    self.paths.append(lambda p, v=frozenset(values): p in v)
                case StringStartsWith(("path",), value):
                    self.paths.append(lambda p, v=value: p.startswith(v))
                case EqualTo(("block",), value):
                    self._between(value, value + 1)
                case GreaterThanOrEqual(("block",), value):
                    self._between(value, None)
                case GreaterThan(("block",), value):
                    self._between(value + 1, None)
                case LessThan(("block",), value):
                    self._between(0, value)
                case LessThanOrEqual(("block",), value):
                    self._between(0, value + 1)
                case IsNotNull((name,)) if name != "samples":
                    pass  # no other column has nulls
                case _:
                    yield f

    def _between(self, low: int, high: int | None) -> None:
        self.low = max(self.low, low)
        self.high = high if self.high is None else self.high if high is None else min(self.high, high)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushingWavReader if options.get("pushdown", "false").lower() == "true" else WavReader)(options)


def read_wav(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The blocks of all WAV files below a folder."""
    spark.dataSource.register(WavSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("wav").option("pushdown", pushed).options(**options).load(path)
