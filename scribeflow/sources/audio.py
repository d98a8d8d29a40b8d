"""Audio files: scans, WAV decoding and encoding."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import predicates as P
from ..functions import text as T

INFO = "valid boolean, error string, warnings array<string>, sample_rate int, channels int, bits int, duration double, bitrate long"


def list_audio(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Supported files below a path, without their content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return rows.select("path", F.regexp_replace(T.file_name(F.col("path")), "%20", " ").alias("name"), "length", "modificationTime").where(P.is_supported(T.extension(F.col("path"))))


def listed_or_found(cached: DataFrame, listing: DataFrame) -> DataFrame:
    """The cached listing, or the full one where that is empty."""
    return cached if cached.limit(1).count() else listing


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, extension, size and content of files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", T.file_name(F.col("path")).alias("fileName"), T.extension(F.col("path")).alias("extension"), F.col("length").alias("size"), F.col("content").alias("data"))


def copy_in(files: DataFrame, folder: str) -> DataFrame:
    """Content under safe names in a staging table; returns it (S3)."""
    safe = files.withColumn("fileName", T.safe_file_name(F.col("fileName")))
    safe.write.mode("overwrite").parquet(folder)
    return files.sparkSession.read.parquet(folder)


def _header(data: bytes) -> tuple[int, int, int, int]:
    channels, rate = struct.unpack_from("<HI", data, 22)
    bits = struct.unpack_from("<H", data, 34)[0]
    size = struct.unpack_from("<I", data, 40)[0]
    return rate, channels, bits, size


def wav_info(data: bytes, extension: str, target: int = config.SAMPLE_RATE, most_mb: float = 25) -> dict:
    """Whether a WAV file can be read, and its properties."""
    out = {"valid": False, "error": None, "warnings": [], "sample_rate": None, "channels": None, "bits": None, "duration": None, "bitrate": None}
    mb = len(data) / (1024 * 1024)
    if mb > most_mb:
        return out | {"error": f"File size {mb:.1f}MB exceeds maximum {most_mb:g}MB"}
    if (extension or "").lower() != "wav":
        return out | {"error": f"only WAV is supported, got '{extension}'"}
    if len(data) < 44 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return out | {"error": "Invalid WAV file format"}
    rate, channels, bits, size = _header(data)
    if not rate * channels * bits:
        return out | {"error": "Invalid WAV file format"}
    notes = []
    if rate != target:
        notes.append(f"Sample rate {rate}Hz will be passed as-is")
    if channels != 1:
        notes.append(f"{channels} channels detected")
    return out | {"valid": True, "warnings": notes, "sample_rate": rate, "channels": channels, "bits": bits, "duration": size / (rate * channels * bits / 8), "bitrate": rate * channels * bits}


def wav_samples(data: bytes, channel: int = 0) -> np.ndarray:
    """Samples of one channel in [-1, 1): 8 or 16 bits, other depths are silence."""
    rate, channels, bits, size = _header(data)
    n = size // (channels * (bits // 8))
    if bits == 16:
        x = np.frombuffer(data, "<i2", min(n * channels, (len(data) - 44) // 2), 44) / 32768
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8, min(n * channels, len(data) - 44), 44).astype(np.float64) - 128) / 128
    else:
        return np.zeros(n, np.float32)
    return x[channel::channels].astype(np.float32)


def wav_bytes(samples: np.ndarray, rate: int, rounded: bool = False) -> bytes:
    """A mono 16-bit WAV file of samples, clipped; values cut or rounded (K8)."""
    x = np.clip(np.asarray(samples, np.float64), -1, 1)
    x = np.where(x < 0, x * 32768, x * 32767)
    x = np.floor(x + 0.5) if rounded else np.trunc(x)
    body = np.clip(x, -32768, 32767).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(body)) + body


def validate_wav(files: DataFrame) -> DataFrame:
    """Add ``info`` to rows with data and extension."""
    check = F.pandas_udf(lambda d, e: pd.DataFrame([wav_info(x or b"", y) for x, y in zip(d, e)], columns=[c.split()[0] for c in INFO.split(", ")]).astype({"sample_rate": "Int32", "channels": "Int32", "bits": "Int32", "bitrate": "Int64"}), INFO)
    return files.withColumn("info", check("data", "extension"))


def decode_wav(files: DataFrame, rounded: bool = False) -> DataFrame:
    """(path, sampleRate, duration, channels, pcmData) of valid WAV files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, ext, data in zip(pdf["path"], pdf["extension"], pdf["data"]):
                info = wav_info(data, ext)
                if info["valid"]:
                    rows.append((path, info["sample_rate"], info["duration"], 1, wav_samples(data)))
            yield pd.DataFrame(rows, columns=["path", "sampleRate", "duration", "channels", "pcmData"])

    return files.select("path", "extension", "data").mapInPandas(run, "path string, sampleRate int, duration double, channels int, pcmData array<float>")


def encode_wav(samples: DataFrame, column: str = "pcmData", rate: str = "sampleRate", out: str = "wav", rounded: bool = False) -> DataFrame:
    """Add a WAV file of each row's samples (K8)."""
    pack = F.pandas_udf(lambda s, r: pd.Series([None if x is None else wav_bytes(x, int(k), rounded) for x, k in zip(s, r)], dtype=object), "binary")
    return samples.withColumn(out, pack(column, rate))


def energy_labels(samples: DataFrame, key: str, column: str = "pcmData", frame: int = config.FRAME_SAMPLES, rate: int = config.SAMPLE_RATE, threshold: float = 0.01) -> DataFrame:
    """Frames labelled by energy: a stand-in for a voice model, which is not part of this.

    Gives (key, frame, t, label); frames that do not fill are left out.
    """
    n = F.floor(F.size(column) / frame).cast("int")
    rows = samples.where(n > 0).select(key, column, F.explode(F.sequence(F.lit(0), n - 1)).alias("frame"))
    part = F.slice(column, F.col("frame") * frame + 1, F.lit(frame))
    energy = F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / frame)
    return rows.select(key, "frame", (F.col("frame") * (frame / rate)).alias("t"), (energy >= threshold).cast("int").alias("label"))
