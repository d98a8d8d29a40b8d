"""Recogniser and model answers as rows.

The remote services are not part of this: answers come from a table of recorded
results or from a function given by the caller, which is retried as the services
ask for.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

WORD = "struct<word:string,start:double,end:double,confidence:double>"
SEGMENT = f"struct<text:string,start:double,end:double,words:array<{WORD}>>"
WHISPER = f"struct<text:string,language:string,duration:double,segments:array<{SEGMENT}>,words:array<{WORD}>>"
GPT4O = "struct<text:string,language:string>"
CHAT = "struct<choices:array<struct<message:struct<role:string,content:string>>>,usage:struct<total_tokens:int>>"


def shifted(segments: Column, offset: Column) -> Column:
    """Segments and their words moved by the start of their chunk."""
    move = lambda w: F.struct(w["word"].alias("word"), (w["start"] + offset).alias("start"), (w["end"] + offset).alias("end"), w["confidence"].alias("confidence"))
    return F.transform(segments, lambda s: F.struct(s["text"].alias("text"), (s["start"] + offset).alias("start"), (s["end"] + offset).alias("end"), F.transform(s["words"], move).alias("words")))


def whisper_rows(answers: DataFrame, keys: list[str], raw: str = "json", start: str = "startTime") -> DataFrame:
    """Result rows of time-stamped answers."""
    rows = answers.withColumn("_r", F.from_json(raw, WHISPER))
    good = F.col("_r").isNotNull() & F.col("_r.text").isNotNull()
    return rows.select(
        *keys,
        F.trim("_r.text").alias("text"),
        F.col(start).alias("startTime"),
        "endTime",
        good.alias("success"),
        F.when(~good, F.lit("unreadable answer")).alias("error"),
        shifted(F.col("_r.segments"), F.col(start)).alias("segments"),
        F.col("_r.language").alias("language"),
    )


def gpt4o_rows(answers: DataFrame, keys: list[str], raw: str = "json") -> DataFrame:
    """Result rows of plain answers, out of their transcript tags."""
    rows = answers.withColumn("_r", F.from_json(raw, GPT4O)).withColumn("_t", T.transcript(F.coalesce("_r.text", F.lit(""))))
    good = F.col("_r").isNotNull() & F.col("_r.text").isNotNull()
    return rows.select(*keys, F.col("_t.text").alias("text"), "startTime", "endTime", good.alias("success"), F.when(~good, F.lit("unreadable answer")).alias("error"), F.col("_r.language").alias("language"))


def chat_text(raw: Column) -> Column:
    """The text of a chat answer."""
    return F.from_json(raw, CHAT)["choices"][0]["message"]["content"]


class Unavailable(Exception):
    """A failed call with the service's status."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"API error {status}")
        self.status = status


def retried(call: Callable[[], str], retries: int = 3, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Call again after 5xx, 429 and 408, waiting delay * 2^n."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Unavailable as error:
            if attempt == retries or not (error.status >= 500 or error.status in (429, 408)):
                raise
            sleep(delay * 2**attempt)
    raise AssertionError


def transcribe(chunks: DataFrame, model: Callable[[bytes, str], str], keys: list[str], group: str, order: str = "id", context: int = 500, retries: int = 1, delay: float = 2.0, most_mb: float = 25.0, language: str = "auto") -> DataFrame:
    """Call a model chunk by chunk within each group, each with the end of the text
    before it, cleared of loops (S10, W20, C8); after a failure the context is empty.
    A failure is a row, and so is a chunk beyond the size that the service takes."""
    from ..functions import kernels

    cols = [c for c in chunks.columns if c != "data"]
    schema = ", ".join(f"{c} {t}" for c, t in chunks.dtypes if c != "data") + ", text string, success boolean, error string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        before, out = "", []
        for row in pdf.sort_values(order).to_dict("records"):
            own = {c: row[c] for c in cols}
            prompt = kernels.last_sentences(before, context) if before else ""
            try:
                size = len(row["data"] or b"") / (1024 * 1024)
                if size > most_mb:
                    raise ValueError(f"Chunk size {size:.1f}MB exceeds API limit of {most_mb:g}MB")
                text = retried(lambda r=row, p=prompt: model(r["data"], p), retries, delay)
                out.append({**own, "text": text, "success": True, "error": None})
                before = kernels.continuation(text, language) if text else ""
            except Exception as error:
                out.append({**own, "text": "", "success": False, "error": str(error)})
                before = ""
        return pd.DataFrame(out)

    return chunks.groupBy(*keys, group).applyInPandas(run, schema)


def recorded(chunks: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded answers for chunks; chunks without one are failures."""
    out = chunks.join(results.select(*keys, F.col("json")), keys, "left")
    return out.withColumns({"success": F.col("json").isNotNull(), "error": F.when(F.col("json").isNull(), F.lit("no recorded answer"))})


def prompt(language: Column, keywords: Column, context: Column) -> Column:
    """The request text of a chunk: instruction, keywords, end of the text before."""
    instruct = F.when(language == "en", "Transcribe only the audio content.").when(language == "zh", "仅转录音频内容。").otherwise("音声内容のみを文字に起こしてください。")
    return T.join_prompt([instruct, F.when(F.size(keywords) > 0, F.array_join(F.slice(keywords, 1, 30), ", ")), F.when(F.length(context) > 0, F.concat(F.lit("<previous>"), context, F.lit("</previous>")))])


def realtime_events(raw: DataFrame, column: str = "json") -> DataFrame:
    """Typed events of a live session."""
    kind = "struct<type:string,event_id:string,item_id:string,transcript:string,delta:string,audio_start_ms:bigint,audio_end_ms:bigint,error:struct<code:string,message:string>>"
    return raw.withColumn("e", F.from_json(column, kind)).where(F.col("e.type").isNotNull()).select("e.*")


def realtime_append(samples: Column) -> Column:
    """The event that appends base64 samples to a live session."""
    return F.to_json(F.struct(F.lit("input_audio_buffer.append").alias("type"), F.base64(samples).alias("audio")))


def realtime_session(model: str, language: str | None = None, threshold: float = 0.5, padding_ms: int = 300, silence_ms: int = 500) -> dict:
    """The settings event of a live session, with the server's speech detection."""
    detection = {"type": "server_vad", "threshold": threshold, "prefix_padding_ms": padding_ms, "silence_duration_ms": silence_ms}
    speech = {"model": model} | ({"language": language} if language else {})
    return {"type": "session.update", "session": {"input_audio_format": "pcm16", "input_audio_transcription": speech, "turn_detection": detection}}


def first_path(*paths: Column) -> Column:
    """The first candidate path that is present."""
    return F.get(F.array_distinct(F.filter(F.array(*paths), lambda p: p.isNotNull() & (p != ""))), F.lit(0))


def batches(chunks: DataFrame, key: str, size: int, order: str = "id") -> DataFrame:
    """Add the batch of each chunk for a service that takes ``size`` at a time."""
    from pyspark.sql import Window

    return chunks.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size))


def rows_of(batch: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for pdf in batch:
        yield from pdf.to_dict("records")
