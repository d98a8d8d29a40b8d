"""Post-processing of texts by a model in bounded segments; without one, the text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import kernels
from ..functions import text as T
from ..functions.arrow import pieces, row_function

Model = Callable[[str, str], str]


def identity(text: str, language: str) -> str:
    """The model of an offline run: what the reference falls back to."""
    return text


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """(key, pos, segment): texts packed by lines under the language's limit.

    Texts under the limit stay in the JVM as one segment.
    """
    language = T.detect_language(F.col(text))
    limit = F.lit(most) if most else F.element_at(F.create_map(*[F.lit(x) for kv in config.MAX_SEGMENT_CHARS.items() for x in kv]), language)
    rows = docs.withColumn("_limit", limit)
    pack = row_function(lambda t, n: None if t is None else kernels.pack_lines(t, int(n)), pa.list_(pa.string()), "array<string>", 2)
    large = F.length(text) + 1 > F.col("_limit")
    packed = pack(F.when(large, F.col(text)), F.col("_limit"))
    rows = rows.withColumn("_parts", F.coalesce(packed, F.array(F.col(text))))
    return rows.select(key, F.posexplode("_parts").alias("pos", "segment"))


def token_chunks(docs: DataFrame, max_tokens: int = 3000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, index, text, tokens, start, end) of pieces within a token budget."""
    kind = "array<struct<text:string,tokens:int,start:int,end:int>>"
    cut = pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    split = row_function(lambda t: None if t is None else [dict(zip(("text", "tokens", "start", "end"), c)) for c in kernels.token_chunks(t, max_tokens)], cut, kind)
    n = F.length(text)
    small = T.estimate_tokens(F.col(text), F.lit("auto")) <= max_tokens
    one = F.array(F.struct(F.col(text).alias("text"), T.estimate_tokens(F.col(text), F.lit("auto")).cast("int").alias("tokens"), F.lit(0).alias("start"), n.alias("end"))).cast(kind)
    rows = docs.withColumn("_parts", F.coalesce(split(F.when(~small, F.col(text))), one))
    return rows.select(key, F.posexplode("_parts").alias("index", "c")).select(key, "index", "c.text", "c.tokens", F.col("c.start"), F.col("c.end"))


def post_process(docs: DataFrame, model: Model = identity, key: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """(key, text, confidence): each segment through the model, joined in order.

    Any failure gives the input with confidence 0.
    """
    own = docs.withColumn("_segments", F.lit(0)).drop("_segments")
    parts = segments(own, key, text, most)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            done, good = [], []
            for s in b.column("segment").to_pylist():
                try:
                    done.append(None if s is None else model(s, ""))
                    good.append(True)
                except Exception:  # a failed call keeps the text
                    done.append(s)
                    good.append(False)
            cols = [b.column(key), b.column("pos"), pa.array(done, pa.string()), pa.array(good, pa.bool_()), b.column("segment")]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "pos", "segment", "good", "raw"])

    rows = parts.mapInArrow(run, f"{key} {kind}, pos int, segment string, good boolean, raw string")
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("s")))), lambda p: p["s"]), "")
    out = rows.groupBy(key).agg(ordered("segment").alias("new"), ordered("raw").alias("old"), F.min("good").alias("good"))
    return out.select(key, F.when(F.col("good"), F.col("new")).otherwise(F.col("old")).alias("text"), F.when(F.col("good"), 1.0).otherwise(0.0).alias("confidence"))


def meta_info(rows: DataFrame, raw: str = "rawContent", model: Model | None = None) -> DataFrame:
    """Add ``keywords`` and ``context`` of labelled notes.

    Notes of up to 200 tokens are parsed; longer ones go to the model, which answers
    in JSON with keywords as text or list, and are parsed where that fails.
    """
    import json

    def parse(t: str | None) -> dict:
        if t is None:
            return {"keywords": [], "context": ""}
        if model is not None and -(-len(t) // config.CHARS_PER_TOKEN["auto"]) > 200:
            try:
                got = json.loads(model(t, ""))
                words = got.get("keywords") or []
                words = [w.strip() for w in words.split(",")] if isinstance(words, str) else [str(w) for w in words]
                return {"keywords": [w for w in words if w][:30], "context": str(got.get("context") or "")}
            except (ValueError, AttributeError):
                pass
        keywords, context = kernels.parse_meta(t)
        return {"keywords": keywords, "context": context}

    @F.pandas_udf("keywords array<string>, context string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t) for t in s], columns=["keywords", "context"])

    return rows.withColumn("_meta", run(raw)).withColumns({"keywords": F.col("_meta.keywords"), "context": F.col("_meta.context")}).drop("_meta")


def translation_metadata(docs: DataFrame, model: str = "gpt-4o-mini", key: str = "doc_id") -> DataFrame:
    """Lengths, tokens and number of pieces of each text for a translating model."""
    limit = config.CHUNK_TOKEN_LIMITS.get(model, 3000) * config.CHUNK_TOKEN_FACTORS["auto"]
    # Only the number of pieces comes back; no text is shuffled or copied for it.
    count = row_function(lambda t: None if t is None else len(kernels.token_cuts(t, int(limit))) - 1, pa.int64(), "long")
    tokens = T.estimate_tokens(F.col("text"), F.lit("auto"))
    rows = docs.select(key, F.length("text").alias("total_length"), tokens.alias("tokens"), count(F.when(tokens > int(limit), F.col("text"))).alias("chunks"))
    rows = rows.withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    return rows.select(key, "total_length", "tokens", "chunks", (F.col("chunks") > 1).alias("needs_chunking"), F.lit(int(limit)).alias("optimal_chunk_size"))


def needs_chunking(text: Column, max_tokens: int = 3000, language: str = "auto") -> Column:
    return T.estimate_tokens(text, F.lit(language)) > max_tokens
