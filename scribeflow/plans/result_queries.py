"""Queries from chunk results to final texts, and over the cache of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.cache import SourceCache
from ..sources.storage import shared_folder
from .interval_queries import _results
from .registry import query, table
from .strategy import strategy_result, with_failures

_STRATEGY = """WITH r AS (SELECT *, turn % 3 <> 2 AS good FROM conversations WHERE conv_id % 6 <> 4),
 a AS (SELECT conv_id, count(*) AS came, count(*) FILTER (good) AS processed, coalesce(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) FILTER (good), '') AS merged,
  list({'start': turn * 60.0::DOUBLE, 'end': turn * 60.0::DOUBLE + 50, 'text': role} ORDER BY turn) FILTER (good) AS segments,
  '**処理に失敗した' || CASE WHEN count(*) FILTER (NOT good) = 1 THEN '' ELSE count(*) FILTER (NOT good) || '個の' END || 'チャンク:**' || chr(10) || string_agg('- チャンク ' || turn || ' (' || turn || ':00 - ' || turn || ':50): API error ' || conv_id, chr(10) ORDER BY turn) FILTER (NOT good) AS report FROM r GROUP BY conv_id),
 p AS (SELECT conv_id, count(*) + (conv_id % 5 = 1)::INT AS total, CASE WHEN conv_id % 4 = 2 THEN 'run cancelled' WHEN conv_id % 4 = 0 THEN 'quota of ' || conv_id END AS stopped FROM conversations GROUP BY conv_id),
 j AS (SELECT p.*, coalesce(came, 0) AS came, coalesce(processed, 0) AS processed, merged, segments, report, coalesce(contains(stopped, 'cancelled'), false) AS user_stop FROM p LEFT JOIN a USING (conv_id)),
 o AS (SELECT *, CASE WHEN came > 0 THEN processed < total OR stopped IS NOT NULL ELSE user_stop END AS partial FROM j),
 t AS (SELECT *, CASE WHEN came = 0 AND user_stop THEN 'Partial transcription result' || chr(10) || chr(10) || 'Transcription was cancelled before any chunks were processed.' WHEN came > 0 THEN CASE WHEN partial THEN 'Partial transcription result' || chr(10) || processed || '/' || total || ' chunks processed.' || chr(10) || chr(10) ELSE '' END || merged || coalesce(chr(10) || chr(10) || '---' || chr(10) || report, '') END AS text FROM o)
 SELECT conv_id AS doc_id, CASE WHEN user_stop THEN 'cancelled' WHEN came = 0 THEN 'failed' WHEN partial THEN 'partial' ELSE 'complete' END AS outcome, text, array_to_string([x.text || '@' || x.start::BIGINT || '-' || x.end::BIGINT for x in segments], ', ') AS segments, partial,
 CASE WHEN came > 0 AND user_stop THEN 'Transcription cancelled. Completed ' || processed || ' out of ' || total || ' chunks.' WHEN came > 0 AND stopped IS NOT NULL THEN 'Partial transcription due to error: ' || stopped || '. Completed ' || processed || ' out of ' || total || ' chunks.' WHEN came = 0 AND user_stop THEN 'Transcription was cancelled before any chunks were processed.' WHEN came = 0 THEN coalesce(stopped, 'No transcription results obtained') END AS error,
 processed, total, CASE WHEN came > 0 THEN 100 ELSE 10 END AS percentage, CASE WHEN processed > 0 THEN 1000.0::DOUBLE / processed * (total - processed) END AS remaining_ms FROM t"""


@query("strategy_result", _STRATEGY)
def strategy(spark, d):
    """Turns as chunks: every third fails, some recordings are stopped, some have no results."""
    rows = table(spark, d, "conversations")
    stopped = F.when(F.col("conv_id") % 4 == 2, F.lit("run cancelled")).when(F.col("conv_id") % 4 == 0, F.concat(F.lit("quota of "), F.col("conv_id").cast("string")))
    planned = rows.groupBy("conv_id").agg((F.count("*") + (F.col("conv_id") % 5 == 1).cast("int")).alias("total")).select(F.col("conv_id").alias("doc_id"), "total", stopped.alias("stopped"), F.lit(1000.0).alias("elapsed_ms"))
    roles = rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("id"), "role")
    segment = F.struct(F.col("startTime").alias("start"), F.col("endTime").alias("end"), F.col("role").alias("text"))
    results = _results(spark, d).where("doc_id % 6 <> 4").join(roles, ["doc_id", "id"]).withColumn("segments", F.array(segment)).drop("role")
    out = with_failures(strategy_result(planned, results, timestamps=True), results)
    told = F.transform("segments", lambda s: F.concat(s["text"], F.lit("@"), s["start"].cast("long").cast("string"), F.lit("-"), s["end"].cast("long").cast("string")))
    return out.withColumn("segments", F.array_join(told, ", "))


@query(
    "source_cache",
    """WITH RECURSIVE r AS (SELECT user_id, event_id, event_type || '.wav' AS p, (event_id // 400)::BIGINT AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 c AS (SELECT user_id, event_id, i, [{'p': p, 'm': m}] AS held, 'miss' AS state, NULL::VARCHAR AS gone_path, NULL::BIGINT AS gone_changed FROM r WHERE i = 1
 UNION ALL SELECT user_id, event_id, i, CASE WHEN hit THEN held WHEN len(held) < 5 THEN list_append(held, f) ELSE list_append(held[2:], f) END, CASE WHEN hit THEN 'hit' ELSE 'miss' END, CASE WHEN NOT hit AND len(held) >= 5 THEN held[1].p END, CASE WHEN NOT hit AND len(held) >= 5 THEN held[1].m END
 FROM (SELECT r.user_id, r.event_id, r.i, c.held, {'p': r.p, 'm': r.m} AS f, list_contains(c.held, {'p': r.p, 'm': r.m}) AS hit FROM c JOIN r ON r.user_id = c.user_id AND r.i = c.i + 1))
 SELECT user_id, event_id, state, gone_path, gone_changed FROM c""",
)
def source_cache(spark, d):
    """Events as reads of files that change now and then, in two runs over one cache."""
    rows = table(spark, d, "events")
    reads = rows.select(F.col("user_id").alias("reader"), F.col("event_id").alias("at"), F.concat("event_type", F.lit(".wav")).alias("path"), F.expr("event_id div 400").alias("changed"))
    half = rows.agg(F.expr("max(event_id) div 2")).first()[0] or 0
    cache = SourceCache(spark, shared_folder(spark, "cache"))
    out = cache.replay(reads.where(F.col("at") <= half)).unionByName(cache.replay(reads.where(F.col("at") > half)))
    return out.select(F.col("reader").cast("long").alias("user_id"), F.col("at").alias("event_id"), "state", "gone_path", "gone_changed")
