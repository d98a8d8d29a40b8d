"""Queries over the library functions that no text or interval query reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import kernels
from ..functions import numbers as N
from ..functions import predicates as P
from ..functions import signal as S
from ..functions import text as T
from ..operators import catalog, dictionary, intervals, merging, repeats
from ..sources import asr, audio, redaction, sinks, state
from ..streaming import sessions
from . import audio as audio_plans
from .interval_queries import _FRAMES, _SPEECH, _results, _rounded, frame_rows
from .registry import query, spread, table

_RATE = config.SAMPLE_RATE

# --- Audio ------------------------------------------------------------------------------


def _waves(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.lit("wav").alias("extension"), F.col("embedding").alias("pcmData"), F.lit(_RATE).alias("sampleRate"))
    return audio.encode_wav(rows, out="data")


@query(
    "wav_round_trip",
    f"SELECT vec_id::VARCHAR AS path, {_RATE} AS \"sampleRate\", len(embedding) / {_RATE}.0::DOUBLE AS duration, [CASE WHEN x < 0 THEN trunc(greatest(x::DOUBLE, -1) * 32768) ELSE trunc(least(x::DOUBLE, 1) * 32767) END::INT for x in embedding] AS samples FROM embeddings",
)
def wav_round_trip(spark, d):
    rows = audio.decode_wav(_waves(spark, d).select("path", "extension", "data"))
    return rows.select("path", "sampleRate", "duration", F.transform("pcmData", lambda x: (x * 32768).cast("int")).alias("samples"))


@query(
    "wav_validation",
    f"""SELECT path, k IN (0, 3) AS valid, CASE k WHEN 1 THEN 'only WAV is supported, got ''mp3''' WHEN 2 THEN 'Invalid WAV file format' END AS error, CASE k WHEN 0 THEN 1 WHEN 3 THEN 2 END AS channels,
 CASE k WHEN 0 THEN n * 2 / ({_RATE} * 2.0) WHEN 3 THEN n * 2 / ({_RATE} * 4.0) END::DOUBLE AS duration, CASE k WHEN 3 THEN ['2 channels detected'] ELSE [] END AS warnings FROM (SELECT vec_id::VARCHAR AS path, vec_id % 4 AS k, len(embedding) AS n FROM embeddings)""",
)
def wav_validation(spark, d):
    k = F.col("path").cast("long") % 4
    head = lambda n: F.substring("data", 1, n)
    stereo = F.concat(head(22), F.unhex(F.lit("0200")), F.expr("substring(data, 25)"))
    rows = _waves(spark, d).select("path", F.when(k == 1, "mp3").otherwise("wav").alias("extension"), F.when(k == 2, head(20)).when(k == 3, stereo).otherwise(F.col("data")).alias("data"))
    return audio.validate_wav(rows).select("path", "info.valid", "info.error", "info.channels", "info.duration", "info.warnings")


@query("speech_extract", "SELECT vec_id, embedding[11:25] || embedding[41:52] || embedding[64:64] AS samples FROM embeddings")
def speech_extract(spark, d):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((1.0, 2.5), (4.0, 5.15), (6.3, 9.0))])
    return table(spark, d, "embeddings").select("vec_id", S.extract(F.col("embedding"), spans, 10).alias("samples"))


def _tones(spark, d):
    """A file per nation: 0.6 s of a level, 1.2 s of silence, 0.6 s of the level."""
    level = ((F.col("n_nationkey") + 1) / 50).cast("float")
    sound, silence = F.array_repeat(level, 9600), F.array_repeat(F.lit(0.0).cast("float"), 19200)
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.lit("wav").alias("extension"), F.concat(sound, silence, sound).alias("pcmData"), F.lit(_RATE).alias("sampleRate"))
    return audio.encode_wav(rows, out="data").select("path", "extension", "data")


@query("audio_preprocess", "SELECT n_nationkey::VARCHAR AS path, (44 + 2 * n)::INT AS bytes, n::INT AS samples FROM nation, (SELECT ceil((19 * 0.03::DOUBLE + 0.03::DOUBLE + 0.2::DOUBLE) * 16000) + 38400 - floor((60 * 0.03::DOUBLE - 0.2::DOUBLE) * 16000) AS n)")
def audio_preprocess(spark, d):
    return audio_plans.preprocess(_tones(spark, d)).select("path", F.length("wav").alias("bytes"), F.size("pcmData").alias("samples"))


@query("audio_pipeline", "SELECT n_nationkey::VARCHAR AS path, 0::BIGINT AS id, 0.0::DOUBLE AS \"startTime\", 2.4::DOUBLE AS \"endTime\", 38400 AS samples FROM nation")
def audio_pipeline(spark, d):
    rows = audio_plans.audio_pipeline(_tones(spark, d), "whisper-1")
    return rows.select("path", F.col("id").cast("long").alias("id"), "startTime", "endTime", F.size("pcmData").alias("samples"))


@query(
    "segments_and_chunks",
    f"""SELECT file_id, 'speech' AS kind, round(start, 6) AS start, round("end", 6) AS "end" FROM {_SPEECH}
 UNION ALL SELECT file_id, 'chunk', 0.0, round(max(frame) * 0.03::DOUBLE + 0.03, 6) FROM {_FRAMES} WHERE label >= 0 GROUP BY file_id HAVING max(frame) * 0.03::DOUBLE + 0.03 >= 0.1""",
)
def segments_and_chunks(spark, d):
    speech, chunks = audio_plans.segments_and_chunks(frame_rows(spark, d), "gpt-4o-transcribe")
    told = speech.select("file_id", F.lit("speech").alias("kind"), "start", "end")
    return _rounded(told.unionByName(chunks.select("file_id", F.lit("chunk").alias("kind"), F.col("startTime").alias("start"), F.col("endTime").alias("end"))), "start", "end")


@query("realtime_floor", "SELECT vec_id, [floor(CASE WHEN x < 0 THEN greatest(x::DOUBLE, -1) * 32768 ELSE least(x::DOUBLE, 1) * 32767 END)::INT for x in embedding] AS samples FROM embeddings")
def realtime_floor(spark, d):
    return table(spark, d, "embeddings").select("vec_id", S.pcm16_floor(F.col("embedding")).alias("samples"))


# --- Files, notes, history ----------------------------------------------------------------


@query("time_range", "SELECT event_id, CASE WHEN s < 0 THEN 'negative start' WHEN e <= s THEN 'end before start' WHEN e > 90 THEN 'end beyond duration' END AS problem, least(greatest(s, 0), 90) AS low, greatest(least(greatest(s, 0), 90), least(greatest(e, 0), 90)) AS high FROM (SELECT event_id, value - 20.0 AS s, value * 2 - 30 AS e FROM events)")
def time_range(spark, d):
    s, e, n = F.col("value") - 20.0, F.col("value") * 2 - 30, F.lit(90.0)
    kept = P.clamped_range(s, e, n)
    return table(spark, d, "events").select("event_id", P.time_range_problem(s, e, n).alias("problem"), kept["start"].alias("low"), kept["end"].alias("high"))


@query("remaining_time", "SELECT event_id, CASE WHEN event_id % 7 > 0 THEN value / (event_id % 7) * (10 - event_id % 7) END AS remaining, event_id % 7 * 30.0::DOUBLE AS whole, event_id % 7 * 15.0::DOUBLE AS shared, floor(value * 2 + 0.5)::BIGINT AS chars FROM events")
def remaining_time(spark, d):
    k = F.col("event_id") % 7
    return table(spark, d, "events").select("event_id", N.remaining_ms(F.col("value"), k, F.lit(10)).alias("remaining"), N.processing_seconds(k).cast("double").alias("whole"), N.processing_seconds(k, True).alias("shared"), N.expected_chars(F.col("value"), 2.0).alias("chars"))


@query("key_checks", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'format' END AS problem, page_id % 4 >= 2 AS key FROM pages")
def key_checks(spark, d):
    k = F.col("page_id") % 4
    own = F.when(k == 0, " ").when(k == 1, "sk-short").otherwise(F.concat(F.lit("sk-"), F.md5(F.col("url"))))
    return table(spark, d, "pages").select("page_id", P.key_problem(own).alias("problem"), P.looks_like_key(own).alias("key"))


@query(
    "note_search",
    "SELECT page_id, stamp FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'md' ELSE 'txt' END AS ext, strftime(TIMESTAMP '2024-01-01' + to_days((page_id % 90)::INT), '%Y-%m-%d') AS stamp FROM pages) WHERE ext = 'md' AND contains(stamp, '2024-02')",
)
def note_search(spark, d):
    stamp = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int")), "yyyy-MM-dd")
    rows = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "md").otherwise("txt").alias("extension"), stamp.alias("stamp"))
    return catalog.notes_of(rows, "2024-02", "stamp").select("page_id", "stamp")


@query("supported_files", "SELECT page_id FROM (SELECT page_id, ['mp3', 'MP4', 'doc', 'wav', 'png'][page_id % 5 + 1] AS ext FROM pages) WHERE lower(ext) IN ('mp3', 'mp4', 'wav')")
def supported_files(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("mp3", "MP4", "doc", "wav", "png")]), (F.col("page_id") % 5 + 1).cast("int"))
    return catalog.supported_files(table(spark, d, "pages").select("page_id", F.concat(F.lit("a/b."), ext).alias("path"))).select("page_id")


@query("cleanup_files", "SELECT page_id FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'tmp/run/' WHEN 1 THEN 'tmp/run/../' WHEN 2 THEN 'tmp/runner/' ELSE 'other/' END || page_id AS path FROM pages) WHERE starts_with(path, 'tmp/run/') AND NOT contains(path, '/../')")
def cleanup_files(spark, d):
    k = F.col("page_id") % 4
    folder = F.when(k == 0, "tmp/run/").when(k == 1, "tmp/run/../").when(k == 2, "tmp/runner/").otherwise("other/")
    return sinks.expired(table(spark, d, "pages").select("page_id", F.concat(folder, F.col("page_id").cast("string")).alias("path")), "tmp/run/").select("page_id")


@query(
    "note_front_matter",
    """SELECT event_id, '---' || chr(10) || 'status: ' || event_type || chr(10) || 'timestamp: ' || strftime(epoch_ms(epoch_us(ts) // 1000), '%Y-%m-%dT%H:%M:%S.%gZ') || chr(10) || 'source: ' || user_id || chr(10) || 'model: m' || chr(10) || 'characters: ' || length(props) || chr(10) || '---' || chr(10) || chr(10) || props AS content FROM events""",
)
def note_front_matter(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).alias("startTime"), F.col("user_id").cast("string").alias("inputFilePath"), F.col("props").alias("text"), F.col("props").alias("body"))
    return sinks.note_text(sinks.front_matter(rows, "m")).select("event_id", "content")


@query("position_update", "SELECT item_id, CASE WHEN item_id = 3 THEN 'changed' ELSE text END AS text FROM benchmark")
def position_update(spark, d):
    return catalog.set_at(table(spark, d, "benchmark"), "item_id", 3, text="changed").select("item_id", "text")


@query("default_settings", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, 'view') AS kind, 'en' AS language FROM events")
def default_settings(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind"))
    return catalog.with_defaults(rows, {"kind": "view", "language": "en"})


@query("settings_overlay", "SELECT event_id, event_type AS kind, 'en' AS language, user_id::VARCHAR AS owner FROM events")
def settings_overlay(spark, d):
    own = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("owner"), F.col("user_id").cast("string"))
    base = F.create_map(F.lit("kind"), F.lit("none"), F.lit("language"), F.lit("en"))
    rows = table(spark, d, "events").withColumn("m", catalog.overlay_maps(own, base))
    return rows.select("event_id", *[F.col(f"m.{k}").alias(k) for k in ("kind", "language", "owner")])


@query("partial_results", "SELECT conv_id AS doc_id, turn::INT AS id, turn % 3 <> 2 AND turn < 4 AS success, CASE WHEN turn >= 4 THEN 'cancelled' WHEN turn % 3 = 2 THEN 'API error ' || conv_id END AS error FROM conversations")
def partial_results(spark, d):
    return sessions.partial_results(_results(spark, d).withColumn("mark", F.lit(4)), "mark").select("doc_id", "id", "success", "error")


@query("tumbling_frames", "SELECT user_id, (epoch_us(ts) // 30000)::BIGINT AS frame, count(*) AS n FROM events GROUP BY user_id, frame")
def tumbling_frames(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions.frames(rows).select("user_id", F.floor(F.unix_micros("window.start") / 30000).cast("long").alias("frame"), "n")


@query("first_path", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'cache/' || page_id END AS path FROM pages")
def first_path(spark, d):
    k = F.col("page_id") % 3
    own = asr.first_path(F.when(k == 0, F.col("url")).when(k == 1, ""), F.when(k < 2, F.concat(F.lit("cache/"), F.col("page_id").cast("string"))))
    return table(spark, d, "pages").select("page_id", own.alias("path"))


@query("recorded_answers", "SELECT conv_id AS doc_id, turn::INT AS id, turn % 2 = 0 AS success, CASE WHEN turn % 2 = 1 THEN 'no recorded answer' END AS error FROM conversations")
def recorded_answers(spark, d):
    rows = _results(spark, d).select("doc_id", "id")
    answers = _results(spark, d).where("id % 2 = 0").select("doc_id", "id", F.to_json(F.struct("text")).alias("json"))
    return asr.recorded(rows, answers, ["doc_id", "id"]).select("doc_id", "id", "success", "error")


@query("plain_answers", "SELECT conv_id AS doc_id, turn::INT AS id, CASE WHEN turn % 4 = 3 THEN '' ELSE trim(text, E' \\t\\n\\r') END AS text, turn % 4 <> 3 AS success, CASE WHEN turn % 4 = 3 THEN 'unreadable answer' END AS error FROM conversations")
def plain_answers(spark, d):
    raw = F.when(F.col("id") % 4 == 3, "{}").otherwise(F.to_json(F.struct(F.concat(F.lit("x <TRANSCRIPT>"), "text", F.lit("</TRANSCRIPT>")).alias("text"))))
    rows = asr.gpt4o_rows(_results(spark, d).withColumn("json", raw), ["doc_id", "id"])
    return rows.select("doc_id", "id", "text", "success", "error")


@query("chat_answers", "SELECT conv_id, turn, text AS answer FROM conversations")
def chat_answers(spark, d):
    message = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))
    raw = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    return table(spark, d, "conversations").select("conv_id", "turn", asr.chat_text(raw).alias("answer"))


@query("realtime_events", "SELECT 'e' || event_id AS event_id, 'speech.' || event_type AS type, (event_id % 1000)::BIGINT AS start_ms FROM events WHERE event_id % 5 <> 0")
def realtime_events(spark, d):
    told = F.to_json(F.struct(F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("speech."), "event_type")).alias("type"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), (F.col("event_id") % 1000).alias("audio_start_ms")))
    rows = asr.realtime_events(table(spark, d, "events").select(told.alias("json")))
    return rows.select("event_id", "type", F.col("audio_start_ms").alias("start_ms"))


@query("service_batches", "SELECT conv_id AS doc_id, turn::INT AS id, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3)::BIGINT AS batch FROM conversations")
def service_batches(spark, d):
    return asr.batches(_results(spark, d), "doc_id", 3).select("doc_id", "id", "batch")


# --- Dictionaries and state ------------------------------------------------------------------


@query("dictionary_documents", "SELECT 'en' AS lang, kind, 0 AS ord, ['w' || item_id, 'v' || item_id] AS \"from\", 'r' || item_id AS \"to\", (item_id % 5)::INT AS priority, item_id FROM benchmark, (VALUES ('contextual'), ('definite')) AS k(kind) WHERE kind = 'definite' OR item_id % 2 = 0")
def dictionary_documents(spark, d):
    name = lambda c: F.concat(F.lit(c), F.col("item_id").cast("string"))
    plain = F.array(F.struct(F.array(name("w"), name("v")).alias("from"), name("r").alias("to"), (F.col("item_id") % 5).alias("priority")), F.struct(F.array(F.lit("")).alias("from"), F.lit("lost").alias("to"), F.lit(1).cast("long").alias("priority")))
    older = F.array(F.struct(F.concat(name("w"), F.lit(", "), name("v"), F.lit(",")).alias("from"), name("r").alias("to"), (F.col("item_id") % 5).alias("priority")))
    lists = F.struct(plain.alias("definiteCorrections"), F.when(F.col("item_id") % 2 == 0, older).alias("contextualCorrections"))
    rows = table(spark, d, "benchmark").select("item_id", F.to_json(F.struct(F.struct(lists.alias("en")).alias("dictionaries"))).alias("json"))
    # One document per row: its number comes back by the name of its replacement.
    out = state.parse_dictionary(rows).select("lang", "kind", "ord", "from", "to", "priority")
    return out.withColumn("item_id", F.expr("substring(to, 2)").cast("long"))


@query("flat_rules", "SELECT item_id::INT AS ord, p::INT AS pat_ord, w AS pattern, 'r' || item_id AS replacement FROM (SELECT item_id, string_split(text, ' ') AS words FROM benchmark), (VALUES (0), (1)) AS v(p), LATERAL (SELECT words[p + 1] AS w) WHERE p < len(words)")
def flat_rules(spark, d):
    rows = table(spark, d, "benchmark").select(
        F.lit("en").alias("lang"), F.lit("definite").alias("kind"), F.col("item_id").cast("int").alias("ord"), F.slice(F.split("text", " "), 1, 2).alias("from"), F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("to"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("int").alias("priority"), F.array().cast("array<string>").alias("context_keywords")
    )
    return dictionary.flattened(rows).select("ord", "pat_ord", "pattern", "replacement")


@query("merged_rules", "SELECT ord, word FROM (SELECT item_id AS ord, text AS word FROM benchmark UNION ALL SELECT item_id + (SELECT max(item_id) + 1 FROM benchmark), upper(left(text, 3)) FROM benchmark)")
def merged_rules(spark, d):
    old = table(spark, d, "benchmark").select(F.lit("en").alias("lang"), F.lit("plain").alias("kind"), F.col("item_id").alias("ord"), F.col("text").alias("word"))
    new = old.withColumn("word", T.upper_by_points(F.left("word", F.lit(3))))
    return dictionary.merged(old, new).select("ord", "word")


@query("name_lists", "SELECT page_id, [trim(x) for x in string_split(url || ', ,b ,, ' || page_id, ',') if trim(x) <> ''] AS names FROM pages")
def name_lists(spark, d):
    return table(spark, d, "pages").select("page_id", state.split_names(F.concat("url", F.lit(", ,b ,, "), F.col("page_id").cast("string"))).alias("names"))


@query("history_rows", "SELECT event_id::VARCHAR AS id, user_id::INT AS \"totalChunks\", event_type AS status FROM events")
def history_rows(spark, d):
    task = F.struct(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("int").alias("totalChunks"), F.col("event_type").alias("status"))
    held = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(task).alias("history"))
    return state.history_rows(held).select("id", "totalChunks", "status")


# --- Texts --------------------------------------------------------------------------------------


@query("translated_merge", "SELECT conv_id, string_agg(trim(text, E' \\t\\n\\r'), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE turn % 4 <> 1 AND trim(text, E' \\t\\n\\r') <> '' GROUP BY conv_id")
def translated_merge(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("index"), F.when(F.col("turn") % 4 == 1, " \n").otherwise(F.concat(F.lit(" "), "text", F.lit("\n"))).alias("text"))
    return merging.translated(rows, "conv_id")


@query("processed_overlay", "SELECT conv_id AS doc_id, turn::INT AS id, CASE WHEN turn % 2 = 0 THEN upper(left(text, 1)) ELSE text END AS text, CASE WHEN turn % 2 = 0 THEN 0.9 ELSE 0.1 END::DOUBLE AS confidence FROM conversations")
def processed_overlay(spark, d):
    rows = _results(spark, d).withColumn("confidence", F.lit(0.1))
    done = rows.where("id % 2 = 0").select("doc_id", "id", T.upper_by_points(F.left("text", F.lit(1))).alias("text"), F.lit(0.9).alias("confidence"))
    return merging.overlay(rows, done, ["doc_id", "id"]).select("doc_id", "id", "text", "confidence")


@query("folded_places", r"SELECT item_id, [i - 1 for i in generate_series(1, length(text)) if NOT regexp_matches(substr(text, i, 1), '[\pP\pS\pZ\s]')] AS places FROM benchmark")
def folded_places(spark, d):
    return repeats.folded_places(spread(table(spark, d, "benchmark"))).select("item_id", "places")


@query(
    "short_kana",
    """SELECT doc_id, CASE WHEN k >= 20 + (3 + 3 * k) // 100 * 10 AND k > greatest(1, k // 5) THEN '終 ' ELSE '終 ' || repeat('ねこ ', k) END AS reduced FROM (SELECT doc_id, (doc_id % 60)::INT AS k FROM documents)""",
)
def short_kana(spark, d):
    text = F.concat(F.lit("終 "), F.repeat(F.lit("ねこ "), (F.col("doc_id") % 60).cast("int")))
    rows = spread(table(spark, d, "documents")).select("doc_id", text.alias("text"))
    return repeats.reduce_short_kana(rows, config.cleaning_plan("gpt-4o-transcribe")).select("doc_id", "reduced")


@query(
    "critical_issues",
    "SELECT event_id, event_type IN ('view', 'click') AS critical FROM events",
)
def critical_issues(spark, d):
    kind = F.col("event_type")
    issue = F.when(kind == "view", "Excessive text removal: 40%").when(kind == "click", "possible ENCODING issues").otherwise("High katakana ratio")
    return table(spark, d, "events").select("event_id", T.critical(F.array(F.lit("plain"), issue)).alias("critical"))


@query(
    "fallback_decision",
    """SELECT doc_id, line, CASE WHEN n = 0 THEN true WHEN k = 0 THEN m / (600 * 1.8::DOUBLE) < 0.1 AND n < 80 WHEN k = 1 THEN n < 80 AND (total - n) / total::DOUBLE > 0.9 ELSE false END AS fallback
 FROM (SELECT doc_id, line::BIGINT AS line, (doc_id + line) % 3 AS k, length(own) AS n, length(regexp_replace(own, '\\s+', '', 'g')) AS m, length(text) AS total
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS own, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents))""",
)
def fallback_decision(spark, d):
    """Each line of the whole texts as what a cleaning of its text has left."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.posexplode(F.split("text", "\n", -1)).alias("line", "own"))
    k = (F.col("doc_id") + F.col("line")) % 3
    issues = F.when(k == 1, F.array(F.lit("Unicode replacement characters detected"))).otherwise(F.array(F.lit("minor")))
    plan = config.cleaning_plan("gpt-4o-transcribe")
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), T.needs_fallback(F.col("own"), F.length("text"), issues, F.when(k == 0, 600.0), plan).alias("fallback"))


@query("japanese_rule", "SELECT doc_id, doc_id % 4 = 0 OR (doc_id % 4 = 1 AND doc_id % 9 >= 5) AS japanese FROM documents")
def japanese_rule(spark, d):
    k = F.col("doc_id") % 4
    text = F.concat(F.lit("漢字 "), F.repeat(F.lit("か"), (F.col("doc_id") % 9).cast("int")))
    language = F.when(k == 0, "ja").when(k == 1, "auto").otherwise("en")
    return table(spark, d, "documents").select("doc_id", T.is_japanese(text, language, config.cleaning_plan("whisper-1").japanese).alias("japanese"))


_PATTERNS = ["/THE|que/gi", "/^./m", "Th.s", "[unclosed", "a+b (c)", "an", "//", "/x/"]


@query(
    "user_patterns",
    """SELECT item_id, len(regexp_extract_all(text, '(?i)THE|que'))::INT AS p0, len(regexp_extract_all(text, '(?m)^.'))::INT AS p1, len(regexp_extract_all(text, '(?i)Th.s'))::INT AS p2, 0 AS p3, 0 AS p4, len(regexp_extract_all(text, 'an'))::INT AS p5, 0 AS p6, len(regexp_extract_all(text, 'x'))::INT AS p7 FROM benchmark""",
)
def user_patterns(spark, d):
    compiled = [kernels.user_pattern(p)[0] for p in _PATTERNS]
    return table(spark, d, "benchmark").select("item_id", *[F.regexp_count("text", F.lit(p)).alias(f"p{i}") for i, p in enumerate(compiled)])


@query("script_checks", "SELECT doc_id, regexp_matches(text, '[a-zA-Z]') AS latin, false AS chinese, false AS korean, split_part(lower(lang), '-', 1) AS base FROM documents")
def script_checks(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.contains_script(t, "en").alias("latin"), T.contains_script(t, "zh").alias("chinese"), T.contains_script(t, "ko").alias("korean"), T.base_language(F.concat(F.upper("lang"), F.lit("-XX"))).alias("base"))


@query("speech_gaps", f'SELECT file_id, count(*) AS gaps, round(max(gap), 6) AS longest FROM (SELECT file_id, lead(start) OVER (PARTITION BY file_id ORDER BY start) - "end" AS gap FROM {_SPEECH}) WHERE round(gap, 6) >= 0.05 GROUP BY file_id')
def speech_gaps(spark, d):
    rows = intervals.speech_intervals(frame_rows(spark, d))
    middles = intervals.gap_midpoints(rows, min_gap=0.045)
    ends = rows.select("file_id", "end").join(middles, "file_id").where("end <= boundary").groupBy("file_id", "boundary").agg(F.max("end").alias("end"))
    return ends.groupBy("file_id").agg(F.count("*").alias("gaps"), F.round(F.max((F.col("boundary") - F.col("end")) * 2), 6).alias("longest"))


@query("seam_overlaps")
def seam_overlaps(spark, d):
    text = F.col("text")
    rows = spread(table(spark, d, "documents")).where(F.length("text") >= 200)
    # The second text begins with a passage of the first, one character in it changed.
    again = F.concat(F.substring(text, 101, 40), F.lit("~"), F.substring(text, 142, 200))
    return merging.seam_overlaps(rows.select("doc_id", F.substring(text, 1, 180).alias("previous"), again.alias("current")), ["doc_id"])


@query("duplicate_spans")
def duplicate_spans(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.concat("text", F.lit(" "), F.upper("text"), F.lit(" "), F.reverse("text")).alias("text"))
    return repeats.without_duplicates(spread(rows), 60, 0.9).select("item_id", "collapsed")


_SAMPLES = ["これは漢字の文です。", "それは 彼が 家に 本を ", "っっっっっっっっっっっっやばい。", "（「『【〈始め。", "カタカナバカリノブンショウ、", "ひらがなばかりのぶんがながくつづくのでとてもよみにくいですね", "文字�化けあAあ。", "はい"]
_JA = "CASE k " + " ".join(f"WHEN {i} THEN repeat('{t}', 1 + (doc_id % 23)::INT)" for i, t in enumerate(_SAMPLES)) + " END"
_N = "len(regexp_extract_all(t, '{}'))"


@query(
    "japanese_checks",
    f"""SELECT doc_id, doc_id % 2 = 0 AS removed, {_N.format("[はがにをでと](?:[ ]|$)")} > 3 AS incomplete, {_N.format("[あ-んア-ン]{1,2}[あ-んア-ン]{5,}")} > 5 AS merged, n < 60 AS short, m < 100 * 2.0::DOUBLE * 0.3 AS sparse, {_N.format("っ{11,}")} > 0 AS repeated,
 m > 100 AND {_N.format("[。！？]")} < 2 AS unended, abs({_N.format("[（「『【〈]")} - {_N.format("[）」』】〉]")}) > 2 AS brackets, {_N.format("[ア-ン]")} / n::DOUBLE > 0.3 AS katakana,
 len([s for s in regexp_split_to_array(t, '[。！？]') if length(s) > 20 AND NOT regexp_matches(s, '[はがにをでと]')]) > 2 AS bare, contains(t, chr(65533)) AS broken, regexp_matches(t, '[あ-ん][A-Z][あ-ん]') AS mixed,
 {_N.format("[あ-ん]")} / n::DOUBLE > 0.8 AS hiragana, {_N.format("[一-龯]")} / n::DOUBLE < 0.05 AND n > 100 AS kanji, {_N.format("[a-zA-Z]")} / n::DOUBLE > 0.2 AS latin
 FROM (SELECT doc_id, t, length(t) AS n, length(replace(t, ' ', '')) AS m FROM (SELECT doc_id, {_JA} AS t FROM (SELECT doc_id, doc_id % 8 AS k FROM documents)))""",
)
def japanese_checks(spark, d):
    k = F.col("doc_id") % 8
    text = F.lit(None).cast("string")
    for i, t in enumerate(_SAMPLES):
        text = F.when(k == i, F.repeat(F.lit(t), (1 + F.col("doc_id") % 23).cast("int"))).otherwise(text)
    rows = table(spark, d, "documents").select("doc_id", text.alias("t"))
    before = F.length("t") * F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1)
    issues = rows.withColumn("i", T.japanese_issues(F.col("t"), before, F.lit(100.0), config.cleaning_plan("whisper-1")))
    named = {
        "removed": "Excessive text removal", "incomplete": "Possible incomplete", "merged": "Possible merged", "short": "Text too short", "sparse": "Text significantly shorter", "repeated": "Character repetition", "unended": "Missing proper",
        "brackets": "Unbalanced", "katakana": "High katakana", "broken": "Unicode replacement", "mixed": "Unusual mixed", "hiragana": "Extremely high hiragana", "kanji": "Very low kanji", "latin": "High Latin",
    }
    has = lambda start: F.exists("i", lambda x: x.startswith(start))
    return issues.select("doc_id", *[has(v).alias(c) for c, v in named.items()], F.exists("i", lambda x: x.endswith("long sentences without particles detected")).alias("bare"))


@query("dictionary_export", "SELECT 'en' AS lang, CASE WHEN item_id % 3 = 0 THEN 'contextual' ELSE 'definite' END AS kind, [trim(left(text, 5)), 'x' || item_id] AS \"from\", 'to ' || item_id AS \"to\", (item_id % 4)::INT AS priority FROM benchmark")
def dictionary_export(spark, d):
    rows = table(spark, d, "benchmark").select(
        F.lit("en").alias("lang"), F.when(F.col("item_id") % 3 == 0, "contextual").otherwise("definite").alias("kind"), F.col("item_id").cast("int").alias("ord"), F.array(F.left("text", F.lit(5)), F.concat(F.lit("x"), F.col("item_id").cast("string"))).alias("from"),
        F.concat(F.lit("to "), F.col("item_id").cast("string")).alias("to"), F.lit("noun").alias("category"), (F.col("item_id") % 4).cast("int").alias("priority"), F.array(F.lit("k")).alias("context_keywords"),
    )
    return state.parse_dictionary(state.dictionary_document(rows)).select("lang", "kind", "from", "to", "priority")


@query("plan_lookup", "SELECT event_type, CASE event_type WHEN 'view' THEN 'whisper-1' WHEN 'click' THEN 'gpt-4o-transcribe' ELSE 'gpt-4o-mini-transcribe' END AS strategy, CASE event_type WHEN 'view' THEN 35 WHEN 'click' THEN 20 ELSE 25 END AS threshold FROM (SELECT DISTINCT event_type FROM events)")
def plan_lookup(spark, d):
    names = {"view": "whisper-1", "click": "gpt-4o-transcribe"}
    plans = spark.createDataFrame([(k, config.cleaning_plan(names.get(k, k)).model, config.cleaning_plan(names.get(k, k)).base_threshold) for k in ("view", "click", "unknown")], "name string, strategy string, threshold int")
    rows = table(spark, d, "events").select("event_type").distinct().withColumn("name", F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise("unknown"))
    return rows.join(plans, "name").select("event_type", "strategy", "threshold")


@query(
    "removed_text",
    """SELECT item_id, substr(b, s + 1, length(b) - s - list_max([j for j in generate_series(0, n - s) if right(b, j) = right(a, j)])) AS removed FROM (SELECT *, list_max([i for i in generate_series(0, n) if left(b, i) = left(a, i)]) AS s
 FROM (SELECT item_id, text AS b, left(text, 10) || substr(text, 11 + (item_id % 30)::INT) AS a, least(length(text), length(left(text, 10) || substr(text, 11 + (item_id % 30)::INT))) AS n FROM benchmark))""",
)
def removed_text(spark, d):
    after = F.concat(F.left("text", F.lit(10)), F.expr("substring(text, 11 + cast(item_id % 30 as int))"))
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("before"), after.alias("after"))
    return repeats.removed(spread(rows)).select("item_id", "removed")


@query(
    "nested_redaction",
    """SELECT event_id, '{"data":{"inner":{"prompt":"<redacted: object>","props":' || replace(props, ' ', '') || '},"lines":"<redacted: ' || (length(event_type) + 4) || ' chars>","textLength":' || length(props) || '},"kind":"' || event_type || '","segments":"<redacted: array(len=2)>","text":"<redacted: ' || length(props) || ' chars>"}' AS whole,
 '{"body":"<redacted: ' || length(event_type) || ' chars>","deep":{"a":[{"b":[{"c":["<redacted: max depth>"]}]}]},"value":' || user_id || '}' AS typed FROM events""",
)
def nested_redaction(spark, d):
    """JSON of unknown shape, and a typed struct."""
    rows = table(spark, d, "events")
    inner = F.struct(F.struct(F.lit(1).alias("a")).alias("prompt"), F.parse_json("props").alias("props"))
    data = F.struct(inner.alias("inner"), F.concat(F.lit("two\n"), "event_type").alias("lines"), F.length("props").alias("textLength"))
    whole = F.to_json(F.struct(F.col("event_type").alias("kind"), F.array("event_type", "event_type").alias("segments"), F.col("props").alias("text"), data.alias("data")))
    deep = F.struct(F.array(F.struct(F.array(F.struct(F.array("event_type").alias("c"))).alias("b"))).alias("a"))
    typed = F.struct(F.col("event_type").alias("body"), deep.alias("deep"), F.col("user_id").alias("value"))
    return redaction.redacted_columns(rows.select("event_id", redaction.redacted_json(whole).alias("whole"), typed.alias("typed")), "typed")
