"""Golden vectors of expressions and operators; files, state and streams."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribeflow import config
from scribeflow.functions import numbers as N
from scribeflow.functions import predicates as P
from scribeflow.functions import signal as S
from scribeflow.functions import similarity as M
from scribeflow.functions import text as T
from scribeflow.operators import catalog, chunking, dictionary, intervals, merging
from scribeflow.plans import audio as audio_plans
from scribeflow.plans import clean, postprocess
from scribeflow.sources import asr, audio, sinks, state
from scribeflow.streaming import sessions


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    return row if len(cols) > 1 else row[0]


def values(spark, rows, ddl, expr):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(expr).collect()]


def test_times(spark):
    sec = [(75 * 60.0,), (5.0,)]
    assert values(spark, sec, "s double", N.minutes_seconds(F.col("s"))) == ["75:00", "0:05"]
    assert values(spark, sec, "s double", N.clock(F.col("s"))) == ["1:15:00", "0:05"]
    assert values(spark, [(3725.9,), (None,), (-3.0,)], "s double", N.full_clock(F.col("s"))) == ["01:02:05", "00:00:00", "00:00:00"]
    rows = [("130",), ("3.5",), ("1:02:03",), ("９９",), ("",), (None,), ("1：99",), ("x",)]
    assert values(spark, rows, "t string", N.parse_time(F.col("t"))) == [90, 185, 3723, 99, 0, 0, 119, 0]
    assert values(spark, [("3.5",)], "t string", N.parse_time(F.col("t"), decimal_minutes=True)) == [210]
    assert values(spark, [(0,), (1536,), (1048576,)], "b long", N.size_label(F.col("b"))) == ["0 Bytes", "1.5 KB", "1 MB"]
    assert values(spark, [(65000,), (5000,)], "b long", N.duration_label(F.col("b"))) == ["1:05", "5s"]
    assert one(spark, a=N.backoff_ms(F.lit(1)), b=N.backoff_ms(F.lit(9))) == (2000, 15000)
    assert one(spark, a=N.remaining_ms(F.lit(10.0), F.lit(2), F.lit(6)), b=T.round_half_up(F.lit(-2.5)).cast("int")) == (20, -2)


def test_texts(spark):
    rows = [("a  b\r\n\n\n\nc ",), ("　x　",), ("",), (None,)]
    assert values(spark, rows, "t string", T.tidy(F.col("t"))) == ["a b\n\nc", "x", "", None]
    assert values(spark, [("10chars...",)], "t string", T.estimate_tokens(F.col("t"), F.lit("en"))) == [3]
    assert values(spark, [("10chars...",)], "t string", T.estimate_tokens(F.col("t"), F.lit("ja"))) == [8]
    langs = [("hello there",), ("こんにちは",), ("안녕하세요",), ("",), ("你好吗朋友",)]
    assert values(spark, langs, "t string", T.detect_language(F.col("t"))) == ["en", "ja", "ko", "ja", "ja"]
    assert values(spark, [("en-US",), ("zh-CN",), ("auto",), (None,)], "t string", T.resolve_language(F.col("t"), F.lit("ko"))) == ["en", "zh", "ko", "ko"]
    tags = [("x <TRANSCRIPT> a </transcript>",), ("<TRANSCRIPT>b",), ("c</TRANSCRIPT>",), ("d",), ("y" * 300 + "<TRANSCRIPT>z",)]
    got = [tuple(r) for r in values(spark, tags, "t string", T.transcript(F.col("t")))]
    assert [g[:2] for g in got[:4]] == [("a", "full"), ("b", "openOnly"), ("c", "closeOnly"), ("d", "none")] and got[4][1:] == ("none", True)
    assert values(spark, [("a\nb\n",)], "t string", T.quoted(F.col("t"))) == ["> a\n> b\n> "]
    assert values(spark, [("  //foo//bar//  ",), ("   ",), (None,)], "t string", T.normalize_path(F.col("t"))) == ["/foo/bar", "", ""]
    assert one(spark, a=T.fill_template(F.lit("{a} {b:x} {c}"), {"a": F.lit("$1\\")})) == "$1\\ x "
    assert values(spark, [("abcdef " * 4,)], "t string", T.collapse_phrases(F.col("t"))) == ["abcdef "]
    assert one(spark, a=T.connector(F.lit("end."), F.lit(" Next")), b=T.connector(F.lit("終"), F.lit(" 次"))) == (" ", "")
    assert values(spark, [("a\n\nb\n\na",)], "t string", T.dedupe_paragraphs(F.col("t"))) == ["a\n\nb"]


def test_leaks_and_checks(spark):
    plan = config.cleaning_plan("gpt-4o-transcribe")
    body = "The meeting went on for a long while and nobody objected to anything. " * 4
    rows = [("Please transcribe the following audio. " + body,), ("<context>old</context>" + body,), ("<b>" + body + "</b>",), ("<context>" + "x" * 500 + "</context>short",)]
    got = values(spark, rows, "t string", T.leak_cleaned(F.col("t"), plan))
    assert got[0] == got[1] == got[2] == body.strip()
    assert not values(spark, [(body.strip(),)], "t string", T.leak_suspect(F.col("t")))[0]
    whisper = config.cleaning_plan("whisper-1")
    issues = values(spark, [("短い。",)], "t string", T.japanese_issues(F.col("t"), F.lit(100), F.lit(60.0), whisper))[0]
    assert issues[0] == "Excessive text removal: 97% of original text removed"
    assert "Text too short: only 3 characters" in issues and any(i.startswith("Text significantly shorter") for i in issues)
    assert one(spark, a=T.critical(F.array(F.lit("x"), F.lit("Emergency Fallback: y")))) is True


def test_predicates(spark):
    rows = [("API error 429",), ("Request aborted",), ("API error 503",), ("timed out",), (None,), ("?",)]
    assert values(spark, rows, "m string", P.chunk_error(F.col("m"))) == ["rate_limit", "cancelled", "server", "timeout", "unknown", "unknown"]
    assert values(spark, [("MP3",), ("xyz",)], "e string", P.mime_type(F.col("e"))) == ["audio/mpeg", "audio/mpeg"]
    key = "sk-" + "a" * 30
    assert one(spark, a=P.masked_key(F.lit(key)), b=P.looks_like_key(F.lit(key)), c=P.key_problem(F.lit("x"))) == ("sk-aaaa" + "*" * 40, True, "format")
    assert one(spark, a=P.redacted(F.lit("text"), F.lit("abc")), b=P.redacted(F.lit("textLength"), F.lit("3"))) == ("<redacted: 3 chars>", "3")
    assert one(spark, a=P.time_range_problem(F.lit(2.0), F.lit(1.0), F.lit(9.0)), b=P.clamped_range(F.lit(-1.0), F.lit(99.0), F.lit(9.0))) == ("end before start", (0.0, 9.0))


def test_similarity_equals_the_kernels(spark):
    from scribeflow.functions import kernels as K

    rows = [("abcd", "abce"), ("", ""), ("ab", "cd"), ("hello world", "help the world"), ("é", "e")]
    cols = [M.ngram_jaccard(F.col("a"), F.col("b")), M.inclusion(F.col("a"), F.col("b")), M.edit_similarity(F.col("a"), F.col("b"))]
    for (a, b), r in zip(rows, spark.createDataFrame(rows, "a string, b string").select(*cols).collect()):
        assert tuple(r) == pytest.approx((K.jaccard(a, b), K.inclusion(a, b), K.edit_similarity(a, b)))


def test_intervals(spark):
    rows = spark.createDataFrame([("f", 0.0, 1.0), ("f", 1.3, 2.0), ("f", 5.0, 5.05)], "file_id string, start double, end double")
    got = sorted((round(r.start, 6), round(r.end, 6)) for r in intervals.bridge_gaps(rows).collect())
    assert got == [(0.0, 2.2), (4.8, 5.25)]
    frames = spark.createDataFrame([("f", i, i * 0.03, v) for i, v in enumerate([1, 1, -1, 1, 0, 1])], "file_id string, frame int, t double, label int")
    got = sorted((r.start, round(r.end, 6)) for r in intervals.speech_intervals(frames).collect())
    assert got == [(0.0, 0.12), (0.15, 0.18)]
    assert sorted(r.boundary for r in intervals.gap_midpoints(rows).collect()) == [3.5]
    stats = intervals.speech_statistics(rows, spark.createDataFrame([("f", 10.0), ("g", 0.0)], "file_id string, duration double"))
    assert {r.file_id: (round(r.speech_ratio, 4), r.total_segments) for r in stats.collect()} == {"f": (0.175, 3), "g": (0.0, 0)}


def test_chunk_plans(spark):
    rows = spark.createDataFrame([(1, 30.0), (2, 180.0), (3, 170.0)], "k int, duration double")
    got = {r.k: (r.needs_chunking, r.total_chunks, r.chunk_duration, r.overlap_duration, r.reason) for r in chunking.with_plan(rows).collect()}
    assert got == {1: (False, 1, 30.0, 0.0, None), 2: (True, 4, 60.0, 5.0, "duration"), 3: (True, 3, 60.0, 5.0, "duration")}
    chunks = chunking.audio_chunks(chunking.chunk_starts(chunking.with_plan(rows), "k"), "k").where("k = 2").orderBy("id").collect()
    assert [(c.id, c.startTime, c.endTime, c.hasOverlap) for c in chunks] == [(0, 0.0, 60.0, True), (1, 55.0, 115.0, True), (2, 110.0, 170.0, True), (3, 165.0, 180.0, False)]
    waves = {5: [5], 6: [3, 3], 7: [3, 4], 9: [4, 5], 11: [3, 4, 4], 16: [4, 4, 4, 4], 21: [4, 4, 4, 4, 5], 0: []}
    n = spark.createDataFrame([(k,) for k in waves], "n long")
    assert {r.n: r.w for r in n.select("n", chunking.wave_sizes(F.col("n")).alias("w")).collect()} == waves
    assert one(spark, a=chunking.wave_concurrency(F.lit(3600), F.lit(10)), b=chunking.wave_concurrency(F.lit(600), F.lit(10)), c=chunking.wave_concurrency(F.lit(10800), F.lit(2)), d=chunking.wave_concurrency(F.lit(10800), F.lit(1))) == (3, 2, 2, 1)
    seven = spark.createDataFrame([("x", i) for i in range(7)], "k string, id int")
    assert [(r.group, r.place) for r in chunking.in_waves(seven, "k").orderBy("id").collect()] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (1, 3)]


def test_merging(spark):
    ddl = "doc_id int, id int, text string, startTime double, endTime double, success boolean, error string"
    shared = "the part that both of the chunks have in common here"
    rows = [(1, 0, f"start of it all {shared}", 0.0, 30.0, True, None), (1, 1, f"{shared} and the rest", 25.0, 60.0, True, None), (2, 0, "a", 0.0, 1.0, True, None), (2, 1, "b", 1.0, 2.0, True, None), (3, 4, "", 65.0, 70.0, False, "boom")]
    df = spark.createDataFrame(rows, ddl)
    plan = config.model_plan("gpt-4o-transcribe")
    got = {r.doc_id: r.text for r in merging.overlap_merge(df, plan, include_failures=True).collect()}
    assert got == {1: f"start of it all {shared} and the rest", 2: "a\n\nb", 3: "**処理に失敗したチャンク:**\n- チャンク 4 (1:05 - 1:10): boom"}
    assert {r.doc_id: r.outcome for r in merging.outcome(df, "doc_id").collect()} == {1: "complete", 2: "complete", 3: "failed"}
    context = {(r.doc_id, r.id): r.context for r in merging.chunk_context(df, ["doc_id"], "id", 10).collect()}
    assert context[(2, 1)] == "a" and context[(1, 0)] == ""


def test_dictionary_rows(spark):
    old = json.dumps({"ja": {"definiteCorrections": [{"from": "a, b ,,c", "to": "X"}, {"to": "no pattern"}]}})
    new = json.dumps({"version": 2, "dictionaries": {"en": {"contextualCorrections": [{"from": ["q"], "to": "Q", "priority": 5, "contextKeywords": ["k"]}]}}})
    entries = state.parse_dictionary(spark.createDataFrame([(old,), (new,), ("not json",)], "json string"))
    got = sorted((r.lang, r.kind, r["from"], r.to, r.priority) for r in entries.collect())
    assert got == [("en", "contextual", ["q"], "Q", 5), ("ja", "definite", ["a", "b", "c"], "X", None)]
    assert dictionary.flattened(entries).count() == 4
    back = state.parse_dictionary(state.dictionary_document(entries))
    assert sorted((r.lang, r["from"]) for r in back.collect()) == [("en", ["q"]), ("ja", ["a", "b", "c"])]
    assert state.dictionary_document(entries.limit(0)).count() == 0
    assert dictionary.rules_for(dictionary.flattened(entries), "ko").count() == 0


def test_catalog(spark):
    history = spark.createDataFrame([("1", "a.mp3", "/x/a.mp3"), ("2", "b.mp3", "/gone"), ("3", "c.mp3", "/gone")], "id string, inputFileName string, inputFilePath string")
    files = spark.createDataFrame([("/x/a.mp3", "a.mp3"), ("/y/b.mp3", "b.mp3"), ("/1/c.mp3", "c.mp3"), ("/2/c.mp3", "c.mp3")], "path string, name string")
    assert {r.id: r.found for r in catalog.lookup(history, files).collect()} == {"1": "/x/a.mp3", "2": "/y/b.mp3", "3": None}
    assert catalog.with_defaults(files, {"name": "d", "extra": 7}).first().extra == 7
    assert one(spark, a=catalog.overlay_maps(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(0), F.lit("b"), F.lit(2)))) == {"a": 1, "b": 2}
    assert [r.path for r in catalog.sort_files(files, "path").collect()][0] == "/1/c.mp3"
    assert catalog.supported_files(files).count() == 4 and catalog.search_files(files, "X/A").count() == 1


def test_signal(spark):
    x = [0.5, -0.5, 1.5, -1.5, 0.1]
    row = spark.createDataFrame([(x,)], "s array<double>").select(S.pcm16(F.col("s")), S.pcm16(F.col("s"), rounded=True), S.rms(F.col("s")), S.resample(F.col("s"), 2, 1), S.waveform(F.col("s"), 2)).first()
    assert row[0] == [16383, -16384, 32767, -32768, 3276] and row[1][0] == 16384 and row[1][4] == 3277
    assert row[2] == pytest.approx(np.sqrt(np.mean(np.square(x)))) and row[3] == [0.5, 1.5]
    assert [tuple(w) for w in row[4]] == [(-0.5, 1.5), (-1.5, 0.1)]
    assert audio.wav_samples(audio.wav_bytes(np.array([0.5, -0.5]), 16000)).tolist() == pytest.approx([0.49997, -0.5], abs=1e-4)


def test_audio_files(spark, tmp_path):
    rate = config.SAMPLE_RATE
    tone = 0.5 * np.sin(np.arange(rate) * 0.3)
    quiet = np.zeros(rate)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.wav").write_bytes(audio.wav_bytes(np.concatenate([quiet, tone, quiet, quiet]), rate))
    (tmp_path / "in" / "bad.wav").write_bytes(b"nothing")
    (tmp_path / "in" / "note.txt").write_bytes(b"x")
    eight = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 38, b"WAVE", b"fmt ", 16, 1, 2, 8000, 16000, 2, 8, b"data", 4) + bytes([128, 0, 255, 0])
    (tmp_path / "in" / "eight.WAV").write_bytes(eight)
    folder = str(tmp_path / "in")
    assert audio.list_audio(spark, folder).count() == 3
    files = audio.read_audio(spark, folder).where("extension = 'wav'")
    info = {r.fileName: r.info for r in audio.validate_wav(files).collect()}
    assert info["bad.wav"].error == "Invalid WAV file format"
    assert info["eight.WAV"].valid and info["eight.WAV"].channels == 2 and len(info["eight.WAV"].warnings) == 2
    decoded = {r.path.rsplit("/", 1)[1]: r for r in audio.decode_wav(files).collect()}
    assert decoded["eight.WAV"].pcmData == [0.0, pytest.approx(127 / 128)]
    speech = {r.path.rsplit("/", 1)[1]: r for r in audio_plans.preprocess(files).collect()}
    kept = next(r for n, r in speech.items() if n.startswith("a"))
    assert 1.3 * rate < len(kept.pcmData) < 1.5 * rate and kept.wav[:4] == b"RIFF"
    assert audio_plans.audio_pipeline(files, "whisper-1").count() == 1


def test_state_and_sinks(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text(json.dumps({"settings": {"model": "m"}, "history": [{"id": "1", "startTime": 5, "status": "completed"}]}))
    rows = state.read_state(spark, str(path))
    assert rows.first().version == 1 and state.history_rows(rows).first().id == "1"
    state.write_state(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().updatedAt
    result = spark.createDataFrame([("/v/talk.mp3", "talk.mp3", 1700000000000, "completed", "a\nb")], "inputFilePath string, inputFileName string, startTime long, status string, text string")
    note = sinks.note_text(sinks.front_matter(sinks.notes(result), "whisper-1")).first()
    assert note.note == "talk-2023-11-14T22-13-20.md" and note.content.endswith("> [!note] Transcription\n> a\n> b") and "model: whisper-1" in note.content
    assert sinks.write_notes(sinks.notes(result), str(tmp_path / "notes")) == 1
    assert sinks.masked({"text": "secret", "n": [1, 2]}) == {"text": "<redacted: 6 chars>", "n": [1, 2]}
    paths = spark.createDataFrame([("tmp/x.mp3",), ("tmpx/y.mp3",), ("tmp/../z",)], "path string")
    assert [r.path for r in sinks.expired(paths, "tmp").collect()] == ["tmp/x.mp3"]


def test_models(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise asr.Unavailable(503)
        return "ok"

    assert asr.retried(flaky, sleep=lambda s: None) == "ok" and len(calls) == 3
    with pytest.raises(asr.Unavailable):
        asr.retried(lambda: (_ for _ in ()).throw(asr.Unavailable(400)), sleep=lambda s: None)

    def model(data, prompt):
        if data == b"bad":
            raise ValueError("broken")
        return f"{data.decode()}[{prompt}]"

    chunks = spark.createDataFrame([(1, 0, i, bytearray(d)) for i, d in enumerate([b"a", b"bad", b"c"])], "doc_id int, grp int, id int, data binary")
    got = [(r.id, r.text, r.success) for r in asr.transcribe(chunks, model, ["doc_id"], "grp").orderBy("id").collect()]
    assert got == [(0, "a[]", True), (1, "", False), (2, "c[]", True)]
    docs = spark.createDataFrame([(1, "x\ny"), (2, "fail")], "doc_id int, text string")

    def upper(text, language):
        if text == "fail":
            raise ValueError
        return text.upper()

    assert {r.doc_id: (r.text, r.confidence) for r in postprocess.post_process(docs, upper).collect()} == {1: ("X\nY", 1.0), 2: ("fail", 0.0)}


def test_full_clean(spark):
    text = "Hello my friend, how is it going. " + "Thank you. " * 30 + "[Music] The end of the story is near."
    rows = spark.createDataFrame([(1, text, "en", 4.0), (2, "", "en", 1.0), (3, None, None, None), (4, "[Music]", "en", 100.0)], "doc_id int, text string, lang string, secs double")
    got = {r.doc_id: r for r in clean.clean(rows, "gpt-4o-transcribe", language="lang", seconds="secs").collect()}
    assert "Thank you" not in got[1].cleaned and "[Music]" not in got[1].cleaned and got[1].cleaned.startswith("Hello my friend")
    assert got[2].cleaned == "" and got[3].cleaned == "" and got[4]["pass"] == 3 and got[4].cleaned == "[Music]"
    audit = clean.audit(clean.clean(rows, "whisper-1", language="lang"), "doc_id").where("doc_id = 1").first()
    assert audit.sequence == "artefacts -> stamped tail -> tail"


def test_streams_equal_tables(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(1).write.parquet(str(tmp_path / "events"))
    batch = {tuple(r) for r in sessions.sessions(rows, "6 hours").select("user_id", "start", "end", "n").collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events"))
    q = sessions.sessions(stream, "6 hours").writeStream.format("memory").queryName("sess").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    seen = {(r.user_id, r.start, r.end, r.n) for r in spark.table("sess").collect()}
    assert seen and seen <= batch
    speech = spark.createDataFrame([("f", 0.0, 1.0), ("f", 1.3, 2.0), ("f", 5.0, 5.05)], "file_id string, start double, end double")
    speech.coalesce(1).write.parquet(str(tmp_path / "speech"))
    stream = spark.readStream.schema(speech.schema).parquet(str(tmp_path / "speech"))
    q = sessions.adaptive_sessions(stream, 0.5).writeStream.format("memory").queryName("speech").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.start, r.end) for r in spark.table("speech").collect()] == [(0.0, 2.0)]
