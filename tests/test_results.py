"""From results to final texts, and the cache of sources."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from scribeflow.config import model_plan
from scribeflow.operators import merging
from scribeflow.plans.strategy import strategy_result, with_figures
from scribeflow.sources.cache import SourceCache
from scribeflow.sources.versioned import Conflict

RESULT = "doc_id long, id int, text string, startTime double, endTime double, success boolean, error string, segments array<struct<text:string,start:double,end:double>>"


def plain_cache(reads, size, kept=None):
    kept, out = OrderedDict() if kept is None else kept, []
    for path, changed in reads:
        gone = (None, None)
        hit = (path, changed) in kept
        if not hit and path is not None and changed is not None:
            if len(kept) == size:
                gone, _ = kept.popitem(last=False)
            kept[path, changed] = 1
        out.append(("hit" if hit else "miss", *gone))
    return out


@pytest.mark.parametrize("size", [1, 5])
def test_cache_over_runs(spark, tmp_path, size):
    rng = random.Random(size)
    cache = SourceCache(spark, f"file://{tmp_path}/cache", size)
    own: dict = {}
    at = 0
    for _ in range(3):
        rows = []
        for _ in range(400):
            reader = rng.choice(["a", "a", "a", "b", None])
            rows.append((reader, at, rng.choice(["x", "y", "z", "w", None]), rng.choice([1, 2, None]) if rng.random() < 0.1 else 1 + at // 300))
            at += 1
        rng.shuffle(rows)
        got = {r.at: (r.state, r.gone_path, r.gone_changed) for r in cache.replay(spark.createDataFrame(rows, "reader string, at long, path string, changed long")).collect()}
        want = {}
        for reader in ("a", "b", None):
            mine = sorted(r[1:] for r in rows if r[0] == reader)
            told = plain_cache([(p, c) for _, p, c in mine], size, own.setdefault(reader, OrderedDict()))
            want.update({a: t for (a, _, _), t in zip(mine, told)})
        assert got == want
        held = sorted((str(r.reader), r.place, r.path, r.changed) for r in cache.held().collect())
        assert held == sorted((str(k), i, *s) for k, v in own.items() for i, s in enumerate(v))


def test_cache_without_reads_and_two_writers(spark, tmp_path):
    cache = SourceCache(spark, f"file://{tmp_path}/cache")
    none = spark.createDataFrame([], "reader string, at long, path string, changed long")
    assert cache.replay(none).count() == 0 and cache.held().count() == 0
    one = spark.createDataFrame([("a", 1, "p", 1)], none.schema)
    cache.replay(one)
    assert [tuple(r) for r in cache.replay(none).collect()] == [] and [r.path for r in cache.held().collect()] == ["p"]
    other = SourceCache(spark, f"file://{tmp_path}/cache")
    late = other.table.latest
    other.table.latest = lambda: late() - 1  # read before the other run was done
    with pytest.raises(Conflict):
        other.replay(one)
    assert [r.path for r in cache.held().collect()] == ["p"]


def results(spark):
    seg = lambda t, s: [{"text": t, "start": s, "end": s + 5}]
    return spark.createDataFrame(
        [
            (1, 1, "second", 60.0, 90.0, True, None, seg("b", 60.0)), (1, 0, "first", 0.0, 62.0, True, None, seg("a", 1.0)),
            (2, 0, "kept", 0.0, 60.0, True, None, None), (2, 1, "lost", 60.0, 90.0, False, "E", seg("x", 0.0)),
            (3, 0, "kept", 0.0, 60.0, True, None, None),
            (4, 0, "no", 0.0, 60.0, False, "E", None), (4, 1, None, 60.0, 61.0, None, "E", None),
            (8, 0, None, 0.0, 1.0, True, None, None), (9, 0, "unplanned", 0.0, 1.0, True, None, None),
        ],
        RESULT,
    )


def planned(spark):
    return spark.createDataFrame([(1, 2, None), (2, 3, "quota"), (3, 2, "aborted by user"), (4, 2, None), (5, 3, "request cancelled"), (6, 3, "no network"), (7, None, None), (8, 1, None), (8, 1, None)], "doc_id long, total int, stopped string")


def test_strategy_cases(spark):
    out = {r.doc_id: r for r in strategy_result(planned(spark), results(spark), timestamps=True).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert (out[1].outcome, out[1].text, out[1].partial, out[1].error, out[1].percentage) == ("complete", "first\n\nsecond", False, None, 100)
    assert [(s.text, s.start) for s in out[1].segments] == [("a", 1.0), ("b", 60.0)]
    head = "Partial transcription result\n1/%d chunks processed.\n\nkept"
    assert (out[2].outcome, out[2].text, out[2].segments) == ("partial", head % 3, None)
    assert out[2].error == "Partial transcription due to error: quota. Completed 1 out of 3 chunks."
    assert (out[3].outcome, out[3].text, out[3].error) == ("cancelled", head % 2, "Transcription cancelled. Completed 1 out of 2 chunks.")
    assert (out[4].outcome, out[4].text, out[4].error) == ("partial", "Partial transcription result\n0/2 chunks processed.\n\n", None)
    none = "Transcription was cancelled before any chunks were processed."
    assert (out[5].outcome, out[5].text, out[5].partial, out[5].error) == ("cancelled", f"Partial transcription result\n\n{none}", True, none)
    assert (out[6].outcome, out[6].text, out[6].partial, out[6].error) == ("failed", None, False, "no network")
    assert (out[7].outcome, out[7].error, out[7].total) == ("failed", "No transcription results obtained", 0)
    assert (out[8].outcome, out[8].text) == ("complete", "")


def test_strategy_with_another_merge_and_figures(spark):
    rows, seen = with_figures(results(spark))
    merge = lambda r: merging.overlap_merge(r, model_plan("gpt-4o-transcribe"))
    out = {r.doc_id: r.text for r in strategy_result(planned(spark), rows, merge=merge).collect()}
    assert out[1] == "first\n\nsecond" and out[6] is None
    rows, seen = with_figures(results(spark), "again")
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"chunks": 9, "failed": 3, "characters": 34, "seconds": 305.0, "segmented": 3}
    assert strategy_result(planned(spark).limit(0), results(spark)).count() == 0
    assert strategy_result(planned(spark), results(spark).where(F.lit(False))).where("outcome = 'failed'").count() == 6


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_near_pairs_of_a_template(spark, least):
    """All pairs above the similarity, in a block that shares a template and in others."""
    from scribeflow.operators import similar

    rng = random.Random(3)
    head = "one template that all of these texts have got, "
    rows = [(i, head + "".join(rng.choices("abcdef ", k=rng.randrange(0, 60)))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + rng.choice(["", "x", "some more"])) for i in range(30)]
    rows += [(200, "short"), (201, None), (202, ""), (203, "".join(rng.choices("uvwxyz", k=80)))]
    grams = {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, t in rows if t and len(t) >= 40}
    want = {}
    for a in grams:
        for b in grams:
            like = len(grams[a] & grams[b]) / len(grams[a] | grams[b])
            if a < b and dict(rows)[a][:40] == dict(rows)[b][:40] and like >= least:
                want[a, b] = round(like, 6)
    got = {(r.a, r.b): round(r.similarity, 6) for r in similar.jaccard_pairs(spark.createDataFrame(rows, "doc_id long, text string"), least=least).collect()}
    assert got == want and want


def test_heads_by_graphemes():
    from scribeflow.functions import kernels

    assert kernels.head_graphemes("e\u0301" * 20, 15) == "e\u0301" * 15
    assert kernels.head_graphemes("abc", 15) == "abc" and kernels.head_graphemes("", 15) == ""
