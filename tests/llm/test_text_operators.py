"""SimHash, decontamination, line dedup, toxicity, language against brute force."""

import itertools
import random
import re
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from scribeflow.llm import decontam, langid, linededup, queries, simhash, toxicity
from scribeflow.llm.common import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= bits:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_groups(spark):
    rng = random.Random(1)
    base = " ".join(rng.choice("alpha beta Gamma delta É zeta eta theta".split()) + str(rng.randrange(900)) for _ in range(1200))
    texts = [None, "", " \n", "One", "one", "Two words", base, base.upper(), base + " tail", "x\x85y  z\x1cw a b", "long " * 300_000]
    for _ in range(25):
        w = base.split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "swap" + str(rng.random())
        texts.append(" ".join(w))
    rows = list(enumerate(texts)) + [(None, base), (4, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    got = simhash.fingerprint_table(df).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(fps, 2)
    low = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            low[r] = min(i, low.get(r, i))
    want = sorted((str(i), format(f, "016x"), low.get(r)) for (i, _), f, r in zip(rows, fps, root))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert len({r.component_id for r in got}) < len(texts) - 5


@pytest.mark.parametrize("cap", [1, 64])
@pytest.mark.parametrize("bits", [1, 2])
def test_no_link_is_lost(spark, cap, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 64, 40, np.uint64, endpoint=False)
    near = [b ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for b in base for _ in range(6)]
    fps = np.unique(np.concatenate([base, near, np.array([0, 1, 3, 7, 2**64 - 1], np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = connected_components(simhash.links(df, bits, cap))
    got = {r.node: r.component for r in found.collect()}
    own = fps.view(np.int64).tolist()
    root = brute_components([int(x) for x in fps], bits)
    for (a, ra), (b, rb) in itertools.combinations(zip(own, root), 2):
        assert (got.get(a, a) == got.get(b, b)) == (ra == rb)


def test_components_of_a_long_chain(spark):
    rng = random.Random(2)
    name = list(range(200))
    rng.shuffle(name)
    chain = spark.createDataFrame([(name[i], name[i + 1]) for i in range(150)] + [(5000, 5001), (5001, 5000), (1, 1)], "a long, b long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    low = min(name[:151])
    assert all(got[n] == low for n in name[:151])
    assert got[5000] == got[5001] == 5000
    empty = spark.createDataFrame([], "a long, b long")
    assert connected_components(empty).count() == 0


def brute_leaks(texts, items):
    def tokens(t):
        t = re.sub("([\u0e00-\u109f\u1780-\u17ff\u2e80-\u9fff\ua000-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff])", r" \1 ", t or "")
        return [x for x in ("".join(c for c in w if c.isalnum()).lower() for w in t.split()) if x]

    out = set()
    for d, text in texts:
        tt = tokens(text)
        for i, item in items:
            it = tokens(item)
            window, miss = (13, 2) if len(it) >= 13 else (len(it), 0)
            if not it or len(it) < 5 and it != tt:
                continue
            best = max(
                ((sum(it[a + k] == tt[b + k] for k in range(window)), -b) for a in range(len(it) - window + 1) for b in range(len(tt) - window + 1)),
                default=(0, 0),
            )
            if best[0] >= window - miss:
                out.add((d, i, best[0], window, -best[1]))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([9, 10, 12, 13, 14, 20, 36, 40])]
    items += [(8, None), (9, ""), (10, "w1"), (11, "w1 w2 w3 w4"), (12, " ".join(rng.choices(vocabulary, k=5))), (13, "北京是中国的首都"), (13, "次の文を読みなさい。"), (None, "w7 w8 w9 w7 w8 w9")]
    texts = [(0, None), (1, ""), (2, "w1 " * 3000), (60, "w1"), (61, "W1, w2 w3 w4!"), (62, "w1 w2 w3 w4 w5"), (63, "人人都说北京是中国的首都。"), (64, "次の文を 読みなさい"), (65, "x w7 w8 w9 w7 w8 w9 y"), (66, "北京是中国的东西")]
    for d in range(3, 60):
        words = rng.choices(vocabulary, k=rng.randrange(5, 60))
        item = rng.choice([x for _, x in items[:8]]).split()
        cut = rng.randrange(max(1, len(item) - 12))
        piece = item[cut:]
        for _ in range(rng.randrange(5)):
            piece[rng.randrange(len(piece))] = "zz"
        at = rng.randrange(len(words))
        texts.append((d, " ".join(words[:at] + [x.upper() + "," for x in piece] + words[at:])))
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "0 as item_id", "'a' as matched")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontam.find_leaks(docs, bench).collect()}
    want = brute_leaks(texts, items)
    assert got == want and len(want) > 15
    kept = {r.doc_id for r in decontam.drop_leaks(docs, bench).collect()}
    assert kept == {d for d, _ in texts} - {w[0] for w in want}
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_in_passages_that_repeat_themselves(spark):
    """Hits on periodic passages grow with the lengths, and the best windows stay those of brute force."""
    for period in ("la", "la lo", "a b c d e f g"):
        words = (period + " ").split() * (20_000 // len(period.split()))
        index = decontam.ItemIndex.of([1], pa.array([" ".join(words)]))
        counts, stream = decontam.tokens_of(pa.array([" ".join(words), " ".join(words[:50] + ["x"] + words)]))
        assert len(index.hits(counts, stream)) < 6 * 20_000 * 4
        assert dict(index.leaks(counts, stream)) == {(0, 1): (-13, 0, 13), (1, 1): (-13, 0, 13)}
    rng = random.Random(3)

    def made():
        words = " ".join(rng.choice("la lo x".split()) for _ in range(rng.randrange(1, 5))).split() * rng.randrange(1, 20)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice("pqr")
        return " ".join(words[: rng.randrange(1, 45)])

    items, texts = ([(k, made()) for k in range(40)] for _ in range(2))
    got = {tuple(r) for r in decontam.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(texts, items)
    assert got == want and len(want) > 20


def test_each_block_is_read_once_a_task(spark, monkeypatch):
    """Pieces of text are gathered while the blocks go by."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    monkeypatch.setattr(decontam, "ITEM_BLOCK_CHARS", 800)
    files = decontam.write_index(bench, decontam.scratch_path(spark, "items"))
    monkeypatch.setattr(decontam, "TEXT_BYTES", 20_000)
    reads = []
    monkeypatch.setattr(decontam, "block_of", lambda uri: reads.append(uri) or decontam.ItemIndex.from_bytes(decontam.read_whole(uri)))
    pieces = list(decontam.leaks_of(iter(docs.select("doc_id", "text").toArrow().to_batches()), "text", files))
    assert len(pieces) > 10 and len(files) > 2
    assert len(reads) == len(files) * len(pieces) and reads[: len(pieces)] == files[:1] * len(pieces)  # by block, from the worker's store


def test_masks_leave_no_gap():
    for bad in itertools.combinations(range(13), 2):
        assert any(all(o + k not in bad for k, c in enumerate(m) if c == "1") for m in decontam.MASKS for o in range(13 - len(m) + 1))


def test_leak_blocks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontam.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam, "ITEM_BLOCK_CHARS", 800)
    assert len(decontam.write_index(bench, decontam.scratch_path(spark, "items"))) > 3
    blocks = decontam.find_leaks(docs, bench)
    assert sorted(map(tuple, blocks.collect())) == whole and whole
    # One scan of the texts for all blocks.
    assert blocks._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1


LINE_ROWS = [
    (0, "A shared line here\nown zero\n\nshort\n  A SHARED LINE HERE \t"),
    (1, "short\na shared line here\r\nshort\nÉcole là-bas\x0b"),
    (2, None),
    (3, ""),
    (4, "École là-bas\nécole là-bas\nÉcole là-bas"),
    (5, "0123456789\n012345678"),
    (6, "012345678\n 0123456789 "),
    (7, "twice in one\ntwice in one"),
    (8, "x" * 300_000 + "\n0123456789"),
    (8, "the same id again\n0123456789"),
    (9, "the same id again"),
    (None, "a shared line here\n0123456789"),
]


@pytest.mark.parametrize("shard_keys", [1, 1 << 18])
def test_line_dedup_against_sql(spark, shard_keys):
    df = spark.createDataFrame(LINE_ROWS, "doc_id long, text string").selectExpr("*", "3 as n_lines", "'q' as h", "'z' as kept_text")
    kept = linededup.dedup_lines(df, shard_keys=shard_keys)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.sha) for r in kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("sha")).collect())
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", LINE_ROWS)
    want = sorted((str(a), b, c, d) for a, b, c, d in db.execute(linededup.LINE_SQL.replace("SELECT any_value(doc_id)", "SELECT max(doc_id)")).fetchall())
    assert got == want
    assert linededup.line_table(df.limit(0)).count() == 0


def test_each_shard_is_read_once_a_task(spark, monkeypatch, tmp_path):
    """With a key a shard and few lines a task, tasks read no shard twice."""
    rows = [(d, "\n".join(f"shared line number {(d * 7 + k) % 40}" for k in range(12))) for d in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = linededup.written(linededup.line_hashes(df, "doc_id", "text", 10), "hashes")
    folder = linededup.scratch_path(spark, "index")
    bits, shards = linededup.build_index(lines, folder, 1)
    assert bits >= 5 and shards.count() > 10
    monkeypatch.setattr(linededup, "PROBE_LINES", 100)
    made = linededup.probe(lines, folder, bits)
    plan = lines.withColumn("shard", linededup._shard(bits)).repartitionByRange(10, "shard", F.xxhash64("doc", "h"))
    per = plan.select(F.spark_partition_id().alias("p"), "shard").distinct().groupBy("shard").count()
    # Shards and tasks are both in order: together they meet in at most shards + tasks - 1 reads.
    assert per.agg(F.sum("count")).first()[0] <= per.count() + 10 - 1
    assert made.count() == sum(len(set(t.split("\n"))) for _, t in rows) - 40


def test_a_hot_line_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(linededup, "PROBE_LINES", 50)
    df = spark.createDataFrame([(d, f"the line that all have\nown line of {d} only") for d in range(600)], "doc_id long, text string")
    lines = linededup.line_hashes(df, "doc_id", "text", 10)
    asked = lines.withColumn("shard", linededup._shard(0)).repartitionByRange(24, "shard", F.xxhash64("doc", "h"))
    assert max(asked.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 150
    out = linededup.dedup_lines(df)
    assert {(r.doc_id, r.n_dropped) for r in out.collect()} == {(d, int(d > 0)) for d in range(600)}


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        mph, end = linededup.PerfectHash.from_bytes(data := linededup.PerfectHash.build(keys).to_bytes())
        assert end == len(data)
        assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    few = linededup.PerfectHash.build(keys)
    cut = linededup.PerfectHash(few.levels[:1], np.sort(keys[linededup.PerfectHash(few.levels[:1], keys[:0], 0).slots(keys) < 0]), len(keys))
    assert sorted(cut.slots(keys).tolist()) == list(range(len(keys)))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    out = toxicity.score_table(docs, labels)
    seen = out.join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert (seen.predicted == seen.toxic).mean() > 0.9
    assert out.where("score < 0 or score > 1 or score is null").count() == 0
    assert out.count() == docs.count()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "you idiot", 9.0), (3, "fine day " * 200_000, 9.0), (4, "you idiot", 9.0), (4, "you idiot", 9.0)], "doc_id long, text string, score double")
    none = toxicity.score_table(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {(r.score, r.predicted) for r in none.collect()} == {(0.0, 0)}
    rng = random.Random(6)
    texts = [" ".join(rng.choices("calm river stone garden window".split(), k=12)) + (" idiot" if i % 2 else "") for i in range(400)]
    model = toxicity.fit(texts, np.arange(400) % 2)
    out = toxicity.score(docs, model).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert len(out) == 6 and out[0].score > 0.5 and out[1].score < 0.5 and out[2].score < 0.5 and out[3].score < 0.5 and out[4].score == out[5].score > 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(texts, np.zeros(400)) is None


def brute_grams(text):
    """The buckets of a text, gram by gram."""
    low = " "
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            low += c
        elif low[-1] != " ":
            low += " "
    out = set()
    for n in (4, 5, 6):
        for i in range(len(low) - n + 1):
            h = n
            for c in map(ord, low[i : i + n]):
                h = (h * 0x01000193 + c) & 0xFFFFFFFF
            h ^= h >> 15
            out.add((h * 0x2C1B3C6D & 0xFFFFFFFF) >> 10)
    return out


def test_toxicity_against_brute_force(spark):
    """Grams, log-count ratios, the choice of features and the scores, by hand."""
    rng = random.Random(16)
    vocabulary = ["calm", "river", "été", "stone", "Garden", "fool", "idiot", "rot", "window,", "2nd", "«глупый»", "дом—сад", "日本語。日本語", "हिन्दी"]
    docs, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        docs.append((i, " ".join(rng.choices(vocabulary, [1] * 5 + [4 * toxic] * 3 + [1, 1, 4 * toxic, 1, 1, 1], k=rng.randrange(3, 15)))))
        labels.append((i, 1, int(toxic)))
    docs += [(300, None), (301, ""), (None, "idiot")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, told, features=40)
    own = {r.doc_id for r in df.where(~toxicity.held_out()).collect()}
    grams = {i: brute_grams(t) for i, t in docs}
    marks = {i: t for i, _, t in labels if i in own}
    positive, negative = sum(marks.values()), sum(1 - t for t in marks.values())
    count = {}
    for i, t in marks.items():
        for g in grams[i]:
            count.setdefault(g, [0, 0])[t] += 1
    far = {}
    for g, (clean, toxic) in count.items():
        if clean + toxic >= toxicity.MIN_DOCS:
            p = (clean + toxic) / (positive + negative)
            far[g] = abs(toxic / positive - clean / negative) / (p * (1 - p) * (1 / positive + 1 / negative) + 1e-12) ** 0.5
    best = sorted(sorted(far, key=lambda g: (-round(far[g], 9), g))[:40])
    assert model.buckets.tolist() == best
    want = [np.log((count[g][1] + 1) / (positive + 2) / ((count[g][0] + 1) / (negative + 2))) for g in best]
    assert np.allclose(model.ratios, want)
    weight = dict(zip(best, model.weights))
    for r in toxicity.score(df, model).collect():
        logit = sum(weight.get(g, 0) for g in grams[r.doc_id]) + model.intercept
        assert abs(r.score - 1 / (1 + np.exp(-logit))) < 1e-9
    same = toxicity.fit([t for i, t in docs if i in marks], np.array([marks[i] for i, _ in docs if i in marks]), 40)
    assert same.buckets.tolist() == best and np.allclose(same.weights, model.weights, rtol=1e-3, atol=1e-4)


def test_toxicity_sample_is_balanced(spark):
    """The rare class keeps its share of the characters; a text beyond the bound is passed over."""
    docs = spark.createDataFrame([(i, f"text {i} " + "x" * 90) for i in range(2000)] + [(i, "y" * 100_000) for i in range(2000, 2100)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 as quality", "cast(doc_id % 10 = 0 as int) as toxic")
    sizes = {r.toxic: r["count"] for r in toxicity.labelled_sample(docs, labels, 1000, 20_000).groupBy("toxic").count().collect()}
    assert 80 <= sizes[1] <= 100 and 80 <= sizes[0] <= 100
    again = docs.unionByName(docs.where("doc_id < 50")).unionByName(docs.where("doc_id < 50"))
    assert {r.toxic: r["count"] for r in toxicity.labelled_sample(again, labels, 1000, 20_000).groupBy("toxic").count().collect()} == sizes


def brute_phrases(text, sample, segment):
    n = 0
    for lo in range(0, len(text), segment):
        part, i = text[lo : lo + segment], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in sample:
                j += 1
            i = max(j - 1, i + 1)
            n += 1
    return n


@pytest.mark.parametrize("dense", [1, 3, 40])
def test_phrases_against_brute_force(dense):
    rng = random.Random(7)
    samples = (("a", "".join(rng.choices("abc d", k=300))), ("b", "".join(rng.choices("bcde ", k=250))))
    parser = langid.Parser([langid.pack(t, dense) for _, t in samples])
    texts = ["", "a", "z", "zz", "abz"] + ["".join(rng.choices("abcdez ", k=rng.randrange(1, 2600))) for _ in range(40)]
    got = parser.phrases(texts)
    for t, row in zip(texts, got.tolist()):
        assert row == [brute_phrases(t, s, langid.SEGMENT) for _, s in samples]


def write_languages(folder, samples):
    files = []
    for name, text in samples:
        (folder / name).write_bytes(langid.pack(text))
        files.append(f"file://{folder}/{name}")
    return langid.Languages(tuple(n for n, _ in samples), tuple(files))


def test_letters_and_marks():
    assert [langid.folded(t) for t in ("²½", "Ⅷ ①", "12 !", "\u0301\u0308", "a²b", "Cafe\u0301 x", "नमस्ते!", "_ß_")] == ["", "", "", "", "a b", "cafe\u0301 x", "नमस्ते", "ß"]


def test_many_languages_in_rounds(tmp_path, monkeypatch):
    """Rounds give what all languages at once give, and a worker holds one round."""
    rng = random.Random(8)
    samples = tuple((f"l{k:02}", "".join(rng.choices("abcdefgh ", [1 + (i * k) % 7 for i in range(9)], k=2000))) for k in range(40))
    own = write_languages(tmp_path, samples)
    texts = [s[500:900] for _, s in samples] + ["²", None]
    monkeypatch.setattr(langid, "ROUND", 40)
    whole = own.predict(texts)
    assert whole[0] == [n for n, _ in samples] + ["und"] * 2
    monkeypatch.setattr(langid, "ROUND", 7)
    rounds = own.predict(texts)
    assert rounds[0] == whole[0] and np.allclose(rounds[1], whole[1]) and langid.parser.cache_info().currsize == 1


def test_languages_of_many_signs_take_little_memory(tmp_path):
    rng = random.Random(15)
    signs = [chr(0x4E00 + i) for i in range(3000)]
    weights = [1 / (i + 5) for i in range(3000)]
    samples = tuple((name, "".join(rng.choices(signs[k::2], weights[k::2], k=40_000))) for k, name in enumerate(("x", "y")))
    parser = langid.Parser([langid.pack(t) for _, t in samples])
    assert parser.flat.nbytes + parser.keys.nbytes + parser.targets.nbytes < 40 << 20
    texts = ["".join(rng.choices(signs[k::2], weights[k::2], k=900)) for k in (0, 1, 0, 1)] + [samples[0][1][1000:1900]]
    assert parser.phrases(texts).tolist() == [[brute_phrases(t, s, langid.SEGMENT) for _, s in samples] for t in texts]
    own = write_languages(tmp_path, samples)
    assert own.predict(texts)[0] == ["x", "y", "x", "y", "x"]
    named, score = own.predict(["".join(rng.choices(signs[1::2], weights[1::2], k=400_000))])
    assert named == ["y"] and 0 < score[0] <= 1


def test_language_held_out(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    out = langid.language_table(docs).join(docs.select("doc_id", "lang"), "doc_id")
    seen = out.where("held_out").toPandas()
    assert (seen.lang_pred == seen.lang).mean() > 0.95
    odd = spark.createDataFrame([(1, None, "en", 1), (2, "123 !!", "en", 1), (None, "the house", None, 1), (3, "漢字", "en", 1), (4, "²½", "en", 1), (5, "Ⅷ ①", "en", 1)], "doc_id long, text string, lang string, score int")
    learned = langid.learn(docs, langid.scratch_path(spark, "automata"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, learned).collect()}
    assert got[1] == got[2] == got[4] == got[5] == ("und", 0.0) and got[3][0] in learned.names and len(got) == 6
    assert langid.language_table(odd.where("doc_id is null")).collect()[0].lang_pred == "und"
    assert langid.language_table(odd.limit(0)).count() == 0


def brute_groups(rows, width=5, threshold=0.8):
    def grams(text):
        w = WORDS.findall((text or "").lower())
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or len(a & b) >= threshold * len(a | b):
            x, y = label[i], label[j]
            label = [min(x, y) if k in (x, y) else k for k in label]
    return label


@pytest.mark.parametrize("cap", [4, 64])
def test_similar_groups(spark, cap):
    rng = random.Random(9)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n)]
    texts = [None, "", "a b", "A B", "one two three four"]
    for _ in range(6):
        base = words(rng.randrange(150, 400))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(len(w))] = "swap"
            texts.append(" ".join(w))
    texts += [" ".join(words(120)) for _ in range(20)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows + [(None, texts[5])], "doc_id long, text string").selectExpr("*", "1 as node", "2 as component_id", "3 as fp")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, cap=cap).collect()}
    assert got == dict(enumerate(brute_groups(rows)))
    kept = simhash.keep_one(df).collect()
    assert {r.doc_id for r in kept} == set(got.values()) | {None}
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_near_copies_in_large_buckets(spark, monkeypatch):
    """Texts of one template fill buckets; each of the many groups among them is found."""
    monkeypatch.setattr(simhash, "EXACT_BLOCK", 64)
    rng = random.Random(3)
    template = [f"t{i}" for i in range(200)]
    texts, want = [], []
    for i in range(700):
        own = template + [f"{i}-{rng.randrange(10**9)}" for _ in range(90)]
        want.append(len(texts))
        texts.append(" ".join(own))
        if i % 10 == 0:
            for at in rng.sample(range(290), 4):
                own[at] = f"x{rng.randrange(10**9)}"
            want.append(want[-1])
            texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, cap=4).collect()}
    # Copies at a similarity of 0.87 or more, other texts at about 0.5.
    assert sum(got[i] != k for i, k in enumerate(want)) == 0


def test_groups_in_one_hot_bucket(spark, monkeypatch):
    """Five sixths of all texts are one template: nearly all keys are, and groups are told apart exactly."""
    monkeypatch.setattr(simhash, "EXACT_BLOCK", 32)
    rng = random.Random(8)
    template, texts = [f"t{i}" for i in range(240)], []
    for g in range(60):
        base = template + [f"{g}-{rng.randrange(10**9)}" for _ in range(90)]
        for k in range(1 + g % 4):
            own = list(base)
            for at in rng.sample(range(330), 3 * k):
                own[at] = f"y{rng.randrange(10**9)}"
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df, cap=8).collect()} == dict(enumerate(brute_groups(rows)))


def test_recall_at_the_threshold(spark):
    """1,000 pairs at a similarity of 0.80 to 0.85: measured, not computed."""
    rng = random.Random(12)
    texts = []
    for i in range(1000):
        n = rng.randrange(120, 500)
        base = [f"{i}-{rng.randrange(10**9)}" for _ in range(n)]
        own = list(base)
        # Cutting words off the end takes one shingle each.
        keep = 0.80 + 0.05 * rng.random()
        own = own[: int(np.ceil(keep * (n - 4))) + 4]
        texts += [" ".join(base), " ".join(own)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    found = sum(got[2 * i + 1] == 2 * i for i in range(1000))
    assert found >= 970, found
    assert all(got[2 * i] == 2 * i for i in range(1000))


def test_recall_on_given_documents(spark):
    """Every fiftieth text against all others: all links by brute force are found."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {i: set(simhash.keyed_set(t, 5)[1].tolist()) for i, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    links = missed = 0
    for i in sets:
        for j in sets if i % 50 == 0 else ():
            if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links += 1
                missed += got[i] != got[j]
    assert links and missed <= 0.02 * links


def test_near_in_runs_counts_the_sign_bit():
    bits = np.array([0, 1 << 63], np.uint64).view(np.int64)
    left, right = simhash.near_in_runs(np.zeros(2, np.int64), np.arange(2), bits, np.arange(2))
    assert (left.tolist(), right.tolist()) == ([0], [1])


def test_near_copies_with_repeats(spark):
    """A sentence repeated more often leaves the shingle set, and so the similarity, as it is."""
    rng = random.Random(4)
    texts, want = [], []
    for i in range(40):
        own = " ".join(f"{i}-{rng.randrange(10**9)}" for _ in range(300))
        line = " ".join(f"{i}-{rng.randrange(10**9)}" for _ in range(10))
        want += [2 * i, 2 * i]
        texts += [own + f" {line}" * 2, own + f" {line}" * 10]
    fp = simhash.wide_block(texts, 5)[1]
    assert (fp[::2] == fp[1::2]).all()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == dict(enumerate(want))


def test_leaks_against_sql(spark):
    """The query's SQL on planted passages with and without substitutions."""
    rng = random.Random(17)
    vocabulary = ["w%d" % i for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([6, 9, 12, 13, 14, 25, 40])]
    texts = [(0, ""), (1, items[0][1])]
    for d in range(2, 60):
        piece = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            piece[rng.randrange(len(piece))] = "zz"
        around = rng.choices(vocabulary, k=rng.randrange(30))
        texts.append((d, " ".join(around + [x.upper() + ",!"[rng.randrange(2)] for x in piece] + around)))
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", texts)
    db.execute("create table benchmark (item_id bigint, text varchar)")
    db.executemany("insert into benchmark values (?, ?)", items)
    got = decontam.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {tuple(r) for r in db.execute(decontam.LEAK_SQL).fetchall()}
    assert {tuple(r) for r in got.select("doc_id", "item_id", "matched", "window", "position").collect()} == want == brute_leaks(texts, items) and len(want) > 20
