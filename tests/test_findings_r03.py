"""Queries against their SQL to the bit, on tables made for the cases of the round."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from scribeflow import config
from scribeflow.functions import arrow, kernels
from scribeflow.functions import text as T
from scribeflow.llm import simhash
from scribeflow.operators import similar
from scribeflow.plans import postprocess
from scribeflow.plans.catalogue import ORACLE_SQL, QUERIES
from scribeflow.streaming import late
from scribeflow.streaming.chunks import rocksdb_state, unordered_chunks


def held(spark, folder, name, rows, schema):
    """A table in a folder of its own, one file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def both(spark, folder, name):
    """Sorted rows of the query and of its SQL; ``repr`` tells -0.0 from 0.0."""
    db = duckdb.connect()
    for path in folder.glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    plain = lambda v: [plain(x) for x in v] if isinstance(v, (list, tuple)) else v
    got = sorted(repr([plain(r[c]) for c in df.columns]) for r in df.collect())
    cur = db.execute(ORACLE_SQL[name])
    at = [[c[0] for c in cur.description].index(c) for c in df.columns]
    return got, sorted(repr([plain(r[i]) for i in at]) for r in cur.fetchall())


@pytest.fixture
def samples(spark, tmp_path):
    """Samples that become zero from below, and halves of the sixth digit."""
    values = [-2e-7, 3e-7, -1e-5, 1e-5, 0.0, -0.0, 0.0078125, -0.0078125, 0.1234565, -0.2345675, -1.0, 1.0]
    rows = [(k, [values[(k + i) % len(values)] for i in range(64)], k % 2) for k in range(60)]
    held(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, label int")
    return tmp_path


@pytest.mark.parametrize("name", ["mono_mix", "resample_half", "resample_blocks", "wav_source"])
def test_signs_of_zero_and_halves(spark, samples, name):
    got, want = both(spark, samples, name)
    assert got == want and any("-0.0," in r for r in want)


def test_upper_case_of_single_letters(spark, tmp_path):
    held(spark, tmp_path, "benchmark", [(0, "erßt"), (1, "ŉaß"), (2, "ﬁx"), (3, "ᾳéı"), (4, ""), (5, None)], "item_id long, text string")
    got, want = both(spark, tmp_path, "merged_rules")
    assert got == want


def test_upper_case_of_all_letters(spark):
    points = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    db = duckdb.connect()
    want = {c: db.execute("select upper(?)", [c]).fetchone()[0] for c in points if len(c.upper()) > 1}
    got = spark.createDataFrame([(c,) for c in want], "c string").select("c", T.upper_by_points("c").alias("u"))
    assert {r.c: r.u for r in got.collect()} == want


def test_context_is_as_its_sql(spark, tmp_path):
    loop = "And so it goes on and on again. "
    text = ["One. " + 30 * loop, "Two words here. " + "A passage of some length that comes twice, word by word, and not once, so that it is a block of text in all respects. " * 2, "x", "y"]
    held(spark, tmp_path, "conversations", [(1, k, "user", t) for k, t in enumerate(text)], "conv_id long, turn long, role string, text string")
    got, want = both(spark, tmp_path, "previous_context")
    assert got == want


@pytest.mark.parametrize("least", [0.0, 0.5])
def test_pairs_in_parts_are_all_pairs(spark, monkeypatch, least):
    rng = random.Random(5)
    head = "one template that all of these texts have got, "
    rows = [(i, head + "".join(rng.choices("abcdeß ", k=rng.randrange(0, 50)))) for i in range(50)]
    rows += [(100 + 3 * i + k, rows[i][1]) for i in range(9) for k in range(i % 3)]
    rows += [(300 + i, "y" * 40 + "xz"[i % 2] * i) for i in range(4)] + [(400, None), (401, "short")]
    monkeypatch.setattr(similar, "PART_ROWS", 7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = {i: t for i, t in rows if t and len(t) >= 40}
    grams = {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, t in held.items()}
    low = {t: min(i for i in held if held[i] == t) for t in held.values()}
    like = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in held for b in held if a < b and held[a][:40] == held[b][:40]}
    want = sorted((a, b, round(s, 9)) for (a, b), s in like.items() if s >= least)
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in similar.jaccard_pairs(df, least=least).collect()) == want
    want = [(a, b, s) for a, b, s in want if low[held[a]] == a and (low[held[b]] == b or held[a] == held[b])]
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in similar.jaccard_pairs(df, least=least, copies=False).collect()) == want


def test_products_in_slabs_count_common_members():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(23)]
    at = np.arange(23)
    got = {(int(x), int(y)): s for a, b, c in kernels.set_similarities(sets, at, at, True, 0.2, slab=4, columns=7) for x, y, s in zip(a, b, c)}
    like = lambda x, y: len(set(x) & set(y)) / max(1, len(set(x) | set(y)))
    assert got == {(i, j): s for i in range(23) for j in range(i + 1, 23) if (s := like(sets[i], sets[j])) >= 0.2}


def test_common_runs_are_those_of_the_table():
    rng = random.Random(2)
    for _ in range(1500):
        letters = rng.choice(["ab", "abc", "abcdef", "aßé漢b"])
        a, b = ("".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(2))
        if a and rng.random() < 0.6:
            b = b[:5] + a[rng.randrange(len(a)) :][:30] + b[5:]
        least, start, end, window = rng.randrange(1, 12), rng.randrange(50), rng.randrange(50), rng.randrange(1, 60)
        want = kernels.longest_common_by_table(a, b, least, start, end) if a and b else None
        assert kernels.longest_common(a, b, least, start, end) == want
        assert kernels.exact_duplicate(a, b, least, window) == kernels.exact_duplicate_by_table(a, b, least, window)


def test_fuzzy_runs_are_those_of_all_characters():
    rng = random.Random(4)
    for _ in range(1500):
        a, b = ("".join(rng.choices("ぁァあアかカ", k=rng.randrange(1, 30))) for _ in range(2))
        x, y = (kernels._codes(t).astype(np.int64) for t in (a, b))
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        for near in (0, 3, 64):
            ahead = kernels.fuzzy_equal(x[i:][: len(b) - j], y[j:][: len(a) - i]).tolist() + [False]
            back = kernels.fuzzy_equal(x[: i + 1][::-1][: j + 1], y[: j + 1][::-1][: i + 1]).tolist() + [False]
            assert kernels.fuzzy_run(x, y, (a, b), i, j, 1, near) == ahead.index(False)
            assert kernels.fuzzy_run(x, y, (a, b), i, j, -1, near) == back.index(False)


def test_seams_cost_little():
    """Steps counted, not seconds: no array is made for a seed of a few characters, and no table for texts with few common pieces."""
    calls = []
    held = kernels.fuzzy_equal, kernels.longest_common_by_table, kernels.exact_duplicate_by_table
    try:
        for f in held:
            setattr(kernels, f.__name__, lambda *x, f=f: calls.append(f.__name__) or f(*x))
        rng = random.Random(1)
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
        a, b = (" ".join(rng.choices(words, k=100)) for _ in range(2))
        kernels.fuzzy_overlap(a, b), kernels.exact_duplicate(a, b), kernels.longest_common(a, b, 20, 250, 0)
    finally:
        for f in held:
            setattr(kernels, f.__name__, f)
    assert not calls


def test_grams_and_regions_by_plain_means():
    rng = random.Random(6)
    for k in range(300):
        text = "".join(rng.choices("abß漢😀"[: 2 + k % 4], k=rng.randrange(90)))
        assert kernels.gram_count(text, 5) == len({text[i : i + 5] for i in range(len(text) - 4)})
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 7000)))  # too many letters for 64 bits
    assert kernels.gram_count(many + many, 5) == 7000
    assert [r["position"] for r in kernels.start_regions("abcdefghij" + "." * 60 + "abcde" + "." * 200 + "abcde", 10, 5, 0.1, 10)] == [70, 275]


@pytest.mark.parametrize("name", ["tail_repeat", "ngram_set_size", "candidate_regions"])
def test_no_rows_or_copies_of_expressions_per_gram(spark, tmp_path, name):
    """One scan and no join or window; the text is split once."""
    held(spark, tmp_path, "documents", [(1, "a\nb\nb"), (2, "x" * 300), (3, ""), (4, None), (7, "q\n\n q \nq\n"), (9, "abcdefghijklmnopqrstuvwxyz" * 5)], "doc_id long, text string")
    got, want = both(spark, tmp_path, name)
    assert got == want
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("split(") <= 2 and "xxhash64(" not in plan


def test_near_copies_come_from_pivot_tables(spark, monkeypatch):
    """the pipeline's copies go through the pivot distance tables, and those decide no less than all pairs."""
    rng = random.Random(11)
    prose = [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(12)]
    texts = prose + [t + " end" for t in prose] + [prose[0].replace("w1", "x1")]
    asked = []
    tables = simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, *more: asked.append(1) or tables(distinct, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert asked and set(range(12)) <= kept and not kept & set(range(12, 24))

    key, fp, _ = simhash.wide_block(texts, 5)
    rows = [(int(k), x.tobytes()) for k, x in zip(key.view(np.int64), fp)] + [(n, bytes(32)) for n in range(70)]
    pairs = simhash.pivot_pairs(spark.createDataFrame(rows, "node long, fp binary")).collect()
    bits = {n: int.from_bytes(x[:8], "little") for n, x in rows}
    assert all((bits[p.a] ^ bits[p.b]).bit_count() == p.away <= 2 for p in pairs)
    group = {n: n for n in bits}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for p in pairs:
        group[root(p.a)] = root(p.b)
    assert all(root(a) == root(b) for a in bits for b in bits if (bits[a] ^ bits[b]).bit_count() <= 2)


def test_recurring_pieces_mark_what_a_comparison_marks():
    """the places where patterns are tried come from equal pieces, not from a comparison per shift."""
    rng = random.Random(13)
    for _ in range(200):
        text = "".join(rng.choice("ab .") for _ in range(rng.randrange(200)))
        text += text[-rng.randrange(1, 40) :] * rng.randrange(4)
        codes = kernels._codes(text)
        found = kernels._recurring(codes, 5, 40)
        for least in ({u: 2 * u for u in range(5, 11)}, {u: max(5, u - 3) for u in range(5, 41)}):
            mask = np.zeros(len(codes), bool)
            for shift, n in least.items():
                kernels._echoes(codes, shift, n, mask)
            assert kernels._echo_mask(len(text), found, 5, least).tolist() == mask.tolist()


def test_few_rows_are_python_objects_at_once():
    """A batch is not turned into Python texts as a whole."""
    texts = pa.array([None, *["x" * 30_000] * 500])
    sizes = [len(values[0]) for values in arrow.few([texts])]
    assert sum(sizes) == 501 and max(sizes) * 30_000 <= 1.01 * arrow.BYTES
    assert [b.num_rows for b in arrow.pieces([pa.RecordBatch.from_arrays([texts], ["t"])])] == sizes
    assert arrow.mapped(lambda t: t and t[:2], [texts], pa.string()).to_pylist() == [None, *["xx"] * 500]
    assert arrow.mapped(len, [texts[:0]], pa.int64()).to_pylist() == []


def test_pieces_are_counted_in_place(spark, tmp_path):
    """no shuffle, and each row is told by its own text; a null has one piece."""
    held(spark, tmp_path, "documents", [(1, "a. " * 9000), (2, "b"), (3, None), (4, "word\n\n" * 5000)], "doc_id long, text string")
    got, want = both(spark, tmp_path, "translation_metadata")
    assert got == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plan = postprocess.translation_metadata(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_rows_of_a_folder_are_one_file(spark, tmp_path):
    """Each task wrote a file to each folder."""
    hours = spark.range(4000, numPartitions=4).selectExpr("id", "timestamp_seconds(1700000000 + id % 40 * 3600) as ts", "'x' as v")
    deal = late.LateRows(f"{tmp_path}/out", ["id"], "ts", 4 * 3600)
    deal.batch(hours, 0)
    files = [p for p in tmp_path.glob("out/**/*.parquet") if "marks" not in p.parts]
    assert len(files) == len({p.parent for p in files}) == 40
    assert deal.table(spark, "late", ["id"]) is None and deal.table(spark, "double", ["id"]) is None
    deal.batch(hours.selectExpr("id + 3880 as id", "ts", "v"), 1)
    assert {n: deal.table(spark, n, ["id"]).count() for n in late.TABLES} == {"kept": 4485, "double": 15, "late": 3500}


def test_waiting_frames_are_packed(spark, tmp_path):
    """Each frame was an element of the list, pickled by itself."""
    plan = config.ModelPlan("test", "whisper", 0.5, 0.1, 0.2, 0.06, 0.1, 1, 0, 0, 0.0)
    schema = "file_id string, frame long, t double, label int, last boolean, at timestamp"
    rows = spark.range(600).selectExpr("'f' || id % 3 as file_id", "id div 3 as frame", "id div 3 * 0.03D as t", "cast(id % 2 as int) as label", "false as last", "timestamp_millis(id * 10) as at")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    with rocksdb_state(spark):
        out = unordered_chunks(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), plan, "at", late="1 hour")
        out.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(path=f"{tmp_path}/out", format="parquet").awaitTermination()
        held = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/state")
        assert sorted(r.key.file_id for r in held.collect()) == ["f0", "f1", "f2"]
