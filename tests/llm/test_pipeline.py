"""The pipeline's stages against brute force, on planted cases."""

import random

import pytest

import corpus_pipeline
from scribeflow.llm import decontam, queries
from scribeflow.llm.bpe import codec
from scribeflow.llm.queries import word_vocabulary

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    bench = queries.table(spark, SF, "benchmark")
    rng = random.Random(1)
    clean = [" ".join(rng.choice("lorem ipsum dolor sit amet".split()) + str(rng.randrange(9999)) for _ in range(200)) for _ in range(4)]
    item = max((r.text for r in bench.collect()), key=len)
    line = "this very line is in several of the documents"
    planted = [
        (900_000, clean[0]),
        (900_001, clean[0].replace(clean[0].split()[50], "other")),
        (900_002, clean[1] + "\n" + line),
        (900_003, clean[2] + "\n" + line),
        (900_004, clean[3] + " " + item + " " + clean[3][:300]),
        (900_005, None),
    ]
    extra = spark.createDataFrame([(i, t, "en", "made", len(t or "")) for i, t in planted], docs.schema)
    all_docs = docs.unionByName(extra)
    out, rows = {}, all_docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF)
        rows.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = {r[0]: r for r in rows.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == docs.columns
    for i, _ in planted:
        assert i in out["toxicity"]
    assert out["line_dedup"].keys() == out["toxicity"].keys()
    assert line in out["line_dedup"][900_002].text and line not in out["line_dedup"][900_003].text
    assert out["line_dedup"][900_003].n_chars == len(out["line_dedup"][900_003].text)
    assert 900_000 in out["near_copies"] and 900_001 not in out["near_copies"]
    assert 900_004 in out["near_copies"] and 900_004 not in out["decontamination"]
    left = spark.read.parquet(f"{tmp_path}/near_copies")
    leaked = {r.doc_id for r in decontam.find_leaks(left, bench).collect()}
    assert out["decontamination"].keys() == out["near_copies"].keys() - leaked
    ids = {i: r for i, r in out["bpe"].items()}
    assert ids.keys() == out["decontamination"].keys()
    assert ids[900_002].ids == codec(word_vocabulary()).encode_batch([out["decontamination"][900_002].text])[0]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 50
    assert rows.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def brute_leaked(texts, items):
    """Documents with an aligned window of 13 tokens of an item, 2 apart at most; short items whole."""
    import numpy as np

    def tokens(t):
        return np.array([x for x in ("".join(c for c in w if c.isalnum()).lower() for w in (t or "").split()) if x])

    own = [tokens(t) for t in items]
    gone = set()
    for d, text in texts.items():
        tt = tokens(text)
        for it in own:
            n = min(13, len(it))
            if not n or len(tt) < n or n < 5 and len(tt) != n:
                continue
            same = it[:, None] == tt[None, :]
            total = sum(same[k : len(it) - n + 1 + k, k : len(tt) - n + 1 + k].astype(int) for k in range(n))
            if total.max() >= (11 if n == 13 else n):
                gone.add(d)
                break
    return gone


def test_run_against_brute_force(spark, tmp_path):
    """Every stage of the pipeline by a plain version, on all rows of a small corpus."""
    import hashlib

    import duckdb
    import tokenizers
    from test_text_operators import brute_groups

    from scribeflow.llm import linededup, toxicity

    docs = queries.table(spark, SF, "documents")
    scored = toxicity.score_table(docs, queries.table(spark, SF, "labels")).collect()
    kept = {r.doc_id for r in scored if r.predicted == 0}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", list(rows.items()))
    sql = linededup.LINE_SQL.replace("sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256", "coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept")
    rows = {r[0]: r[3] for r in db.execute(sql).fetchall()}
    ids = sorted(rows)
    label = brute_groups([(i, rows[i]) for i in ids])
    rows = {i: rows[i] for k, i in enumerate(ids) if label[k] == k}
    gone = brute_leaked(rows, [r.text for r in queries.table(spark, SF, "benchmark").collect()])
    library = tokenizers.Tokenizer.from_file(word_vocabulary())
    want = {}
    for i in rows.keys() - gone:
        own = library.encode(rows[i], add_special_tokens=False).ids
        want[i] = (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and gone and len(ids) < docs.count() and len(rows) < len(ids)


def test_stages_on_odd_tables(spark, tmp_path):
    """An empty table, repeated and null ids, null and empty texts, and columns with clashing names."""
    docs = queries.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    text = "a line that is long enough to count\n" + " ".join(f"w{i}" for i in range(60))
    odd = [(1, text), (1, text), (1, text + " more"), (2, text), (None, text), (None, text), (3, None), (4, ""), (5, "words " * 3)]
    rows = spark.createDataFrame([(i, t, "en", "made", 0) for i, t in odd], docs.schema).selectExpr("*", "1 as node", "'x' as kept_text", "2 as bucket", "3 as draw", "4 as marks", "5 as h")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
    left = sorted((str(r.doc_id), r.text) for r in rows.collect())
    # Rows of one id go or stay together; rows without one lose nothing; 2 has lost all its lines, as 3 and 4 have none.
    assert [i for i, _ in left] == ["1", "1", "1", "2", "5", "None", "None"] and left[3][1] == ""
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == 7
