"""Ranked search against SQL, and secret scans against plain versions."""

import random
import re
import string
from hashlib import sha256
from math import inf

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scribeflow.llm import lexical, secrets

SF = "/root/testdata/sf0.001"


def by_sql(documents, benchmark):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.execute("create table benchmark(item_id bigint, text varchar)")
    for name, rows in (("documents", documents), ("benchmark", benchmark)):
        if rows:
            con.executemany(f"insert into {name} values (?, ?)", rows)
    return sorted(con.execute(f"select item_id, rank, doc_id, score from ({lexical.LEXICAL_SQL})").fetchall())


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZz09 .@[`{é\x7f\x00ß中", max_size=12)), max_size=6))
def test_terms(texts):
    counts, found = lexical.terms_of(pa.array(["drop", *texts], pa.string())[1:])
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    want = [re.findall(lexical.TERM, (t or "").translate(low)) for t in texts]
    assert counts.tolist() == [len(x) for x in want] and found.to_pylist() == sum(want, [])


@pytest.mark.parametrize("shard_bytes, query_block", [(600, 3), (16 << 20, 4096)])
def test_search_against_sql(spark, monkeypatch, shard_bytes, query_block):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", query_block)
    rng = random.Random(shard_bytes)
    words = [f"w{k}" for k in range(40)] + ["É", "x9"]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(42)], k=rng.randrange(1, 40)))) for i in range(250)]
    docs += [(900 + i, "w0 W1 tie") for i in range(60)] + [(7, "w0 W1 tie")] * 3  # ties beyond the 20th place
    docs += [(1000, None), (1001, ""), (1002, "... ,"), (1003, "w3 " * 30_000), (1004, "rare w0")]
    items = [(1, "w0 w1 tie"), (2, "W5 w5 É"), (3, "rare"), (4, "unknown"), (5, None), (6, ""), (7, "w0 " * 50 + "w39")]
    frame = spark.createDataFrame([(*d, "a", 5) for d in docs], "doc_id long, text string, term string, df int").repartition(3)
    asked = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, rank int")
    got = sorted(tuple(r) for r in lexical.search_table(frame, asked).collect())
    assert got == by_sql(docs, items)
    assert sum(r[0] == 1 for r in got) == 20 and sum(r[0] == 3 for r in got) == 1


def test_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a"), (3, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b"), (None, "b"), (2, "a")], "item_id long, text string")
    got = lexical.search_table(docs, items).collect()
    ranked = sorted(got, key=lambda r: r["rank"])
    assert [r.doc_id for r in ranked if r.item_id == 2] == [3, None, None]
    assert [r["rank"] for r in ranked if r.item_id is None] == [1, 1, 2, 3]
    assert lexical.search_table(docs.where("false"), items).count() == 0
    assert lexical.search_table(docs, items.where("false")).count() == 0


def test_search_stops_early():
    """Lists are read only as far as the threshold asks for."""
    texts = ["hit " * 50] * 30 + ["hit " + "x " * (50 + k) for k in range(5000)]
    shard = lexical.Shard.from_bytes(lexical.Shard.build(pa.array(range(len(texts))), pa.array(texts), len(texts), 500_000).to_bytes())
    query = lexical.Queries.of(pa.table({"query": [0], "term": ["hit"], "weight": [5]}))
    best, looked = [lexical.Best(20)], []
    add = best[0].add
    best[0].add = lambda scores, ids, known: (looked.append(len(ids)), add(scores, ids, known))
    lexical.search_shard(shard, query, best)
    assert best[0].ids.tolist() == list(range(20)) and sum(looked) <= 112


def test_lengths_beyond_64_bits():
    n, total = 10**12, 10**15
    lengths = np.array([1, 10**7], np.int64)
    assert lexical.length_parts(lengths, n, total).tolist() == [75 + 25 * int(x) * n // total for x in lengths]


# --- secrets -----------------------------------------------------------------

RANKS = {w: k for k, w in enumerate("the and password secret dragon correct horse battery change".split(), 1)}
HEADS = {w[:3] for w in RANKS}


def plain_base(text):
    out = []
    for k, (pattern, group, least) in enumerate(((r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16))):
        for m in re.finditer(pattern, text, (re.I | re.A) if k == 0 else 0):
            if len(m[group]) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def slow_bits(value):
    """All divisions by recursion over the same parts, without the two running minima."""
    n = len(value)
    low, plain = value.lower(), value.lower().translate(secrets._LOOK_ALIKE)
    brute = lambda i, j: sum(map(secrets.char_bits, value[i:j]))
    runs, repeats = list(secrets._runs(value, low)), list(secrets._repeats(value))

    def word(i, j):
        return min([secrets.word_bits(value[i:j], RANKS[t[i:j]], t[i:j]) for t in (low, plain) if t[i:j] in RANKS], default=inf)

    def dated(i, j):
        cost = [365 for d in secrets._DATES if (m := d.match(value, i)) and m.end() == j and int(m["y"])]
        if cost:
            year = min(max(20, abs(int(d.match(value, i)["y"]) - 2000)) for d in secrets._DATES if (m := d.match(value, i)) and m.end() == j)
            return np.log2(365) + np.log2(year) + (2 if j - i > 8 else 0)
        return np.log2(max(20, abs(int(value[i:j]) - 2000))) if j - i == 4 and secrets._YEAR.fullmatch(value[i:j]) else inf

    def simple(i, j):
        return min([word(i, j), dated(i, j), *(b for s, e, b in runs if (s, e) == (i, j))])

    def part(i, j):
        again = [min(brute(i, i + u), simple(i, i + u)) + np.log2(t) for s, e, u, t in repeats if (s, e) == (i, j)]
        return min([brute(i, j), simple(i, j), *again])

    least = [0.0]
    for j in range(1, n + 1):
        least.append(min(least[i] + (secrets.JOIN_BITS if i else 0) + part(i, j) for i in range(j)))
    return least[n]


PIECES = st.sampled_from(["password", "P4ssword", "dr4gon", "qwerty", "asdfgh", "2024-05-17", "17.05.1999", "1984", "aaaa", "abab", "xyz", "789", "K", "é", "ß", "İ", "#", "t9", "zQ!", "@"])


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=6))
def test_guess_bits_are_the_least(pieces):
    value = "".join(pieces)
    if len(value.lower()) == len(value):
        assert secrets.guess_bits(value, RANKS) == pytest.approx(slow_bits(value), abs=1e-6)
    assert secrets.guess_bits(value, RANKS) <= sum(map(secrets.char_bits, value)) + 1e-6


TEXT = st.lists(st.sampled_from(["token", "TOKEN", "api_key", "apikey", "toKen", "paſſword", "password", '"', "'", " ", "=", ":", "0123456789abcdef", "deadbeef", "AKIA", "ABCDEFGHIJKLMN", "Zz9+/_.-", "é中", "\n", "pwd: t9#Vx!2qLm4w", "secret is password1"]), max_size=14)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_base_spans(parts):
    text = "".join(parts)
    assert [x[:3] for x in secrets.base_spans(text)] == plain_base(text)
    asked = secrets._asked(pa.array([text]))
    spans = secrets.spans_of(text, RANKS, HEADS)
    assert asked == [0] or not spans
    assert [x[:3] for x in spans if x[1] < 3] == plain_base(text)
    for s, k, e, _ in spans:
        assert k < 3 or not any(a < e and s < b for a, _, b in plain_base(text))


def test_costly_values_only():
    def kinds(text):
        return [(text[s:e], secrets.KINDS[k]) for s, k, e, _ in secrets.spans_of(text, RANKS, HEADS)]

    assert kinds("pwd: t9#Vx!2qLm4w, and") == [("t9#Vx!2qLm4w", "guess")]
    assert kinds("Authorization: Bearer zK8-vv2Q_mPq7x.") == [("zK8-vv2Q_mPq7x", "guess")]
    for easy in ("password2024", "changedragon", "qwertyuiop", "zzzzzzzzzzzzzzzzzzzzzzz", "correcthorsebattery", "12345678901234", "1999-12-31"):
        assert kinds(f"pwd: {easy}") == []
    assert secrets.guess_bits("aB3$x9" * 30_000, RANKS) < 60


def test_secret_table(spark):
    texts = [None, "", "none", 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"', "中é AKIAABCDEFGHIJKLMN pwd: t9#Vx!2qLm4w", "x " * 200_000 + "secret=abcdefghijkl", "token=secret=abcdefghijklmnop"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, spans string, bits int").repartition(3)
    got = secrets.secret_table(df).collect()
    want = []
    for i, t in rows:
        base = plain_base(t or "")
        names = ["assign", "access", "hex"]
        listed = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in base)
        want.append((i, *(sum(k == n for _, k, _ in base) for n in range(3)), sha256(listed.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    assert {r.spans for r in got if r.doc_id is None} == {"access:3:21,guess:27:39"}
    folder = secrets.scratch_path(spark, "words")
    ranks = secrets.write_ranks(df, folder)
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(df, ranks).collect()}
    assert masked[4] == masked[None] == "中é [secret] pwd: [secret]" and masked[3] == "[secret]\"" and masked[0] is None and masked[2] == "none"
    assert secrets.secret_table(df.where("false")).count() == 0


def test_word_counts(spark):
    df = spark.createDataFrame([("The the, the! a1b no straße (x) ok",), ("the\nno",), (None,)], "text string")
    assert [(r.word, r["count"]) for r in secrets.count_words(df).collect()] == [("the", 4), ("straße", 1)]
    assert [r.word for r in secrets.count_words(df, limit=1).collect()] == ["the"]
