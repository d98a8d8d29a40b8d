"""The Merkle manifest against a plain tree, and the laws of its monoid."""

import random
import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scribeflow.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute(rows):
    """Digests of (doc_id, source, lang, n_chars, text) rows by whole levels."""

    def leaf(r, more=0):
        r = [r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4]]
        return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))

    def tree(level):
        levels = [level]
        while len(level) > 1:
            level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
            levels.append(level)
        return levels

    def climb(levels, i, value):
        beside = []
        for level in levels[:-1]:
            run = list(range(i & ~1, min((i & ~1) + 2, len(level))))
            beside += [level[k] for k in run if k != i]
            value = h(*(value if k == i else level[k] for k in run))
            i >>= 1
        return value, beside

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    upper = tree([t[-1][0] for t in trees])
    out = []
    for k, (g, t) in enumerate(zip(groups, trees)):
        for i, r in enumerate(g):
            wrong = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            value, low = climb(t, i, leaf(r, 1) if wrong else leaf(r))
            value, high = climb(upper, k, value)
            out.append((r[0], leaf(r), t[-1][0], upper[-1][0], h(*low, *high), value, value == upper[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, part int, `group` int, leaf string, digest string"
ORDER = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("part_rows, fan_in", [(12, 3), (10_000, 64)])
def test_manifest_against_plain_tree(spark, monkeypatch, part_rows, fan_in):
    monkeypatch.setattr(merkle, "PART_ROWS", part_rows)
    monkeypatch.setattr(merkle, "FAN_IN", fan_in)
    rng = random.Random(part_rows)
    langs = ["en"] * 60 + ["de"] * 9 + [None] * 5 + ["", "é", "z", "lone"] + [f"l{k}" for k in range(11)]
    rows = [(i - 3, rng.choice(["web", None]), g, rng.choice([None, 5, 2**62]), rng.choice(["", None, "é" * 9, "x" * 70_000])) for i, g in enumerate(langs)]
    rows += [(None, None, None, None, None)] * 9 + [(4, "web", "en", 3, "same")] * 7 + [(4, "web", "en", 3, "other"), (4, "web", "fr", 3, "other")]
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in merkle.manifest_table(df).collect()), key=ORDER)
    assert got == sorted(brute(rows), key=ORDER)
    assert {r[6] for r in got} == {True, False}


def test_lone_rows_and_empty_table(spark):
    df = spark.createDataFrame([(7, "a", "en", 1, "t", 0, 0, "", "")], SCHEMA)
    (row,) = merkle.manifest_table(df).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h()
    assert merkle.manifest_table(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=6), st.integers(2, 9), st.randoms(use_true_random=False))
def test_forests_are_a_commutative_monoid(sizes, cuts, rng):
    leaves = {(t, 0, i): (n, h(f"{t} {i}")) for t, n in enumerate(sizes) for i in range(n)}
    keys = list(leaves)
    rng.shuffle(keys)
    trees = len(sizes)
    forests = [{k: leaves[k] for k in keys[i::cuts]} for i in range(cuts)]
    forests = [merkle.settle(dict(f), trees, list(f), {}) for f in forests]
    whole = merkle.settle(dict(leaves), trees, list(leaves), {})
    assert len(whole) == 1 and next(iter(whole.values()))[0] == 1
    left = {}
    for f in forests:
        left = merkle.combine(left, f, trees)
    right = {}
    for f in reversed(forests):
        right = merkle.combine(f, right, trees)
    while len(forests) > 1:
        rng.shuffle(forests)
        forests = [merkle.combine(*forests[:2], trees), *forests[2:]]
    assert left == right == forests[0] == whole
    assert merkle.combine(whole, {}, trees) == merkle.combine({}, whole, trees) == whole
