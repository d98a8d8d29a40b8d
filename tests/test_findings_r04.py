"""Tests of what the fourth round's findings named."""

from __future__ import annotations

import random

import numpy as np
import pytest

from scribeflow.functions import kernels
from scribeflow.operators import similar
from test_findings_r03 import both, held


def test_tasks_of_pairs_get_packed_sets_and_no_texts(spark):
    """What goes to each two parts of a block is a row a part, not its texts."""
    df = spark.createDataFrame([(1, "x" * 50), (2, "x" * 40 + "y")], "doc_id long, text string")
    plan = similar.jaccard_pairs(df, copies=False)._jdf.queryExecution().optimizedPlan().toString()
    (dealt,) = [line for line in plan.splitlines() if "Project" in line and " AS i#" in line]
    assert "sets#" in dealt and "text#" not in dealt


def test_packed_sets_are_the_sets():
    rng = np.random.default_rng(4)
    for _ in range(50):
        top = int(rng.choice([5, 300, 1 << 62]))
        sets = [np.unique(rng.integers(0, top, rng.integers(0, 40))).astype(np.uint64) for _ in range(rng.integers(1, 30))]
        got = kernels.unpacked_sets(kernels.packed_sets(kernels.joined_sets(sets, some=17)))
        assert [got.members[got.column[s:e]].tolist() for s, e in zip(got.ends, got.ends[1:])] == [s.tolist() for s in sets]


def test_pairs_of_two_parts_are_all_pairs_in_the_order_of_their_keys():
    rng = np.random.default_rng(6)
    for top in (20, 200, 5000):
        sets = [np.unique(rng.integers(0, top, rng.integers(0, 60))).astype(np.uint64) for _ in range(60)]
        rank = rng.permutation(60)
        like = {(i, j): len(np.intersect1d(sets[i], sets[j])) / max(1, len(np.union1d(sets[i], sets[j]))) for i in range(25) for j in range(25, 60)}
        want = sorted((i, j, s) if rank[i] < rank[j] else (j, i, s) for (i, j), s in like.items())
        got = kernels.similar_sets(kernels.joined_sets(sets[:25]), kernels.joined_sets(sets[25:]), rank, slab=9, columns=7)
        assert sorted(row for a, b, s in got for row in zip(a.tolist(), b.tolist(), s.tolist())) == want


def test_halves_are_rounded_as_by_the_sql(spark, tmp_path):
    """41 of 640: 0.0640625, which by DuckDB's scaling lies below the half."""
    head = "".join(map(chr, range(0x4E00, 0x4E00 + 43)))
    tails = ["".join(map(chr, range(0x5000, 0x5000 + 300))), "".join(map(chr, range(0x6000, 0x6000 + 299)))]
    held(spark, tmp_path, "documents", [(i, head + t) for i, t in enumerate(tails)], "doc_id long, text string")
    got, want = both(spark, tmp_path, "ngram_jaccard_pairs")
    assert got == want and len(got) == 1


def test_near_pairs_are_those_of_the_rounded_similarity(spark, tmp_path):
    """240,001 of 400,002 common grams: below 0.6, and 0.6 when rounded."""
    text = "".join(map(chr, np.random.default_rng(8).integers(0x4E00, 0x9FA0, 400_004)))
    assert len(kernels.gram_codes(text, 3)) == 400_002
    held(spark, tmp_path, "documents", [(1, text), (2, text[:240_003])], "doc_id long, text string")
    got, want = both(spark, tmp_path, "ngram_jaccard_near")
    assert got == want and len(got) == 1


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_slabs_left_out_by_size_lose_no_pair(least):
    rng = random.Random(9)
    sets = [np.array(sorted(rng.sample(range(rng.choice([40, 90])), rng.randrange(1, 40))), np.uint64) for _ in range(90)]
    like = {(i, j): len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i in range(90) for j in range(i + 1, 90)}
    for slab in (1, 4, 100):
        got = kernels.similar_sets(kernels.joined_sets(sets), None, np.arange(90), least, slab=slab)
        assert sorted(row for a, b, s in got for row in zip(a.tolist(), b.tolist(), s.tolist())) == sorted((i, j, s) for (i, j), s in like.items() if s >= least)
