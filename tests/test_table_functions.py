"""Table functions called by SQL, with nulls, ties and one key that has nearly all rows."""

import datetime
import random

from scribeflow.functions import table_functions

ZERO = datetime.datetime(2024, 1, 1)


def plain_runs(rows, limit):
    """(run, n, total, gap) of rows (seconds or None, value) in order."""
    out, last, n, total = [], None, 0, 0.0
    for t, v in rows:
        if n and t is not None and last is not None and t - last > limit:
            out.append((len(out), n, round(total, 6), round(t - last, 6)))
            last, n, total = None, 0, 0.0
        last = t if t is not None else last
        n, total = n + 1, total + (v or 0.0)
    return out + ([(len(out), n, round(total, 6), None)] if n else [])


def test_runs(spark):
    table_functions.register(spark)
    rng = random.Random(6)
    keys = ["hot"] * 3000 + ["a"] * 40 + [None] * 20 + ["lone"]
    rows = [(k, None if rng.random() < 0.02 else rng.randrange(0, 40_000 if k == "hot" else 900), rng.choice([None, 1.5, -2.0]), i) for i, k in enumerate(keys)]
    df = spark.createDataFrame([(k, None if t is None else ZERO + datetime.timedelta(seconds=t), v, i) for k, t, v, i in rows], "key string, at timestamp, value double, id int")
    df.repartition(5).createOrReplaceTempView("run_rows")
    call = "SELECT * FROM gap_runs(TABLE(run_rows) PARTITION BY key ORDER BY (at, id), 30.0D)"
    got = {}
    for r in spark.sql(call).collect():
        got.setdefault(r.key, []).append((r.run, r.n, round(r.total, 6), None if r.gap is None else round(r.gap, 6)))
    want = {}
    for k in set(keys):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[3]))
        want[k] = plain_runs([(r[1], r[2]) for r in own], 30.0)
    assert {k: sorted(v) for k, v in got.items()} == want and len(want["hot"]) > 20
    df.where("false").createOrReplaceTempView("run_rows")
    assert spark.sql(call).count() == 0


def test_chunk_times(spark):
    table_functions.register(spark)
    rows = spark.sql("SELECT d, c.* FROM VALUES (0D), (10D), (60D), (61D), (200D), (NULL) AS t(d), LATERAL chunk_times(d, 60.0D, 5.0D) AS c").collect()
    assert [(r.d, r.pos, r.start, r.end) for r in sorted(rows, key=lambda r: (r.d, r.pos))] == [(10, 0, 0, 10), (60, 0, 0, 60), (61, 0, 0, 60), (61, 1, 55, 61), (200, 0, 0, 60), (200, 1, 55, 115), (200, 2, 110, 170), (200, 3, 165, 200)]
    assert spark.sql("SELECT * FROM chunk_times(100.0D, 5.0D, 5.0D)").count() == 0
