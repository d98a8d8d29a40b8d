"""Streams in disorder: chunks of unordered frames, late and double rows."""

import random

import pytest

from scribeflow import config
from scribeflow.functions import kernels
from scribeflow.streaming import late
from scribeflow.streaming.chunks import rocksdb_state, unordered_chunks

PLAN = config.ModelPlan("test", "whisper", 0.5, 0.1, 0.2, 0.06, 0.1, 1, 0, 0, 0.0)
FRAME = "file_id string, frame long, t double, label int, last boolean, at timestamp"


def machine_chunks(frames):
    """Chunks of (frame, t, label, last) rows in order."""
    machine, out = kernels.ChunkMachine(PLAN, 0.03), []
    for f in frames:
        out.append(machine.step(*f))
    out.append(machine.close())
    return [x for x in out if x]


class Feed:
    """A stream over a folder that gets one file, and so one batch, at a time."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def read(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")

    def run(self, made):
        with rocksdb_state(self.spark):
            made(self.read()).writeStream.option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start(path=f"{self.folder}/out", format="parquet").awaitTermination()

    def out(self):
        return self.spark.read.parquet(f"{self.folder}/out")


def frames_of(name, n, rng, last=True, base=0):
    labels = [rng.choice([0, 1, 1, 1, -1]) if k % 40 < 25 else 0 for k in range(n)]
    rows = [(k, k * 0.03, labels[k], last and k == n - 1) for k in range(n)]
    return rows, [(name, *r, base + r[0] * 0.03) for r in rows]


def stamped(spark_rows):
    import datetime

    zero = datetime.datetime(2024, 1, 1)
    return [(*r[:-1], zero + datetime.timedelta(seconds=r[-1])) for r in spark_rows]


def test_unordered_batches_give_the_chunks_of_the_table(spark, tmp_path):
    rng = random.Random(4)
    a, rows_a = frames_of("a", 130, rng)
    b, rows_b = frames_of("b", 90, rng, last=False)  # ends by idling
    feed = Feed(spark, tmp_path, FRAME)
    rows = stamped(rows_a + rows_b)
    rows += rng.sample(rows, 30)  # some come twice
    # Disorder within two seconds.
    rows.sort(key=lambda r: (r[-1].timestamp() + rng.uniform(0, 1.9), rng.random()))
    make = lambda s: unordered_chunks(s, PLAN, "at", late="2 seconds", idle=30.0)
    for k in range(0, len(rows), 63):
        feed.add(rows[k : k + 63])
        if k % 126 == 0:
            feed.run(make)  # and starts anew from its checkpoint
    feed.add(stamped([("far", 0, 0.0, 0, False, 100.0)]))
    feed.run(make)
    feed.add(stamped([("far", 1, 0.03, 0, False, 200.0)]))
    feed.run(make)
    got = {}
    for r in feed.out().orderBy("id").collect():
        got.setdefault(r.file_id, []).append((r.id, pytest.approx(r.startTime), pytest.approx(r.endTime), r.hasOverlap))
    assert got == {"a": machine_chunks(a), "b": machine_chunks(b)}
    assert len(got["a"]) > 3


COLUMNS = "id long, ts timestamp, v string"


def brute_late(batches, delay):
    """Where each row of each batch goes."""
    newest, kept, out = None, set(), []
    for n, rows in enumerate(batches):
        behind = lambda t: newest is not None and t is not None and t < newest - delay  # noqa: B023, E731
        ordered = sorted(range(len(rows)), key=lambda k: (rows[k][1] is None, rows[k][1] or 0, k))
        for k in ordered:
            i, t, v = rows[k]
            if behind(t):
                out.append((n, "late", i, v))
            elif i in kept:
                out.append((n, "double", i, v))
            else:
                kept.add(i)
                out.append((n, "kept", i, v))
        newest = max([t for _, t, _ in rows if t is not None] + ([newest] if newest is not None else []), default=None)
    return sorted(out, key=str)


def test_every_row_is_kept_double_or_late(spark, tmp_path):
    import datetime

    rng = random.Random(9)
    batches = []
    for n in range(4):
        rows = [(rng.randrange(60), n * 3600 * 3 + rng.uniform(-9 * 3600, 3600), f"{n}-{k}") for k in range(40)]
        batches.append(rows + [(200 + n % 2, None, f"{n}-none"), (None, n * 10800.0, f"{n}-null")])
    # An id comes again only within the delay, or its later rows are late.
    zero = datetime.datetime(2024, 1, 1)
    feed = Feed(spark, tmp_path, COLUMNS)
    deal = late.LateRows(f"{tmp_path}/out", ["id"], "ts", 4 * 3600)
    for rows in batches:
        feed.add([(i, None if t is None else zero + datetime.timedelta(seconds=t), v) for i, t, v in rows])
        deal.start(feed.read()).awaitTermination()

    def dealt():
        out = []
        for name in late.TABLES:
            rows = deal.table(spark, name, ["id", "v"])
            out += [(r.batch, name, r.id, r.v) for r in rows.collect()] if rows is not None else []
        return sorted(out, key=str)

    got = dealt()
    assert len(got) == sum(map(len, batches))
    want = brute_late(batches, 4 * 3600)
    # Doubles of rows kept longer ago than the delay count anew, as ids are kept that long only.
    near = {x for x in want if x[1] != "double"}
    assert {x for x in got if x[1] == "late"} == {x for x in near if x[1] == "late"}
    assert {x[0:3] for x in got if x[1] == "kept"} >= {x[0:3] for x in near if x[1] == "kept"}
    assert {n for _, n, _, _ in got} == {"kept", "double", "late"}
    # A batch that runs again leaves the same rows.
    again = spark.createDataFrame([(i, None if t is None else zero + datetime.timedelta(seconds=t), v) for i, t, v in batches[2]], COLUMNS)
    deal.batch(again.coalesce(1), 2)
    assert dealt() == got


def test_doubles_within_the_watermark(spark, tmp_path):
    import datetime

    zero = datetime.datetime(2024, 1, 1)
    feed = Feed(spark, tmp_path, COLUMNS)
    for n in range(3):
        feed.add([(k % 5, zero + datetime.timedelta(seconds=60 * n), "x") for k in range(9)])
    feed.run(lambda s: late.without_doubles(s, ["id"], "ts"))
    assert feed.out().groupBy("id").count().where("count > 1").count() == 0 and feed.out().count() == 5


def test_setting_of_the_state_store_comes_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with rocksdb_state(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before
