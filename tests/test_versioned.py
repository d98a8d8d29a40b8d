"""Versions of state: conflicts, and content that changes."""

import pytest
from pyspark.sql import functions as F

from scribeflow.sources import sinks
from scribeflow.sources.versioned import Conflict, VersionedTable, content_digest


def test_digest_does_not_depend_on_order(spark):
    rows = [(1, "a", [1.5]), (2, None, None), (2, None, None), (3, "", [])]
    df = spark.createDataFrame(rows, "id long, text string, x array<double>")
    same = content_digest(df)
    assert same == content_digest(df.orderBy(F.desc("id")).repartition(3)) and same[0] == 4
    others = [df.where("id < 3"), df.unionByName(df.limit(1)), df.withColumn("text", F.coalesce("text", F.lit(""))), df.withColumnRenamed("text", "t"), df.distinct(), df.withColumn("id", F.col("id") + 1)]
    assert all(content_digest(o) != same for o in others)
    assert content_digest(df.where("false"))[0] == 0


def test_two_writers(spark, tmp_path):
    held = VersionedTable(spark, f"{tmp_path}/state")
    assert held.latest() == 0
    first = spark.createDataFrame([(1, "a")], "id long, text string")
    assert held.write(first, 0) == 1
    other = VersionedTable(spark, f"{tmp_path}/state")
    assert other.write(first.unionByName(first), 1) == 2
    before = sorted(p.name for p in (tmp_path / "state").iterdir())
    with pytest.raises(Conflict):
        held.write(first, 1)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == before
    # Both have seen version 2; the second one's pointer is there already.
    latest = held.latest
    held.latest = lambda: 2
    assert other.write(first, 2) == 3
    with pytest.raises(Conflict):
        held.write(first.unionByName(first), 2)
    held.latest = latest
    assert sum(p.name.startswith("data") for p in (tmp_path / "state").iterdir()) == 3
    assert held.versions() == [1, 2, 3] and [held.read(v, check=True).count() for v in (1, 2, None)] == [1, 2, 1]
    assert held.write(first.where("false"), 3) == 4 and held.read(check=True).count() == 0


def test_a_changed_row_is_found(spark, tmp_path):
    held = VersionedTable(spark, f"{tmp_path}/state")
    rows = spark.range(100).withColumn("text", F.lit("kept"))
    held.write(rows, 0)
    (data,) = [p for p in (tmp_path / "state").iterdir() if p.name.startswith("data")]
    changed = rows.withColumn("text", F.when(F.col("id") == 7, "lost").otherwise(F.col("text")))
    changed.write.mode("overwrite").parquet(str(data))
    assert held.read().count() == 100
    with pytest.raises(OSError, match="changed"):
        held.read(check=True)


def test_notes_are_compared_by_content(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a.md", "x"), ("b.md", "y")], "note string, body string")
    assert sinks.write_notes(rows, f"{tmp_path}/notes") == 2
    real = sinks.content_digest
    monkeypatch.setattr(sinks, "content_digest", lambda df: real(df.withColumn("body", F.lit("z"))) if "Scan parquet" in df._jdf.queryExecution().executedPlan().toString() else real(df))
    with pytest.raises(OSError):
        sinks.write_notes(rows, f"{tmp_path}/again")


def test_a_writer_that_died_blocks_no_version(spark, tmp_path, monkeypatch):
    from scribeflow.sources import versioned

    held = VersionedTable(spark, f"{tmp_path}/state")
    rows = spark.range(3)
    held.write(rows, 0)
    (tmp_path / "state/_lock-000000000002").touch()
    with pytest.raises(Conflict):
        held.write(rows, 1)
    monkeypatch.setattr(versioned, "LOCK_SECONDS", -60)
    assert held.write(rows, 1) == 2 and held.read(check=True).count() == 3
