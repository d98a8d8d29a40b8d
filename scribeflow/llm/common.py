"""Helpers shared by the training-data operators: storage, batches, components."""

from __future__ import annotations

import atexit
import ctypes
import posixpath
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Single-byte white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"

_scratch: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that the whole cluster shares, from ``spark.checkpoint.dir``.

    A path without a scheme is one of the cluster's default file system.  Where the
    setting is absent, a local session gets a folder of this process, installed as
    its checkpoint folder; on a cluster that is an error, as executors would not
    share it.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif context.master.split("[")[0] == "local":
            root = f"file://{tempfile.mkdtemp(prefix='scribeflow-')}"
            context.setCheckpointDir(root)
        else:
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    made = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file:///" + made[5:].lstrip("/") if made.startswith("file:") else made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root; removed when the driver ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_sweep)
    _scratch.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _scratch:
        try:
            remove_path(spark, path)
        except Exception:  # the context may be gone; the folder is only scratch
            continue


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a qualified URI, as seen from an executor."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_once(uri: str, data: bytes | memoryview) -> None:
    """Write a file under a temporary name and move it into place.

    The name follows from the part, so a task that runs twice writes the same bytes
    to the same place.  Temporary names of lost tasks are swept with their folder.
    """
    fs, path = open_fs(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    held = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(held) as out:
        out.write(data)
    put(fs, held, path)


def put(fs: pafs.FileSystem, held: str, path: str) -> None:
    """Move a finished file into place; where an earlier attempt has put it, that one stays."""
    try:
        fs.move(held, path)
    except OSError:
        if fs.get_file_info(path).type != pafs.FileType.File:
            raise
        fs.delete_file(held)


def drop_temporary(uri: str) -> None:
    """Delete what lost or doubled tasks have left under temporary names in a folder."""
    fs, path = open_fs(uri)
    for info in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if info.path.endswith(".tmp"):
            fs.delete_file(info.path)


def read_whole(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as src:
        return src.read()


def release_memory() -> None:
    """Give freed memory back: a worker stays for other tasks, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes`` in each piece.

    A single value larger than that forms a piece of its own: rows are never cut.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if batch.nbytes <= max_bytes:
            yield batch
            continue
        col = batch.column(batch.schema.get_field_index(column))
        nested = pa.types.is_nested(col.type)
        lengths = [col.slice(i, 1).nbytes for i in range(n)] if nested else pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start = held = 0
        for i, k in enumerate(lengths):
            if held and held + k > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += k
        yield batch.slice(start, n - start)
    release_memory()


def fraction_hash(*cols: Column, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) from the values of some columns."""
    mixed = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(mixed, 11).cast("double") / F.lit(float(1 << 53))


def running_total(df: DataFrame, key: str, value: str, name: str, group: int = 4096) -> DataFrame:
    """Column ``name``: the sum of ``value`` over all rows of a smaller whole number ``key``.

    Sums within groups of neighbouring keys, then over the groups' sums, so that no
    task holds all rows.  Keys are distinct and not negative.
    """
    held = df.withColumn("_run_group", F.floor(F.col(key) / group))
    inner = Window.partitionBy("_run_group").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_run_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("_run_group").agg(F.sum(value).alias("_run_sum"))
    sums = sums.select("_run_group", F.coalesce(F.sum("_run_sum").over(outer), F.lit(0)).alias("_run_earlier"))
    out = held.withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0))).join(sums, "_run_group")
    return out.withColumn(name, (F.col(name) + F.col("_run_earlier")).cast("long")).drop("_run_group", "_run_earlier")


def connected_components(links: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Smallest node of each component: (node, component) for nodes with links.

    ``links`` has long columns a and b.  Alternates the large-star and small-star
    steps, each a grouped minimum plus a join on the node, until no link changes.
    The minima are written before the join, so that both its sides are plain
    shuffles and Spark deals a node with very many links to several tasks.  Every
    step is written to the shared folder, so a lost executor costs one step at most,
    and nothing of the graph reaches the driver but one number.  Raises
    ``RuntimeError`` after ``max_rounds`` (the rounds grow with the logarithm of the
    longest path).
    """
    # Both orders are kept implicit: (u, v) with u > v.
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        f"{name}-0",
    )
    before = None
    for turn in range(1, max_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-low-{turn}")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(large.distinct(), f"{name}-large-{turn}")
        down = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-down-{turn}")
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        edges = written(small, f"{name}-{turn}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
