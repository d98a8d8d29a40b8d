"""State as numbered versions: writers that do not overwrite each other, content that is checked.

A version is a Parquet table in a folder of its own and a pointer file with its number.
A writer names the version that it has read; its pointer is created only where none
of that number is, so of two writers on one version the second fails and leaves
nothing.  Readers see whole versions only, and keep what they have begun to read.

The pointer holds a digest of the content: the number of rows, and the sum and the
exclusive or of their hashes.  It does not depend on the order or the partitions of
the rows, needs one pass with partial aggregation, and tells any changed, lost or
doubled row but for collisions of 64 bits.  It is compared with what was written
before the pointer is made, and on request with what is read.

An empty table is a version like others.  Null values count; so do names and the
order of columns.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lock without its version is that of a writer that died once it is so old.
LOCK_SECONDS = 600
_POINTER = re.compile(r"version-(\d{12})\.json")


class Conflict(RuntimeError):
    """Another writer has made the version in the meantime."""


def content_digest(rows: DataFrame) -> tuple[int, int, int]:
    """(rows, sum, exclusive or) of the hashes of all rows."""
    names = [F.struct(F.col(f"`{c}`").alias("v")) for c in rows.columns]
    whole = F.concat_ws(",", *[F.to_json(x, {"ignoreNullFields": "false"}) for x in names])
    h = F.xxhash64(F.lit(json.dumps(rows.columns)), whole)
    n, total, mixed = rows.select(h.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return n, int(total or 0), mixed or 0


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.path = lambda name: self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self.fs = self.path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of all versions, ascending."""
        root = self.jvm.org.apache.hadoop.fs.Path(self.folder)
        names = [s.getPath().getName() for s in self.fs.listStatus(root)] if self.fs.exists(root) else []
        return sorted(int(m[1]) for m in map(_POINTER.fullmatch, names) if m)

    def latest(self) -> int:
        """The newest version, 0 for none."""
        return max(self.versions(), default=0)

    def _pointer(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.folder}/version-{version:012}.json", wholetext=True).first()[0]
        return json.loads(text)

    def write(self, rows: DataFrame, after: int) -> int:
        """Make the version behind ``after``, the one that the rows were derived from; returns its number."""
        if self.latest() != after:
            raise Conflict(f"version {after} is not the newest: {self.latest()}")
        data = f"data-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.folder}/{data}")
            written = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{data}")
            wanted, found = content_digest(rows), content_digest(written)
            if wanted != found:
                raise OSError(f"written {found}, wanted {wanted}")
            self._create(after + 1, {"data": data, "digest": found, "schema": rows.schema.jsonValue()})
        except (Conflict, OSError, PySparkException):
            self.fs.delete(self.path(data), True)
            raise
        return after + 1

    def _create(self, version: int, held: dict) -> None:
        """The pointer, whole under a name of its own first, then renamed where there is none."""
        name = f"version-{version:012}.json"
        own = self.path(f"_{name}.{uuid.uuid4().hex}")
        out = self.fs.create(own, False)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        try:
            lock = self.path(f"_lock-{version:012}")
            if not self.fs.exists(self.path(name)) and self.fs.exists(lock) and time.time() - self.fs.getFileStatus(lock).getModificationTime() / 1000 > LOCK_SECONDS:
                self.fs.delete(lock, False)  # its writer died before the rename
            if not self.fs.createNewFile(lock) or not self.fs.rename(own, self.path(name)):
                raise Conflict(f"version {version} is there already")
        finally:
            self.fs.delete(own, False)

    def read(self, version: int | None = None, check: bool = False) -> DataFrame:
        """The rows of a version, the newest by default; with ``check`` their digest is compared first."""
        from pyspark.sql.types import StructType

        held = self._pointer(version or self.latest())
        rows = self.spark.read.schema(StructType.fromJson(held["schema"])).parquet(f"{self.folder}/{held['data']}")
        if check and content_digest(rows) != tuple(held["digest"]):
            raise OSError(f"the content of version {version or self.latest()} has changed")
        return rows
