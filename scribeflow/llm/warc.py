"""WARC: a deterministic sharded writer and its reader.

Pages are range-sorted by ``page_id`` into parts.  A part is a run of archives;
an archive is closed at the first record behind ``ROLL_BYTES`` compressed bytes.
Headers and digests are made anew for every record, each record is a gzip member
of its own, and ids, dates and order depend on the rows only, so that a second
run writes the same bytes under the same names.  An archive is written under a
temporary name and moved into place; the manifest lists the archives of tasks that
succeeded, readers go by the manifest alone, and what lost tasks leave under
temporary names is deleted behind it.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the
largest ``page_id`` is a response and the others revisit it.  Which payloads occur
twice is found on digests, salted where they are joined, as one payload may be very
common; the few marks that say so travel to the pages of their id and digest in the
same sort, so that the html is shuffled once.  Ranges are of ids and digests: an id
that very many pages share (or none) is cut into several.

Defined cases: null html is an empty payload; null urls are written as
``urn:none``; rows with null ``page_id`` come first, are always responses and are
never referred to; among rows equal in id and payload the first is the response;
an empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_temporary, open_fs, put, scratch_path, slices, written

ROLL_BYTES = 64 << 20
PART_BYTES = 48 << 20
#: Shares into which the pages of one payload are dealt where digests meet.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6f1c1c52-6a0c-4b0e-9a63-2f6c0d7a7a11")
PAGE_FIELD, REFERS_FIELD = "WARC-X-Page-ID", "WARC-X-Refers-To-Page-ID"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload: str, repeat: int | str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{payload}/{repeat}')}>"


def _clean_url(url: str | None) -> str:
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "") or "urn:none"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, without a time stamp."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Length", str(len(block)))])
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + press.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, repeat: int | str, refers: int | None) -> bytes:
    own = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Record-ID", record_id(page_id, own, repeat)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean_url(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{own}"),
    ]
    if page_id is not None:
        fields.append((PAGE_FIELD, str(page_id)))
    if refers is None:
        return warc_record("response", fields, http + payload)
    fields += [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", record_id(refers, own, 0)),
        (REFERS_FIELD, str(refers)),
    ]
    return warc_record("revisit", fields, http)


class Archive:
    """An archive file under a temporary name until it is closed."""

    def __init__(self, folder: str, part: int, nth: int):
        self.uri = f"{folder}/pages-{part:06d}-{nth:04d}.warc.gz"
        self.fs, self.path = open_fs(self.uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.held = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.held)
        self.size = self.records = 0
        info = f"software: scribeflow\r\nformat: WARC File Format 1.1\r\npart: {part}\r\nnumber: {nth}\r\n".encode()
        self.write(warc_record("warcinfo", [("WARC-Record-ID", record_id(None, f"info-{part}-{nth}", 0)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info))
        self.records = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        put(self.fs, self.held, self.path)
        return self.uri, self.records, self.size


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write all pages below ``folder``; returns the manifest (file, part, nth, records, bytes)."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    marks = written(rows.where(F.col("page_id").isNotNull() & (F.length("payload") >= min_bytes)).select("page_id", "sha"), "digests")
    shared = marks.groupBy("sha").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    salted = marks.distinct().withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = salted.join(shared, ["sha", "salt"]).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "sha", "keep")
    total = rows.agg(F.sum(F.length("payload"))).first()[0] or 0
    parts = int(total // PART_BYTES) + 1
    # Pages without id need no mark: equal ones are dealt by their place, however many there are.
    place = F.when(F.col("page_id").isNull(), F.monotonically_increasing_id())
    dealt = told.withColumn("place", F.lit(None).cast("long")).unionByName(rows.select("*", F.lit(None).cast("long").alias("keep"), place.alias("place")))
    dealt = dealt.repartitionByRange(parts, "page_id", "sha", F.when(F.col("page_id").isNull(), F.col("url")), "place")
    # The mark before the pages of the same id and digest; then a fixed order of the pages.
    dealt = dealt.sortWithinPartitions("page_id", "sha", F.col("keep").isNull(), "url", "place").drop("place")

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, nth, archive, made, unnamed = TaskContext.get().partitionId(), 0, None, [], 0
        current, keep, repeat = None, None, -1
        for b in slices(batches, "payload", 16 << 20):
            for page_id, url, payload, sha, kept in zip(*(c.to_pylist() for c in b.columns)):
                if (page_id, sha) != current:
                    current, keep, repeat = (page_id, sha), None, -1
                if payload is None:
                    keep = kept
                    continue
                repeat += 1
                refers = keep if keep is not None and (keep != page_id or repeat) else None
                if archive and archive.size >= roll_bytes:
                    made.append((*archive.close(), nth))
                    archive, nth = None, nth + 1
                archive = archive or Archive(folder, part, nth)
                unnamed += page_id is None
                archive.write(page_record(page_id, url, payload, repeat if page_id is not None else f"{part}.{unnamed}", refers))
        if archive:
            made.append((*archive.close(), nth))
        for uri, records, size, n in made:
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri]), pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([records], pa.int64()), pa.array([size], pa.int64())],
                names=["file", "part", "nth", "records", "bytes"],
            )

    schema = "file string, part int, nth int, records long, bytes long"
    dealt.mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    drop_temporary(folder)
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive."""
    src = gzip.GzipFile(fileobj=io.BytesIO(data))
    while line := src.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        fields: dict[str, str] = {}
        while (line := src.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().partition(":")
            fields[key.strip()] = value.strip()
        block = src.read(int(fields["Content-Length"]))
        if fields.get("WARC-Block-Digest") not in (None, f"sha1:{digest32(block)}"):
            raise ValueError(f"digest of {fields.get('WARC-Record-ID')} differs")
        src.read(4)
        yield fields, block


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per page record: page_id, url, payload (null for revisits) and what the query returns."""
    n = max(1, manifest.count())
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        from .common import read_whole

        for b in batches:
            for uri in b.column(0).to_pylist():
                held, size = [], 0
                for fields, block in read_records(read_whole(uri)):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != length or digest32(payload) != digest):
                        raise ValueError("payload differs from its header")
                    page, refers = fields.get(PAGE_FIELD), fields.get(REFERS_FIELD)
                    held.append((int(page) if page else None, fields["WARC-Target-URI"], payload if kind == "response" else None, length, digest, kind, int(refers) if refers else None))
                    size += len(payload)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)

    return manifest.select("file").repartition(n).mapInArrow(run, schema)


def page_table(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back."""
    manifest = write_archives(pages, scratch_path(pages.sparkSession, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Base 32 takes five hexadecimal digits at a time for four of its own.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, {5 * i + 1}, 5))::INT >> {shift}) & 31) + 1)::INT, 1)" for i in range(8) for shift in (15, 10, 5, 0))
WARC_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, sha1(html) AS x, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS keep,
    count(page_id) OVER (PARTITION BY html) AS c, row_number() OVER (PARTITION BY html, page_id ORDER BY rid) AS k
  FROM p),
r AS (SELECT *, page_id IS NOT NULL AND c > 1 AND NOT (page_id = keep AND k = 1) AS again FROM d)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keep END AS refers_to
FROM r
"""
