"""Ranked lexical search with Fagin's threshold algorithm.

Terms are runs of ASCII letters and digits and of everything beyond ASCII; only A-Z
is lower-cased.  A term that occurs tf times in a document of n terms has the
impact (1,000,000,000 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L, where N
counts the documents with a term and L all their terms.  A document's score for a
query is the sum of weight times impact over the query's terms, repeats included.

The index is dealt into shards of some megabytes of text.  A shard holds for each
of its terms the documents in order of falling impact, and a forward index with
the terms and impacts of each document.  Beside the shards stands one table with
the number of documents that hold each term, from which the weights of query terms
are joined.

A search takes the lists of a query's terms by turns, reads ahead in each of them,
looks up the whole score of every new document in the forward index, and stops
once the threshold, which is the best score that a document not met yet can have,
falls strictly below the k-th score so far.  Documents that tie with the k-th one
are therefore always met.  The k best of a task go on from shard to shard, so that
most of its later shards stop early; two windows with limits pushed before their
shuffles merge the tasks.  No list, no document and no query's candidates meet in
one task, however frequent a term is.

Queries are a stated set, kept in blocks of bounded size that meet every shard.

Defined cases: null and empty texts have no terms and are never found; queries
without known terms have no rows; equal documents (or ids) are documents of their
own and are found as often; equal scores go by ascending id, null ids last; queries
with equal or null ids are queries of their own; empty tables give no rows; other
columns are ignored.  A text is indexed whole, and one larger than a shard is a
shard of its own.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_whole, release_memory, scratch_path, slices, write_once, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text in a shard.  Larger shards are fewer files; a task holds one at a time.
SHARD_BYTES = 16 << 20
#: Queries that meet a shard together.
QUERY_BLOCK = 4096
#: Entries read from every list in the first turn; each later turn reads twice as many.
FIRST_STEP = 16
#: Impacts are below it.
IMPACT_BITS = 20

_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_IN_TERM = (_BYTES >= 128) | (_BYTES >= 48) & (_BYTES <= 57) | _UPPER | (_BYTES >= 97) & (_BYTES <= 122)
_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many terms each text has, and all terms end to end."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    if offsets[-1] == offsets[0]:
        return np.zeros(n, np.int64), pa.array([], pa.string())
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    bounds = (offsets - offsets[0]).astype(np.int64)
    inside = _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    kept = _LOWER[data[inside]]
    skipped = np.cumsum(~inside, dtype=np.int32)
    at = (start - skipped[start]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(at, np.int32(len(kept)))), pa.py_buffer(kept))
    return np.diff(np.searchsorted(start, bounds)), found


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, total) of each piece: the texts with a term, and all their terms."""
    for b in slices(batches, "text"):
        counts = terms_of(b.column(0))[0]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (int((counts > 0).sum()), int(counts.sum()))], names=["n", "total"])


def length_parts(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document length; in whole numbers of any size where 64 bits do not hold them."""
    if len(lengths) and int(lengths.max()) * 25 * n >= 1 << 63:
        return np.array([75 + 25 * int(x) * n // total for x in lengths], np.int64)
    return 75 + 25 * lengths * n // max(total, 1)


@dataclass
class Shard:
    """A part of the index: ``rows`` is the forward index, ``by_impact`` its entries by term and falling impact."""

    ids: np.ndarray
    known: np.ndarray
    rows: np.ndarray
    codes: np.ndarray
    impacts: np.ndarray
    lists: np.ndarray
    by_impact: np.ndarray
    terms: pa.Array

    @classmethod
    def build(cls, ids: pa.Array, texts: pa.Array, n: int, total: int) -> Shard:
        lengths, found = terms_of(texts)
        coded = found.dictionary_encode()
        size = max(1, len(coded.dictionary))
        owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
        keys, tf = np.unique(owner * size + coded.indices.to_numpy(), return_counts=True)
        owner, codes = keys // size, (keys % size).astype(np.int32)
        impacts = (1_000_000_000 * tf // (1000 * tf + 12 * length_parts(lengths, n, total)[owner])).astype(np.int32)
        order = np.argsort((codes.astype(np.int64) << IMPACT_BITS) + ((1 << IMPACT_BITS) - 1 - impacts), kind="stable")
        return cls(
            pc.fill_null(ids, 0).to_numpy(),
            pc.is_valid(ids).to_numpy(zero_copy_only=False),
            np.searchsorted(owner, np.arange(len(texts) + 1)),
            codes,
            impacts,
            np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=size))]),
            order.astype(np.int32),
            coded.dictionary,
        )

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        names = pa.concat_arrays([self.terms, pa.array([""])])  # with an entry, there are buffers
        arrays = {k: v for k, v in vars(self).items() if k != "terms"}
        np.savez(out, **arrays, term_at=np.frombuffer(names.buffers()[1], np.int32)[: len(names) + 1], term_bytes=np.frombuffer(names.buffers()[2] or b"", np.uint8))
        return zstandard.ZstdCompressor(level=1).compress(out.getbuffer())

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        held = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data)))
        at = held["term_at"]
        terms = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(held["term_bytes"]))
        return cls(*(held[k] for k in ("ids", "known", "rows", "codes", "impacts", "lists", "by_impact")), terms[:-1])


@dataclass
class Index:
    """shards: file; terms: term, df; n documents have terms, ``total`` in all."""

    shards: DataFrame
    terms: DataFrame
    n: int
    total: int


def build_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every document in ``folder``: shard files and the tables ``shards``, ``terms`` and ``size``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = rows.select("text").mapInArrow(count_terms, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    size.write.parquet(f"{folder}/size")
    n, total = spark.read.parquet(f"{folder}/size").first()

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for b in slices(batches, "text", SHARD_BYTES):
            shard = Shard.build(b.column(0), b.column(1), n, total)
            name = f"{folder}/shard-{part:07d}-{k:05d}.idx"
            k += 1
            write_once(name, shard.to_bytes())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([None], pa.string()), pa.array([len(b)], pa.int64())], names=["file", "term", "df"])
            df = np.diff(shard.lists)[: len(shard.terms)]
            for low in range(0, len(df), 65_536):
                part_terms = shard.terms[low : low + 65_536]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part_terms), pa.string()), part_terms, pa.array(df[low : low + 65_536], pa.int64())], names=["file", "term", "df"])

    rows.mapInArrow(run, "file string, term string, df long").write.parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")
    parts.where("file is not null").select("file").write.parquet(f"{folder}/shards")
    parts.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{folder}/terms")
    return open_index(docs, folder)


def open_index(near: DataFrame, folder: str) -> Index:
    spark = near.sparkSession
    return Index(spark.read.parquet(f"{folder}/shards"), spark.read.parquet(f"{folder}/terms"), *spark.read.parquet(f"{folder}/size").first())


@dataclass
class Queries:
    """A block of queries: their ids, the distinct terms, and each query's places and weights in these."""

    numbers: list[int]
    terms: pa.Array
    wanted: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: pa.Table) -> Queries:
        coded = rows["term"].combine_chunks().dictionary_encode()
        number, place, weight = rows["query"].to_numpy(), coded.indices.to_numpy(), rows["weight"].to_numpy()
        order = np.argsort(number, kind="stable")
        numbers, first = np.unique(number[order], return_index=True)
        cut = [*first.tolist(), len(order)]
        wanted = [(place[order[a:b]], weight[order[a:b]]) for a, b in zip(cut, cut[1:])]
        return cls(numbers.tolist(), coded.dictionary, wanted)


def weigh_queries(index: Index, queries: DataFrame, folder: str, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """The numbered queries, and the files of their blocks.  Terms of weight zero or unknown ones add nothing."""
    numbered = written(queries.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("query")), "queries")

    def split(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "text"):
            counts, found = terms_of(b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), counts)), found], names=["query", "term"])

    held = numbered.select("query", "text").mapInArrow(split, "query long, term string").groupBy("query", "term").count()
    weight = F.floor(1000 * F.log(F.lit(2 * index.n + 2) / (2 * F.col("df") + 1)))
    weighed = held.join(index.terms, "term").select("query", "term", (weight * F.col("count")).cast("long").alias("weight")).where("weight > 0")
    blocks = numbered.count() // QUERY_BLOCK + 1
    weighed = weighed.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))

    def keep(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        name = f"{folder}/queries-{key[0].as_py():05d}.arrow"
        out = io.BytesIO()
        with pa.ipc.new_stream(out, rows.schema) as sink:
            sink.write_table(rows)
        write_once(name, out.getbuffer())
        return pa.table({"file": [name]})

    files = written(weighed.groupBy("block").applyInArrow(keep, "file string"), "query-files")
    return numbered, sorted(r.file for r in files.collect())


@lru_cache(maxsize=2)
def queries_of(uri: str) -> Queries:
    return Queries.of(pa.ipc.open_stream(read_whole(uri)).read_all())


class Best:
    """The k best documents of a query so far: by falling score, then by id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.scores = self.ids = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)

    @property
    def least(self) -> int:
        """The score that a further document must reach."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        fit = scores >= self.least
        if not fit.any():
            return
        scores, ids, known = (np.concatenate(x) for x in ((self.scores, scores[fit]), (self.ids, ids[fit]), (self.known, known[fit])))
        order = np.lexsort((ids, ~known, -scores))[: self.k]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]


def search_shard(shard: Shard, queries: Queries, best: list[Best]) -> None:
    """Bring the best documents of each query up to date with those of a shard."""
    # The forward index and the lists, with the terms that the queries name.
    found = pc.index_in(queries.terms, value_set=shard.terms)
    place = np.full(len(shard.lists), -1, np.int32)
    there = pc.is_valid(found).to_numpy(zero_copy_only=False)
    code = pc.fill_null(found, 0).to_numpy()
    place[code[there]] = np.flatnonzero(there)
    column = place[shard.codes]
    kept = column >= 0
    rows = np.concatenate([[0], np.cumsum(kept)])[shard.rows]
    column, impact = column[kept], shard.impacts[kept].astype(np.int64)
    owner = np.repeat(np.arange(len(shard.ids), dtype=np.int32), np.diff(shard.rows))
    weights = np.zeros(len(queries.terms), np.int64)
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(term: int) -> tuple[np.ndarray, np.ndarray]:
        if term not in lists:
            at = shard.by_impact[shard.lists[code[term]] : shard.lists[code[term] + 1]]
            lists[term] = owner[at], shard.impacts[at].astype(np.int64)
        return lists[term]

    for (terms, weight), top in zip(queries.wanted, best):
        have = there[terms]
        terms, weight = terms[have], weight[have]
        weights[terms] = weight
        sources = [(w, *list_of(t)) for t, w in zip(terms.tolist(), weight.tolist())]
        met = np.zeros(len(shard.ids), bool)
        depth, step = 0, FIRST_STEP
        while sources:
            docs = np.concatenate([d[depth : depth + step] for _, d, _ in sources])
            fresh = np.unique(docs[~met[docs]])
            met[fresh] = True
            if len(fresh):
                sizes = rows[fresh + 1] - rows[fresh]
                ends = np.cumsum(sizes)
                at = np.arange(ends[-1]) + np.repeat(rows[fresh] - (ends - sizes), sizes)
                scores = np.add.reduceat(weights[column[at]] * impact[at], ends - sizes)
                top.add(scores, shard.ids[fresh], shard.known[fresh])
            depth, step = depth + step, step * 2
            sources = [x for x in sources if len(x[1]) > depth]
            # What a document that no list has shown yet can reach at most.
            if sum(w * int(i[depth]) for w, _, i in sources) < top.least:
                break
        weights[terms] = 0


def search(index: Index, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of every query."""
    spark = queries.sparkSession
    numbered, files = weigh_queries(index, queries, scratch_path(spark, "lexical-queries"), id_col, text_col)
    shards = index.shards.count()
    tasks = max(1, min(shards, max(2 * spark.sparkContext.defaultParallelism, shards // 64)))
    work = index.shards.repartition(tasks).sortWithinPartitions("file")
    schema = "query long, doc_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]):
        names = [x for b in batches for x in b.column(0).to_pylist()]
        for block in files:
            queries = queries_of(block)
            best = [Best(k) for _ in queries.numbers]
            for name in names:
                search_shard(Shard.from_bytes(read_whole(name)), queries, best)
            sizes = [len(b.scores) for b in best]
            if sum(sizes):
                ids, known, scores = (np.concatenate([getattr(b, c) for b in best]) for c in ("ids", "known", "scores"))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries.numbers, sizes)), pa.array(ids, mask=~known), pa.array(scores)], names=["query", "doc_id", "score"])
        release_memory()

    held = work.mapInArrow(run, schema).withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(256)))
    by_score = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = held.withColumn("_at", F.row_number().over(Window.partitionBy("query", "_group").orderBy(*by_score))).where(F.col("_at") <= k).drop("_at", "_group")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*by_score))).where(F.col("rank") <= k)
    return ranked.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def search_table(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Index the documents and rank them for each item."""
    return search(build_index(docs, scratch_path(docs.sparkSession, "lexical")), items)


LEXICAL_SQL = r"""
WITH terms AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS all_terms FROM documents),
sized AS (SELECT doc_id, d, len(all_terms)::BIGINT AS n, all_terms FROM terms WHERE len(all_terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sized),
tf AS (SELECT doc_id, d, n, term, count(*) AS tf FROM (SELECT doc_id, d, n, unnest(all_terms) AS term FROM sized) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term),
wanted AS (
  SELECT item_id, q, term, count(*) AS times FROM (
    SELECT item_id, row_number() OVER () AS q, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
scores AS (
  SELECT item_id, q, doc_id, d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN tf USING (term), totals GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""
