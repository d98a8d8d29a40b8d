"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes ratios.

Texts are lower-cased; runs of anything but letters and the marks on them (Unicode
categories L and M) become one space; each n-gram of 4 to 6 code points is hashed to
a bucket, and a feature is the presence of a bucket in a text.  On a bounded sample of labelled rows the smoothed
log-count ratio of each bucket is taken; the buckets whose presence tells most
(document frequency in both classes against chance) are kept, each scaled by its
ratio, and a logistic regression is fitted on them by full-batch gradient steps.
Scoring reads every text whole, in one scan.

Labels are learned from rows whose crc32 of the decimal ``doc_id`` is not
divisible by 5 (``fold``).  Only the text enters a score.

Parameters that bound training: ``SAMPLE_ROWS`` rows of each class, drawn by a
hash of the id, and ``SAMPLE_CHARS`` characters, half of them for each class.

Defined cases: null and empty texts have the score of the intercept, made to be
a clean one; null labels and labels of unknown documents are ignored; a document
with several labels counts once with the highest; null ids are never learned from,
not held out, and scored alike; without labels of both classes every score is 0;
an empty table gives an empty result; other columns pass through ``score``.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fraction_hash, release_memory, slices, written

GRAMS = (4, 5, 6)
BUCKET_BITS = 22
FEATURES = 4000
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 16 << 20
#: Tasks that count the grams of the sample; each holds two counts a bucket.
COUNT_TASKS = 8
MIN_DOCS = 4
#: Characters of sample texts whose grams are held at once.
BLOCK_CHARS = 1 << 18


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the decimal id is divisible by 5 (null ids: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters or marks."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


def text_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each between spaces, end to end, and their ends."""
    parts = [f" {(t or '').lower()} " for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    if not len(points):
        return points, ends
    own = letters()[points]
    kept = own.copy()
    kept[1:] |= own[:-1]  # a space behind each word
    kept[0] = True
    kept[ends[:-1]] = True  # and one before each text
    return np.where(own, points, np.uint32(32))[kept], np.cumsum(kept)[ends - 1]


def gram_buckets(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at every place where one fits."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(size, n, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h += data[k : k + size]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BUCKET_BITS)


def present(data: np.ndarray, ends: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs; ``wanted`` marks the buckets that count."""
    rows, buckets = [], []
    for n in GRAMS:
        h = gram_buckets(data, n)
        at = np.flatnonzero(wanted[h]) if wanted is not None else np.arange(len(h))
        text = np.searchsorted(ends, at, "right")
        inside = at + n <= ends[text] if len(at) else np.zeros(0, bool)
        rows.append(text[inside])
        buckets.append(h[at[inside]])
    pair = np.unique(np.concatenate(rows).astype(np.uint64) << np.uint64(BUCKET_BITS) | np.concatenate(buckets).astype(np.uint64))
    return (pair >> np.uint64(BUCKET_BITS)).astype(np.int64), (pair & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded size together; a longer text is a run of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t or "") > BLOCK_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


class Model:
    """Weights of the kept buckets, the log-count ratios in them, and an intercept."""

    def __init__(self, buckets: np.ndarray, ratios: np.ndarray, weights: np.ndarray, intercept: float):
        self.buckets, self.ratios, self.weights, self.intercept = buckets, ratios, weights, intercept

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        wanted, weight = np.zeros(1 << BUCKET_BITS, bool), np.zeros(1 << BUCKET_BITS)
        wanted[self.buckets], weight[self.buckets] = True, self.weights
        return wanted, weight


def add_counts(counts: np.ndarray, texts: list[str | None], labels: np.ndarray) -> None:
    """Add to (2, buckets) in how many texts of each class a bucket is present."""
    for lo, hi in blocks(texts):
        rows, buckets = present(*text_points(texts[lo:hi]))
        for c in (0, 1):
            np.add.at(counts[c], buckets[labels[lo + rows] == c], 1)


def ratio_and_weight(toxic: np.ndarray, clean: np.ndarray, positive: int, negative: int) -> tuple[np.ndarray, np.ndarray]:
    """The smoothed log-count ratio of buckets, and how far their shares are apart by chance."""
    ratio = np.log(((toxic + 1) / (positive + 2)) / ((clean + 1) / (negative + 2)))
    pooled = (toxic + clean) / (positive + negative)
    z = np.abs(toxic / positive - clean / negative) / np.sqrt(pooled * (1 - pooled) * (1 / positive + 1 / negative) + 1e-12)
    return ratio, z


def slots_of(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the kept buckets, and the place of each among them."""
    wanted, slot = np.zeros(1 << BUCKET_BITS, bool), np.zeros(1 << BUCKET_BITS, np.int32)
    wanted[buckets], slot[buckets] = True, np.arange(len(buckets))
    return wanted, slot


def solve(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on scaled presence, classes balanced."""
    labels = np.asarray(labels, np.float64)
    value = scale[cols]
    balance = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    w, bias = np.zeros(len(scale)), -1.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, 301):
        logit = np.bincount(rows, value * w[cols], len(labels)) + bias
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * balance
        g = np.bincount(cols, value * error[rows], len(w)) + 1e-4 * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 - 0.9**step) * np.sqrt(1 - 0.999**step)
        w -= rate * m / (np.sqrt(v) + 1e-10)
        bias -= rate * mb / (np.sqrt(vb) + 1e-10)
    return w * scale, min(float(bias), -0.5)


def fit(texts: list[str | None], labels: np.ndarray, features: int = FEATURES) -> Model | None:
    """A model from labelled texts in memory; None where a class is missing."""
    labels = np.asarray(labels, np.int64)
    positive, negative = int(labels.sum()), int((1 - labels).sum())
    if not positive or not negative:
        return None
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int32)
    add_counts(counts, texts, labels)
    seen = np.flatnonzero(counts.sum(0) >= MIN_DOCS)
    ratio, z = ratio_and_weight(counts[1, seen], counts[0, seen], positive, negative)
    best = np.sort(np.lexsort((seen, -z))[:features])
    wanted, slot = slots_of(seen[best])
    rows, cols = [], []
    for lo, hi in blocks(texts):
        r, b = present(*text_points(texts[lo:hi]), wanted)
        rows.append(r + lo)
        cols.append(slot[b])
    return Model(seen[best], ratio[best], *solve(np.concatenate(rows), np.concatenate(cols), labels, ratio[best]))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_class: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(toxic, nth, text): a bounded sample of the training fold, nth in each class.

    Each class has half of ``chars`` to itself; a text over a sixteenth of that is
    passed over.  A document with several rows counts once, with its smallest text.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("draw", fraction_hash(F.col("doc_id"), seed=5))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rate = F.lit(0.0)
    for label, n in sizes.items():
        rate = F.when(F.col("toxic") == label, F.lit(min(1.0, rows_per_class / n))).otherwise(rate)
    drawn = F.broadcast(known.where(F.col("draw") < rate))  # about rows_per_class ids of each class
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    joined = texts.join(drawn, "doc_id").where(size <= chars // 32).groupBy("doc_id", "toxic", "draw").agg(F.min("text").alias("text"))
    order = Window.partitionBy("toxic").orderBy("draw", "doc_id")
    told = joined.withColumns({"nth": F.row_number().over(order), "so_far": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return written(told.where(F.col("so_far") <= chars // 2).select("toxic", "nth", "text"), "toxic-sample")


def train(docs: DataFrame, labels: DataFrame, features: int = FEATURES, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """A model from the labelled documents; None where a class is missing.

    Grams are counted on the executors; the driver gets the kept buckets, and of each
    sampled text which of them it has.
    """
    sample = labelled_sample(docs, labels, sample_rows, sample_chars)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    if not positive or not negative:
        return None
    dealt = sample.repartition(COUNT_TASKS)

    def counted(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        for b in batches:
            add_counts(total, b.column(1).to_pylist(), b.column(0).to_numpy())
        release_memory()
        at = np.flatnonzero(total.any(0))
        for lo in range(0, len(at), 1 << 18):
            own = at[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[1, own]), pa.array(total[0, own])], names=["bucket", "toxic", "clean"])

    def weighed(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ratio, z = ratio_and_weight(b.column(1).to_numpy(), b.column(2).to_numpy(), positive, negative)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ratio), pa.array(z)], names=["bucket", "ratio", "z"])

    counts = dealt.select("toxic", "text").mapInArrow(counted, "bucket int, toxic int, clean int")
    counts = counts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") + F.col("clean") >= MIN_DOCS)
    best = counts.mapInArrow(weighed, "bucket int, ratio double, z double").orderBy(F.col("z").desc(), "bucket").limit(features)
    best = sorted((r.bucket, r.ratio) for r in best.collect())
    buckets, ratios = np.array([x[0] for x in best], np.int64), np.array([x[1] for x in best])

    def marked(batches: Iterator[pa.RecordBatch]):
        wanted, slot = slots_of(buckets)
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in blocks(texts):
                part = b.slice(lo, hi - lo)
                rows, found = present(*text_points(texts[lo:hi]), wanted)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=part.num_rows))])
                held = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(slot[found], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), held], names=["toxic", "nth", "slots"])

    told = dealt.select("toxic", "nth", "text").mapInArrow(marked, "toxic int, nth int, slots array<int>").toArrow().sort_by([("toxic", "ascending"), ("nth", "ascending")])
    slots = told.column("slots").combine_chunks()
    rows = np.repeat(np.arange(told.num_rows), np.diff(slots.offsets.to_numpy()))
    return Model(buckets, ratios, *solve(rows, slots.flatten().to_numpy(), told.column("toxic").to_numpy(), ratios))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score", reject: float | None = None) -> DataFrame:
    """Add the score of every text; with ``reject``, keep only rows below it."""
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        own = held.value
        wanted, weight = own.dense() if own else (None, None)
        for b in slices(batches, text_col, 4 << 20):
            if own is None:
                value = np.zeros(b.num_rows)
            else:
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                rows, buckets = present(*text_points(texts), wanted)
                logit = np.bincount(rows, weight[buckets], len(texts)) + own.intercept
                value = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(value)], names=[*b.schema.names, score_col])
            yield out if reject is None else out.filter(pa.array(value < reject))

    return docs.mapInArrow(run, schema)


def score_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
