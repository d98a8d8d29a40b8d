"""SimHash near-duplicates by pivot distance tables.

A fingerprint has a bit set where over half of the shingle hashes have it.  The
distances of each distinct fingerprint to many reference fingerprints are laid
down in a table.  The references come in bands: those of a band have bits inside
it only, so their distance less the distance to the zero reference depends on the
bits of that band alone.  Two fingerprints that differ in at most ``max_bits``
bits leave all but ``max_bits`` bands untouched, hence agree on the coordinates of
some choice of the other bands; each choice gives one bucket key (a hash of its
coordinates), and no linked pair lacks a common bucket.  (As the references of a band
are independent, their distances determine its bits: a key amounts to the bits of two
bands of sixteen.  That is what makes it lossless.)  Pairs of a bucket are
discarded where any coordinate to further references differs by more than
``max_bits`` (triangle inequality), and survivors are verified bit by bit.

Buckets of more than ``bucket_cap`` fingerprints never form pairs.  Their members
go an exact other way: each gives the 65 values within one bit of it; members that
share such a value are within two bits of each other, at most 65 share one, and a
chain through it links them.  (It covers max_bits of 1 and 2.)

Components of the links come from star contraction in the shared folder; only
counts reach the driver.

Defined cases: null or empty text has fingerprint zero, linked like any other;
a text with fewer words than the shingle is one shingle; rows with null ``doc_id``
link but name no component: their component is the smallest known ``doc_id``, or
null; repeated rows give repeated results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, slices, written

BANDS = 4
REFERENCES_PER_BAND = 16
#: Random references whose coordinates discard pairs, 7 bits each in one long.
SCREEN_REFERENCES = 8
BUCKET_CAP = 64
PIECE_BYTES = 1 << 20
SEED = 42
LANES = np.array([[(v >> j) & 1 for j in range(8)] for v in range(256)], np.uint8).view(np.uint64).ravel()


def word_pieces(data: bytes, width: int) -> Iterator[list[bytes]]:
    """The words of a text in pieces that overlap by ``width`` - 1 words."""
    if len(data) <= PIECE_BYTES:
        yield data.split()
        return
    at, held = 0, []
    while at < len(data):
        end = at + PIECE_BYTES
        while end < len(data) and not data[end : end + 1].isspace():
            step = data[end : end + 4096].split(None, 1)
            end += len(step[0]) if step else 4096
        words = held + data[at:end].split()
        at = end
        if len(words) < width and at < len(data):
            held = words
            continue
        yield words
        held = words[len(words) - width + 1 :] if width > 1 else []
        if at >= len(data):
            return
        if not data[at:].strip():
            return


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words joined by a space."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)


def bit_counts(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each run of hashes: (runs, 64)."""
    out = np.zeros((len(lengths), 64), np.int64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    lengths = lengths[full]
    starts = np.cumsum(lengths) - lengths
    # Byte lanes hold up to 255 ones: sum short runs first, then the runs of a text.
    per = -(-lengths // 255)
    first = np.cumsum(per) - per
    cuts = np.repeat(starts - 255 * first, per) + 255 * np.arange(per.sum())
    data = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        short = np.add.reduceat(LANES[data[:, k]], cuts).view(np.uint8).reshape(-1, 8)
        out[full, 8 * k : 8 * k + 8] = np.add.reduceat(short.astype(np.int64), first, axis=0)
    return out


def fingerprint_block(texts: list[str | None], width: int) -> np.ndarray:
    """The 64-bit fingerprints of some texts."""
    parts, lengths, owner = [], [], []
    for i, text in enumerate(texts):
        for words in word_pieces((text or "").encode("utf-8", "surrogatepass").lower(), width):
            h = shingle_hashes(words, width)
            parts.append(h)
            lengths.append(len(h))
            owner.append(i)
    counts, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    if parts:
        np.add.at(counts, owner, bit_counts(np.concatenate(parts), np.array(lengths)))
        np.add.at(n, owner, lengths)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(df: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, text_col, 4 << 20):
            fp = fingerprint_block(b.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(run, "doc_id long, fp long")


def references() -> tuple[np.ndarray, np.ndarray]:
    """Band references (bands, per band) and the screening references; fixed by a seed."""
    rng = np.random.default_rng(20240131)
    size = 64 // BANDS
    bands = np.zeros((BANDS, REFERENCES_PER_BAND), np.uint64)
    for b in range(BANDS):
        while True:  # independent references tell all bits of a band apart
            rows = rng.integers(0, 2, (REFERENCES_PER_BAND, size))
            if np.linalg.matrix_rank(rows) == size:
                break
        weights = np.uint64(1) << np.arange(b * size, (b + 1) * size, dtype=np.uint64)
        bands[b] = (rows.astype(np.uint64) * weights).sum(1, dtype=np.uint64)
    return bands, rng.integers(0, 1 << 64, SCREEN_REFERENCES, np.uint64, endpoint=False)


def pivot_rows(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys (fingerprints, choices) and packed screening coordinates."""
    bands, screen = references()
    zero = np.bitwise_count(fp).astype(np.int64)
    table = np.stack([np.bitwise_count(fp[:, None] ^ own[None, :]).astype(np.int64) - zero[:, None] for own in bands], 1)
    rng = np.random.default_rng(77)
    keys = []
    for chosen in combinations(range(BANDS), BANDS - max_bits):
        odd = rng.integers(0, 1 << 63, (len(chosen), table.shape[2]), np.int64) | 1
        with np.errstate(over="ignore"):
            keys.append((table[:, list(chosen), :] * odd[None]).sum((1, 2)) + np.int64((len(keys) * 0x5851F42D4C957F2D) & 0x7FFFFFFFFFFFFFFF))
    packed = np.zeros(len(fp), np.int64)
    for k, p in enumerate(screen):
        packed |= np.bitwise_count(fp ^ p).astype(np.int64) << np.int64(7 * k)
    return np.stack(keys, 1), packed


def links(distinct: DataFrame, max_bits: int = 2, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``max_bits`` bits.

    ``distinct`` has one row per fingerprint, in a long column fp.
    """
    if not 1 <= max_bits <= 2:
        raise ValueError("max_bits is 1 or 2")

    def expand(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 1 << 15):
                own = fp[at : at + (1 << 15)]
                keys, packed = pivot_rows(own.view(np.uint64), max_bits)
                n = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(own, n)), pa.array(np.repeat(packed, n))], names=["bucket", "fp", "pivots"])

    table = written(distinct.select("fp").mapInArrow(expand, "bucket long, fp long, pivots long"), "pivots")
    sizes = table.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes, "buckets")
    light = table.join(sizes.where(F.col("n") <= bucket_cap).select("bucket"), "bucket", "left_semi")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits
    screened = F.lit(True)
    for k in range(SCREEN_REFERENCES):
        gap = [F.shiftright(F.col(f"{s}.pivots"), 7 * k).bitwiseAND(F.lit(127)) for s in "xy"]
        screened = screened & (F.abs(gap[0] - gap[1]) <= max_bits)
    light = written(light, "light")
    pairs = light.alias("x").join(light.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.fp") < F.col("y.fp")) & screened & near)
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    heavy = table.join(sizes.where(F.col("n") > bucket_cap).select("bucket"), "bucket", "left_semi").select("fp").distinct()
    ones = F.array(F.lit(0).cast("long"), *[F.lit(v if v < 1 << 63 else v - (1 << 64)).cast("long") for v in (1 << i for i in range(64))])
    around = heavy.select("fp", F.explode(F.transform(ones, lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
    # At most 65 distinct fingerprints are within one bit of a centre.
    star = around.groupBy("centre").agg(F.collect_list("fp").alias("own")).where(F.size("own") > 1)
    if max_bits == 1:
        star = star.where(F.array_contains("own", F.col("centre")))
        hub = F.col("centre")
    else:
        hub = F.array_min("own")
    star = star.select(hub.alias("a"), F.explode("own").alias("b")).where("a <> b")
    return pairs.unionByName(star)


def near_groups(df: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every row: the smallest doc_id reachable."""
    own = written(fingerprints(df, width, id_col, text_col), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    member = connected_components(links(distinct, max_bits)).withColumnRenamed("node", "fp")
    member = written(member.join(distinct, "fp"), "members")
    lowest = member.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = member.join(lowest, "component").select("fp", F.col("component_id").alias("linked"))
    labels = distinct.join(linked, "fp", "left").select("fp", F.coalesce("linked", "low").alias("component_id"))
    return own.join(written(labels, "labels"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_table(df: DataFrame) -> DataFrame:
    """The contract's view: 3-word shingles, 2 bits, hexadecimal fingerprints."""
    out = near_groups(df, 3, 2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- Near copies by shingle similarity, for filtering a corpus -------------------
#
# Texts that share four fifths of their shingles differ in some 15 % of their
# fingerprint bits, unrelated ones in half.  Bucket keys of fingerprint bits or of
# distances to references then need tables whose number grows with the corpus, as
# unrelated texts meet by chance.  So copies within two bits come from the pivot
# distance tables above, which miss none of them; for those further apart there are
# bucket keys of least shingle hashes, which unrelated texts never share: their number
# is fixed.  Fingerprints (256 bits) and their distances discard, and the shingle sets verify.

SIMILAR_WORDS = 4
#: Tables, and least hashes that make up the key of one.  At a similarity of 0.8 a
#: pair shares a key of one table with a chance of 0.8 ** 5, of none with 0.0017.
TABLES, MINIMA = 16, 5
#: Of the first 64 bits; copies at a similarity of 0.8 differ in 10 with a deviation of 3.
SIMILAR_MAX_BITS = 22
#: Of all 256 bits: copies at 0.8 differ in 39 with a deviation of 6, others in 128.
SIMILAR_ALL_BITS = 64
#: Texts of a bucket up to which all its pairs are formed.
SIMILAR_CAP = 64
#: Bits that tell texts worth a second look apart: 16 MB, whatever the corpus.
NEEDED_BITS = 1 << 27
#: Rows of a large group that one task takes with as many others, and at once.
EXACT_BLOCK, EXACT_STRIP = 1 << 12, 32
#: Bytes of shingle sets in such a block, and of the bit rows that a task lays out for two of them.
EXACT_BYTES, LAID_BYTES = 8 << 20, 64 << 20


def min_keys(h: np.ndarray, lengths: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The bucket of each run of shingle hashes in each table: (runs, TABLES).

    ``none`` is the key of a run without hashes.
    """
    rng = np.random.default_rng(818)
    out = np.repeat(none[:, None], TABLES, 1)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    starts = (np.cumsum(lengths) - lengths)[full]
    for t in range(TABLES):
        key = np.full(len(full), t + 1, np.uint64)
        for mask, odd in rng.integers(0, 1 << 64, (MINIMA, 2), np.uint64, endpoint=False):
            least = np.minimum.reduceat((h ^ mask) * (odd | np.uint64(1)), starts)
            key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[full, t] = key
    return out


def wide_block(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of the word sequence, a fingerprint of ``SIMILAR_WORDS`` longs and the
    bucket keys per text.  A shingle counts once, however often the text
    repeats it: the fingerprints of equal sets are equal."""
    keys, sets = zip(*[keyed_set(t, width) for t in texts]) if texts else ((), ())
    node = np.array(keys, np.uint64)
    fp = np.zeros((len(texts), SIMILAR_WORDS), np.uint64)
    buckets = np.zeros((len(texts), TABLES), np.uint64)
    if texts:
        h, n = np.concatenate(sets), np.array([len(x) for x in sets])
        buckets = min_keys(h, n, node)
        for w in range(SIMILAR_WORDS):
            fp[:, w] = np.packbits(2 * bit_counts(h, n) > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return node, fp, buckets


def links_in_cell(node: np.ndarray, component: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of ``left`` and ``right`` that join all components that any pair
    of them at the threshold joins; texts linked already are not compared again.

    Pairs that 256 bits leave are measured exactly: the shingles that two texts have
    at least are numbered, and each text is a row of bits.  Where such rows would take
    more than ``LAID_BYTES``, the sorted sets themselves are intersected.
    """
    size = np.array([len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    words = int((count > 1).sum()) // 64 + 1
    rows = None
    if 8 * words * len(sets) <= LAID_BYTES:
        column, held = np.cumsum(count > 1) - 1, (count > 1)[place]
        owner, column = np.repeat(np.arange(len(sets)), size)[held], column[place[held]]
        rows = np.zeros((len(sets), words), np.uint64)
        np.bitwise_or.at(rows, (owner, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    del place, count
    component, a, b = component.copy(), [], []
    for at in range(0, len(left), EXACT_STRIP):
        strip = left[at : at + EXACT_STRIP]
        away = np.zeros((len(strip), len(right)), np.uint16)
        for w in range(SIMILAR_WORDS):
            away += np.bitwise_count(fp[strip, w][:, None] ^ fp[right, w][None, :])
        for x, near in zip(strip.tolist(), away <= SIMILAR_ALL_BITS):
            others = right[near & (component[right] != component[x])]
            if not len(others):
                continue
            if rows is not None:
                common = np.bitwise_count(rows[others] & rows[x]).sum(1, dtype=np.int64)
            else:
                common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in others])
            for y in others[common >= threshold * (size[x] + size[others] - common)].tolist():
                if component[y] != component[x]:
                    a.append(node[x])
                    b.append(node[y])
                    component[component == component[y]] = component[x]
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return np.minimum(a, b), np.maximum(a, b)


def near_in_runs(run: np.ndarray, node: np.ndarray, bits: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within runs of few rows that are of different components and that the
    first 64 bits leave."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bits = bits.view(np.uint64)  # of a signed number, bitwise_count takes the absolute value
    for gap in range(1, len(run)):
        at = np.flatnonzero(run[:-gap] == run[gap:])
        if not len(at):
            break
        at = at[(component[at] != component[at + gap]) & (np.bitwise_count(bits[at] ^ bits[at + gap]) <= SIMILAR_MAX_BITS)]
        left.append(node[at])
        right.append(node[at + gap])
    x, y = np.concatenate(left), np.concatenate(right)
    return np.minimum(x, y), np.maximum(x, y)


def middles(starts: np.ndarray, node: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs that begin at ``starts``: the row of each row's middle, which rows are
    middles, and how many of the first 64 bits a row differs from its middle in.

    The middle of a run is the row nearest to its majority fingerprint.
    """
    size = np.diff(np.append(starts, len(node)))
    run = np.repeat(np.arange(len(starts)), size)
    ones = np.add.reduceat(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32), starts, axis=0)
    majority = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    away = np.bitwise_count(bits.view(np.uint64) ^ majority[run])
    order = np.lexsort((node, away, run))
    hub = order[starts][run]
    return hub, hub == np.arange(len(node)), np.bitwise_count((bits ^ bits[hub]).view(np.uint64)).astype(np.int64)


def keyed_set(text: str | None, width: int) -> tuple[int, np.ndarray]:
    """The hash of a text's word sequence and its distinct shingle hashes, sorted."""
    key, parts = xxhash.xxh3_64(), [np.zeros(0, np.uint64)]
    for words in word_pieces((text or "").encode("utf-8", "surrogatepass").lower(), width):
        parts.append(shingle_hashes(words, width))
        key.update(parts[-1].tobytes())
    return key.intdigest(), np.unique(np.concatenate(parts))


def marked_ids(ids: DataFrame, bits: int = NEEDED_BITS) -> np.ndarray:
    """A bit map of bounded size in which the bits of all ids are set."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    rows = ids.select(place.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        piece = np.frombuffer(r["m"], np.uint8)
        at = (r["k"] - 1) * len(piece)
        out[at : at + len(piece)] = piece[: len(out) - at]
    return out


def heavy_hubs(heavy: DataFrame) -> DataFrame:
    """(node, hub, away): a middle for each row of a large bucket (bucket, node, bits, n).

    A bucket is dealt in blocks; each has its middle, and the middles are rows of the
    next round, until a bucket has one.  No task takes more than a few blocks.
    """

    def middle(cell: pa.Table) -> pa.Table:
        node, bits = (cell.column(c).to_numpy() for c in ("node", "bits"))
        hub, lead, away = middles(np.zeros(1, np.int64), node, bits)
        return pa.table({"bucket": cell.column("bucket"), "node": node, "hub": node[hub], "away": away, "bits": bits, "lead": lead})

    out, level = None, heavy.select("bucket", "node", "bits", "n")
    while True:
        cells = level.withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("n") / EXACT_BLOCK)))
        cells = cells.select("bucket", "part", "node", "bits").groupBy("bucket", "part")
        told = written(cells.applyInArrow(middle, "bucket long, node long, hub long, away long, bits long, lead boolean"), "hubs")
        own = told.where("not lead").select("node", "hub", "away")
        out = own if out is None else out.unionByName(own)
        leads = told.where("lead").select("bucket", "node", "bits")
        level = leads.join(leads.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket")
        level = written(level, "leads")
        if level.isEmpty():
            return out


def rare_groups(grams: DataFrame, threshold: float) -> DataFrame:
    """(h, node, bytes): each text under its rarest shingles, so many that two texts at the
    threshold share one of them; the bytes of its set.

    ``grams`` has the sorted shingle hashes of each node.  Of n shingles, in one order
    for all texts, texts that share ``threshold`` of their union share one of the first
    n - ceil(threshold * n) + 1.  The order is by the number of texts that have a
    shingle: what many have comes last.
    """

    def spread(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "grams", 4 << 20):
            held = b.column(1).to_pylist()
            n = np.array([len(x) // 8 for x in held])
            h = np.frombuffer(b"".join(held), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(n, n), pa.int64())], names=["h", "node", "n"])

    rows = written(grams.select("node", "grams").mapInArrow(spread, "h long, node long, n long"), "rare-grams")
    counts = written(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "rare-counts")
    # Shingles of one text only come first in its order, and meet no other.
    first = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("own"))
    held = rows.join(counts, "h").groupBy("node").agg(F.first("n").alias("n"), F.collect_list(F.struct("df", "h")).alias("own"))
    held = held.withColumn("first", first.cast("int")).where("first > 0")
    held = held.select("node", (8 * F.col("n")).alias("bytes"), F.explode(F.slice(F.array_sort("own"), 1, F.col("first"))).alias("g"))
    return held.select(F.col("g.h").alias("h"), "node", "bytes")


def exact_links(rare: DataFrame, distinct: DataFrame, grams: DataFrame, threshold: float, across: bool) -> DataFrame:
    """(a, b): links within groups of ``rare`` (h, node, bytes, component) that hold texts of several components.

    A group is dealt to blocks bounded by rows and by bytes of their sets.  Each block
    meets itself, and every set is sent once; or, ``across``, each two blocks meet,
    for what is not linked by then.
    """
    # Shingles of one passage have the same texts: these meet once.
    same = [F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("t")]
    most = rare.groupBy("h").agg(*same, F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    parts = F.ceil(F.greatest(F.col("n") / EXACT_BLOCK, F.col("bytes") / EXACT_BYTES)).cast("int")
    most = most.groupBy("n", "bytes", "s", "t").agg(F.min("h").alias("h")).select("h", parts.alias("parts"))
    if across:
        most = most.where("parts > 1")
    cells = rare.drop("bytes").join(written(most, "rare-open"), "h").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    if across:
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> other")
        cells = cells.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    else:
        cells = cells.withColumns({"i": F.col("part"), "j": F.col("part")})
    cells = cells.join(distinct.select("node", "fp"), "node").join(grams.select("node", "grams"), "node")

    def compare(cell: pa.Table) -> pa.Table:
        node, component, part = (cell.column(c).to_numpy() for c in ("node", "component", "part"))
        fp = np.frombuffer(b"".join(cell.column("fp").to_pylist()), np.uint64).reshape(-1, SIMILAR_WORDS)
        sets = [np.frombuffer(g, np.uint64) for g in cell.column("grams").to_pylist()]
        first = part == part.min()
        # A block meets another one, or itself.
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        a, b = links_in_cell(node, component, fp, sets, left, right if len(right) else left, threshold)
        return pa.table({"a": a, "b": b})

    return cells.groupBy("h", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def pivot_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b, away): texts whose first 64 bits are at most two apart, by the pivot distance tables.

    ``distinct`` has a node and its fingerprint in each row.  Texts of equal bits are
    paired with the first of their block, these with the first of all, and the firsts
    with each other where ``links`` has them.
    """

    def head(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            bits = np.array([x[:8] for x in b.column(1).to_pylist()], "S8").view(np.int64) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits)], names=["node", "fp"])

    own = written(distinct.select("node", "fp").mapInArrow(head, "node long, fp long"), "pivot-bits")
    firsts = written(own.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "pivot-distinct")
    alike = own.join(firsts.where("n > 1"), "fp").withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("n") / EXACT_BLOCK)))
    leads = alike.groupBy("fp", "part").agg(F.min("node").alias("lead"), F.first("first").alias("first"))
    to_lead = alike.select("fp", "part", "node").join(leads, ["fp", "part"]).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    to_first = leads.select(F.col("lead").alias("a"), F.col("first").alias("b"))
    equal = to_lead.unionByName(to_first).where("a <> b").withColumn("away", F.lit(0).cast("long"))
    sides = [firsts.select(F.col("fp").alias(f"f{k}"), F.col("first").alias(k)) for k in "ab"]
    near = links(firsts.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb")).distinct()
    apart = near.join(sides[0], "fa").join(sides[1], "fb").select("a", "b", F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))).cast("long").alias("away"))
    return written(equal.unionByName(apart), "pivot-pairs")


def similar_groups(docs: DataFrame, width: int = 5, threshold: float = 0.8, cap: int = SIMILAR_CAP) -> DataFrame:
    """(doc_id, component_id): the smallest id of each group of near copies.

    Two texts are linked where the Jaccard similarity of their shingle sets is
    ``threshold`` or more; groups are the components of the links.  Candidates are the
    links of the pivot distance tables (``pivot_pairs``), all of them compared, and what
    a fixed number of further tables has.  First each text is held against the nearest of
    these links and of the middle texts of its buckets, so that a group of thousands costs a pair per text.
    Texts that share a bucket and are not linked yet are then compared exactly: in
    buckets of up to ``cap`` texts all pairs that the first 64 bits leave; of larger
    ones all that share one of their rarest shingles (``rare_groups`` misses no pair),
    in blocks that give out no more links than they have texts.
    Texts without words form one group; rows without ``doc_id`` are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")

    def marks(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "text", 4 << 20):
            key, fp, buckets = wide_block(b.column(1).to_pylist(), width)
            cols = [pa.array([x.tobytes() for x in v], pa.binary()) for v in (fp, buckets)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key.view(np.int64)), *cols], names=["doc_id", "node", "fp", "keys"])

    own = written(rows.mapInArrow(marks, "doc_id long, node long, fp binary, keys binary"), "wide")
    distinct = own.groupBy("node").agg(F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in ("fp", "keys")])
    distinct = written(distinct, "wide-distinct")

    def expand(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            node = b.column(0).to_numpy()
            first = np.array([x[:8] for x in b.column(1).to_pylist()], "S8").view(np.int64) if b.num_rows else np.zeros(0, np.int64)
            buckets = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.repeat(node, TABLES)), pa.array(np.repeat(first, TABLES))], names=["bucket", "node", "bits"])

    table = written(distinct.select("node", "fp", "keys").mapInArrow(expand, "bucket long, node long, bits long"), "tables")
    sizes = written(table.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = written(table.join(sizes, "bucket").select("bucket", "node", "bits", "n"), "shared")

    def hubs_of(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            held = b.column(0)
            node, bits = (x.to_numpy() for x in held.flatten().flatten())
            starts = held.offsets.to_numpy()
            hub, lead, away = middles(starts[:-1] - starts[0], node, bits) if len(held) else (np.zeros(0, np.int64),) * 3
            rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (node, node[hub], away)], names=["node", "hub", "away"])
            yield rows.filter(pa.array(~lead.astype(bool)))

    def pairs_of(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            held = b.column(0)
            node, bits, component = (x.to_numpy() for x in held.flatten().flatten())
            run = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in near_in_runs(run, node, bits, component)], names=["a", "b"])

    light = shared.where(F.col("n") <= cap).groupBy("bucket").agg(F.collect_list(F.struct("node", "bits")).alias("own"))
    hubs = light.select("own").mapInArrow(hubs_of, "node long, hub long, away long")
    heavy = shared.where(F.col("n") > cap)
    if large := not heavy.isEmpty():
        hubs = hubs.unionByName(heavy_hubs(heavy))
    pivots = pivot_pairs(distinct)
    hubs = hubs.unionByName(pivots.select(F.col("a").alias("node"), F.col("b").alias("hub"), "away"))
    # The nearest link or middle of each text.
    nearest = hubs.where(F.col("away") <= SIMILAR_MAX_BITS).groupBy("node").agg(F.min(F.struct("away", "hub"))["hub"].alias("hub"))
    # All bits of both before any text is fetched: chance pairs end here.
    sides = [distinct.select(F.col("node").alias(k), F.col("fp").alias(f"f{k}")) for k in "ab"]

    def screen(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(-1, SIMILAR_WORDS) for i in (2, 3))
            near = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= SIMILAR_ALL_BITS
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(near))

    def screened(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "fa", "fb")
        return written(both.mapInArrow(screen, "a long, b long"), name)

    def overlap(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if min(len(x), len(y)) < threshold * max(len(x), len(y)):
            return False
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common >= threshold * (len(x) + len(y) - common)

    def verify(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "ga", 8 << 20):
            keep = [overlap(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # The sets of all texts that share a bucket or have a link.  The bit map leaves out most others
    # before their sets are made, and the join those that it cannot tell apart; no text
    # is shuffled.
    nearest = screened(nearest.select(F.col("node").alias("a"), F.col("hub").alias("b")), "nearest").withColumnsRenamed({"a": "node", "b": "hub"})
    heads = nearest.select(F.col("hub").alias("node")).distinct().withColumn("head", F.lit(True))
    meet = shared.select("node").unionByName(pivots.select(F.col("a").alias("node"))).unionByName(pivots.select(F.col("b").alias("node")))
    needed = distinct.select("node", F.col("low").alias("doc_id")).join(meet.distinct(), "node")
    needed = written(needed.join(nearest, "node", "left").join(heads, "node", "left"), "needed")
    marked = docs.sparkSession.sparkContext.broadcast(marked_ids(needed))

    def sets(batches: Iterator[pa.RecordBatch]):
        bits = marked.value
        for b in batches:
            place = b.column(2).to_numpy()
            b = b.filter(pa.array((bits[place >> 3] >> (place & 7) & 1).astype(bool)))
            for part in slices([b], "text", 4 << 20):
                held = [keyed_set(t, width) for t in part.column(1).to_pylist()]
                node = np.array([k for k, _ in held], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node), pa.array([g.tobytes() for _, g in held], pa.binary())], names=["doc_id", "node", "grams"])

    found_sets = rows.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(NEEDED_BITS))).mapInArrow(sets, "doc_id long, node long, grams binary")
    grams = written(found_sets.join(needed, ["node", "doc_id"]).select("node", "hub", "head", "grams"), "grams")
    if not grams.groupBy("node").count().where("count > 1").isEmpty():  # repeated rows
        grams = written(grams.groupBy("node").agg(*[F.first(c).alias(c) for c in ("hub", "head", "grams")]), "grams-once")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
        both = both.join(grams.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b").select("a", "b", "ga", "gb")
        return both.mapInArrow(verify, "a long, b long")

    # Each set travels once, to that of its middle.
    members = grams.where("hub is not null").select("hub", F.col("node").alias("a"), F.col("grams").alias("ga"))
    middle_sets = grams.where("head").select(F.col("node").alias("hub"), F.col("grams").alias("gb"))
    first = members.join(middle_sets, "hub").select("a", F.col("hub").alias("b"), "ga", "gb")
    # What the pivot tables have beside the nearest is compared as well.
    tried = nearest.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    beside = pivots.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(tried, ["a", "b"], "left_anti")
    found = connected_components(first.mapInArrow(verify, "a long, b long").unionByName(verified(beside)), "similar")
    named = shared.join(found, "node", "left").select("bucket", "node", "bits", "n", F.coalesce("component", "node").alias("component"))
    named = written(named, "named")
    # Buckets of one component have nothing to add.
    open_ = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    left = written(named.join(open_, "bucket", "left_semi"), "open")
    if not left.isEmpty():
        light = left.where(F.col("n") <= cap).groupBy("bucket").agg(F.collect_list(F.struct("node", "bits", "component")).alias("own"))
        pairs = light.select("own").mapInArrow(pairs_of, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
        more = verified(screened(pairs, "more"))
        if large:
            left = left.where(F.col("n") > cap).select("node", "component").distinct()
            rare = written(rare_groups(grams.join(left.select("node"), "node", "left_semi"), threshold).join(left, "node"), "rare")
            inside = written(exact_links(rare, distinct, grams, threshold, False), "inside-links")
            if not inside.isEmpty():
                # What blocks have linked within is one component before blocks meet each other.
                known = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(inside)
                again = connected_components(known, "similar-inside").select("node", F.col("component").alias("again"))
                rare = rare.join(again, "node", "left").withColumn("component", F.coalesce("again", "component")).drop("again")
                more = more.unionByName(inside)
            more = more.unionByName(exact_links(written(rare, "rare-left"), distinct, grams, threshold, True))
        more = written(more, "more-links")
        if not more.isEmpty():
            known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = connected_components(known.unionByName(more), "similar-more")
    member = written(found.join(distinct.select("node", "low"), "node"), "similar-members")
    lowest = member.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = member.join(lowest, "component").select("node", F.col("component_id").alias("linked"))
    labels = distinct.join(linked, "node", "left").select("node", F.coalesce("linked", "low").alias("component_id"))
    return own.select("doc_id", "node").join(written(labels, "similar-labels"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents but for near copies of one with a smaller ``doc_id``.

    Rows without ``doc_id`` stay; rows that share one stay or go together.
    """
    gone = similar_groups(docs, width, threshold).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
