"""Merkle manifest of a dataset: a hash tree per group, one tree over the groups.

A row's leaf hashes its fields with their lengths.  Leaves of a group stand in
ascending order of the id; every two consecutive nodes become the hash of both (a
last one without partner the hash of itself) until one is left, the group's
subroot.  The subroots, in byte order of the group with null first, give the root
in the same way.

The trees are reduced as a monoid of sparse forests.  A forest maps (tree, level,
index) to the width of that level and a digest; ``combine`` unites two forests and
replaces every run of siblings that is complete by its parent.  The width tells
how many siblings a run has, so the result depends neither on the order nor on the
grouping of the operands.  Rows are range-sorted into parts of bounded size; a
part's forest keeps only the nodes whose siblings lie elsewhere, a few per level.
The tree reduction unites neighbouring forests, ``FAN_IN`` at a time and round
after round, each round a grouped table in the shared folder: neighbours complete
most runs at once, so a forest stays logarithmic all the way, a lost executor
repeats one group, and the driver sees the root alone.

A proof lists the siblings from the leaf to the root.  Within a part all but two
nodes per level are at hand; those two are looked up among the nodes that the
reduction has met.

Defined cases: null fields are ``-`` in a leaf; null ids come first; rows of one id
and group are ordered by their leaves; equal rows are leaves of their own, with
equal leaves; a lone leaf is its group's subroot, a lone subroot the root; empty
tables give no rows and the root ``None``; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_total, written

#: Rows of a part, about; fragments that a task of the reduction unites.
PART_ROWS = 32_768
FAN_IN = 64
#: The tree over the groups; those of the groups are numbered from 0.
UPPER = -1

Node = tuple[int, int, int]
Forest = dict[Node, tuple[int, str]]


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def settle(forest: Forest, trees: int, fresh: list[Node], made: Forest) -> Forest:
    """Replace complete runs around the nodes ``fresh`` until none is left; all new nodes go to ``made``."""
    todo = list(fresh)
    while todo:
        tree, level, index = node = todo.pop()
        if node not in forest:
            continue
        width, value = forest[node]
        if width == 1:
            if tree == UPPER:
                continue
            parent, entry = (UPPER, 0, tree), (trees, value)
            del forest[node]
        else:
            run = [(tree, level, k) for k in range(index & ~1, min((index | 1) + 1, width))]
            if any(k not in forest for k in run):
                continue
            parent, entry = (tree, level + 1, index >> 1), ((width + 1) >> 1, digest(*(forest.pop(k)[1] for k in run)))
        forest[parent] = made[parent] = entry
        todo.append(parent)
    return forest


def combine(a: Forest, b: Forest, trees: int, made: Forest | None = None) -> Forest:
    """The forest of all rows of two disjoint forests."""
    return settle({**a, **b}, trees, list(b), {} if made is None else made)


def field(name: str, value: Column | None = None) -> Column:
    """A column as it stands in a leaf: ``-``, or the byte count, a colon and the value."""
    held = (F.col(name) if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(held).cast("string"), F.lit(":"), held), F.lit("-"))


@dataclass
class Manifest:
    """rows: part, pos, doc_id, group, leaf, claimed; spans: where each group lies in each part;
    nodes: all nodes with siblings in another part and above; root: the digest over all."""

    rows: DataFrame
    spans: DataFrame
    nodes: DataFrame
    needs: DataFrame
    root: str | None


_NODE = "part long, tree long, level int, index long, width long, digest string"
_FRESH = f"{_NODE}, open boolean, made boolean"


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(list(c), t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


_NODE_ARROW = [("part", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("width", pa.int64()), ("digest", pa.string())]


def _outside(low: int, high: int, width: int) -> Iterator[tuple[int, int]]:
    """(level, index) of the siblings that the path from the nodes low to high needs from elsewhere."""
    level = 0
    while width > 1:
        if low & 1:
            yield level, low - 1
        if not high & 1 and high + 1 < width:
            yield level, high + 1
        low, high, width, level = low >> 1, high >> 1, (width + 1) >> 1, level + 1


def spans_of(rows: DataFrame) -> DataFrame:
    """(part, group, tree, start, total, first, n): each group's number, and its places in each part."""
    held = rows.groupBy("part", "group").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    held = written(held, "merkle-held")
    own = Window.partitionBy("group").orderBy("part")
    starts = held.select(
        "part", "group", "n", "first",
        F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.sum("n").over(Window.partitionBy("group")).alias("total"),
    )
    # A group is numbered in the part where it begins: behind all that begin in earlier parts.
    begun = held.groupBy("group").agg(F.min("part").alias("begins"))
    local = Window.partitionBy("begins").orderBy(F.col("group").asc_nulls_first())
    counts = running_total(begun.groupBy("begins").agg(F.count("*").alias("_n")), "begins", "_n", "_before")
    tree = begun.withColumn("_at", F.row_number().over(local) - 1).join(counts, "begins").select(F.col("group").alias("_g"), (F.col("_at") + F.col("_before")).alias("tree"))
    return starts.join(tree, F.col("group").eqNullSafe(F.col("_g"))).drop("_g")


def build(docs: DataFrame, fields: tuple[str, ...], claims: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "lang") -> Manifest:
    """Hash and reduce all rows.

    ``claims`` names fields that the holder of the data claims to have instead, by
    expressions; the column ``claimed`` is the leaf of these.
    """
    claims = claims or {}
    plain = {c: field(c) for c in fields}
    leaves = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(group_col).cast("string").alias("group"),
        F.sha2(F.concat(*plain.values()), 256).alias("leaf"),
        F.sha2(F.concat(*(field(c, claims[c]) if c in claims else x for c, x in plain.items())), 256).alias("claimed") if claims else F.lit(None).cast("string").alias("claimed"),
        F.monotonically_increasing_id().alias("_salt"),
    )
    leaves = written(leaves, "merkle-leaves")
    count = leaves.count()
    order = [F.col("group").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("_salt")]
    dealt = leaves.repartitionByRange(count // PART_ROWS + 1, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    rows = dealt.select(
        F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("pos"),
        "doc_id", "group", "leaf", F.coalesce("claimed", "leaf").alias("claimed"),
    )
    rows = written(rows, "merkle-rows")
    spans = written(spans_of(rows), "merkle-spans")
    trees, parts = spans.agg(F.max("tree") + 1, F.max("part") + 1).first()
    if not trees:
        empty = spans.sparkSession.createDataFrame([], _NODE)
        return Manifest(rows, spans, empty, empty.select("part", "tree", "level", "index"), None)

    def fragment(key: tuple[pa.Scalar, ...], own: pa.Table, places: pa.Table) -> pa.Table:
        """The unresolved nodes of a part, and (not open) the nodes that its proofs need."""
        part, leaves = key[0].as_py(), _ordered(own)["leaf"].to_pylist()
        forest: Forest = {}
        need, ranks = set(), []
        for p in places.to_pylist():
            ranks.append(p["tree"])
            need |= {(p["tree"], *x) for x in _outside(p["start"], p["start"] + p["n"] - 1, p["total"])}
            forest |= {(p["tree"], 0, p["start"] + k): (p["total"], leaves[p["first"] + k]) for k in range(p["n"])}
        need |= {(UPPER, *x) for x in _outside(min(ranks), max(ranks), trees)}
        made: Forest = {}
        settle(forest, trees, list(forest), made)
        out = [(part, *node, width, value, True, True) for node, (width, value) in forest.items()]
        out += [(part, *node, 0, "", False, False) for node in need]
        return _table(out, [*_NODE_ARROW, ("open", pa.bool_()), ("made", pa.bool_())])

    step = written(rows.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(fragment, _FRESH), "merkle-parts")
    needs = step.where("not made").select("part", "tree", "level", "index")
    met = [step.where("made").drop("open", "made", "part")]

    def unite(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        forests: dict[int, Forest] = {}
        for r in held.to_pylist():
            forests.setdefault(r["part"], {})[r["tree"], r["level"], r["index"]] = (r["width"], r["digest"])
        total, made = {}, {}
        for k in sorted(forests):
            total = combine(total, forests[k], trees, made)
        part = key[0].as_py()
        out = [(part, *node, *total[node], True, node in made) for node in total]
        out += [(part, *node, *made[node], False, True) for node in made if node not in total]
        return _table(out, [*_NODE_ARROW, ("open", pa.bool_()), ("made", pa.bool_())])

    turn = 0
    while parts > 1:
        turn += 1
        held = step.where("open").select((F.col("part") / FAN_IN).cast("long").alias("group"), "part", "tree", "level", "index", "width", "digest")
        step = written(held.groupBy("group").applyInArrow(unite, _FRESH), f"merkle-round-{turn}")
        met.append(step.where("made").drop("open", "made", "part"))
        parts = -(-parts // FAN_IN)
    nodes = met[0]
    for more in met[1:]:
        nodes = nodes.unionByName(more)
    root = step.where(f"open and tree = {UPPER} and width = 1").first()["digest"]
    return Manifest(rows, spans, nodes, needs, root)


def _ordered(rows: pa.Table) -> pa.Table:
    return rows.sort_by("pos")


def climb(low: int, values: list[str], width: int, outside: dict[tuple[int, int], str]) -> tuple[list[tuple[int, list[str | None]]], list[str]]:
    """Of neighbouring nodes: per level (first index, the sibling of each node), and what stands on top."""
    levels = []
    level = 0
    while width > 1:
        high = low + len(values) - 1
        left = [outside[level, low - 1]] if low & 1 else []
        right = [outside[level, high + 1]] if not high & 1 and high + 1 < width else []
        known, base = left + values + right, low - len(left)
        beside = [known[(k ^ 1) - base] if (k ^ 1) < width else None for k in range(low, high + 1)]
        levels.append((low, beside))
        values = [digest(*known[k : k + 2]) for k in range(0, len(known), 2)]
        low, width, level = base >> 1, (width + 1) >> 1, level + 1
    return levels, values


def path_of(levels: list[tuple[int, list[str | None]]], index: int) -> list[tuple[int, str | None]]:
    """(1 if the sibling stands to the left, sibling or None) from a node up to its top."""
    return [(index >> k & 1, beside[(index >> k) - low]) for k, (low, beside) in enumerate(levels)]


def fold(leaf: str, path: list[tuple[int, str | None]]) -> str:
    """The digest on top of a path, from its leaf."""
    for left, other in path:
        leaf = digest(leaf) if other is None else digest(other, leaf) if left else digest(leaf, other)
    return leaf


def proofs(manifest: Manifest) -> DataFrame:
    """(doc_id, group, leaf, subroot, root, proof, folded_root) of every row.

    ``proof`` is the list of siblings from the leaf to the root; ``folded_root`` is
    recomputed from the claimed leaf and these.
    """
    schema = "doc_id long, group string, leaf string, subroot string, root string, proof array<string>, folded_root string"
    root = manifest.root
    arrow = [("doc_id", pa.int64()), ("group", pa.string()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.list_(pa.string())), ("folded_root", pa.string())]
    keys = ["tree", "level", "index"]
    given = manifest.needs.join(manifest.nodes.select(*keys, "digest"), keys)
    # One table of what a part needs beside its rows: its spans, and the siblings from elsewhere.
    spans = manifest.spans.select("part", "tree", F.lit(None).cast("int").alias("level"), F.col("start").alias("index"), "n", "first", "total", F.lit(None).cast("string").alias("digest"))
    trees = manifest.spans.agg(F.max("tree") + 1).first()[0] or 0
    given = given.select("part", "tree", "level", "index", *(F.lit(None).cast("long").alias(c) for c in ("n", "first", "total")), "digest")
    beside = spans.unionByName(given)

    def prove(key: tuple[pa.Scalar, ...], own: pa.Table, notes: pa.Table) -> pa.Table:
        own = _ordered(own)
        leaves, claimed = own["leaf"].to_pylist(), own["claimed"].to_pylist()
        outside: dict[int, dict[tuple[int, int], str]] = {}
        places = []
        for r in notes.to_pylist():
            if r["n"] is None:
                outside.setdefault(r["tree"], {})[r["level"], r["index"]] = r["digest"]
            else:
                places.append(r)
        if not places:  # a part without rows
            return _table([], arrow)
        places.sort(key=lambda r: r["tree"])
        grown = [climb(p["index"], leaves[p["first"] : p["first"] + p["n"]], p["total"], outside.get(p["tree"], {})) for p in places]
        upper, _ = climb(places[0]["tree"], [top[0] for _, top in grown], trees, outside.get(UPPER, {}))
        subroots, siblings, folded = [], [], []
        for p, (levels, top) in zip(places, grown):
            above = path_of(upper, p["tree"])
            for k in range(p["n"]):
                path = path_of(levels, p["index"] + k) + above
                subroots.append(top[0])
                siblings.append([x for _, x in path if x is not None])
                folded.append(fold(claimed[p["first"] + k], path))
        return pa.table(
            [own["doc_id"].cast(pa.int64()), own["group"].cast(pa.string()), pa.array(leaves, pa.string()), pa.array(subroots, pa.string()), pa.array([root] * len(leaves), pa.string()), pa.array(siblings, pa.list_(pa.string())), pa.array(folded, pa.string())],
            names=[n for n, _ in arrow],
        )

    return manifest.rows.groupBy("part").cogroup(beside.groupBy("part")).applyInArrow(prove, schema)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest_table(docs: DataFrame) -> DataFrame:
    """Digests of a manifest of the documents, a seventh of them claimed with a wrong length."""
    wrong = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    claims = {"n_chars": F.when(wrong, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))}
    held = proofs(build(docs, FIELDS, claims))
    return held.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


MERKLE_SQL = r"""
WITH RECURSIVE numbered AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS wrong, xor(crc, 4294967295) % 7 = 0 AS tampered
  FROM numbered),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM hashed),
low(tree, level, i, n, h) AS (
  SELECT tree, 0, i, n, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY tree, level, i // 2),
subroots AS (SELECT tree, h, level AS height FROM low WHERE n = 1),
up(level, i, n, h) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroots), h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY level, i // 2),
nodes AS (
  SELECT tree, level, i, n, h FROM low WHERE n > 1
  UNION ALL
  SELECT s.tree, s.height + u.level, u.i, u.n, u.h FROM up u, subroots s WHERE u.n > 1),
steps AS (
  SELECT l.tree AS tree, l.i AS leaf_i, x.level,
    CASE WHEN x.level < s.height THEN l.i >> x.level ELSE l.tree >> (x.level - s.height) END AS i
  FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN (SELECT DISTINCT tree, level FROM nodes) x ON x.tree = l.tree),
path AS (
  SELECT p.tree, p.leaf_i, p.level, p.i, o.h AS other
  FROM steps p LEFT JOIN nodes o ON o.tree = p.tree AND o.level = p.level AND o.i = xor(p.i, 1)),
proof AS (SELECT tree, leaf_i, coalesce(string_agg(other, '' ORDER BY level), '') AS siblings, list({'i': i, 'other': other} ORDER BY level) AS ways FROM path GROUP BY ALL),
folded(doc_id, leaf, subroot, siblings, ways, h) AS (
  SELECT l.doc_id, l.leaf, s.h, coalesce(p.siblings, ''), coalesce(p.ways, []), CASE WHEN l.tampered THEN l.wrong ELSE l.leaf END
  FROM leaves l JOIN subroots s ON s.tree = l.tree LEFT JOIN proof p ON p.tree = l.tree AND p.leaf_i = l.i
  UNION ALL
  SELECT doc_id, leaf, subroot, siblings, ways[2:],
    sha256(CASE WHEN ways[1].other IS NULL THEN h WHEN ways[1].i % 2 = 1 THEN ways[1].other || h ELSE h || ways[1].other END)
  FROM folded WHERE len(ways) > 0)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(siblings) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM folded f, (SELECT h FROM up WHERE n = 1) r WHERE len(ways) = 0
"""
