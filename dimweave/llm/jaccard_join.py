"""N-gram Jaccard join: signature trees.

Documents are sets of distinct word shingles.  Two are linked when their
Jaccard similarity is at least `PERCENT` / 100; the result is exact.

1. Equal sets form a class; classes stand for their documents.
2. Peeling.  Of the shingles whose hash is below a fixed bound (SAMPLED of
   all), those that one class alone holds are counted.  A class that holds more
   such shingles than a link can leave out is linked with none, and goes; so
   only what is mostly shared is looked at further, and only its sets are kept.
3. Routing.  In any fixed order of all shingles, two linked sets share one
   among the first n - ceil(0.75 n) + 1 of each.  Shingles that many classes
   hold come last in the order (a heuristic that changes no result), so common
   passages route nothing.  Classes meet where such a shingle is the same, if
   it stands early enough in both orders to be the first that they share, all
   shingles of one smallest class in one place.
4. Hubs.  In each meeting place whole sets are compared with a hub, and what
   links becomes one component; copies of one text, be they thousands, need one
   comparison each.  It is done up to HUBS times, with what is left.
5. Signature trees.  Places that still hold several components are searched by
   trees: leaves hold classes sorted by component and size, nodes the OR of
   their shingle bitmaps and their size range.  A dual traversal goes down only
   where the largest possible overlap reaches the threshold and the two sides
   aren't one component already; pairs that survive are verified on whole sets.
   A tree holds TREE classes at most; larger places are pairs of trees, each
   pair a task's work of its own.
6. Linked classes are joined by distributed union-find.

Shingles are 64-bit hashes of five words; classes are 63-bit hashes of sets.

Defined results: null and empty texts, and those without words, have an empty
set, and are linked with nothing, their component is their own id; fewer than
five words are one shingle; rows without an id belong to their class, but
never name a component; repeated rows are alike; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, block_pairs, meeting_places, mix, shingle_sets, table, text_blocks, text_bytes
from .components import connected_components
from .places import Place, grouped, link_batch

WORDS = 5
PERCENT = 75
#: Share of all shingles, by their hashes, that are counted to find classes without links; above a quarter, as a
#: class is found once more than a quarter of its shingles are known to be its own.  Any share gives the same result.
SAMPLED = 0.35
_BELOW = np.uint64(int(SAMPLED * (1 << 53)) << 11)
#: A shingle that this many sets of one batch hold counts towards the common ones.
LOCAL_COMMON = 4
#: Common shingles kept, the most frequent first. They only order the routing; any number gives the same result.
COMMON_KEPT = 1 << 20
#: Hubs that a place's classes are compared with before its trees are searched.
HUBS = 4
#: Bits of a routing key; equal keys of different shingles only cost a comparison.
KEY_MASK = np.uint64((1 << 44) - 1)
LEAF = 16
FANOUT = 8
#: Classes and unpacked bytes of bitmaps in one tree; a larger meeting place is searched as pairs of trees.
TREE = 1024
TREE_BYTES = 16 << 20
#: Bits of a bitmap for each shingle, before rounding up to a power of two.
BITS = 8


def linked(overlap: int, a: int, b: int) -> bool:
    return 100 * overlap >= PERCENT * (a + b - overlap)


def may_miss(n):
    """How many of n shingles a set's links can leave out at most."""
    return n - (PERCENT * n + 99) // 100


def may_miss_sql(n: str) -> Column:
    return F.col(n) - F.floor((PERCENT * F.col(n) + 99) / 100)


def _need(a, b):
    """The least overlap that links sets of a and b elements: 100 o >= P (a + b - o)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _class_of(s: np.ndarray) -> int:
    """63-bit hash of a set, by sums over its elements' mixed hashes."""
    if not len(s):
        return 0
    x, y = mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64), mix(s + np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(mix(np.atleast_1d(x ^ (y << np.uint64(1)) ^ np.uint64(len(s))))[0] >> np.uint64(1)) | 1


def _sets_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, n, cls) of texts."""
    for batch in text_blocks(batches, "text"):
        sets = shingle_sets(text_bytes(batch.column(1)), WORDS)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_of(s) for s in sets], pa.int64())], names=["id", "n", "cls"])


def _sample_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cls, keys): the shingles below the bound, of each set once a task."""
    seen: set[int] = set()
    for batch in text_blocks(batches, "text"):
        sets = {c: s for s in shingle_sets(text_bytes(batch.column(0)), WORDS) if (c := _class_of(s)) and c not in seen}
        seen.update(sets)
        keys = [s[: np.searchsorted(s, _BELOW)] for s in sets.values()]
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["cls", "keys"])


def _elements(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(e, np.uint64) for e in column.to_pylist()]


def _common_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, n) of those that several sets of a batch hold."""
    for batch in batches:
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *_elements(batch.column(0))]), return_counts=True)
        h, n = h[n >= LOCAL_COMMON], n[n >= LOCAL_COMMON]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])


def _prefix_pass(common: tuple[np.ndarray, np.ndarray]):
    """Rows (cls, n, keys): the routing keys of each set, in the order of all shingles."""
    shingles, level = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets = [np.zeros(0, np.int64)], _elements(batch.column(1))
            for s in sets:
                p = may_miss(len(s)) + 1
                if len(shingles):
                    at = np.minimum(np.searchsorted(shingles, s), len(shingles) - 1)
                    rank = np.where(shingles[at] == s, level[at], 0)
                    first = s[np.argsort(rank, kind="stable")[:p]] if rank[:p].any() else s[:p]
                else:
                    first = s[:p]
                keys.append((mix(first) & KEY_MASK).view(np.int64))
            ends = np.cumsum(list(map(len, keys))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), lists], names=["cls", "n", "keys"])

    return run


def _fetch_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cls, n, elements): a text's whole set."""
    for batch in text_blocks(batches, "text"):
        sets = shingle_sets(text_bytes(batch.column(1)), WORDS)
        keep = [(int(c), s) for c, s in zip(batch.column(0).to_pylist(), sets, strict=True) if len(s) and _class_of(s) == c]
        columns = [pa.array([c for c, _ in keep], pa.int64()), pa.array([len(s) for _, s in keep], pa.int64()), pa.array([s.tobytes() for _, s in keep], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["cls", "n", "elements"])


def _bitmap(s: np.ndarray) -> bytes:
    """A bitmap whose length is the power of two from BITS n bits on, 64 at least; bit = top bits of the hash, so neighbours OR to shorter ones."""
    bits = max(6, int(BITS * len(s) - 1).bit_length())
    out = np.zeros(1 << bits, np.uint8)
    out[(s >> np.uint64(64 - bits)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _fold(sig: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (of bits, as booleans) at a shorter length: neighbours are OR-combined."""
    return sig.reshape(size, -1).any(axis=1) if len(sig) > size else sig


def _bits(sig: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(sig, np.uint8)).astype(bool)


def most_overlap(sig_a: np.ndarray, n_a: int, sig_b: np.ndarray, n_b: int) -> int:
    """The largest overlap that two sets with these bitmaps can have."""
    size = min(len(sig_a), len(sig_b))
    a, b = _fold(sig_a, size), _fold(sig_b, size)
    return min(n_a - int(np.count_nonzero(a & ~b)), n_b - int(np.count_nonzero(b & ~a)))


class SignatureTree:
    """A tree over classes of one meeting place.

    Items are sorted by component and size.  A node has its items' range, least and largest
    size, the OR of their bitmaps (at the length of the tree's shortest), the
    least count of bits an item has there, and its component if all share one.
    """

    def __init__(self, ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, sigs: list[np.ndarray]):
        order = np.lexsort((ids, sizes, comps))
        self.ids, self.comps, self.sizes = ids[order], comps[order], sizes[order]
        self.sigs = [sigs[i] for i in order]
        self.width = min(map(len, sigs))
        folded = np.stack([_fold(s, self.width) for s in self.sigs])
        level = [self._node(a, min(a + LEAF, len(ids)), folded, ()) for a in range(0, len(ids), LEAF)]
        while len(level) > 1:
            level = [self._node(g[0][0], g[-1][1], folded, g) for g in (level[i : i + FANOUT] for i in range(0, len(level), FANOUT))]
        self.root = level[0]
        self._rows: dict[int, np.ndarray] = {}

    def rows(self, a: int, b: int) -> np.ndarray:
        """The bitmaps of a leaf's items, at the length of its shortest."""
        if a not in self._rows:
            width = min(len(x) for x in self.sigs[a:b])
            self._rows[a] = np.stack([_fold(x, width) for x in self.sigs[a:b]])
        return self._rows[a]

    def _node(self, a: int, b: int, folded: np.ndarray, children) -> tuple:
        sig = np.logical_or.reduce([c[4] for c in children]) if children else folded[a:b].any(axis=0)
        fill = min(c[6] for c in children) if children else int(folded[a:b].sum(axis=1).min())
        same = self.comps[a] if (self.comps[a:b] == self.comps[a]).all() else None
        return (a, b, int(self.sizes[a:b].min()), int(self.sizes[a:b].max()), sig, same, fill, tuple(children))


def _apart(x: tuple, y: tuple) -> bool:
    """Whether no item of node x can link with one of node y, in another component."""
    if x[5] is not None and x[5] == y[5]:
        return True
    low, high = (x, y) if x[3] <= y[3] else (y, x)
    if 100 * low[3] < PERCENT * high[2]:
        return True
    # an item of x has x.fill bits or more; those outside y's OR are elements that no item of y has
    size = min(len(x[4]), len(y[4]))
    if size < len(x[4]) or size < len(y[4]):
        return False  # fills hold at the nodes' own widths
    both = int(np.count_nonzero(x[4] & y[4]))
    most = min(x[3] - max(0, x[6] - both), y[3] - max(0, y[6] - both))
    return most < _need(x[2], y[2])


def tree_pairs(s: SignatureTree, t: SignatureTree) -> Iterator[tuple[int, int]]:
    """Pairs of ids, of different components, whose largest possible overlap links them; each pair once."""
    stack = [(s.root, t.root)]
    while stack:
        x, y = stack.pop()
        if _apart(x, y):
            continue
        if x[7] or y[7]:
            xs, ys = x[7] or (x,), y[7] or (y,)
            if s is t and x is y:
                stack += [(xs[i], xs[j]) for i in range(len(xs)) for j in range(i, len(xs))]
            else:
                stack += [(p, q) for p in xs for q in ys]
            continue
        for i, j in _leaf_pairs(s, x, t, y):
            a, b = int(s.sizes[i]), int(t.sizes[j])
            if most_overlap(s.sigs[i], a, t.sigs[j], b) >= _need(a, b):
                yield int(s.ids[i]), int(t.ids[j])


def _leaf_pairs(s: SignatureTree, x: tuple, t: SignatureTree, y: tuple) -> Iterator[tuple[int, int]]:
    """Pairs of items of two leaves, of different components, that may link by sizes and the leaves' bitmaps."""
    p, q = s.rows(x[0], x[1]), t.rows(y[0], y[1])
    width = min(p.shape[1], q.shape[1])
    p, q = (m.reshape(len(m), width, -1).any(axis=2).astype(np.float32) for m in (p, q))
    both = (p @ q.T).astype(np.int64)  # of 0 and 1: exact below 2 ** 24 common bits
    a, b = s.sizes[x[0] : x[1], None], t.sizes[None, y[0] : y[1]]
    most = both + np.minimum(a - p.sum(axis=1, dtype=np.int64)[:, None], b - q.sum(axis=1, dtype=np.int64)[None, :])
    may = (most >= _need(a, b)) & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)) & (s.comps[x[0] : x[1], None] != t.comps[None, y[0] : y[1]])
    if s is t and x is y:
        may = np.triu(may, 1)
    yield from ((x[0] + int(i), y[0] + int(j)) for i, j in zip(*np.nonzero(may), strict=True))


class _SetPlace(Place):
    def trees(self) -> None:
        """Finds the links that hubs didn't, between blocks or within the only one."""
        trees = []
        for block in np.unique(self.blocks):
            part = np.flatnonzero(self.blocks == block)
            comps = np.array([self.root(i) for i in part], np.int64)
            trees.append(SignatureTree(part, comps, self.sizes[part], [_bits(_bitmap(self.sets[i])) for i in part]))
        for i, j in tree_pairs(trees[0], trees[-1]):
            if self.root(i) != self.root(j) and len(self.near(i, np.array([j]))):
                self.link(i, j)


def _place_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) enough to join what links in each place; rows (place, low, high, block, cls, elements) come sorted by the first three.

    Rows of one place, low and high are one block of a meeting place, searched
    in itself, or two blocks, searched against each other.
    """
    for rows in grouped(batches, ["place", "low", "high"], ["block", "cls", "elements"]):
        place = _SetPlace(*zip(*((b, c, np.frombuffer(e, np.uint64)) for *_, b, c, e in rows), strict=True), PERCENT)
        if place.hubs(HUBS, rows[0][0]):
            place.trees()
        yield link_batch(place.links)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of each row of `docs`."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = scratch.keep(texts.mapInArrow(_sets_pass, "id long, n long, cls long"))
    # how many of the counted shingles each class alone holds; a common shingle is brought to a row a task before the shuffle
    # (texts are read again for it: kept shingles would take as much room as the texts)
    sampled = texts.select("text").mapInArrow(_sample_pass, "cls long, keys array<long>")
    holders = sampled.select(F.explode("keys").alias("key"), "cls").groupBy("key").agg(F.min("cls").alias("cls"), F.max("cls").alias("high"))
    alone = holders.where("cls = high").groupBy("cls").agg(F.count("*").alias("alone"))
    classes = rows.where("n > 0").groupBy("cls").agg(F.max("n").alias("n"), F.min("id").alias("id"))
    picked = scratch.keep(classes.join(alone, "cls", "left").where(F.coalesce("alone", F.lit(0)) <= may_miss_sql("n")).select("cls", "id"))

    # whole sets of the classes that are left, from one document of each
    source = texts.join(scratch.small(picked).where("id is not null"), "id").select("cls", "text")
    nameless = picked.where("id is null").select("cls")
    if nameless.limit(1).count():  # classes of rows without ids are found by their sets
        source = source.unionByName(nameless.join(_classed(texts.where("id is null")), "cls").select("cls", "text"))
    sets = scratch.keep(source.mapInArrow(_fetch_pass, "cls long, n long, elements binary").dropDuplicates(["cls"]))

    # the order of shingles: common ones last, by the power of two of their counts
    common = sets.select("elements").mapInArrow(_common_pass, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(f"n >= {4 * LOCAL_COMMON}")
    top = common.orderBy(F.desc("n"), "shingle").limit(COMMON_KEPT).toPandas()  # at most COMMON_KEPT rows of 16 bytes
    shingles = top["shingle"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(shingles)
    shared = spark.sparkContext.broadcast((shingles[by], np.log2(np.maximum(top["n"].to_numpy(np.int64), 1)).astype(np.int8)[by]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _prefix_pass(shared.value)(batches)

    routed = sets.select("cls", "elements").mapInArrow(prefixes, "cls long, n long, keys array<long>").select("cls", "n", F.posexplode("keys").alias("pos", "key"))
    # at the first shingle that x shares with y, x has n - pos at most in common with it: so y's size is at most this
    largest = F.floor((F.lit(100 + PERCENT) * (F.col("n") - F.col("pos")) - PERCENT * F.col("n")) / PERCENT)
    early = routed.withColumn("least", F.min("n").over(Window.partitionBy("key"))).where(largest >= F.col("least"))
    places = meeting_places(scratch, early, "key").join(sets.select("cls", "n"), "cls")
    weight = F.greatest(F.lit(TREE_BYTES // TREE), F.col("n") * 2 * BITS)
    blocks = block_pairs(places, "place", [F.col("n"), F.col("cls")], TREE * (TREE_BYTES // TREE), weight)
    blocks = scratch.keep(blocks.select("place", "low", "high", "block", "cls"))
    at = ["place", "low", "high"]
    whole = blocks.join(sets.select("cls", "elements"), "cls").repartition(*at).sortWithinPartitions(*at).select(*at, "block", "cls", "elements")
    edges = scratch.keep(whole.mapInArrow(_place_pass, "u long, v long"))

    found = connected_components(edges, scratch)
    members = rows.join(found.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    names = members.where("n > 0").groupBy("component").agg(F.min("id").alias("component_id"))
    named = members.where("n > 0").join(names, "component").select("id", "n", "component_id")
    return named.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _classed(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text"):
            sets = shingle_sets(text_bytes(batch.column(0)), WORDS)
            yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.int64()), batch.column(0)], names=["cls", "text"])

    return texts.select("text").mapInArrow(run, "cls long, text string")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLE = {
    "op4_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= {WORDS} THEN list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * n >= {PERCENT} * (len(a.sh) + len(b.sh) - n)),
r AS (SELECT doc_id AS x, doc_id AS c FROM s UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x)
SELECT s.doc_id, len(any_value(sh)) AS n_shingles, min(c) AS component_id FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id"""
}
