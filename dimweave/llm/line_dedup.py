"""Line dedup: fuzzy lines by MinHash.

Lines of all documents are compared as sets of character shingles.  Equal
lines are one class first.  Each class's signature (one hash of every shingle,
dealt to SLOTS slots that keep their smallest; slots that stay empty copy others
in random orders) is cut to bands; classes with an equal band meet, all bands of
one smallest class in one place.  Where they meet, whole lines are verified by exact
Jaccard similarity, first with up to HUBS hubs, then whatever is not yet one
component; a place of more than BLOCK classes is searched as pairs of its blocks.
Distributed union-find joins what is verified, and of each component the first
line, by document and line number, is kept.

Lines are compared with A-Z in lower case (other letters as they are) and with
white space runs as one blank.  Lines of white space only are no lines to
compare and stay as they are.

Equal lines are told by 127 bits of a hash; candidates travel with 63 of them,
and where two lines share those, only the first line's component is applied.
Shingles of a place are compared by 64-bit hashes.

Defined results: null texts stay null; empty texts stay empty; a document all
of whose lines go has an empty text; rows without an id stand last; rows with
the same id are told apart by their texts' hashes, and of wholly equal rows
each loses or keeps the same lines; an empty table gives an empty table; other
columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, block_pairs, mix, table, text_blocks, text_bytes
from .components import connected_components
from .meetings import packed_places, packer
from .places import Place, grouped, link_batch

#: Characters (code points) of a shingle, the least similarity of duplicates in percent, bands and rows of a signature.
#: One changed character leaves a line of L characters (L - 9) / (L + 1) alike, which links from L = 39 on.
#: Lines that are just similar enough meet with probability 0.991, those of similarity 0.8 with 0.9993.
SHINGLE = 5
PERCENT = 75
BANDS = 24
ROWS = 6
SLOTS = BANDS * ROWS
HUBS = 8
#: Classes of one place that a task compares in itself; a larger place is compared as pairs of blocks.
BLOCK = 512
#: Bytes of lines that are hashed at a time, so that arrays stay in the processor's cache.
SLICE = 1 << 17
#: Classes that a task remembers having signed.
SEEN = 500_000
#: Lines of one class that make it a hot one, as a share of all lines: there are at most 1 / HOT such classes.
HOT = 0.001
_NONE = np.uint32(0xFFFFFFFF)
_B, _B2 = np.uint32(0x9E3779B1), np.uint32(0x9E3779B1 * 0x9E3779B1 & 0xFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The slots that an empty slot looks at, one row a step: a random order for each, so that one shingle that
#: differs spoils no more of a short line's signature than its share.
_ORDERS = np.random.Generator(np.random.PCG64(20240301)).permuted(np.tile(np.arange(SLOTS)[:, None], SLOTS), axis=0)
_ODD_SPACE = (b"  ", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c")


def _canonical(text: bytes) -> list[bytes]:
    """The lines of a text as they are compared."""
    low = text.lower()
    lines = low.split(b"\n")
    if low[:1] == b" " or low[-1:] == b" " or any(x in low for x in _ODD_SPACE):
        return [b" ".join(x.split()) for x in lines]
    return lines


def _code_points(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines, each closed by a line end, and where those stand; a line shorter than a shingle is padded with zeros."""
    padded = [x if len(x) >= 4 * SHINGLE else x.decode("utf-8", "replace").ljust(SHINGLE, "\0").encode() for x in lines]
    flat = b"\n".join(padded) + b"\n"
    arr = np.frombuffer(flat, np.uint8).astype(np.uint32) if flat.isascii() else np.frombuffer(flat.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    return arr, np.flatnonzero(arr == 10)


def _hashed(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles from each code point on, also over line ends, and where those stand."""
    arr, ends = _code_points(lines)
    wide, n = arr.astype(np.uint64), len(arr) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        h = h * _MIX + wide[j : j + n] + np.uint64(1)
    return mix(h), ends


def _shingle_sets(lines: list[bytes]) -> list[np.ndarray]:
    """Each line's sorted distinct 64-bit hashes of shingles."""
    h, ends = _hashed(lines)
    out, start = [], 0
    for end in ends.tolist():
        x = np.sort(h[start : end - SHINGLE + 1])
        out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        start = end + 1
    return out


def _alike(lines: list[bytes]) -> np.ndarray:
    """Whether each two lines, the first and second, third and fourth and so on (up to 65,536 pairs), are similar."""
    h, ends = _hashed(lines)
    sizes = np.diff(ends, prepend=-1)
    line = np.repeat(np.arange(len(lines)), sizes)[: len(h)]
    inside = np.arange(len(h)) <= ends[line] - SHINGLE
    h, line = h[inside], line[inside]
    order = np.argsort(h)
    order = order[np.argsort((line[order] >> 1).astype(np.uint16), kind="stable")]
    h, line = h[order], line[order]
    pair = line >> 1
    start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (pair[1:] != pair[:-1]))))
    of = np.bitwise_or.reduceat(1 + (line & 1), start)  # 3: a shingle of both lines
    union, both = (np.bincount(x, minlength=len(lines) // 2) for x in (pair[start], pair[start[of == 3]]))
    return 100 * both >= PERCENT * union


def _shingle_set(line: bytes) -> set[str]:
    x = line.decode("utf-8", "replace")
    return {x[i : i + SHINGLE] for i in range(max(1, len(x) - SHINGLE + 1))}


def line_similarity(a: bytes, b: bytes) -> float:
    """Exact Jaccard similarity of two canonical lines' shingles."""
    s, t = _shingle_set(a), _shingle_set(b)
    return len(s & t) / len(s | t)


def signatures(lines: list[bytes]) -> np.ndarray:
    """(len(lines), SLOTS) smallest hash of each slot; an empty slot takes that of the first full one in its own order."""
    arr, ends = _code_points(lines)
    two = arr[:-1] * _B + arr[1:]
    h = (two[:-3] * _B2 + two[2:-1]) * _B + arr[4:]  # a polynomial of five code points, finalised below
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    sizes = np.diff(ends, prepend=-1)
    at = np.repeat(np.arange(len(lines)) * SLOTS, sizes)[: len(h)]
    at += ((h >> np.uint32(16)) * np.uint32(SLOTS)) >> np.uint32(16)
    for j in range(SHINGLE):  # shingles that reach over a line's end are none; those of the last end's own places don't exist
        h[(ends if j == SHINGLE - 1 else ends[:-1]) - j] = _NONE
    sig = np.full(len(lines) * SLOTS, _NONE)
    np.minimum.at(sig, at, h)
    sig = sig.reshape(len(lines), SLOTS)
    out = sig.copy()
    line, slot = np.nonzero(sig == _NONE)
    for order in _ORDERS:
        if not len(line):
            break
        found = sig[line, order[slot]]
        full = found != _NONE
        out[line[full], slot[full]] = found[full]
        line, slot = line[~full], slot[~full]
    return out


def _bands(lines: list[bytes]) -> np.ndarray:
    sig = signatures(lines).astype(np.uint64)
    out = np.zeros((len(lines), BANDS), np.uint64)
    for r in range(ROWS):
        out = mix(out * _MIX + sig[:, r * BANDS : (r + 1) * BANDS])
    return out + np.arange(BANDS, dtype=np.uint64)


def _line_hash(lines: list[bytes]) -> np.ndarray:
    """(len(lines), 2): 63 and 64 bits of each line's hash; zeros for an empty line."""
    import xxhash

    out = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), np.uint64).reshape(-1, 2).copy()
    out[:, 0] = out[:, 0] >> np.uint64(1) | np.uint64(1)
    out[[not x for x in lines]] = 0
    return out.view(np.int64)


def _split_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, row, line_no, cls, sure, n_solid) of each document's lines that aren't blank; n_solid is their number in it, on the first of them only."""
    for batch in text_blocks(batches, "text"):
        parts = [_canonical(t) for t in text_bytes(batch.column(2))]
        sizes = np.array(list(map(len, parts)), np.int64)
        lines = [x for p in parts for x in p]
        at, hashes = np.repeat(np.arange(len(parts)), sizes), _line_hash(lines)
        numbers = np.arange(len(lines)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        solid = hashes[:, 0] != 0
        at = at[solid]
        n_solid = pa.array(np.bincount(at, minlength=len(parts))[at].astype(np.int32), mask=np.concatenate(([False], at[1:] == at[:-1]))[: len(at)])
        take = pa.array(at)
        numeric = [*(pa.array(x[solid]) for x in (numbers.astype(np.int32), hashes[:, 0], hashes[:, 1])), n_solid]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *numeric], names=["id", "row", "line_no", "cls", "sure", "n_solid"])


def _class_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bands and classes of the lines of each text block, equal lines once, and mostly once a task."""
    seen: set[int] = set()
    for batch in text_blocks(batches, "text"):
        lines = list({x for text in text_bytes(batch.column(0)) for x in _canonical(text)} - {b""})
        classes = _line_hash(lines)[:, 0].tolist()
        new = {c: x for c, x in zip(classes, lines, strict=True) if c not in seen}
        if len(seen) >= SEEN:
            seen.clear()
        seen.update(new)
        ids = np.array(list(new), np.int64)
        for part in _slices(list(new.values()), SLICE):
            mine, ids = ids[: len(part)], ids[len(part) :]
            yield _bands(part).reshape(-1), np.repeat(mine, BANDS)


def _slices(lines: list[bytes], limit: int) -> Iterator[list[bytes]]:
    start, size = 0, 0
    for i, x in enumerate(lines):
        if size > limit:
            yield lines[start:i]
            start, size = i, 0
        size += len(x)
    if start < len(lines):
        yield lines[start:]


def _wanted_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cls, line) of canonical lines whose numbers in their text are asked for."""
    for batch in text_blocks(batches, "text"):
        out: list[bytes] = []
        for numbers, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            lines = _canonical(text)
            out += [lines[i] for i in numbers]
        yield pa.RecordBatch.from_arrays([pa.array(_line_hash(out)[:, 0]), pa.array(out, pa.binary())], names=["cls", "line"])


def _place_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) enough to join what links in each place, rows (place, low, high, block, cls, line) that come sorted by the first three."""
    held: list[list[tuple]] = []

    def search() -> pa.RecordBatch:
        pairs, larger = [rows for rows in held if len(rows) == 2], [rows for rows in held if len(rows) > 2]
        links = []
        if pairs:
            alike = _alike([r[5] for rows in pairs for r in rows])
            links += [(a[4], b[4]) for (a, b), yes in zip(pairs, alike.tolist(), strict=True) if yes]
        sets = iter(_shingle_sets([r[5] for rows in larger for r in rows]) if larger else ())
        for rows in larger:
            place = Place([r[3] for r in rows], [r[4] for r in rows], [next(sets) for _ in rows], PERCENT)
            if place.hubs(HUBS, rows[0][0]):  # a place's own class shares a band with each other
                place.rest()
            links += place.links
        held.clear()
        return link_batch(links)

    # the lines of many small places are hashed together
    for rows in grouped(batches, ["place", "low", "high"], ["block", "cls", "line"]):
        held.append(rows)
        if sum(len(r[5]) for r in rows) > SLICE or len(held) >= 256:
            yield search()
    if held:
        yield search()


def line_components(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of (id, row, text): its lines (id, row, line_no, cls, sure, n_solid), and (cls, sure, component) of classes that are linked with others."""
    lines = scratch.keep(docs.mapInArrow(_split_pass, "id long, row long, line_no int, cls long, sure long, n_solid int"))
    bands = docs.select("text").mapInArrow(packer(_class_pass, BANDS * lines.count()), "bucket long, packed binary")
    places = packed_places(scratch, bands)
    nodes = places.select("cls").distinct()

    # the lines of classes that meet others, each from its first document
    first = lines.join(nodes, "cls").groupBy("cls").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row", "line_no", "sure")).alias("at"))
    first = scratch.keep(first.select("cls", "at.*"))
    asked = scratch.keep(first.groupBy("id", "row").agg(F.collect_list("line_no").alias("numbers")))  # lines of one document at most
    texts = docs.alias("d").join(scratch.small(asked).alias("a"), F.col("d.id").eqNullSafe(F.col("a.id")) & (F.col("d.row") == F.col("a.row"))).select("numbers", "text")
    texts = scratch.keep(texts.mapInArrow(_wanted_pass, "cls long, line binary").dropDuplicates(["cls"]))

    sized = texts.select("cls", F.length("line").alias("size"))
    blocks = scratch.keep(block_pairs(places.join(sized, "cls"), "place", [F.col("size"), F.col("cls")], BLOCK).select("place", "low", "high", "block", "cls"))
    at = ["place", "low", "high"]
    whole = blocks.join(texts, "cls").repartition(*at).sortWithinPartitions(*at).select(*at, "block", "cls", "line")
    edges = scratch.keep(whole.mapInArrow(_place_pass, "u long, v long"))
    found = connected_components(edges, scratch).withColumnRenamed("id", "cls")
    return lines, scratch.keep(found.join(first.select("cls", "sure"), "cls").select("cls", "sure", "component"))


def _repeats(lines: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, row, line_no) of lines that aren't their component's first; a class that is like no other is a component of its own.

    Most classes stand once and alone: lines of the others only are told their
    component.  Classes and components that hold more than HOT of all lines,
    at most 1 / HOT each, are brought to the lines by a broadcast; for no other
    is one task's share large.
    """
    classes = lines.groupBy("cls", "sure").agg(F.count("*").alias("n")).join(found, ["cls", "sure"], "left")
    classes = scratch.keep(classes.where("n > 1 or component is not null"))
    cut = F.lit(max(1, int(HOT * lines.count())))

    def told(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
        hot, others = F.broadcast(table.where(F.col("n") > cut)), table.where(F.col("n") <= cut)
        return rows.join(hot, by).unionByName(rows.join(others, by)).drop("n")

    # a class's own component is named by both of its hashes, others by a class's first hash
    alone = F.col("component").isNull()
    parts = classes.select("cls", "sure", "n", alone.alias("alone"), F.coalesce("component", "cls").alias("part"), F.when(alone, F.col("sure")).otherwise(0).alias("part2"))
    some = scratch.keep(told(lines.select("id", "row", "line_no", "cls", "sure"), parts, ["cls", "sure"]).drop("cls", "sure"))
    at = F.struct(F.col("id").isNull().alias("nameless"), "id", "row", "line_no")
    by = ["alone", "part", "part2"]
    first = scratch.keep(some.groupBy(by).agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1"))
    return told(some, first, by).where(~F.col("first").eqNullSafe(at)).select("id", "row", "line_no")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `text` less its duplicate lines, and n_lines, n_kept (of lines that aren't blank)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    named = docs.drop("n_lines", "n_kept").withColumns({"id_": F.col(key).cast("long"), "row_": F.xxhash64(text)})
    lines, found = line_components(named.select(F.col("id_").alias("id"), F.col("row_").alias("row"), F.col(text).alias("text")), scratch)
    sizes = lines.where("n_solid is not null").select("id", "row", "n_solid", F.lit(None).cast("int").alias("line_no"))
    each = sizes.unionByName(_repeats(lines, found, scratch).withColumn("n_solid", F.lit(None).cast("int")))
    cut = each.groupBy("id", "row").agg(F.max("n_solid").alias("n_solid_"), F.collect_set("line_no").alias("gone_"))  # lines of one document at most
    cut = scratch.keep(cut.withColumnsRenamed({"id": "of_", "row": "text_"}))
    out = named.join(cut, F.col("id_").eqNullSafe(F.col("of_")) & (F.col("row_") == F.col("text_")), "left")
    less = lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone_")), lambda i: F.get(parts, i)), "\n")
    fewer = F.element_at(F.transform(F.array(F.split(F.col(text), "\n")), less), 1)  # a lambda's argument is computed once
    n_lines, n_gone = F.coalesce("n_solid_", F.lit(0)), F.coalesce(F.size("gone_"), F.lit(0))
    counted = out.withColumns({"n_lines": n_lines, "n_kept": F.when(F.col("n_solid_").isNull(), 0).otherwise(n_lines - n_gone)})
    return counted.withColumn(text, F.when(F.size("gone_") > 0, fewer).otherwise(F.col(text))).select(*docs.columns, "n_lines", "n_kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLE: dict[str, str] = {}
