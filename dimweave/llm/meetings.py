"""Which classes share a key, found from rows (key, cls) that travel packed.

Many more rows are dealt than meet.  So a task packs its rows into blobs, each
of one bucket of the keys' range, and buckets are sorted as arrays; only what
meets becomes rows.  Buckets grow in number with the rows.  A bucket of more
than LIMIT rows, as when very many classes share one key, isn't held: its rows
come out as they are and meet in a window, which Spark can spill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of a bucket, if keys are dealt evenly; rows that a task holds before it packs them; rows of a blob at most.
BUCKET, HELD, BLOB = 1 << 18, 1 << 20, 256
#: Rows of a bucket that a task holds.
LIMIT = 1 << 21


def packer(pairs: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass that yields rows (bucket, packed) of what `pairs` yields, arrays of keys and classes; `rows` is about their number in all tasks."""
    buckets = np.uint64(min(max(1, rows // BUCKET), 1 << 31))

    def pack(keys: list[np.ndarray], classes: list[np.ndarray]) -> pa.RecordBatch:
        both = np.stack([np.concatenate(keys), np.concatenate(classes)], axis=1)
        bucket = (both[:, 0] >> np.uint64(32)) * buckets >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        both, bucket = both[order], bucket[order]
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        within = np.arange(len(bucket)) - np.repeat(start, np.diff(np.append(start, len(bucket))))
        cuts = np.flatnonzero(within % BLOB == 0)
        offsets = (np.append(cuts, len(bucket)) * 16).astype(np.int32)
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(both))])
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int64)), packed], names=["bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes, held = [], [], 0
        for k, c in pairs(batches):
            keys.append(k.view(np.uint64))
            classes.append(c.view(np.uint64))
            held += len(k)
            if held >= HELD:
                yield pack(keys, classes)
                keys, classes, held = [], [], 0
        if held:
            yield pack(keys, classes)

    return run


def _met(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places and classes of a whole bucket: the smallest class that has a key, and each other that has it."""
    both = np.concatenate(parts)
    both = both[np.argsort(both[:, 0])]
    start = np.flatnonzero(np.concatenate(([True], both[1:, 0] != both[:-1, 0])))
    classes = both[:, 1].view(np.int64)
    place = np.repeat(np.minimum.reduceat(classes, start), np.diff(np.append(start, len(classes))))
    other = place < classes
    return place[other], classes[other]


def _meet_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, place, cls) of rows (bucket, packed) that come sorted by bucket: what meets without a key, and rows of buckets that are too large with it."""
    here, parts, held, large = None, [], 0, False

    def out(key: pa.Array, place: pa.Array, cls: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([key, place, pa.array(cls)], names=["key", "place", "cls"])

    def plain() -> Iterator[pa.RecordBatch]:
        for x in parts:
            yield out(pa.array(np.ascontiguousarray(x[:, 0]).view(np.int64)), pa.nulls(len(x), pa.int64()), np.ascontiguousarray(x[:, 1]).view(np.int64))
        parts.clear()

    def whole() -> Iterator[pa.RecordBatch]:
        if parts:
            place, cls = _met(parts)
            parts.clear()
            yield out(pa.nulls(len(cls), pa.int64()), pa.array(place), cls)

    for batch in batches:
        buckets = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if buckets[a] != here:
                yield from whole()
                here, held, large = buckets[a], 0, False
            mine = np.frombuffer(b"".join(batch.column(1).slice(a, b - a).to_pylist()), np.uint64).reshape(-1, 2)
            parts.append(mine)
            held += len(mine)
            large = large or held > LIMIT
            if large:
                yield from plain()
    yield from whole()


def packed_places(scratch: Scratch, packed: DataFrame) -> DataFrame:
    """As `meeting_places`, of rows (bucket, packed) that a `packer` made."""
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    met = scratch.keep(dealt.mapInArrow(_meet_pass, "key long, place long, cls long"))
    low = F.min("cls").over(Window.partitionBy("key"))
    rest = met.where("key is not null").select(low.alias("place"), "cls").where("place < cls")
    members = scratch.keep(met.where("key is null").select("place", "cls").unionByName(rest).distinct())
    scratch.drop(met)
    return members.unionByName(members.select("place", F.col("place").alias("cls")).distinct())
