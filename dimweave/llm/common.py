"""Shared pieces of the corpus operators: scratch tables, batches and word hashes.

Scratch tables go to the folder the session names in ``spark.checkpoint.dir``
(shared by all executors), so that a lost executor never loses a stage's
result.  Only where that setting is missing, as in tests, a local folder is
made and used.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import shared_dir

#: Bytes of text that a Python worker handles at a time.
TEXT_BLOCK = 1 << 20
#: Bytes of a kept table's files, up to which it is broadcast.
SMALL_BYTES = 4 << 20
#: Spark's setting by which a query's shuffle files are removed when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one operator run, written as Parquet in the shared folder.

    ``keep`` writes a frame and returns it reread, which cuts its lineage;
    ``drop`` removes tables that no later step needs.  What is left goes when
    the driver's Python ends, as lazily read results may still need it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/dimweave-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._remove, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        """`df` as a table of its own.  The shuffle files that writing it made go at once, as nothing else reads them."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(_CLEAN) if before is None else self.spark.conf.set(_CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def bytes_of(self, df: DataFrame) -> int:
        """Bytes of a kept table's files."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()

    def small(self, df: DataFrame) -> DataFrame:
        """A broadcast hint for a kept table whose files have at most SMALL_BYTES; beyond that the join shuffles."""
        return F.broadcast(df) if self.bytes_of(df) <= SMALL_BYTES else df

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._remove(df._scratch_path)

    def _remove(self, path: str) -> None:
        try:
            jvm, sc = self.spark._jvm, self.spark.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone at exit
            if path != self.root:
                raise


def bounded_sample(rows: DataFrame, order: Column, size: int, count: int) -> DataFrame:
    """At most `size` of `rows`, which are `count`: those of the smallest hashes `order`.

    Hashes above a bound that lets four times as many through go first, so
    that what the limit sorts doesn't grow with the number of partitions.
    """
    share = min(1.0, 4.0 * size / max(count, 1))
    near = rows.where(F.pmod(order, F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))
    return near.orderBy(F.pmod(order, F.lit(1 << 30)), order).limit(size)


def meeting_places(scratch: Scratch, rows: DataFrame, key: str) -> DataFrame:
    """Distinct rows (place, cls): the classes of `rows` (key, cls) that share a key with another class.

    A place is named by the smallest class that has its key, and keys of one
    smallest class are one place: so any two classes that share a key share a
    place, and a class of k keys is in k places at most, mostly in very few.
    """
    low = F.min("cls").over(Window.partitionBy(key))
    members = scratch.keep(rows.select(low.alias("place"), "cls").where("place < cls").distinct())
    return members.unionByName(members.select("place", F.col("place").alias("cls")).distinct())


def block_pairs(rows: DataFrame, place: str, order: list[Column], size: int, weight: Column | None = None) -> DataFrame:
    """`rows` for tasks of bounded size: each place is cut to blocks of `size` rows, or a total `weight` of about that, in some order.

    Adds block, and low and high: a row goes to every pair of blocks that its
    own is in, so that any two rows of a place share a (place, low, high), once
    if their blocks differ or as low = high otherwise.  A place of up to `size`
    rows is one block and isn't repeated.
    """
    here = Window.partitionBy(place)
    before = F.row_number().over(here.orderBy(*order)) - 1
    if weight is not None:
        before = F.sum(weight).over(here.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - weight
    cut = rows.withColumn("block", F.floor(before / size).cast("int"))
    cut = cut.withColumn("last", F.max("block").over(here))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return cut.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "last")


def text_blocks(batches: Iterator[pa.RecordBatch], columns: str | tuple[str, ...], limit: int = TEXT_BLOCK) -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of about `limit` bytes of some string or binary columns, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ((columns,) if isinstance(columns, str) else columns))
        block = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only, alike in every engine."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- hashes of words ------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ORDER = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_pow = [np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    if len(_pow[0]) < n:
        p = np.full(max(n, 64), _BASE, np.uint64)
        p[0] = 1
        _pow[0] = np.cumprod(p)
    return _pow[0]


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some texts, A-Z lower-cased.

    hashes: 64-bit hash of each word; first: index of each text's first word
    (one more at the end); begin, end: byte range of each word in `buf`, and
    text_begin the byte where each text starts.
    """

    def __init__(self, texts: list[bytes]):
        self.buf = buf = b"\n".join(texts) + b"\n"
        arr = np.frombuffer(buf.lower(), np.uint8)
        solid = ~_SPACE[arr]
        edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        self.begin, self.end = edge[::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_begin = np.cumsum(sizes) - sizes
        self.first = np.append(np.searchsorted(self.begin, self.text_begin), len(self.begin))
        lens = self.end - self.begin
        if len(lens):
            start = np.cumsum(lens) - lens
            offset = np.arange(lens.sum()) - np.repeat(start, lens)
            value = _BYTE[arr[solid]] * _powers(int(lens.max()))[offset]
            self.hashes = mix(np.add.reduceat(value, start) ^ lens.astype(np.uint64))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def runs(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, across texts too: callers cut at `first`."""
        w = self.hashes
        n = len(w) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += w[j : j + n] * _ORDER[j]
        return mix(out)


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of k-word shingles.

    A text with fewer than k words, but some, has the whole sequence as its
    only shingle; without words the set is empty.
    """
    words = Words(texts)
    runs, out = words.runs(k), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            w = words.hashes[a:b]
            out.append(mix(np.atleast_1d((w * _ORDER[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
