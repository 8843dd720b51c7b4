"""Suffix-array dedup: sparse suffix arrays.

Passages of at least `min_words` words that occur more than once, in whatever
documents, are found.  Of every text, only suffixes at minimiser positions are
retained: of each SPAN consecutive runs of RUN words, the run with the
smallest hash.  As SPAN + RUN - 1 is at most `min_words`, two equal passages
of that length retain the same run.  Each window of MIN_WORDS words belongs to the
run that it retains; the words of all windows of a retained run are its
context.  Of equal runs, those of one context are sorted by their content (ever
longer stretches) and neighbours are compared.  Where equal runs have several
contexts, the first run of each is also compared with its neighbours in each
window that recurs, so that no two holders of a window are missed.  Matches are
extended left and right, word by word, on the whole texts.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; white space between
them doesn't count.

Defined results: texts that are null, empty or shorter than `min_words` hold
no passage; a passage that repeats within one text counts; rows without an id
take no part; rows that share an id and a text are one text, and other rows
that share an id are told apart by their texts' hashes; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, mix, table, text_blocks, text_bytes

MIN_WORDS = 50
RUN = 36
SPAN = MIN_WORDS - RUN + 1
#: Words of the longer stretches by which suffixes of equal contexts are sorted.
STRETCHES = (64, 128)

_B = np.uint64(0xD6E8FEB86659FD93)
_B_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums that give every stretch's hash, P[i] = h[0] + h[1] B + ... of i terms, and the powers of 1 / B."""
    p, q = np.full(len(h) + 1, _B, np.uint64), np.full(len(h) + 1, _B_INVERSE, np.uint64)
    p[0] = q[0] = 1
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(p)[:-1], dtype=np.uint64))), np.cumprod(q)


def _stretch(prefix: np.ndarray, inverse: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, the same wherever they stand."""
    return mix((prefix[at + n] - prefix[at]) * inverse[at])


def minimisers(hashes: np.ndarray, first: np.ndarray, prefix: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the runs that are the smallest (the rightmost of equals) of some SPAN consecutive runs of a text; the first and last start of those.

    first: where each of the texts begins in `hashes`, and the end.
    """
    ends = np.repeat(first[1:], np.diff(first))
    start = np.flatnonzero(np.arange(len(hashes)) + MIN_WORDS <= ends)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    h = _stretch(prefix, inverse, np.arange(len(hashes) - RUN + 1), RUN)
    windows = np.lib.stride_tricks.sliding_window_view(h, SPAN)
    at = start + SPAN - 1 - np.argmin(windows[:, ::-1], axis=1)[start]
    # later windows have no earlier minimiser
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return at[new], start[new], start[np.append(new[1:], len(at)) - 1]


def _retain_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, ctx, s0, s1, id, row, at, lo, hi): hashes of the run at each retained position, of its context and of longer stretches; its windows start at lo..hi."""
    for batch in text_blocks(batches, "text", 1 << 20):
        words = Words(text_bytes(batch.column(2)))
        prefix, inverse = _prefix(words.hashes)
        at, lo, hi = minimisers(words.hashes, words.first, prefix, inverse)
        text = np.searchsorted(words.first, at, side="right") - 1
        begin, end = words.first[text], words.first[text + 1]
        run = _stretch(prefix, inverse, at, RUN)
        ctx = mix(_stretch(prefix, inverse, lo, hi - lo + MIN_WORDS) + ((at - lo) * SPAN + hi - lo).astype(np.uint64))
        longer = []
        for n in STRETCHES:
            fits = at + n <= end
            longer.append(np.zeros(len(at), np.uint64))
            longer[-1][fits] = _stretch(prefix, inverse, at[fits], n) >> np.uint64(33)
        take = pa.array(text)
        ints = [pa.array(c.astype(np.int32)) for c in (*longer, at - begin, lo - begin, hi - begin)]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c.view(np.int64)) for c in (run, ctx)), *ints[:2], batch.column(0).take(take), batch.column(1).take(take), *ints[2:]],
            names=["run", "ctx", "s0", "s1", "id", "row", "at", "lo", "hi"],
        )


def _lists(column: pa.Array, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of lists of structs without nulls inside: where each list begins, and the end; and the fields of all. A null is an empty list."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    inner = column.flatten()
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64))), [pc.struct_field(inner, f).to_numpy(zero_copy_only=False) for f in fields]


def _window_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (win, ctx, many, id, row, at, start) of the windows of each text's listed runs, win their hash."""
    for whole in batches:
        for batch in text_blocks((whole,), "text", 1 << 20):
            words = Words(text_bytes(batch.column(3)))
            prefix, inverse = _prefix(words.hashes)
            begin, (ctx, many, at, lo, hi) = _lists(batch.column(2), ("ctx", "many", "at", "lo", "hi"))
            text = np.repeat(np.arange(batch.num_rows), np.diff(begin))
            each = hi.astype(np.int64) - lo + 1
            of = np.repeat(np.arange(len(each)), each)  # each window's run
            start = lo[of] + np.arange(len(of)) - (np.cumsum(each) - each)[of]
            win = _stretch(prefix, inverse, words.first[text[of]] + start, MIN_WORDS).view(np.int64)
            take = pa.array(text[of])
            yield pa.RecordBatch.from_arrays(
                [pa.array(win), pa.array(ctx[of]), pa.array(many[of].astype(bool)), batch.column(0).take(take), batch.column(1).take(take), pa.array(at[of].astype(np.int32)), pa.array(start.astype(np.int32))],
                names=["win", "ctx", "many", "id", "row", "at", "start"],
            )


_ORDER = ["run", "s0", "s1", "id", "row", "at"]
_SUFFIX = ["row", "at", "first_id"]
_PAIR = "run long, edge int, part int, " + ", ".join(f"row_{x} long, at_{x} int, first_id_{x} long" for x in "ab")


def _neighbour_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbouring suffixes of equal run (a context or a window), of rows sorted by _ORDER; and a part's first (edge 1) and last (edge 2) suffix."""
    from pyspark import TaskContext

    part, last = TaskContext.get().partitionId(), None

    def rows(run: list, a: list[list], b: list[list], edge: int) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64())
        n = len(run)
        head = [pa.array(run, pa.int64()), pa.array([edge] * n, pa.int32()), pa.array([part] * n, pa.int32())]
        return pa.RecordBatch.from_arrays([*head, *(pa.array(x, k) for x, k in zip([*a, *b], kinds * 2, strict=True))], names=["run", "edge", "part", *(f"{c}_{x}" for x in "ab" for c in _SUFFIX)])

    for batch in batches:
        if not batch.num_rows:
            continue
        run, *cols = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("run", *_SUFFIX))
        if last is None:
            first = [c[:1] for c in cols]
            yield rows(run[:1], first, first, 1)
        else:
            run, cols = [last[0], *run], [[x, *c] for x, c in zip(last[1:], cols, strict=True)]
        same = [i for i in range(len(run) - 1) if run[i] == run[i + 1]]
        yield rows([run[i] for i in same], [[c[i] for i in same] for c in cols], [[c[i + 1] for i in same] for c in cols], 0)
        last = (run[-1], *(c[-1] for c in cols))
    if last is not None:
        end = [[x] for x in last[1:]]
        yield rows([last[0]], end, end, 2)


def _extend_pass(min_words: int):
    """Maximal matches of two texts from pairs of positions; rows (row_a, row_b, pairs, text_a, text_b, firsts_a, firsts_b).

    A match is late in a text if it holds no window whose first occurrence is there; firsts are the ranges of such windows' starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "n_words", "start_byte", "end_byte", "late", "first_id"]
        for whole in batches:
            for batch in text_blocks((whole,), ("text_a", "text_b"), 1 << 20):
                c = {n: batch.column(batch.schema.get_field_index(n)) for n in ("row_a", "row_b", "pairs", "text_a", "text_b", "firsts_a", "firsts_b")}
                rows_a, rows_b = c["row_a"].to_pylist(), c["row_b"].to_pylist()
                texts = dict(zip(rows_a, text_bytes(c["text_a"]), strict=True)) | dict(zip(rows_b, text_bytes(c["text_b"]), strict=True))
                words, place = Words(list(texts.values())), {row: i for i, row in enumerate(texts)}  # each text once
                low, hashes, first = words.buf.lower(), words.hashes, words.first.tolist()
                begin, found = _lists(c["pairs"], ("at_a", "at_b", "first_id_a"))
                order = np.lexsort((found[1], found[0], np.repeat(np.arange(batch.num_rows), np.diff(begin))))
                found = [x[order].tolist() for x in found]
                places = [np.array([place[row] for row in rows]) for rows in (rows_a, rows_b)]
                kept: list[tuple] = []  # text, start and end in words, first id
                for ta, tb, i, j in zip(*(x.tolist() for x in (*places, begin[:-1], begin[1:])), strict=True):
                    ba, bb = first[ta], first[tb]
                    ha, hb = hashes[ba : first[ta + 1]], hashes[bb : first[tb + 1]]
                    matches: dict[tuple[int, int], list] = {}  # by diagonal and start: end, first id
                    reach: dict[int, tuple[int, int]] = {}  # by diagonal: the last match
                    for at_a, at_b, first_id in zip(*(x[i:j] for x in found), strict=True):
                        d = at_a - at_b
                        s, e = reach.get(d, (0, -1))
                        if e < at_a + RUN:
                            s, e = reach[d] = _extend(ha, hb, at_a, at_b)
                        m = matches.setdefault((d, s), [e, first_id])
                        m[1] = min(m[1], first_id)
                    for (d, s), (e, first_id) in matches.items():
                        if e - s >= min_words and _equal(words, low, ba + s, bb + s - d, e - s):
                            kept += (ta, s, e, first_id), (tb, s - d, e - d, first_id)
                text, start, end, first_id = np.array(kept, np.int64).reshape(-1, 4).T
                late = ~_holds([_lists(c[n], ("lo", "hi")) for n in ("firsts_a", "firsts_b")], places, text, start, end - MIN_WORDS)
                bytes_of = [at - words.text_begin[text] for at in (words.begin[words.first[text] + start], words.end[words.first[text] + end - 1])]
                out = (np.array(list(texts), np.int64)[text], end - start, *bytes_of, late.astype(np.int64), first_id)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    return run


def _holds(ranges: list[tuple], places: list[np.ndarray], text: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a range (lo, hi) of the text meets low..high; ranges: lists of them, as of _lists, of the texts `places`."""
    of = np.concatenate([np.repeat(p, np.diff(begin)) for p, (begin, _) in zip(places, ranges, strict=True)]) << 32
    lo, hi = (of + np.concatenate([r[i] for _, r in ranges]) for i in (0, 1))
    order = np.argsort(lo)
    reach = np.append(np.maximum.accumulate(hi[order]), -1)  # of the ranges up to each; ranges of earlier texts end below a text's own
    return reach[np.searchsorted(lo[order], (text << 32) + high, side="right") - 1] >= (text << 32) + low


def _extend(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """The longest stretch of equal words around position i of a and j of b, as positions of a."""
    n = min(len(a) - i, len(b) - j)
    differ = np.flatnonzero(a[i : i + n] != b[j : j + n])
    end = i + (int(differ[0]) if len(differ) else n)
    m = min(i, j)
    differ = np.flatnonzero(a[i - m : i] != b[j - m : j])
    return (i - m + int(differ[-1]) + 1 if len(differ) else i - m), end


def _equal(words: Words, low: bytes, i: int, j: int, n: int) -> bool:
    """Whether n words from i and from j are equal as text (`low`, lower-cased), not only by their hashes."""
    a, b = (low[words.begin[x] : words.end[x + n - 1]] for x in (i, j))
    return a == b or a.split() == b.split()


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of `min_words` words or more that recur, as stretches of each text that holds them.

    (key, start, end, n_words, first_id, is_first): characters start..end of
    the text, end exclusive; overlapping matches of one kind are one stretch.
    n_words is the longest match in it, first_id the smallest id that holds
    a window of MIN_WORDS words of the compared ones.  is_first: the stretch has a
    match with a window whose first occurrence this is; cutting the stretches that have none leaves each
    passage once.
    """
    if min_words < RUN + SPAN - 1:
        raise ValueError(f"min_words must be at least {RUN + SPAN - 1}")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(key, text).alias("row"), F.col(text).alias("text"))
    kept = texts.mapInArrow(_retain_pass, "run long, ctx long, s0 int, s1 int, id long, row long, at int, lo int, hi int")
    # only runs that occur again can match; contexts of one occurrence need windows, if there are others
    run, context, me = Window.partitionBy("run"), Window.partitionBy("run", "ctx"), F.struct("id", "row", "at")
    again = kept.withColumns({"low": F.min(me).over(run), "high": F.max(me).over(run), "mixed": F.min("ctx").over(run) != F.max("ctx").over(run)}).where("low <> high")
    again = again.withColumns({"low": F.min(me).over(context), "high": F.max(me).over(context)})
    shared = again.select("ctx", "s0", "s1", "id", "row", "at", "lo", "hi", "mixed", (F.col("low") != F.col("high")).alias("many"), (me == F.col("low")).alias("head"), F.col("low.id").alias("first_id"))
    shared = scratch.keep(shared.distinct())
    listed = scratch.keep(shared.where("mixed and head").groupBy("row").agg(F.collect_list(F.struct("ctx", "many", "at", "lo", "hi")).alias("runs")))  # of one text at most
    windowed = texts.join(listed, "row").select("id", "row", "runs", "text")
    wins = scratch.keep(windowed.mapInArrow(_window_pass, "win long, ctx long, many boolean, id long, row long, at int, start int"))
    place = F.struct("id", "row", "at", "start")
    found = wins.groupBy("win").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("many").alias("many"))
    found = scratch.keep(found.where("first <> last or many").select("win", "first", (F.col("first") != F.col("last")).alias("several")))
    met = scratch.keep(wins.drop("many").join(found, "win").select("win", "ctx", "id", "row", "at", "several", F.col("first.id").alias("first_id")))
    earliest = met.groupBy("ctx").agg(F.min("first_id").alias("earliest"))
    same = shared.where("many").join(earliest, "ctx", "left").withColumn("first_id", F.coalesce("earliest", "first_id"))
    zero = F.lit(0).cast("int")
    members = same.select(F.col("ctx").alias("run"), *_ORDER[1:], "first_id").unionByName(met.where("several").select(F.col("win").alias("run"), zero.alias("s0"), zero.alias("s1"), "id", "row", "at", "first_id"))
    ordered = scratch.keep(members).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    firsts = found.select("first.row", F.col("first.start").alias("lo"), F.col("first.start").alias("hi")).unionByName(shared.where("head and not mixed").select("row", "lo", "hi"))
    firsts = firsts.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("firsts"))  # of one text at most
    near = scratch.keep(ordered.mapInArrow(_neighbour_pass, _PAIR))
    # the last suffix of a part and the first of the next: two rows a part
    a_cols, b_cols = ([f"{c}_{x}" for c in _SUFFIX] for x in "ab")
    w = Window.orderBy("part", "edge")
    across = near.where("edge > 0").withColumn("prev", F.lag(F.struct("run", "edge", *a_cols)).over(w)).where("edge = 1 and prev.edge = 2 and prev.run = run")
    pairs = near.where("edge = 0").select(*a_cols, *b_cols).unionByName(across.select(*(F.col(f"prev.{c}").alias(c) for c in a_cols), *b_cols))
    # the two texts in a fixed order, so that each pair of texts is extended once
    swap = F.col("row_a") > F.col("row_b")
    pairs = pairs.where("row_a <> row_b or at_a <> at_b")
    pairs = pairs.select(*(F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in _SUFFIX))
    grouped = pairs.groupBy("row_a", "row_b").agg(F.collect_set(F.struct("at_a", "at_b", "first_id_a")).alias("pairs"))  # positions of two texts at most
    needed = scratch.keep(grouped)
    rows = scratch.keep(needed.select(F.col("row_a").alias("row")).unionByName(needed.select(F.col("row_b").alias("row"))).distinct())
    held = scratch.keep(rows.join(firsts, "row", "left"))
    used = scratch.keep(texts.join(held, "row"))
    side = lambda x: used.select(*(F.col(c).alias(f"{c}_{x}") for c in ("row", "text", "firsts")))
    both = needed.join(side("a"), "row_a").join(side("b"), "row_b")
    matches = both.select("row_a", "row_b", "pairs", "text_a", "text_b", "firsts_a", "firsts_b").mapInArrow(_extend_pass(min_words), "row long, n_words long, start_byte long, end_byte long, late long, first_id long")
    matches = scratch.keep(matches.distinct())

    # overlapping matches of one text and kind become one stretch
    by = Window.partitionBy("row", "late").orderBy("start_byte", "end_byte")
    reach = F.max("end_byte").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = matches.withColumn("reach", reach).withColumn("stretch", F.sum(F.when(F.col("reach").isNull() | (F.col("start_byte") >= F.col("reach")), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = opened.groupBy("row", "late", "stretch").agg(F.min("start_byte").alias("a"), F.max("end_byte").alias("b"), F.max("n_words").alias("n_words"), F.min("first_id").alias("first_id"))
    # bytes to characters, on the text itself
    cut = lambda n: F.char_length(F.decode(F.substring(F.encode("text", "UTF-8"), F.lit(1), n.cast("int")), "UTF-8")).cast("long")
    return spans.join(used, "row").select(F.col("id").alias(key), cut(F.col("a")).alias("start"), cut(F.col("b")).alias("end"), "n_words", "first_id", (F.col("late") == 0).alias("is_first")).distinct()


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
ORACLE: dict[str, str] = {}
