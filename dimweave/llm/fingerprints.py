"""Document fingerprints: Order MinHash. [native]

k-mers are runs of K words (pieces of at most WORD characters between white
space); each is numbered among its equals, so repeats count.  One hash deals
the numbered k-mers to BINS bins, and each bin keeps its smallest.  Slot j of
the fingerprint hashes the pair of bin j's k-mer and the next non-empty bin's,
in the order in which they stand in the text: moving or editing text changes
the pairs, so the share of equal slots follows edit distance rather than
shared vocabulary.  Built-in functions only.

Positions and hashes are packed into longs, so arrays are sorted as
primitives and cost n log n for any text.

Defined results: null and empty texts, and texts of white space, have the
empty fingerprint (all slots blank), alike to each other (1.0) and to nothing
else; a text of fewer than K words is one k-mer; equal texts have equal
fingerprints; rows without an id stand last; rows of one id stand in the order
of their texts' hashes; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

K = 2
WORD = 24
BINS = 64
#: Cuts of the order in which successors are sought, at each of two levels: CUTS * CUTS ranges at most, whose bounds are broadcast.
CUTS = 512
#: Rows that a range has about, while there are fewer ranges than that.
RANGE_ROWS = 500

#: No array of longs in a Spark row has 2^28 entries, as its bytes are counted by an int: positions don't wrap.
_POSITION_BITS = 28
_POSITION = (1 << _POSITION_BITS) - 1
_HASH_BITS = 63 - _POSITION_BITS
_BLANK = "--------"
#: Steps of the search for how many equals precede a k-mer.
_STEPS = tuple(1 << j for j in range(_POSITION_BITS - 1, -1, -1))


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kmers(text: Column) -> Column:
    """Sorted longs: 35 bits of each k-mer's hash, then its position (28 bits)."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\S{{1,{WORD}}}"), 0)
    key = lambda parts, i: F.shiftleft(F.xxhash64(*parts).bitwiseAND(F.lit((1 << _HASH_BITS) - 1)), _POSITION_BITS).bitwiseOR(i.cast("long").bitwiseAND(F.lit(_POSITION)))

    def runs(w: Column) -> Column:
        n = F.size(w) - (K - 1)
        many = F.transform(F.slice(w, 1, F.greatest(n, F.lit(0))), lambda x, i: key([x, *(F.get(w, i + j) for j in range(1, K))], i))
        return F.when(n > 0, many).when(F.size(w) > 0, F.array(key([F.array_join(w, " ")], F.lit(0)))).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(_let(words, runs))


def _numbered(sorted_kmers: Column) -> Column:
    """Sorted longs of numbered k-mers: bin (6 bits), 29 bits of a hash of k-mer and number, position."""

    def number(s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            h = F.shiftrightunsigned(x, _POSITION_BITS)
            same = lambda d: (i >= d) & (F.shiftrightunsigned(F.get(s, i - d), _POSITION_BITS) == h)
            many = F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), lambda r, d: F.when(same(r + d), r + d).otherwise(r))
            nth = F.when(~same(F.lit(1)), F.lit(0)).when(~same(F.lit(2)), F.lit(1)).otherwise(many)
            return F.shiftleft(F.shiftrightunsigned(F.xxhash64(h, nth), 64 - _HASH_BITS), _POSITION_BITS).bitwiseOR(x.bitwiseAND(F.lit(_POSITION)))

        return F.sort_array(F.transform(s, one))

    return _let(sorted_kmers, number)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 57).cast("int")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a whole text: BINS slots of 8 characters, one string."""

    def slots(v: Column) -> Column:
        least = F.filter(v, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(v, i - 1))))

        def paired(m: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                y = F.coalesce(F.get(m, i + 1), F.get(m, F.lit(0)))
                a, b = F.shiftrightunsigned(x, _POSITION_BITS), F.shiftrightunsigned(y, _POSITION_BITS)
                ahead = x.bitwiseAND(F.lit(_POSITION)) <= y.bitwiseAND(F.lit(_POSITION))
                code = F.when(ahead, F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
                return F.concat(F.repeat(F.lit(_BLANK), _bin(x) - F.coalesce(_bin(F.get(m, i - 1)), F.lit(-1)) - 1), F.lower(F.lpad(F.hex(code.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))

            return F.rpad(F.array_join(F.transform(m, one), ""), 8 * BINS, "-")

        return _let(least, paired)

    return _let(_numbered(_kmers(text)), slots)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those that either fingerprint has (0 to 1); 1 if neither has any."""

    def shares(same: Column) -> Column:
        either, equal = F.aggregate(same, F.lit(0), lambda n, x: n + F.least(x, F.lit(1))), F.aggregate(same, F.lit(0), lambda n, x: n + F.when(x == 2, 1).otherwise(0))
        return F.when(either == 0, F.lit(1.0)).otherwise(equal / either)

    slot = lambda i: F.struct(F.substring(a, i, F.lit(8)).alias("a"), F.substring(b, i, F.lit(8)).alias("b"))
    kind = lambda s: F.when((s["a"] == _BLANK) & (s["b"] == _BLANK), F.lit(0)).when(s["a"] == s["b"], F.lit(2)).otherwise(F.lit(1))
    return F.when(a == b, F.lit(1.0)).otherwise(_let(F.transform(F.transform(F.sequence(F.lit(1), F.lit(8 * BINS), F.lit(8)), slot), kind), shares))


def _range_of(id_: Column, bounds: list[int]) -> Column:
    """Which of the ranges that descending `bounds` cut `id_` stands in, the last one without an id; by halving, so few comparisons a row."""

    def cut(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(id_ >= bounds[mid], cut(lo, mid)).otherwise(cut(mid + 1, hi))

    return F.when(id_.isNull(), F.lit(len(bounds) + 1)).otherwise(cut(0, len(bounds)))


def _ranges(order: DataFrame, scratch: Scratch) -> tuple[list[int], DataFrame, DataFrame]:
    """Of (key, tie): descending bounds of the first level, (range, one, cuts) of the second, and (range, part, before, key, tie).

    The first level cuts keys at quantiles, and a key that fills a range is a
    range of its own, as are rows without one.  The second cuts each range to
    parts of about RANGE_ROWS rows: by key, or where it holds `one` key by tie.
    The last table names the range and part before each one that has rows
    (before the first: the last one), and the key and tie that its rows begin with.
    """
    n = order.count()
    ranges = min(CUTS, max(1, n // RANGE_ROWS))
    shares = lambda k: [i / k for i in range(1, k)]
    cuts = order.agg(F.percentile_approx("key", shares(ranges), 20 * ranges).alias("q")).first()["q"] if ranges > 1 else []
    cuts = sorted(cuts or [], reverse=True)
    bounds = sorted({*cuts, *(a + 1 for a, b in zip(cuts, cuts[1:], strict=False) if a == b and a < (1 << 63) - 1)}, reverse=True)
    ranged = order.withColumn("range_", _range_of(F.col("key"), bounds))

    one = F.coalesce(F.min("key") == F.max("key"), F.lit(True))
    quantiles = lambda c: F.percentile_approx(c, shares(CUTS), 20 * CUTS)
    found = ranged.groupBy("range_").agg(one.alias("one_"), F.count("*").alias("n"), quantiles(F.col("tie")).alias("ties"), quantiles(F.bitwise_not("key")).alias("keys"))
    parts = F.least(F.lit(CUTS), F.ceil(F.col("n") / RANGE_ROWS)).cast("int")
    some = lambda q: F.transform(F.slice(F.sequence(F.lit(0), parts - 1), 2, CUTS), lambda i: F.get(q, F.floor(i * CUTS / parts).cast("int") - 1))
    level = scratch.keep(found.select("range_", "one_", some(F.when(F.col("one_"), F.col("ties")).otherwise(F.col("keys"))).alias("cuts_")))

    least = F.struct(F.bitwise_not("key").alias("down"), "tie")
    heads = ranged.join(F.broadcast(level), "range_").withColumn("part_", _part_of("key", "tie")).groupBy("range_", "part_").agg(F.min(least).alias("head"))
    place, every = F.struct("range_", "part_"), Window.partitionBy()  # CUTS * CUTS narrow rows at most
    before = F.coalesce(F.lag(place).over(Window.orderBy("range_", "part_")), F.max(place).over(every))
    return bounds, level, scratch.keep(heads.select("range_", "part_", before.alias("before_"), F.bitwise_not("head.down").alias("head_key_"), F.col("head.tie").alias("head_tie_")))


def _part_of(key: str, tie: str) -> Column:
    here = F.when(F.col("one_"), F.col(tie)).otherwise(F.bitwise_not(key))
    return F.size(F.filter("cuts_", lambda x: x <= here))


def with_next(docs: DataFrame, key: str, carried: list[str], tie: str) -> DataFrame:
    """`docs` with next_<c> for c in `carried`, of the row next in descending `key`; the first follows the last.

    Rows of one key stand by `tie`, a long of which equal values have equal
    `carried`.  A task sorts a range of that order (see `_ranges`); the row
    that a range begins with also goes to the end of the range before it, so
    whole rows travel once and none is broadcast.
    """
    scratch = Scratch(docs.sparkSession)
    order = scratch.keep(docs.select(F.col(key).cast("long").alias("key"), F.col(tie).alias("tie")))
    bounds, level, heads = _ranges(order, scratch)
    ranged = docs.withColumn("range_", _range_of(F.col(key), bounds)).join(F.broadcast(level), "range_").withColumn("part_", _part_of(key, tie))
    headed = ranged.join(F.broadcast(heads), ["range_", "part_"])
    own = lambda copy: F.struct("range_", "part_", F.lit(copy).alias("copy"))
    ahead = F.struct(F.col("before_.range_").alias("range_"), F.col("before_.part_").alias("part_"), F.lit(True).alias("copy"))
    heading = F.col(key).eqNullSafe(F.col("head_key_")) & (F.col(tie) == F.col("head_tie_"))
    dealt = headed.withColumn("to_", F.explode(F.when(heading, F.array(own(False), ahead)).otherwise(F.array(own(False)))))
    w = Window.partitionBy("to_.range_", "to_.part_").orderBy("to_.copy", F.desc_nulls_last(key), tie)
    led = dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).where("not to_.copy")
    return led.select(*docs.columns, *(f"next_{c}" for c in carried))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last floor(n_chars / 3) code points replaced by
    the first as many, or all, of the next document's.
    """
    base = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({"print": fingerprint(F.col("text")), "tie": F.xxhash64("text")})
    led = with_next(base, key, ["text", "print"], "tie")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = led.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    prints = edited.select(key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("print").alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_print")
    return prints.select(
        key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next")
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_fingerprints": op6_fingerprints}
ORACLE: dict[str, str] = {}
