"""Mixing sources to target weights: Poisson replication.

Each source has a target share of the mixture; its share over its present
share, times the size wanted over the present size, is the mean repetition
rate of its documents.  Each document's count inverts the Poisson
distribution with that mean at a uniform number hashed from a seed and the
document, so that it is the same on every run.  Documents are exploded by
their counts and put in a hash-seeded random order over the whole mixture.

Sizes are characters, counted over all documents.  A null source is a source
of its own; null texts have size 0.  Repeated rows share their uniform number
(it hashes id and text), so they are repeated alike.  A rate above
MAX_PART is drawn as a sum of equal Poisson parts, which has the same
distribution.  Sources of total size 0 have rate 1.  An empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Largest mean that one inversion handles; exp(-MAX_PART) is far from underflow.
MAX_PART = 64.0
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 100_000
#: Seed of op2 and the pipeline.
SEED = 20240501
#: Target weights of the production mixture: what is not named has weight 1.
WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 2.0, "src3": 0.5}

_TOP = float(1 << 52)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1), hashed from `parts` (strings), alike in every engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(_TOP)


def _cdf(rate: Column) -> Column:
    """Poisson CDF at 0, 1, ... far enough that what is left is below any uniform number's step."""
    top = (rate + F.lit(12.0) * F.sqrt(rate) + F.lit(30.0)).cast("int")
    first = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    return F.aggregate(
        F.sequence(F.lit(1), top),
        first,
        lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * rate / k)).alias("c")),
        lambda acc: acc["c"],
    )


def source_rates(docs: DataFrame, weights: dict[str, float], default: float = 1.0, total: float | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """(source, size, rate, parts, cdf) of every source of `docs`; size in characters, `total` the mixture's (default: the present)."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(F.char_length(text)), F.lit(0)).cast("double").alias("size"))
    weight = F.lit(float(default))
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    whole = sizes.agg(F.sum("size").alias("size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("weight")).first()
    wanted = F.lit(float(whole["size"] or 0) if total is None else float(total))
    rate = F.when(F.col("size") > 0, F.col("weight") / F.lit(whole["weight"] or 1.0) * wanted / F.col("size")).otherwise(F.lit(1.0))
    return (
        sizes.select("source", "size", rate.alias("rate"))
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_PART)).cast("int")))
        .withColumn("cdf", _cdf(F.col("rate") / F.col("parts")))
    )


def mix_sources(docs: DataFrame, weights: dict[str, float], default: float = 1.0, total: float | None = None, seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """`docs` replicated to the target weights, in random order: all columns of `docs`, and copy_no from 1."""
    rates = source_rates(docs, weights, default, total, source, text).select(F.col("source").alias("source_"), F.col("parts").alias("parts_"), F.col("cdf").alias("cdf_"))
    few = rates.select("source_").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rates = F.broadcast(rates) if few else rates
    ident = F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    # hashed below the join, so that each text is hashed once
    drawn = docs.withColumn("ident_", ident).join(rates, F.col(source).eqNullSafe(F.col("source_")), "left")
    at = lambda part: F.array(uniform(F.lit(str(seed)), part, F.col("ident_")))  # noqa: E731  an array binds the number once
    below = lambda part: F.element_at(F.transform(at(part), lambda u: F.size(F.filter(F.col("cdf_"), lambda c: c < u))), 1)
    # one part in almost every case; the sum over more is the same draw
    count = F.when(F.col("parts_") == 1, below(F.lit("1"))).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("parts_")), F.lit(0), lambda acc, j: acc + below(j.cast("string"))))
    out = drawn.withColumn("copies_", count).where("copies_ > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies_"))))
    order = uniform(F.lit(str(seed)), F.lit("order"), F.col("ident_"), F.col("copy_no").cast("string"))
    return out.withColumn("order_", order).orderBy("order_").drop("source_", "parts_", "cdf_", "copies_", "order_", "ident_")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), WEIGHTS)


def mixing_sql(docs: str, columns: str = "doc_id, text, lang, source, n_chars, copy_no") -> str:
    """The mixture of relation `docs` as DuckDB SQL."""
    weight = "CASE " + " ".join(f"WHEN source = '{k}' THEN {float(v)}::DOUBLE" for k, v in WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"
    return f"""
WITH RECURSIVE sizes AS (SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS size, {weight} AS weight FROM {docs} GROUP BY source),
whole AS (SELECT sum(size) AS all_size, sum(weight) FILTER (size > 0) AS all_weight FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 THEN weight / all_weight * all_size / size ELSE 1.0::DOUBLE END AS rate FROM sizes, whole),
parts AS (SELECT source, greatest(1, ceil(rate / {MAX_PART}::DOUBLE))::INTEGER AS n FROM rates),
cdf AS (SELECT source, n, r, 0 AS k, exp(-r) AS p, exp(-r) AS c FROM (SELECT p.source, p.n, rate / p.n AS r FROM parts p JOIN rates q ON p.source IS NOT DISTINCT FROM q.source)
  UNION ALL SELECT source, n, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM cdf WHERE k + 1 <= floor(r + 12.0::DOUBLE * sqrt(r) + 30.0::DOUBLE)),
steps AS (SELECT source AS src, n, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, n),
drawn AS (SELECT *, range(1, n + 1) AS js, coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS ident FROM {docs} JOIN steps ON source IS NOT DISTINCT FROM src),
counted AS (SELECT *, list_sum(list_transform(js, lambda j: len(list_filter(cs, lambda c: c <
  (CAST('0x' || substr(md5('{SEED}|' || j || '|' || ident), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / {_TOP}::DOUBLE))))::BIGINT AS copies FROM drawn)
SELECT {columns} FROM (SELECT *, unnest(range(1, copies + 1))::INTEGER AS copy_no FROM counted)"""


QUERIES = {"op2_mixing": op2_mixing}
ORACLE = {"op2_mixing": mixing_sql("documents")}
