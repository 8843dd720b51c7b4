"""Language ID: nearest-centroid classification.

Texts become normalised TF-IDF vectors of hashed character n-grams.  Each
language has several centroids, found by spherical k-means among its labelled
texts; a text takes the language of the centroid with the largest cosine, and
is rejected if that cosine is far below what labelled texts of its length
reach.

The classifier is fitted on the driver from at most `max_rows` labelled rows
(the smallest hashes of id and text, an equal number for each language) and
at most `max_chars` characters of each.  Predictions use whole texts, and only
their texts.

Defined results: null texts and texts without a letter are `und` with score 0
and rejected; with no labelled row at all every text is `und`; repeated rows
are predicted alike; ties go to the language first in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import mix, table, text_blocks

#: Hashed n-gram dimensions.
DIMS = 1 << 14
NGRAMS = (1, 2, 3)
UND = "und"
#: Upper ends of the length classes (letters) that have rejection thresholds of their own.
LENGTHS = (8, 24, 72, 216, 648)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _gram_counts(texts: list[str | None], dims: int = DIMS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(dimension, count) of each text's n-grams, and its number of letters.

    Runs of anything but letters become one blank; letters are lower-cased.
    """
    lowered = [f" {(t or '').lower()} " for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = _letters(code)
    n_letters = np.bincount(owner[letter], minlength=len(texts))
    first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(code) else np.zeros(0, bool)
    keep = letter | first | np.concatenate(([False], letter[:-1])) if len(code) else letter
    value = np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)
    owner = owner[keep]
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    dim = []
    for n in NGRAMS:
        h = np.zeros(max(len(value) - n + 1, 0), np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + value[j : j + len(h)]
        dim.append((mix(h + _SEEDS[n - 1]) % np.uint64(dims)).astype(np.int64))
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        grams = np.concatenate([d[a : b - n + 1] for n, d in zip(NGRAMS, dim, strict=True) if b - n + 1 > a]) if b > a else np.zeros(0, np.int64)
        counts = np.bincount(grams, minlength=dims)
        at = np.flatnonzero(counts)
        out.append((at, counts[at]))
    return out, n_letters


def _letters(code: np.ndarray) -> np.ndarray:
    """Which code points are letters (str.isalpha), through a table of the ones that occur."""
    out = ((code | 32) >= 97) & ((code | 32) <= 122)
    rest = code > 127
    if rest.any():
        known, where = np.unique(code[rest], return_inverse=True)
        out[rest] = np.fromiter((chr(c).isalpha() for c in known.tolist()), bool, len(known))[where]
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (n, DIMS), unit rows
    owner: np.ndarray  # language of each centroid
    reject_below: np.ndarray = field(default_factory=lambda: np.zeros(len(LENGTHS) + 1))

    def vectors(self, texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        grams, letters = _gram_counts(texts)
        out = []
        for at, n in grams:
            w = (1.0 + np.log(n)) * self.idf[at] if len(at) else np.zeros(0)
            norm = np.sqrt((w * w).sum())
            out.append((at, w / norm if norm else w))
        return out, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and whether it is rejected, of each text."""
        vectors, letters = self.vectors(texts)
        langs, scores = [], np.zeros(len(texts))
        for i, (at, w) in enumerate(vectors):
            if not letters[i] or not self.languages:
                langs.append(UND)
                continue
            cosines = self.centroids[:, at] @ w
            best = int(np.argmax(cosines))
            langs.append(self.languages[self.owner[best]])
            scores[i] = min(1.0, max(0.0, float(cosines[best])))
        rejected = np.array([x == UND for x in langs], bool) | (scores < self.reject_below[np.searchsorted(LENGTHS, letters)])
        return langs, scores, rejected


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means with far-apart seeds; unit rows."""
    k = min(k, len(x))
    picks = [int(rng.integers(len(x)))]
    near = x @ x[picks[0]]
    for _ in range(k - 1):
        picks.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picks[-1]])
    c = x[picks]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit_language_id(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = 2000, max_chars: int = 4000, per_language: int = 4, strictness: float = 0.5, seed: int = 7
) -> Model:
    """Fits centroids and thresholds on at most `max_rows` labelled rows.

    Rows with null text or language are left out.  A text is rejected below
    `strictness` times the least cosine that labelled texts, cut to its length
    class, reach.
    """
    # the key only orders the sample, so that texts that are repeated don't stand or fall together
    order = F.pmod(F.xxhash64(*([key] if key in labelled.columns else []), text), F.lit(1 << 40))
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.substring(text, 1, max_chars).alias("text"), F.col(lang).alias("lang"), order.alias("order"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return Model([], np.ones(DIMS), np.zeros((0, DIMS)), np.zeros(0, np.int64))
    share = max(1, max_rows // len(counts))
    # a sample whose size is bounded by max_rows: the smallest hashes of each language, found among those below a bound that lets about four times as many through
    bounds = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, int(min(1.0, 4.0 * share / n) * (1 << 40)))))
    least = Window.partitionBy("lang").orderBy("order", "text")
    first = lambda some: [tuple(r) for r in some.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= share).select("lang", "text").collect()]
    picked = first(rows.where(F.col("order") <= F.element_at(bounds, F.col("lang"))))
    short = [name for name, n in counts.items() if sum(x == name for x, _ in picked) < min(share, n)]
    if short:  # rows that are repeated whole, and share a hash, may leave too few below the bound
        picked = [p for p in picked if p[0] not in short] + first(rows.where(F.col("lang").isin(short)))
    picked.sort()
    langs = sorted({x for x, _ in picked})
    rng = np.random.default_rng(seed)
    grams, letters = _gram_counts([t for _, t in picked])
    df = np.zeros(DIMS)
    for at, _ in grams:
        df[at] += 1
    idf = np.log((1.0 + len(picked)) / (1.0 + df)) + 1.0
    model = Model(langs, idf, np.zeros((0, DIMS)), np.zeros(0, np.int64))
    centroids, owner = [], []
    for i, name in enumerate(langs):
        own = [t for (x, t), n in zip(picked, letters, strict=True) if x == name and n]
        if not own:
            continue
        x = np.zeros((len(own), DIMS))
        for row, (at, w) in zip(x, model.vectors(own)[0], strict=True):
            row[at] = w
        c = _kmeans(x, per_language, 8, rng)
        centroids.append(c)
        owner += [i] * len(c)
    if not owner:
        return Model([], idf, np.zeros((0, DIMS)), np.zeros(0, np.int64))
    model = Model(langs, idf, np.concatenate(centroids), np.array(owner))
    floors = []
    texts = [t for _, t in picked]
    for n in (2, *LENGTHS):
        _, scores, _ = model.predict([t[:n] for t in texts])
        scores = scores[scores > 0]
        floors.append(strictness * float(scores.min()) if len(scores) else 0.0)
    return Model(langs, idf, model.centroids, model.owner, np.array(floors))


_OUT = "lang_pred string, score double, rejected boolean"


def identify_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and rejected; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "rejected")
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, names[at]):
            langs, scores, rejected = model.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], names=[*names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(_OUT).fields]))


def held_out(key: str = "doc_id"):
    """Whether a document may not be learnt from: crc32 of its id as text, mod 3, is 1."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 3 == 1


def fit_on_documents(docs: DataFrame) -> Model:
    return fit_language_id(docs.where(~held_out()))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on_documents(docs)
    return identify_language(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


QUERIES = {"op8_language_id": op8_language_id}
ORACLE: dict[str, str] = {}
