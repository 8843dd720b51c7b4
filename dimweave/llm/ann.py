"""Approximate nearest neighbours: learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts, and a
small classifier learns to tell from a vector in which part its neighbours
are.  Every vector is indexed in its most probable part, queries look into
their most probable parts, and what is found there is ranked by exact inner
products of the original vectors.  Only vectors whose product in single
precision is, within the bound of its error, among a query's k largest are
multiplied exactly, which gives the same rows as multiplying all.  How many parts are probed is measured on
vectors held out of the fit: as few as find TARGET_RECALL of their neighbours.

The sample, its graph and the classifier live on the driver and are bounded by
1.25 `sample` rows; the index holds every vector.  Parts are cut into chunks of at
most about CHUNK vectors, and a part's queries into blocks, so that a part
with a third of all vectors is searched by many tasks.

Defined results: vectors that are null, empty, all zero, of another length
than most, or hold null or non-finite numbers take no part; equal scores are
ordered by id; repeated ids are repeated candidates, but for the query's own
id; with fewer candidates all are given; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, table

SAMPLE = 8192
PARTS = 32
#: Recall that the number of probed parts is chosen for, on vectors held out of the fit.
TARGET_RECALL = 0.96
CHUNK = 8192
QUERIES_PER_BLOCK = 2048
K = 20


@dataclass(frozen=True)
class Router:
    """A two-layer classifier from a vector to parts; `norm` keeps inputs near 1."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    norm: float
    probes: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of the parts for each vector, in the order of their probability."""
        with np.errstate(over="ignore", invalid="ignore"):
            z = x / self.norm
            z = z / np.maximum(1.0, np.abs(z).max(axis=1, keepdims=True) / 1e6)
            return np.maximum(z @ self.w1 + self.b1, 0.0) @ self.w2 + self.b2

    def top(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :n]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each sampled vector's k others of the largest inner product, in blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        if k > 0:
            out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int, slack: float, rng: np.random.Generator) -> np.ndarray:
    """Parts of the neighbour graph, none above (1 + slack) times the mean.

    It starts at far-apart centres and repeatedly moves vectors to the part
    where most of their neighbours (either way) are, while there is room.
    """
    n = len(x)
    room = int(np.ceil(n / parts * (1 + slack)))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    centres = unit[rng.choice(n, parts, replace=False)]
    for _ in range(10):
        near = np.argmax(unit @ centres.T, axis=1)
        centres = np.stack([unit[near == j].sum(axis=0) if (near == j).any() else centres[j] for j in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)
    part = _fill(unit @ centres.T, room)
    ends = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (ends, part[graph.ravel()]), 1.0)
        np.add.at(votes, (graph.ravel(), part[ends]), 1.0)
        moved = _fill(votes + 0.5 * (np.arange(parts) == part[:, None]), room)
        if (moved == part).all():
            break
        part = moved
    return part


def _fill(score: np.ndarray, room: int) -> np.ndarray:
    """Gives each row its best column that has room; rows that lose most by going elsewhere choose first."""
    ranked = np.sort(score, axis=1)
    order = np.argsort(-(ranked[:, -1] - ranked[:, -2]) if score.shape[1] > 1 else np.zeros(len(score)), kind="stable")
    choice, left = np.argsort(-score, axis=1, kind="stable"), np.full(score.shape[1], room)
    out = np.zeros(len(score), np.int64)
    for i in order:
        for j in choice[i]:
            if left[j]:
                left[j] -= 1
                out[i] = j
                break
    return out


def train_router(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, hidden: int, epochs: int, rng: np.random.Generator) -> Router:
    """Learns each vector's shares of neighbours by part (softmax cross-entropy, Adam)."""
    norm = float(np.sqrt((x * x).mean())) or 1.0
    z, n = x / norm, len(x)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph.ravel()]), 1.0)
    target[np.arange(n), part] += 1.0
    target /= target.sum(axis=1, keepdims=True)
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(2 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for idx in np.array_split(rng.permutation(n), max(1, n // 256)):
            h = np.maximum(z[idx] @ p[0] + p[1], 0.0)
            s = h @ p[2] + p[3]
            s = np.exp(s - s.max(axis=1, keepdims=True))
            d = (s / s.sum(axis=1, keepdims=True) - target[idx]) / len(idx)
            dh = (d @ p[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((z[idx].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*p, norm)


def valid_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows whose vectors take part; v holds doubles."""
    v = F.col(vector).cast("array<double>")
    single = dict(rows.dtypes).get(vector) == "array<float>"
    raw = F.col(vector) if single else v  # tests would repeat the cast
    low, high = F.array_min(raw), F.array_max(raw)
    whole = F.coalesce(~F.array_contains(raw, F.lit(float("nan")).cast("float" if single else "double")), F.lit(False))  # whether it contains what it lacks is unknown if it has a null
    finite = whole & (low > float("-inf")) & (high < float("inf"))
    some = rows.where(F.col(key).isNotNull() & raw.isNotNull() & (F.size(raw) > 0) & finite & ((low != 0) | (high != 0)))
    width = some.groupBy(F.size(raw).alias("width")).count().orderBy(F.desc("count"), "width").first()
    return some.where(F.size(raw) == (width["width"] if width else 0)).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def fit_router(vectors: DataFrame, sample: int = SAMPLE, parts: int = PARTS, neighbours: int = 16, hidden: int = 128, epochs: int = 12, seed: int = 11) -> Router | None:
    """Fits on the `sample` vectors of the smallest hashes; None without vectors."""
    # the bound of what comes to the driver: `sample` vectors, and a quarter as many that are held out
    hashed = vectors.select("v", F.xxhash64("vec_id", "v").alias("order"))
    rows = bounded_sample(hashed, F.col("order"), sample + sample // 4, vectors.count()).select("v").collect()
    if not rows:
        return None
    every, rng = np.array([r["v"] for r in rows]), np.random.default_rng(seed)
    top = np.abs(every).max()
    every = every / top if top > 1e100 else every
    held = every[len(every) * 4 // 5 :]
    x = every[: max(1, len(every) * 4 // 5)]
    parts = max(1, min(parts, len(x) // 32))
    graph = neighbour_graph(x, neighbours)
    part = balanced_parts(x, graph, parts, 10, 0.1, rng)
    return calibrated(train_router(x, part, graph, parts, hidden, epochs, rng), held, x)


def calibrated(router: Router, held: np.ndarray, x: np.ndarray, k: int = K, target: float = TARGET_RECALL) -> Router:
    """`router` with as few probes as find `target` of the k nearest in `x` of the vectors `held`."""
    parts = len(router.b2)
    if not len(held) or len(x) <= k:
        return replace(router, probes=parts)
    index, ranks = router.top(x, 1)[:, 0], np.argsort(router.top(held, parts), axis=1)
    near = np.argpartition(-(held @ x.T), k - 1, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(ranks, index[near], axis=1).ravel())
    return replace(router, probes=int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1)


def pack(x: np.ndarray) -> list[bytes]:
    """Each vector as bytes: single precision where that holds it exactly, else double."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    exact = (short == x).all(axis=1)
    return [a.tobytes() if fits else b.tobytes() for fits, a, b in zip(exact.tolist(), short, x, strict=True)]


def unpack(rows: list[bytes], width: int) -> np.ndarray:
    for kind in (np.float32, np.float64):
        if all(len(r) == width * np.dtype(kind).itemsize for r in rows):
            return np.frombuffer(b"".join(rows), kind).reshape(-1, width).astype(np.float64)
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * width else np.float64).astype(np.float64) for r in rows])


def exact_scores(q: np.ndarray, x: np.ndarray, of_q: np.ndarray, of_x: np.ndarray) -> np.ndarray:
    """Inner products of pairs (rows of q, rows of x) in double precision, summed from the first to the last component, so that equal vectors score equally."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.cumsum(q[of_q] * x[of_x], axis=1)[:, -1] + 0.0  # no negative zero


def largest(scores: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of scores that may be among their row's k largest, ties too, if each is off by up to `off` of its row.

    Columns are taken in groups: the k-th largest of the groups' maxima isn't above
    the k-th largest score, and only groups whose maximum may reach it are looked through.
    """
    n, groups = scores.shape[1], 16 * k
    if n <= k:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    least = lambda m: np.nextafter((np.partition(m, m.shape[1] - k, axis=1)[:, m.shape[1] - k] - 2 * off).astype(np.float32), np.float32(-np.inf))
    if n < 2 * groups:
        return np.nonzero(scores >= least(scores)[:, None])
    cut = n // groups * groups
    grouped = scores[:, :cut].reshape(len(scores), -1, groups)
    top = grouped.max(axis=1)
    bound = least(top)
    row, group = np.nonzero(top >= bound[:, None])
    hit, member = np.nonzero(grouped[row, :, group] >= bound[row, None])
    rest, column = np.nonzero(scores[:, cut:] >= bound[:, None])
    return np.concatenate((row[hit], rest)), np.concatenate((member * groups + group[hit], column + cut))


def candidates(own: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of q, rows of x) that hold each query's k largest inner products, their ties too, and few others.

    Products are taken in single precision, of vectors scaled to components of at most 1.  They are off by
    less than `off`: rounding to single precision and summing d terms errs by (d + 2) / 2 ** 24 times the
    norms, the exact score, in double, by far less.  Where doubles would leave their range, all pairs are
    given.  A query isn't paired with its own id.
    """
    d, top_q, top_x = q.shape[1], float(np.abs(q).max()), float(np.abs(x).max())
    inside = 1e-280 < top_q * top_x < 1e300 / d and min(top_q, top_x) > 1e-280
    q, x = q / top_q, x / top_x
    q32, x32 = q.astype(np.float32), np.ascontiguousarray(x.astype(np.float32).T)
    off = (2 * d + 16) * 2.0**-24 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max() + d * 1e-36
    order = np.argsort(ids, kind="stable")
    low, high = (np.searchsorted(ids[order], own, side) for side in ("left", "right"))
    room = np.empty((min(128, len(own)), len(ids) if inside else 0), np.float32)
    for a in range(0, len(own), 128):
        if inside:
            s = np.matmul(q32[a : a + 128], x32, out=room[: len(own) - a])
            for i in np.flatnonzero(high[a : a + 128] > low[a : a + 128]).tolist():
                s[i, order[low[a + i] : high[a + i]]] = -np.inf
            of_q, of_x = largest(s, off[a : a + 128], k)
        else:
            of_q, of_x = (v.ravel() for v in np.indices((len(own[a : a + 128]), len(ids))))
        others = ids[of_x] != own[a + of_q]
        yield a + of_q[others], of_x[others]


def best(group: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of each group's k largest scores, by group and rank, ties by the smaller id; and their ranks from 0.  NaN counts as largest."""
    order = np.lexsort((ids, -scores, ~np.isnan(scores), group))
    starts = np.flatnonzero(np.diff(group[order], prepend=group[order[:1]] - 1)) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[rank < k], rank[rank < k]


_FOUND = np.dtype([("id", np.int64), ("score", np.float64)])


def _merge_pass(k: int):
    """Rows (query_id, rank, vec_id, score) of the k best of each query's rows (query_id, found), which come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = np.zeros(0, np.int64), np.zeros(0, _FOUND)  # of the last query, which may go on

        def out(at: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array((rank + 1).astype(np.int32)), pa.array(held["id"][at]), pa.array(held["score"][at])], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(1).to_pylist()
            own = np.concatenate((own, np.repeat(batch.column(0).to_numpy(), [len(r) // _FOUND.itemsize for r in rows])))
            held = np.concatenate((held, np.frombuffer(b"".join(rows), _FOUND)))
            at, rank = best(own, held["id"], held["score"], k)
            done = own[at] != own[-1]
            yield out(at[done], rank[done])
            own, held = own[at[~done]], held[at[~done]]
        if len(own):
            yield out(*best(own, held["id"], held["score"], k))

    return run


def nearest(vectors: DataFrame, queries: DataFrame, router: Router | None, probes: int | None = None, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found; `vectors` and `queries` are (vec_id, v) rows.

    probes: parts that each query looks into; by default what the router was calibrated to.
    """
    spark = vectors.sparkSession
    if router is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double").select("query_id", F.lit(0).alias("rank"), "vec_id", "score").where("false")
    scratch, width = Scratch(spark), router.w1.shape[0]

    def route(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    top = router.top(x, n)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pack(x), pa.binary()), pa.array(top.tolist(), pa.list_(pa.int32()))], names=["vec_id", "v", "parts"])

        return run

    routed = "vec_id long, v binary, parts array<int>"
    index = scratch.keep(vectors.mapInArrow(route(1), routed).select("vec_id", "v", F.col("parts")[0].alias("part")))
    asked = scratch.keep(queries.mapInArrow(route(probes or router.probes), routed)).select("vec_id", "v", F.explode("parts").alias("part"))

    def blocks(df: DataFrame, size: int) -> DataFrame:  # one row for each part
        return df.groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))

    chunks, rows = F.broadcast(blocks(index, CHUNK).withColumnRenamed("n", "chunks")), F.broadcast(blocks(asked, QUERIES_PER_BLOCK).withColumnRenamed("n", "blocks"))
    of = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    left = index.join(chunks, "part").join(rows, "part").withColumn("chunk", of("chunks")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = asked.join(chunks, "part").join(rows, "part").withColumn("block", of("blocks")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        own_out, found = [], []
        if vectors.num_rows and queries.num_rows:
            ids, x = vectors["vec_id"].to_numpy(), unpack(vectors["v"].to_pylist(), width)
            own, q = queries["vec_id"].to_numpy(), unpack(queries["v"].to_pylist(), width)
            for of_q, of_x in candidates(own, q, ids, x, k):
                scores = exact_scores(q, x, of_q, of_x)
                at, _ = best(of_q, ids[of_x], scores, k)
                rows = np.empty(len(at), _FOUND)
                rows["id"], rows["score"] = ids[of_x[at]], scores[at]
                here, starts = np.unique(of_q[at], return_index=True)
                own_out.append(own[here])
                found += [r.tobytes() for r in np.split(rows, starts[1:])] if len(here) else []
        return pa.table([pa.array(np.concatenate(own_out) if own_out else [], pa.int64()), pa.array(found, pa.binary())], names=["query_id", "found"])

    cols = ["part", "chunk", "block", "vec_id", "v"]
    found = left.select(cols).groupBy("part", "chunk", "block").cogroup(right.select(cols).groupBy("part", "chunk", "block")).applyInArrow(search, "query_id long, found binary")
    # each query has at most probes x chunks rows, of k vectors
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge_pass(k), "query_id long, rank int, vec_id long, score double")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), fit_router(vectors))


QUERIES = {"op7_nearest": op7_nearest}
ORACLE: dict[str, str] = {}
