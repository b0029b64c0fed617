"""Approximate nearest neighbours by learned partitions.

On a bounded sample the neighbour graph is cut into balanced parts of few cut edges,
and a small network learns to tell, from a vector, the parts of its neighbours. Every
row is indexed under its most probable part. A query goes to its most probable parts,
until their probabilities add up to ``ROUTED``, and the rows there are ranked by the
exact cosine in double precision.

A part is dealt over several tasks in proportion to its share of the rows, queries
likewise, so neither a crowded part nor many queries meet in one task; rows with equal
vectors need no more than k + 1 of themselves compared.

Edge cases: vectors that are null, empty, zero, or hold a null or a non-finite number
take no part, nor do rows without id; vectors of another length than the commonest are
one part of their own by length, searched whole; ties go to the smaller id; all rows
with the query's own id are its own; repeated rows are ranked each; an empty table gives
no rows; columns other than vec_id and embedding are not read. There are ``MOST_PARTS`` parts
at most, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Fixed values of the query: neighbours, and every how-manieth id asks.
K, ASKING = 5, 50

# The fitting sample, neighbours in its graph, and the probability a query's parts add up to.
SAMPLE_ROWS = 8192
GRAPH_DEGREE = 10
ROUTED, LEAST_PARTS = 0.98, 3
# Rows to a part, parts at most; rows and queries to a task.
ROWS_A_PART, MOST_PARTS = 1024, 128
ROWS_A_TASK, QUERIES_A_TASK = 16_384, 4096


def bisect(near: np.ndarray, vectors: np.ndarray, levels: int) -> np.ndarray:
    """Balanced parts of a neighbour graph by repeated halving.

    A half starts as one side of the median along the main direction; then pairs of
    vertices change sides while that lowers the number of cut edges.
    """
    n = len(near)
    source = np.repeat(np.arange(n), near.shape[1])
    target = near.ravel()
    source, target = np.concatenate([source, target]), np.concatenate([target, source])
    part = np.zeros(n, np.int64)
    for _ in range(levels):
        side = np.zeros(n, bool)
        for label in np.unique(part):
            rows = np.flatnonzero(part == label)
            centred = vectors[rows] - vectors[rows].mean(axis=0)
            direction = np.linalg.svd(centred.T @ centred)[0][:, 0]
            order = np.argsort(centred @ direction, kind="stable")
            side[rows[order[len(rows) // 2 :]]] = True
        within = part[source] == part[target]
        a, b = source[within], target[within]
        for _ in range(12):
            cut = side[a] != side[b]
            gain = np.bincount(a, np.where(cut, 1, -1), minlength=n)
            moved = 0
            for label in np.unique(part):
                rows = np.flatnonzero(part == label)
                left, right = rows[~side[rows]], rows[side[rows]]
                left = left[np.argsort(-gain[left], kind="stable")]
                right = right[np.argsort(-gain[right], kind="stable")]
                k = min(len(left), len(right))
                # Half of the best swaps at once: neighbours that move together undo a gain.
                good = int(((gain[left[:k]] + gain[right[:k]]) > 0).sum() + 1) // 2
                if good and gain[left[0]] + gain[right[0]] > 0:
                    side[left[:good]], side[right[:good]] = True, False
                    moved += good
            if not moved:
                break
        part = part * 2 + side
    return part


@dataclass
class Router:
    """One hidden layer over unit vectors; probabilities of the parts."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def probabilities(self, unit: np.ndarray) -> np.ndarray:
        z = np.maximum(unit @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train_router(unit: np.ndarray, wanted: np.ndarray, epochs: int = 30, seed: int = 5) -> Router:
    """Fit to each vector's distribution over parts, by Adam on cross-entropy."""
    rng = np.random.default_rng(seed)
    width = 2 * unit.shape[1]
    params = [
        rng.normal(0, (2 / unit.shape[1]) ** 0.5, (unit.shape[1], width)),
        np.zeros(width),
        rng.normal(0, (1 / width) ** 0.5, (width, wanted.shape[1])),
        np.zeros(wanted.shape[1]),
    ]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(unit))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            x = unit[rows]
            inner = x @ params[0] + params[1]
            active = np.maximum(inner, 0)
            error = Router(*params).probabilities(x) - wanted[rows]
            error /= len(rows)
            back = (error @ params[2].T) * (inner > 0)
            slopes = [x.T @ back, back.sum(axis=0), active.T @ error, error.sum(axis=0)]
            step += 1
            for p, slope, m, v in zip(params, slopes, first, second):
                m += 0.1 * (slope - m)
                v += 0.01 * (slope * slope - v)
                p -= 0.01 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Router(*params)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / scale
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit_router(sample: np.ndarray, parts: int) -> tuple[Router, np.ndarray]:
    """The router and the share of the sample it puts into each part."""
    unit = unit_vectors(sample)
    own = np.unique(unit, axis=0)
    degree = min(GRAPH_DEGREE, len(own) - 1)
    if parts < 2 or degree < 1:
        flat = Router(np.zeros((unit.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
        return flat, np.ones(1)
    near = np.empty((len(own), degree), np.int64)
    for at in range(0, len(own), 512):
        like = own[at : at + 512] @ own.T
        like[np.arange(len(like)), at + np.arange(len(like))] = -2
        near[at : at + 512] = np.argpartition(-like, degree - 1, axis=1)[:, :degree]
    part = bisect(near, own, int(np.log2(parts)))
    wanted = np.zeros((len(own), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(own)), degree), part[near].ravel()), 1 / degree)
    router = train_router(own, wanted)
    chosen = router.probabilities(unit).argmax(axis=1)
    return router, np.bincount(chosen, minlength=parts) / len(chosen)


def _usable(embedding: Column) -> Column:
    finite = F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.coalesce(
        (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False)
    )


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def _routes(router: Router, most: int) -> Column:
    """The most probable parts of a vector: one, or as many as ``ROUTED`` asks for."""

    def run(vectors: pa.Array) -> pa.Array:
        chance = router.probabilities(unit_vectors(_matrix(vectors)))
        order = np.argsort(-chance, axis=1, kind="stable")
        if most == 1:
            return pa.array(list(order[:, :1].astype(np.int32)), pa.list_(pa.int32()))
        sums = np.cumsum(np.take_along_axis(chance, order, axis=1), axis=1)
        number = np.maximum((sums < ROUTED).sum(axis=1) + 1, LEAST_PARTS).clip(max=chance.shape[1])
        return pa.array([row[:n].astype(np.int32) for row, n in zip(order, number)], pa.list_(pa.int32()))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(F.col("embedding"))


FOUND = "query_id long, vec_id long, score double"


def rank_block(rows: tuple[np.ndarray, np.ndarray], asking: tuple[np.ndarray, np.ndarray], k: int) -> pa.Table:
    """The k nearest of some rows for each query: (ids, vectors) of both sides.

    A matrix product picks what may be among the k; their cosines are then computed
    row by row, so equal vectors get equal scores wherever they stand.
    """
    ids, vectors = rows
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
    # Repeats of one id are told apart from the query's own by the extra place.
    few = np.arange(len(ids)) - begin <= k
    same_id = np.zeros(len(ids), bool)
    same_id[1:] = ~fresh[1:] & (ids[1:] == ids[:-1])
    keep = few | same_id
    ids, vectors = ids[keep], vectors[keep]
    unit = unit_vectors(vectors)
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    rows_scaled = vectors / scale
    lengths = np.sqrt((rows_scaled * rows_scaled).sum(axis=1))
    out: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(asking[0]), 256):
        own, questions = asking[0][at : at + 256], asking[1][at : at + 256]
        scaled = questions / np.abs(questions).max(axis=1, keepdims=True)
        size = np.sqrt((scaled * scaled).sum(axis=1))
        like = (scaled / size[:, None]) @ unit.T
        like[own[:, None] == ids[None, :]] = -np.inf
        most = min(k, len(ids))
        limit = np.partition(like, len(ids) - most, axis=1)[:, len(ids) - most]
        query, row = np.nonzero((like >= limit[:, None] - 1e-9) & np.isfinite(like))
        score = (scaled[query] * rows_scaled[row]).sum(axis=1) / (size[query] * lengths[row])
        order = np.lexsort((ids[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        first = np.searchsorted(query, np.arange(len(own)))
        good = np.arange(len(query)) - first[query] < k
        out[0].append(own[query[good]])
        out[1].append(ids[row[good]])
        out[2].append(score[good])
    names = ["query_id", "vec_id", "score"]
    return pa.table([np.concatenate(c) if c else np.zeros(0) for c in out], names=names)


def nearest_neighbours(embeddings: DataFrame, k: int = K, asking: Column | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows found.

    ``asking`` tells the queries among the rows; by default ids that ``ASKING`` divides.
    """
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension, count = (sizes[0], sizes[1]) if sizes else (0, 0)
    alike = rows.where(F.size("embedding") == dimension)
    unit = F.pmod(F.xxhash64(F.lit(37), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = (
        alike.where(unit < SAMPLE_ROWS / max(count, 1)).limit(SAMPLE_ROWS * 5 // 4).toArrow()
    ).sort_by("vec_id")
    wanted = min(count // ROWS_A_PART, sample.num_rows // 64, MOST_PARTS)
    parts = 1 << max(0, int(np.log2(max(wanted, 1))))
    if sample.num_rows:
        router, share = fit_router(_matrix(sample["embedding"]), parts)
    else:
        router, share = fit_router(np.ones((1, 1)), 1)
    target = min(ROWS_A_TASK, max(512, count // 64))
    slots = [max(1, int(np.ceil(s * count / target))) for s in share]
    asks = F.pmod("vec_id", F.lit(ASKING)) == 0 if asking is None else asking
    asked = rows.where(asks).count()
    rounds = max(1, -(-asked // QUERIES_A_TASK))
    slot_count = F.element_at(F.array(*map(F.lit, slots)), F.col("part") + 1)

    def routed(side: DataFrame, most: int) -> DataFrame:
        usual = side.where(F.size("embedding") == dimension).withColumn(
            "part", F.explode(_routes(router, most))
        )
        odd = side.where(F.size("embedding") != dimension).withColumn("part", F.lit(-1))
        return usual.union(odd).withColumn("d", F.size("embedding"))

    slot_of = F.when(F.col("part") < 0, 1).otherwise(slot_count)
    indexed = (
        routed(rows, 1)
        .withColumn("slot", F.pmod(F.xxhash64("vec_id"), slot_of).cast("int"))
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    )
    queries = (
        routed(rows.where(asks), 2)
        .withColumn("round", F.pmod(F.xxhash64(F.lit(41), "vec_id"), F.lit(rounds)).cast("int"))
        .withColumn("slot", F.explode(F.sequence(F.lit(0), slot_of - 1)))
    )
    key = ["part", "d", "slot", "round"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table(
                [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())],
                names=["query_id", "vec_id", "score"],
            )
        sides = [
            (t["vec_id"].to_numpy(), _matrix(t["embedding"])) for t in (left, right)
        ]
        return rank_block(*sides, k)

    found = indexed.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
