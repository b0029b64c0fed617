"""Exact nearest neighbours through cells around pivots.

The corpus is written once in cells: each vector with the pivot that is nearest to it and
its distance to that pivot, in the order of both. A search first looks into the cells around
each query's nearest pivots, just enough to hold k vectors; the k-th distance found there
is a limit. By the triangle inequality a cell of radius r around pivot p holds nothing
nearer to q than d(q, p) - r, and a vector x nothing nearer than |d(q, p) - d(x, p)|. What
lies beyond the limit is left out: whole cells by a filter that reaches the scan, vectors
by their place in the cell's order. Everything else is compared, so the result is exact.

Pivots are centres of a bounded sample, a number that grows with the root of the corpus
up to ``MOST_PIVOTS``. They decide what is spared, never what is found: vectors without any
clusters spare little, and then a search costs what the plain one does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewell.functions.vectors import DISTANCE_PLACES, as_floats
from tidewell.operators.knn import (
    DEFAULT_K,
    Hits,
    RunningTopK,
    finish_ranks,
    measured_side,
    row_ids,
    vector_matrix,
)
from tidewell.operators.lookup import among, id_ranges
from tidewell.partitioning import BROADCAST_BYTES, partitions_for
from tidewell.workspace import Workspace

# Cells at most; vectors of the sample for one pivot; rounds of moving pivots to their centres.
MOST_PIVOTS = 1024
SAMPLE_A_PIVOT = 16
ROUNDS = 5

_BLOCK = 4096


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs, in double precision, each within ``slack``."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def slack(a: np.ndarray, b: np.ndarray) -> float:
    """More than what rounding can do to a distance between these sets."""
    largest = max((float(np.abs(m).max(initial=0.0)) for m in (a, b)))
    return 1e-6 * (1.0 + largest * a.shape[1] ** 0.5) if a.ndim == 2 and a.size else 1e-6


def central_pivots(sample: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """``count`` pivots: each is moved to the centre of the sample nearest to it, a few times."""
    pivots = sample[:: max(1, len(sample) // count)][:count].astype(np.float64)
    for _ in range(rounds):
        nearest = np.concatenate(
            [
                distances(sample[at : at + _BLOCK], pivots).argmin(axis=1)
                for at in range(0, len(sample), _BLOCK)
            ]
        )
        sums = np.zeros_like(pivots)
        np.add.at(sums, nearest, sample)
        sizes = np.bincount(nearest, minlength=len(pivots))
        used = sizes > 0
        pivots[used] = sums[used] / sizes[used, None]
    return pivots.astype(np.float32)


@dataclass(frozen=True)
class PivotIndex:
    rows: DataFrame
    """``(_cell, _id, _away, _v)``: cell, id, distance to the pivot, vector; by cell, then distance"""
    pivots: np.ndarray
    sizes: np.ndarray
    nearest: np.ndarray
    radius: np.ndarray
    """Rows of each cell, and their least and greatest distance to the pivot."""


def build_pivot_index(
    corpus: DataFrame,
    workspace: Workspace,
    corpus_id: str = "chunk_id",
    corpus_vector: str = "embedding",
    pivots: int | None = None,
) -> PivotIndex:
    """Write the corpus in cells. Ids must be unique and integral.

    A cell of any size is spread over partitions, as they are cut by distance and id too.
    """
    side = corpus.select(
        F.col(corpus_id).cast("bigint").alias("_id"), as_floats(F.col(corpus_vector)).alias("_v")
    )
    count = side.count()
    number = min(pivots or int(count**0.5) + 1, MOST_PIVOTS, count)
    if not number:
        none = np.zeros(0)
        schema = "_cell int, _id bigint, _away double, _v array<float>"
        empty = corpus.sparkSession.createDataFrame([], schema)
        return PivotIndex(empty, np.zeros((0, 0), np.float32), none, none, none)
    sample = side.orderBy(F.xxhash64("_id"), "_id").limit(number * SAMPLE_A_PIVOT).toArrow()
    centres = central_pivots(vector_matrix(sample["_v"]), number)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = vector_matrix(batch.column("_v"), centres.shape[1])
            for at in range(0, len(vectors), _BLOCK):
                block = vectors[at : at + _BLOCK]
                cell = distances(block, centres).argmin(axis=1)
                gap = block.astype(np.float64) - centres[cell]
                away = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                part = batch.slice(at, len(block))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), part["_id"], pa.array(away), part["_v"]],
                    ["_cell", "_id", "_away", "_v"],
                )

    placed = side.mapInArrow(place, "_cell int, _id bigint, _away double, _v array<float>")
    order = ["_cell", "_away", "_id"]
    parts = partitions_for(side, count * (4 * centres.shape[1] + 20))
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = workspace.stage(ordered, "cells")
    cells = rows.groupBy("_cell").agg(F.count(F.lit(1)), F.min("_away"), F.max("_away")).collect()
    sizes, near, radius = np.zeros(number, np.int64), np.zeros(number), np.zeros(number)
    for cell, rows_there, least, greatest in cells:
        sizes[cell], near[cell], radius[cell] = rows_there, least, greatest
    return PivotIndex(rows, centres, sizes, near, radius)


class CellSearch:
    """The k nearest of the vectors offered, cell by cell, for a block of queries.

    ``limits`` is a distance beyond which nothing is wanted, for each query; ``computed``
    counts the pairs that were compared.
    """

    def __init__(
        self, queries: np.ndarray, index: PivotIndex, k: int, limits: np.ndarray, probes: np.ndarray | None = None
    ) -> None:
        self.best = RunningTopK(queries, k)
        self.k = k
        self.to_pivots = distances(queries, index.pivots)
        self.slack = slack(queries, index.pivots)
        self.limits = limits.copy()
        self.probes = probes
        beyond = self.to_pivots - index.radius[None, :]
        before = index.nearest[None, :] - self.to_pivots
        self.bounds = np.maximum(np.maximum(beyond, before), 0.0)
        self.computed = 0

    def cells(self) -> np.ndarray:
        """Cells that some query has to look into."""
        return np.flatnonzero((self.bounds <= (self.limits + self.slack)[:, None]).any(axis=0))

    def offer(self, cell: int, ids: np.ndarray, away: np.ndarray, vectors: np.ndarray) -> None:
        """Rows of one cell, in the order of their distance to its pivot."""
        if self.probes is not None:
            wanted = np.flatnonzero(self.probes[:, cell])
        else:
            wanted = np.flatnonzero(self.bounds[:, cell] <= self.limits + self.slack)
        if not len(wanted):
            return
        reach = self.limits[wanted] + self.slack
        low = np.searchsorted(away, self.to_pivots[wanted, cell] - reach)
        high = np.searchsorted(away, self.to_pivots[wanted, cell] + reach, side="right")
        wanted, low, high = wanted[high > low], low[high > low], high[high > low]
        if not len(wanted):
            return
        first, last = int(low.min()), int(high.max())
        self.computed += len(wanted) * (last - first)
        found = RunningTopK(self.best.queries[wanted], self.k)
        found.offer(ids[first:last], vectors[first:last])
        at, _, near, distance = found.hits()
        if len(at):
            self.best._merge(slice(None), wanted[at], distance, near)
            kth = np.sqrt(self.best.distance[wanted, -1] + 10.0**-DISTANCE_PLACES)
            self.limits[wanted] = np.minimum(self.limits[wanted], kth)

    def offer_batch(self, cells: np.ndarray, ids: np.ndarray, away: np.ndarray, vectors: np.ndarray) -> None:
        edges = np.flatnonzero(np.diff(cells, prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(cells))):
            self.offer(int(cells[a]), ids[a:b], away[a:b], vectors[a:b])


def _nearest_cells(index: PivotIndex, to_pivots: np.ndarray, k: int) -> np.ndarray:
    """For each query the cells around its nearest pivots that hold ``k`` vectors together."""
    order = np.argsort(to_pivots, axis=1, kind="stable")
    before = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
    probes = np.zeros(to_pivots.shape, bool)
    np.put_along_axis(probes, order, before < k, axis=1)
    return probes


def _search(
    index: PivotIndex, queries: np.ndarray, k: int, limits: np.ndarray, probes: np.ndarray | None
) -> DataFrame:
    """(_q, _id, squared_l2): up to k of each query from each task."""
    context = index.rows.sparkSession.sparkContext
    bare = PivotIndex(None, index.pivots, index.sizes, index.nearest, index.radius)
    sent = context.broadcast((queries, bare, limits, probes))
    if probes is None:
        cells = CellSearch(queries, bare, k, limits).cells()
    else:
        cells = np.flatnonzero(probes.any(axis=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, shape, most, chosen = sent.value
        search = CellSearch(matrix, shape, k, most, chosen)
        for batch in batches:
            search.offer_batch(
                batch["_cell"].to_numpy(),
                row_ids(batch["_id"]),
                batch["_away"].to_numpy(),
                vector_matrix(batch["_v"], matrix.shape[1]),
            )
        at, _, ids, distance = search.best.hits()
        columns = [pa.array(at.astype(np.int64)), pa.array(ids), pa.array(distance)]
        yield pa.RecordBatch.from_arrays(columns, ["_q", "_id", "squared_l2"])

    rows = index.rows.where(among(F.col("_cell"), id_ranges(cells.tolist())))
    return rows.mapInArrow(run, "_q bigint, _id bigint, squared_l2 double")


def _limits(found: DataFrame, queries: int, k: int) -> np.ndarray:
    """The k-th distance of each query so far, rounded up; infinite if there are fewer."""
    nearest = F.slice(F.sort_array(F.collect_list("squared_l2")), 1, k)
    # A task gives k rows of a query at most, so a group has k rows a task.
    kth = found.groupBy("_q").agg(nearest.alias("best")).where(F.size("best") == k)
    limits = np.full(queries, np.inf)
    for q, distance in kth.select("_q", F.element_at("best", -1)).collect():
        limits[q] = np.sqrt(distance + 10.0**-DISTANCE_PLACES)
    return limits


def find_nearest_by_pivots(
    queries: DataFrame,
    index: PivotIndex,
    k: int = DEFAULT_K,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    corpus_id: str = "chunk_id",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> Hits:
    """The rows of ``find_nearest`` over an index: exact, with the same rounding and ties.

    Queries go in hashed groups whose vectors, and distances to all pivots, stay within
    ``broadcast_bytes``; the driver holds one group at a time. A group's first look into its
    nearest cells runs when this is called.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    side, size = measured_side(queries, query_id, query_vector)
    schema = T.StructType(
        [
            T.StructField(query_id, side.df.schema["_id"].dataType),
            T.StructField(corpus_id, T.LongType()),
            T.StructField("squared_l2", T.DoubleType()),
        ]
    )
    spark = queries.sparkSession
    needed = max(size.matrix_bytes, size.rows * len(index.pivots) * 8)
    groups = -(-needed // broadcast_bytes) if len(index.pivots) else 0
    parts = []
    for number in range(groups):
        ids, matrix = side.group(number, groups).local()
        if not len(ids):
            continue
        probes = _nearest_cells(index, distances(matrix, index.pivots), k)
        first = _search(index, matrix, k, np.full(len(ids), np.inf), probes)
        found = _search(index, matrix, k, _limits(first, len(ids), k), None)
        names = spark.createDataFrame(
            pa.table({"_q": pa.array(np.arange(len(ids))), query_id: ids})
        )
        parts.append(found.join(F.broadcast(names), "_q"))
    if not parts:
        return Hits(finish_ranks(spark.createDataFrame([], schema), k, query_id, corpus_id), 0)
    found = reduce(DataFrame.unionByName, parts)
    found = found.select(F.col(query_id), F.col("_id").alias(corpus_id), "squared_l2")
    return Hits(finish_ranks(found, k, query_id, corpus_id), size.hit_bytes(k))
