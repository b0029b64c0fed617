"""Exact nearest neighbours by Euclidean distance, many queries at once.

Four plans give the same rows; sizes decide between them:

* few queries: the query matrix is broadcast and every corpus partition keeps
  a running top-k, so the corpus is read once and never shuffled;
* small corpus: the corpus matrix is broadcast and queries stream past it;
* a few times too many queries: the first plan for each of a few hashed groups
  of queries, that is some more reads of the corpus but still no shuffle of it;
* both large: both sides are hashed into groups, and each pair of groups is
  one task that holds its queries (a bounded number), streams its corpus rows
  and keeps a running top-k. Every row is copied once per group of the other
  side; no pair of rows is ever emitted unless it may be an answer.

A side is broadcast only after its rows were counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidewell.functions.vectors import DISTANCE_PLACES, as_floats
from tidewell.partitioning import BROADCAST_BYTES, estimated_bytes

DEFAULT_K = 3

# Corpus vectors one task streams past its queries when no side is broadcast.
STREAM_BYTES = 1024**3

# Most reads of the corpus that are preferred to shuffling it.
MAX_PASSES = 16

_CORPUS_BLOCK = 4096
_QUERY_BLOCK = 256
_EXACT_PAIRS = 16384
_SINGLE_PRECISION_LIMIT = 1e30
# Two distances whose difference is below this may swap places in rounding.
_ROUNDING_SLACK = 2.0 * 10.0**-DISTANCE_PLACES


def vector_matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column as a float32 matrix; refuses ragged rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("NULL vector")
    lengths = np.diff(column.offsets.to_numpy())
    width = dim if dim is not None else (int(lengths[0]) if len(lengths) else 0)
    if (lengths != width).any():
        raise ValueError(f"vectors must all have dimension {width}")
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, dtype=np.float32).reshape(len(lengths), width)


def row_ids(column: pa.Array) -> np.ndarray:
    """Ids of corpus rows; refuses NULL, which no id can stand for."""
    if column.null_count:
        raise ValueError("NULL id")
    return column.to_numpy(zero_copy_only=False)


def _squared_norms(matrix: np.ndarray) -> np.ndarray:
    norms = np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64)
    if not np.isfinite(norms).all():
        raise ValueError("vectors must be finite")
    return norms


class RunningTopK:
    """The k nearest of all vectors offered so far, for a block of queries.

    A matrix product gives each distance up to a known error; only pairs that
    could still make the top k within that error are computed exactly.
    """

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.k = k
        self.queries = queries
        self.norms = _squared_norms(queries)
        self.distance = np.full((len(queries), k), np.inf)
        self.ids = np.zeros((len(queries), k), dtype=np.int64)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(ids), _CORPUS_BLOCK):
            block = vectors[at : at + _CORPUS_BLOCK]
            norms = _squared_norms(block)
            for lo in range(0, len(self.queries), _QUERY_BLOCK):
                self._offer_block(
                    slice(lo, lo + _QUERY_BLOCK), ids[at : at + _CORPUS_BLOCK], block, norms
                )

    def _offer_block(
        self, rows: slice, ids: np.ndarray, block: np.ndarray, norms: np.ndarray
    ) -> None:
        queries, q_norms = self.queries[rows], self.norms[rows]
        largest = q_norms + norms.max()
        # Single precision is enough to sort out most pairs; it must not overflow.
        kind = np.float32 if largest.max() < _SINGLE_PRECISION_LIMIT else np.float64
        rough = queries.astype(kind, copy=False) @ block.T.astype(kind, copy=False)
        rough *= -2
        rough += norms.astype(kind)
        rough += q_norms.astype(kind)[:, None]
        unit = np.finfo(kind).eps * 2.0 * (queries.shape[1] + 8)
        error = unit * largest + _ROUNDING_SLACK
        near = rough <= (self.distance[rows, -1] + error)[:, None]
        if np.count_nonzero(near) > 2 * self.k * len(queries) and len(ids) > self.k:
            kth = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1]
            near &= rough <= (kth + 2.0 * error)[:, None]
        q_at, c_at = np.nonzero(near)
        if len(q_at) > _EXACT_PAIRS:
            useful = self._without_spare_copies(np.unique(c_at), ids, block)
            kept = useful[c_at]
            q_at, c_at = q_at[kept], c_at[kept]
        if not len(q_at):
            return
        exact = np.empty(len(q_at))
        for lo in range(0, len(q_at), _EXACT_PAIRS):
            pair = slice(lo, lo + _EXACT_PAIRS)
            gap = queries[q_at[pair]].astype(np.float64) - block[c_at[pair]]
            exact[pair] = np.einsum("ij,ij->i", gap, gap)
        self._merge(rows, q_at, np.round(exact, DISTANCE_PLACES), ids[c_at])

    def _without_spare_copies(
        self, rows: np.ndarray, ids: np.ndarray, block: np.ndarray
    ) -> np.ndarray:
        """Marks ``rows``, but of equal vectors only the k with the lowest ids.

        No further copy can rank among the first k of any query.
        """
        raw = np.ascontiguousarray(block[rows])
        raw = raw.view(np.dtype((np.void, raw.shape[1] * raw.itemsize))).ravel()
        group = np.unique(raw, return_inverse=True)[1].ravel()
        order = np.lexsort((ids[rows], group))
        ordered = group[order]
        copy_no = np.arange(len(rows)) - np.searchsorted(ordered, ordered)
        useful = np.zeros(len(ids), dtype=bool)
        useful[rows[order[copy_no < self.k]]] = True
        return useful

    def _merge(
        self, rows: slice, q_at: np.ndarray, distance: np.ndarray, ids: np.ndarray
    ) -> None:
        touched, local = np.unique(q_at, return_inverse=True)
        kept = np.arange(len(touched)).repeat(self.k)
        best_d, best_i = self.distance[rows], self.ids[rows]
        all_q = np.concatenate([kept, local])
        all_d = np.concatenate([best_d[touched].ravel(), distance])
        all_i = np.concatenate([best_i[touched].ravel(), ids])
        order = np.lexsort((all_i, all_d, all_q))
        first = np.searchsorted(all_q[order], np.arange(len(touched)))
        take = order[(first[:, None] + np.arange(self.k)[None, :])]
        best_d[touched] = all_d[take]
        best_i[touched] = all_i[take]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query position, rank from 1, id and distance of every kept row."""
        q_at, place = np.nonzero(np.isfinite(self.distance))
        return q_at, place + 1, self.ids[q_at, place], self.distance[q_at, place]


@dataclass(frozen=True)
class Hits:
    """Ranked neighbours and, where it is known, how many bytes they can have."""

    rows: DataFrame
    max_bytes: int | None


@dataclass(frozen=True)
class _Size:
    rows: int
    dim: int
    id_bytes: int

    @property
    def matrix_bytes(self) -> int:
        """Ids and single-precision vectors, as they are sent."""
        return self.rows * self.dim * 4 + self.id_bytes

    def hit_bytes(self, k: int) -> int:
        """At most k hits per query: id, rank, neighbour and two distances."""
        return k * (self.id_bytes + self.rows * 64)


@dataclass(frozen=True)
class _Side:
    """One input of the search, reduced to its id and vector."""

    df: DataFrame

    @classmethod
    def of(cls, df: DataFrame, id_col: str, vector_col: str) -> "_Side":
        return cls(df.select(F.col(id_col).alias("_id"), as_floats(F.col(vector_col)).alias("_v")))

    def measure(self) -> _Size:
        """Rows and bytes of ids, for which no vector is computed, and the dimension."""
        id_bytes = F.sum(F.octet_length(F.col("_id").cast("string")))
        rows, ids = self.df.agg(F.count(F.lit(1)), id_bytes).first()
        first = self.df.select(F.size("_v")).first() if rows else None
        return _Size(rows, first[0] if first else 0, ids or 0)

    def group(self, number: int, groups: int) -> "_Side":
        return _Side(self.df.where(F.pmod(F.xxhash64("_id"), F.lit(groups)) == number))

    def local(self) -> tuple[pa.Array, np.ndarray]:
        """Ids and matrix on the driver; for a side already measured as small."""
        table = self.df.toArrow()
        return table["_id"].combine_chunks(), vector_matrix(table["_v"])


def _ranked(rows: DataFrame, k: int, query_id: str, id_col: str) -> DataFrame:
    order = Window.partitionBy(query_id).orderBy("squared_l2", id_col)
    return (
        rows.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(query_id, F.col("rank").cast("bigint"), id_col, "squared_l2")
    )


def _with_few_queries(
    queries: _Side, corpus: _Side, k: int, schema: T.StructType
) -> DataFrame:
    names = [field.name for field in schema]
    sent = corpus.df.sparkSession.sparkContext.broadcast(queries.local())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = sent.value
        if not len(query_ids):
            return
        best = RunningTopK(matrix, k)
        for batch in batches:
            ids = row_ids(batch.column("_id"))
            best.offer(ids, vector_matrix(batch.column("_v"), matrix.shape[1]))
        q_at, _, ids, distance = best.hits()
        columns = [query_ids.take(pa.array(q_at)), pa.array(ids), pa.array(distance)]
        yield pa.RecordBatch.from_arrays(columns, names)

    return corpus.df.mapInArrow(search, schema)


def _with_small_corpus(
    queries: _Side, corpus: _Side, k: int, schema: T.StructType
) -> DataFrame:
    ranked = T.StructType([schema[0], T.StructField("rank", T.LongType()), *schema[1:]])
    names = [field.name for field in ranked]
    sent = queries.df.sparkSession.sparkContext.broadcast(corpus.local())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus_ids, matrix = sent.value
        if not len(corpus_ids):
            return
        corpus_ids = row_ids(corpus_ids)
        for batch in batches:
            best = RunningTopK(vector_matrix(batch.column("_v"), matrix.shape[1]), k)
            best.offer(corpus_ids, matrix)
            q_at, rank, ids, distance = best.hits()
            taken = batch.column("_id").take(pa.array(q_at))
            columns = [taken, pa.array(rank), pa.array(ids), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return queries.df.mapInArrow(search, ranked)


def _by_cells(
    queries: _Side,
    corpus: _Side,
    k: int,
    schema: T.StructType,
    query_groups: int,
    corpus_groups: int,
) -> DataFrame:
    """One partition per pair of groups: its queries are held, its corpus streams by."""
    query_type = queries.df.schema["_id"].dataType
    names = [field.name for field in schema]

    def dealt(side: DataFrame, own: int, own_step: int, other: int, other_step: int) -> DataFrame:
        group = F.pmod(F.xxhash64("_id"), F.lit(own)) * own_step
        copies = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        return side.withColumn("_copy", copies).withColumn(
            "_cell", (group + F.col("_copy") * other_step).cast("int")
        )

    held = dealt(queries.df, query_groups, corpus_groups, corpus_groups, 1).select(
        "_cell",
        F.lit(False).alias("_streamed"),
        F.col("_id").alias("_query"),
        F.lit(None).cast("bigint").alias("_row"),
        "_v",
    )
    streamed = dealt(corpus.df, corpus_groups, 1, query_groups, corpus_groups).select(
        "_cell",
        F.lit(True).alias("_streamed"),
        F.lit(None).cast(query_type).alias("_query"),
        F.col("_id").alias("_row"),
        "_v",
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        query_ids, best = None, None
        for batch in batches:
            flags = batch.column("_streamed").to_numpy(zero_copy_only=False)
            first = int(np.searchsorted(flags, True))
            if first:
                waiting.append(batch.slice(0, first))
            if first == batch.num_rows:
                continue
            if best is None:
                if not waiting:
                    return
                held_rows = pa.Table.from_batches(waiting)
                query_ids = held_rows["_query"].combine_chunks()
                best = RunningTopK(vector_matrix(held_rows["_v"]), k)
            rest = batch.slice(first)
            ids = row_ids(rest.column("_row"))
            best.offer(ids, vector_matrix(rest.column("_v"), best.queries.shape[1]))
        if best is None:
            return
        q_at, _, ids, distance = best.hits()
        columns = [query_ids.take(pa.array(q_at)), pa.array(ids), pa.array(distance)]
        yield pa.RecordBatch.from_arrays(columns, names)

    return (
        held.unionByName(streamed)
        .repartitionById(query_groups * corpus_groups, "_cell")
        .sortWithinPartitions("_streamed")
        .drop("_cell")
        .mapInArrow(search, schema)
    )


def find_nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = DEFAULT_K,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    corpus_id: str = "chunk_id",
    corpus_vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    max_passes: int = MAX_PASSES,
    stream_bytes: int = STREAM_BYTES,
) -> Hits:
    """The ``k`` nearest corpus rows of every query: ``min(k, n)`` rows each.

    Squared distances are rounded before ranking, equal ones rank by ascending
    id. Both ids must be unique and the corpus id integral. Counts the smaller
    side (and the other one if that is too large to broadcast) when called.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    q = _Side.of(queries, query_id, query_vector)
    c = _Side.of(corpus, corpus_id, corpus_vector)
    c = _Side(c.df.withColumn("_id", F.col("_id").cast("bigint")))
    schema = T.StructType(
        [
            T.StructField(query_id, q.df.schema["_id"].dataType),
            T.StructField(corpus_id, T.LongType()),
            T.StructField("squared_l2", T.DoubleType()),
        ]
    )
    sizes: dict[str, _Size] = {}
    smaller_first = sorted(
        (("queries", q), ("corpus", c)), key=lambda side: estimated_bytes(side[1].df)
    )
    for name, side in smaller_first:
        size = sizes[name] = side.measure()
        if size.matrix_bytes > broadcast_bytes:
            continue
        if name == "queries":
            found = _with_few_queries(q, c, k, schema)
            return Hits(_finish(_ranked(found, k, query_id, corpus_id)), size.hit_bytes(k))
        known = sizes.get("queries")
        found = _with_small_corpus(q, c, k, schema)
        return Hits(_finish(found), known.hit_bytes(k) if known else None)

    groups = -(-sizes["queries"].matrix_bytes // broadcast_bytes)
    if groups <= max_passes:
        passes = [_with_few_queries(q.group(n, groups), c, k, schema) for n in range(groups)]
        found = reduce(DataFrame.unionByName, passes)
    else:
        corpus_bytes = sizes["corpus"].matrix_bytes
        slots = corpus.sparkSession.sparkContext.defaultParallelism
        corpus_groups = max(-(-corpus_bytes // stream_bytes), -(-slots // groups))
        found = _by_cells(q, c, k, schema, groups, corpus_groups)
    ranked = _ranked(found, k, query_id, corpus_id)
    return Hits(_finish(ranked), sizes["queries"].hit_bytes(k))


def measured_side(df: DataFrame, id_col: str, vector_col: str) -> tuple[_Side, _Size]:
    """A side of a search, and its counted size."""
    side = _Side.of(df, id_col, vector_col)
    return side, side.measure()


def finish_ranks(rows: DataFrame, k: int, query_id: str, id_col: str) -> DataFrame:
    """The k best of all tasks' rows, ranked, with both distances."""
    return _finish(_ranked(rows, k, query_id, id_col))


def _finish(rows: DataFrame) -> DataFrame:
    return rows.withColumn("l2", F.round(F.sqrt("squared_l2"), DISTANCE_PLACES))


def nearest(queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_K, **columns) -> DataFrame:
    """Rows of :func:`find_nearest` only."""
    return find_nearest(queries, corpus, k, **columns).rows
