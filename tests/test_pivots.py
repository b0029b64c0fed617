"""Exact search through cells around pivots, against comparing everything."""

import numpy as np
import pytest

from tidewell.operators.knn import nearest
from tidewell.operators.pivots import (
    CellSearch,
    PivotIndex,
    build_pivot_index,
    central_pivots,
    distances,
    find_nearest_by_pivots,
)

SCHEMA = "chunk_id BIGINT, embedding ARRAY<FLOAT>"


def clusters(rng, count, dim, centres):
    middle = rng.normal(0, 10, (centres, dim))
    return (middle[rng.integers(0, centres, count)] + rng.normal(0, 0.3, (count, dim))).astype(np.float32)


def brute(queries, vectors, k):
    gaps = queries[:, None, :].astype(np.float64) - vectors[None, :, :]
    squares = np.round((gaps * gaps).sum(axis=2), 9)
    return [
        [(int(i), row[i]) for i in np.lexsort((np.arange(len(row)), row))[:k]] for row in squares
    ]


def local_index(vectors, count):
    pivots = central_pivots(vectors, count)
    away = distances(vectors, pivots)
    cell = away.argmin(axis=1)
    exact = np.linalg.norm(vectors.astype(np.float64) - pivots[cell], axis=1)
    sizes = np.bincount(cell, minlength=count)
    near = np.array([exact[cell == c].min(initial=np.inf) for c in range(count)])
    radius = np.array([exact[cell == c].max(initial=0) for c in range(count)])
    return PivotIndex(None, pivots, sizes, near, radius), cell, exact


def test_most_pairs_are_never_compared():
    rng = np.random.default_rng(1)
    vectors = clusters(rng, 8000, 16, 60)
    queries = clusters(rng, 1, 16, 1) * 0 + vectors[rng.integers(0, 8000, 40)] + np.float32(0.01)
    index, cell, away = local_index(vectors, 64)
    order = np.lexsort((np.arange(8000), away, cell))
    want = brute(queries, vectors, 5)
    limits = np.sqrt(np.array([row[-1][1] for row in want]) + 1e-9)
    search = CellSearch(queries, index, 5, limits)
    search.offer_batch(cell[order], order, away[order], vectors[order])
    at, rank, ids, distance = search.best.hits()
    got = [[(int(i), d) for i, d in zip(ids[at == q], distance[at == q])] for q in range(40)]
    assert got == want
    assert search.computed < 0.1 * 40 * 8000
    assert len(search.cells()) < 64


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_same_rows_as_the_plain_search(spark, workspace, kind):
    rng = np.random.default_rng(2)
    vectors = {
        "clusters": clusters(rng, 900, 8, 12),
        "noise": rng.normal(0, 1, (900, 8)).astype(np.float32),
        "copies": np.repeat(rng.integers(-2, 3, (9, 8)), 100, axis=0).astype(np.float32),
    }[kind]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    corpus = spark.createDataFrame(rows, SCHEMA).repartition(5)
    asked = spark.createDataFrame([(f"q{i}", v) for i, v in rows[::30]], "query_id STRING, embedding ARRAY<FLOAT>")
    index = build_pivot_index(corpus, workspace)
    for k, bound in ((1, 1 << 20), (4, 9000)):  # the second in several groups of queries
        found = find_nearest_by_pivots(asked, index, k, broadcast_bytes=bound).rows
        got = sorted(tuple(r) for r in found.collect())
        assert got == sorted(tuple(r) for r in nearest(asked, corpus, k).collect())


def test_few_and_no_rows(spark, workspace):
    corpus = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 4.0])], SCHEMA)
    asked = spark.createDataFrame([(7, [0.0, 0.0])], "query_id INT, embedding ARRAY<FLOAT>")
    index = build_pivot_index(corpus, workspace)
    rows = find_nearest_by_pivots(asked, index, 10).rows.orderBy("rank").collect()
    assert [(r["chunk_id"], r["squared_l2"]) for r in rows] == [(0, 0.0), (1, 1.0), (2, 1.0), (3, 25.0)]
    assert find_nearest_by_pivots(asked.where("false"), index, 3).rows.count() == 0
    empty = build_pivot_index(corpus.where("false"), workspace)
    assert find_nearest_by_pivots(asked, empty, 3).rows.count() == 0
    with pytest.raises(ValueError):
        find_nearest_by_pivots(asked, index, 0)


def test_cells_left_out_do_not_reach_the_task(spark, workspace):
    rng = np.random.default_rng(3)
    vectors = clusters(rng, 2000, 8, 30)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    index = build_pivot_index(corpus, workspace)
    asked = corpus.where("chunk_id = 5").selectExpr("chunk_id query_id", "embedding")
    found = find_nearest_by_pivots(asked, index, 3).rows
    text = found._jdf.queryExecution().toString()
    assert "PushedFilters: [" in text and "_cell" in text.split("PushedFilters: [")[1].split("]")[0]
    assert len(found.collect()) == 3
