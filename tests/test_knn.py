import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewell.functions.vectors import l2, squared_l2
from tidewell.operators.knn import RunningTopK, find_nearest, nearest
from tidewell.operators.lookup import fetch_hits
from tidewell.plans.index import load_index, save_index, search_index

PLANS = {
    "few queries": {},
    "passes": {"broadcast_bytes": 8},
    "cells": {"broadcast_bytes": 8, "max_passes": 1, "stream_bytes": 256},
}


def brute_force(queries, corpus, ids, k):
    gaps = queries[:, None, :].astype(np.float64) - corpus[None, :, :].astype(np.float64)
    distance = np.round((gaps * gaps).sum(axis=2), 9)
    found = []
    for q in range(len(queries)):
        order = np.lexsort((ids, distance[q]))[:k]
        found += [(q, n + 1, int(ids[c]), float(distance[q, c])) for n, c in enumerate(order)]
    return found


def frame(spark, matrix, id_col, parts=3):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{id_col} BIGINT, embedding ARRAY<FLOAT>").repartition(parts)


def found_rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "chunk_id", "squared_l2").collect())


HAND = [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [3.0, 4.0]]


@pytest.mark.parametrize("plan", PLANS)
def test_by_hand(spark, plan):
    corpus, query = frame(spark, HAND, "chunk_id"), frame(spark, [[0.0, 0.0]], "query_id", 1)
    three = found_rows(nearest(query, corpus, 3, **PLANS[plan]))
    assert three == [(0, 1, 0, 0.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0)]
    ten = found_rows(nearest(query, corpus, 10, **PLANS[plan]))
    assert ten == three + [(0, 4, 3, 25.0)]


def test_empty_sides(spark):
    corpus, query = frame(spark, HAND, "chunk_id"), frame(spark, [[0.0, 0.0]], "query_id", 1)
    assert nearest(query, corpus.where("false"), 3).count() == 0
    assert nearest(query.where("false"), corpus, 3).count() == 0


def test_plans_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    corpus = rng.integers(-3, 4, (400, 6)).astype(np.float32)
    corpus[::3] = corpus[0]  # a third of the rows are copies
    queries = np.concatenate([corpus[:5], rng.random((40, 6), dtype=np.float32)])
    want = sorted(brute_force(queries, corpus, np.arange(400), 4))
    c, q = frame(spark, corpus, "chunk_id", 5), frame(spark, queries, "query_id", 3)
    assert found_rows(nearest(q, c, 4)) == want
    assert found_rows(nearest(q, c, 4, broadcast_bytes=400)) == want
    assert plan_of(nearest(q, c, 4, broadcast_bytes=400)).count("MapInArrow") == 3
    cells = nearest(q, c, 4, broadcast_bytes=400, max_passes=2, stream_bytes=2000)
    assert plan_of(cells).count("MapInArrow") == 1 and "_cell" in plan_of(cells)
    assert found_rows(cells) == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_are_broadcast_only_within_the_bound(spark):
    c, q = frame(spark, HAND, "chunk_id"), frame(spark, HAND[:2], "query_id", 1)
    hits = find_nearest(q, c, 3)
    assert hits.max_bytes == 3 * (2 * 64 + 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" in plan_of(fetch_hits(hits, c, "chunk_id"))
        assert "BroadcastHashJoin" not in plan_of(fetch_hits(hits, c, "chunk_id", broadcast_bytes=100))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_corpus_is_broadcast_and_ranks_without_a_shuffle(spark):
    rng = np.random.default_rng(4)
    corpus, queries = rng.random((8, 3), dtype=np.float32), rng.random((300, 3), dtype=np.float32)
    c, q = frame(spark, corpus, "chunk_id", 1), frame(spark, queries, "query_id", 4)
    found = find_nearest(q, c, 2, broadcast_bytes=8 * 3 * 4 + 8)
    assert found_rows(found.rows) == sorted(brute_force(queries, corpus, np.arange(8), 2))
    assert "Window" not in plan_of(found.rows)


def test_string_query_ids(spark):
    corpus = frame(spark, HAND, "chunk_id")
    query = spark.createDataFrame([("a", [3.0, 4.0])], "query_id STRING, embedding ARRAY<FLOAT>")
    for plan in PLANS.values():
        assert found_rows(nearest(query, corpus, 1, **plan)) == [("a", 1, 3, 0.0)]


@pytest.mark.parametrize("bad", [[1.0], [1.0, 2.0, 3.0], [float("nan"), 0.0]])
def test_ragged_or_unusable_vectors_are_refused(spark, bad):
    corpus = frame(spark, HAND, "chunk_id").unionByName(frame(spark, [bad], "chunk_id", 1))
    query = frame(spark, [[0.0, 0.0]], "query_id", 1)
    with pytest.raises(Exception, match="dimension|finite"):
        nearest(query, corpus, 3).collect()


@settings(max_examples=150, deadline=None, database=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.integers(1, 12), st.integers(1, 5))
def test_kernel_equals_brute_force(seed, rows, queries, k):
    rng = np.random.default_rng(seed)
    scale = 10.0 ** rng.integers(-3, 4)
    corpus = (rng.integers(-2, 3, (rows, 3)) * scale).astype(np.float32)
    asked = (rng.integers(-2, 3, (queries, 3)) * scale).astype(np.float32)
    ids = rng.permutation(rows)
    best = RunningTopK(asked, k)
    for at in range(0, rows, 7):
        best.offer(ids[at : at + 7], corpus[at : at + 7])
    q, rank, found, distance = best.hits()
    got = list(zip(q.tolist(), rank.tolist(), found.tolist(), distance.tolist()))
    assert got == brute_force(asked, corpus, ids, k)


def test_kernel_with_many_copies():
    corpus = np.tile(np.array([[1.0, 2.0], [5.0, 5.0]], np.float32), (9000, 1))
    asked = np.array([[1.0, 2.0]] * 30, np.float32)
    best = RunningTopK(asked, 3)
    best.offer(np.arange(18000)[::-1].copy(), corpus)
    assert (best.ids == [1, 3, 5]).all() and not best.distance.any()


def test_distance_expressions(spark):
    row = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    assert tuple(row.select(squared_l2(F.col("a"), F.col("b")), l2(F.col("a"), F.col("b"))).first()) == (25.0, 5.0)


def test_saved_index_maps_positions_to_ids(spark, workspace):
    vectors = workspace.stage(
        frame(spark, HAND, "chunk_id").withColumn("chunk_id", F.col("chunk_id") * 10 + 100), "v"
    )
    save_index(vectors, workspace.path("index"), workspace)
    query = frame(spark, [[0.0, 0.0]], "query_id", 1)
    hits = search_index(query, load_index(spark, workspace.path("index")), 2).rows
    assert sorted((r["rank"], r.vec_pos, r.chunk_id) for r in hits.collect()) == [(1, 0, 100), (2, 1, 110)]


def test_the_greatest_id_is_found_and_a_null_id_refused(spark):
    asked = frame(spark, np.zeros((1, 2), np.float32), "q")
    greatest = spark.createDataFrame([(2**63 - 1, [0.0, 0.0]), (1, [1.0, 0.0])], "c long, embedding array<float>")
    hits = nearest(asked, greatest, 5, query_id="q", corpus_id="c").collect()
    assert {r["c"] for r in hits} == {1, 2**63 - 1}
    unknown = greatest.selectExpr("nullif(c, 1) c", "embedding")
    with pytest.raises(Exception, match="NULL id"):
        nearest(asked, unknown, 5, query_id="q", corpus_id="c").collect()
