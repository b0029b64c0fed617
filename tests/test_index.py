"""The saved index: no vector is shuffled, and a search finds what it would without it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators.knn import nearest
from tidewell.plans.index import id_mapping, load_index, save_index, search_index, stored_vectors


@pytest.fixture
def vectors(spark, workspace):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.integers(-2, 3, 4).astype(float).tolist()) for i in rng.permutation(5000)[:300]]
    frame = spark.createDataFrame(rows, "chunk_id BIGINT, embedding ARRAY<FLOAT>")
    return workspace.stage(frame.repartition(6), "vectors")


def test_no_exchange_holds_vectors(vectors, workspace):
    copy = stored_vectors(vectors, "chunk_id", "embedding")
    assert "Exchange" not in copy._jdf.queryExecution().toString()
    plan = id_mapping(vectors, workspace)._jdf.queryExecution().toString()
    assert "embedding" not in plan
    names = {f.name for f in vectors.sparkSession.read.parquet(workspace.path("placed-vec_pos")).schema}
    assert "embedding" not in names


def test_positions_and_hits(spark, vectors, workspace):
    folder = workspace.path("saved")
    save_index(vectors, folder, workspace)
    index = load_index(spark, folder)
    ids = sorted(r["chunk_id"] for r in vectors.collect())
    assert [tuple(r) for r in index.mapping.orderBy("vec_pos").collect()] == list(enumerate(ids))
    asked = vectors.orderBy("chunk_id").limit(7).withColumnRenamed("chunk_id", "query_id")
    found = search_index(asked, index, 4).rows
    got = sorted((r["query_id"], r["rank"], ids[r["vec_pos"]]) for r in found.collect())
    want = nearest(asked, vectors, 4).select("query_id", "rank", "chunk_id")
    assert got == sorted(tuple(r) for r in want.collect())


def test_an_empty_index(spark, vectors, workspace):
    none = workspace.stage(vectors.where(F.lit(False)), "none")
    save_index(none, workspace.path("saved"), workspace)
    index = load_index(spark, workspace.path("saved"))
    assert index.mapping.count() == 0
    assert search_index(vectors.withColumnRenamed("chunk_id", "query_id"), index).rows.count() == 0
