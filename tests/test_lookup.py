"""Lookups by id: which ranges are made of ids, and what they spare the scan."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators.knn import Hits
from tidewell.operators.lookup import among, fetch_hits, id_ranges, rows_with_ids
from tidewell.sinks.tables import lookup_options

ROWS = 40_000


def test_ranges_hold_all_ids_and_keep_the_widest_gaps():
    assert id_ranges([]) == []
    assert id_ranges([5, 3, 4, 9, 9]) == [(3, 5), (9, 9)]
    assert id_ranges([1, 3, 50, 52, 90], most=3) == [(1, 3), (50, 52), (90, 90)]
    rng = random.Random(1)
    for most in (1, 7, 256):
        ids = rng.sample(range(10**6), 500)
        ranges = id_ranges(ids, most)
        assert len(ranges) <= most
        assert all(any(low <= i <= high for low, high in ranges) for i in ids)


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts") / "table")
    rows = spark.range(0, ROWS, 1, 2).select(F.col("id").alias("chunk_id"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    rows.write.options(**lookup_options("chunk_id", 64 * 1024)).option(
        "parquet.page.row.count.limit", 500
    ).parquet(path)
    return spark.read.parquet(path)


def scanned(df):
    """Rows that the table's scan gave out when ``df`` last ran."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size()) if leaves.apply(i).nodeName().startswith("Scan parquet")]
    return sum(scan.metrics().get("numOutputRows").get().value() for scan in scans)


def hits_of(spark, ids, size):
    rows = spark.createDataFrame([(q, 1, i) for q, i in enumerate(ids)], "query_id INT, rank INT, chunk_id BIGINT")
    return Hits(rows, size)


def test_few_hits_read_few_rows(spark, texts):
    wanted = [7, 19_000, 39_990, 10**9]
    found = fetch_hits(hits_of(spark, wanted, 400), texts, "chunk_id")
    assert sorted(r["chunk_id"] for r in found.collect()) == wanted[:3]
    assert scanned(found) < ROWS / 4
    assert "PushedFilters: [Or(" in found._jdf.queryExecution().toString()


def test_many_hits_are_joined(spark, texts):
    wanted = [7, 19_000, 39_990]
    for size in (None, 10**9):
        found = fetch_hits(hits_of(spark, wanted, size), texts, "chunk_id")
        assert sorted(r["chunk_id"] for r in found.collect()) == wanted
        assert "Or(" not in found._jdf.queryExecution().toString()


def test_no_hits(spark, texts):
    assert fetch_hits(hits_of(spark, [1], 9), texts.where("false"), "chunk_id").count() == 0
    none = Hits(hits_of(spark, [1], 9).rows.where("false"), 9)
    assert fetch_hits(none, texts, "chunk_id").count() == 0


def test_rows_of_ids(spark, texts):
    ids = spark.createDataFrame([(5,), (5,), (None,), (30_000,), (-1,)], "chunk_id BIGINT")
    found = rows_with_ids(texts, ids, "chunk_id")
    assert sorted(r["chunk_id"] for r in found.collect()) == [5, 30_000] and scanned(found) < ROWS / 4
    joined = rows_with_ids(texts, ids, "chunk_id", prune_ids=1)
    assert sorted(r["chunk_id"] for r in joined.collect()) == [5, 30_000]
    by_text = rows_with_ids(texts, texts.where("chunk_id = 3").select("t"), "t")
    assert [r["chunk_id"] for r in by_text.collect()] == [3]


def test_a_filter_of_many_ranges_is_no_deep_tree(spark, texts):
    ranges = id_ranges(list(range(0, ROWS, 97)))
    assert texts.where(among(F.col("chunk_id"), ranges)).count() >= ROWS // 97
