from pyspark.sql import functions as F

from tidewell import partitioning
from tidewell.operators.ids import dense_ids, unique_id
from tidewell.partitioning import estimated_bytes, partitions_for, spread
from tidewell.sinks.tables import PathTarget
from tidewell.workspace import Workspace


def test_dense_ids_follow_the_order(spark, workspace):
    rows = spark.range(1000, numPartitions=7).select(
        (F.col("id") * 7919 % 1000).alias("doc"), (F.col("id") % 3).alias("n")
    )
    found = dense_ids(rows, workspace, ["doc", "n"]).orderBy("doc", "n").collect()
    assert [r.chunk_id for r in found] == list(range(1000))


def test_a_hot_key_is_split_and_keeps_dense_ids(spark, workspace):
    rows = spark.range(300_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc")
    )
    dense_ids(rows, workspace, ["doc"]).createOrReplaceTempView("numbered")
    ids = spark.sql("SELECT count(*) n, count(DISTINCT chunk_id) d, min(chunk_id) lo, "
                    "max(chunk_id) hi FROM numbered").first()
    assert tuple(ids) == (300_000, 300_000, 0, 299_999)
    assert spark.sql(
        "SELECT count(*) FROM numbered a JOIN numbered b "
        "ON b.chunk_id = a.chunk_id + 1 WHERE b.doc < a.doc"
    ).first()[0] == 0
    placed = spark.read.parquet(workspace.path("placed-chunk_id"))
    hot = placed.where("doc = 5").select(F.shiftright("_place", 33).alias("p")).distinct()
    assert hot.count() > 1


def test_dense_ids_in_fetch_order(spark, workspace):
    rows = spark.range(50, numPartitions=5).withColumnRenamed("id", "v")
    found = dense_ids(rows, workspace, id_col="pos").collect()
    assert sorted((r.v, r.pos) for r in found) == [(i, i) for i in range(50)]


def test_no_rows(spark, workspace):
    assert dense_ids(spark.range(0), workspace, ["id"]).count() == 0


def test_unique_ids(spark):
    ids = [r[0] for r in spark.range(100, numPartitions=6).select(unique_id()).collect()]
    assert len(set(ids)) == 100


def test_a_workspace_removes_only_its_own_folder(spark, workspace):
    kept = workspace.stage(spark.range(3), "kept")
    with Workspace(spark, "left") as left:
        written = left.stage(spark.range(2), "gone")
        assert written.count() == 2
    assert kept.count() == 3
    assert not PathTarget(spark, left.root).exists()
    left.clear()


def test_small_inputs_are_dealt_out_and_large_ones_left_alone(spark, workspace, monkeypatch):
    stored = workspace.stage(spark.range(500_000, numPartitions=1), "one-file")
    assert partitions(spread(stored)) == 4
    assert partitions(spread(spark.range(10).limit(3))) == 1
    monkeypatch.setattr(partitioning, "_split_bytes", lambda df: 1)
    assert partitions(spread(stored)) == partitions(stored)
    monkeypatch.setattr(partitioning, "SHUFFLE_BYTES", estimated_bytes(stored) // 20)
    assert partitions_for(stored) >= 20


def partitions(df):
    return df.rdd.getNumPartitions()
