"""Kept state and versioned tables: equal to all history, without reading it."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidewell.sinks.tables import PathTarget, ensure_schema
from tidewell.sinks.versions import VersionedTable
from tidewell.streaming.incremental import LoadLog, latest_versions, logged_load, resolve_watermark
from tidewell.streaming.kept import last_turns, latest_plan, merge_latest, merge_turns


@pytest.fixture
def table(spark, workspace):
    schema = f"kept{uuid.uuid4().hex}"
    ensure_schema(spark, schema, workspace.path("tables"))
    return VersionedTable(spark, schema, "state")


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_a_failed_write_leaves_the_version_before(spark, table):
    assert not table.exists() and table.version() is None
    table.replace(spark.range(5))
    first = table.version()
    bad = spark.range(10, 20, 1, 4).withColumn("id", F.when(F.col("id") == 17, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        table.replace(bad)
    assert table.version() == first and rows(table.read()) == [(i,) for i in range(5)]
    reading = table.read()
    table.replace(table.read().select((F.col("id") + 1).alias("id")))  # from itself
    assert rows(table.read()) == [(i + 1,) for i in range(5)]
    assert rows(reading) == [(i,) for i in range(5)]  # it had begun before
    table.replace(spark.range(2).withColumn("x", F.lit("new column")))
    assert table.read().columns == ["id", "x"]
    names = spark.sql(f"SHOW TABLES IN {table.schema} LIKE 'state__*'").count()
    assert names == 2  # the current version and the one before


def test_latest_versions_of_many_loads(spark, table):
    rng = random.Random(4)
    schema = "k INT, wm INT, v STRING"
    everything = []
    for _ in range(4):
        load = [
            (rng.choice([None, *range(12)]), rng.choice([None, *range(6)]), rng.choice("abc"))
            for _ in range(30)
        ]
        everything += load
        merge_latest(table, spark.createDataFrame(load, schema), "k", "wm", 4)
        want = latest_versions(spark.createDataFrame(everything, schema), "k", "wm")
        assert rows(table.read()) == rows(want)
    merge_latest(table, spark.createDataFrame(everything[:7], schema), "k", "wm", 4)
    assert rows(table.read()) == rows(want)
    with pytest.raises(ValueError):
        merge_latest(table, spark.createDataFrame([(1, 1)], "k INT, wm INT"), "k", "wm")


def test_the_state_is_not_exchanged(spark, table):
    schema = "k INT, wm INT, v STRING"
    merge_latest(table, spark.createDataFrame([(i, 1, "x") for i in range(100)], schema), "k", "wm", 4)
    load = latest_versions(spark.createDataFrame([(1, 2, "y")], schema), "k", "wm")
    plan = latest_plan(table.read(), load, "k", "wm")._jdf.queryExecution().executedPlan().toString()
    known = plan[plan.index("SortMergeJoin") :]
    assert "Bucketed: true" in plan
    assert "Exchange" not in known[: known.index("Scan parquet")], plan


def test_last_turns(spark, table):
    log = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 3)], "conv_id BIGINT, turn BIGINT")
    more = spark.createDataFrame([(2, 1), (2, 2), (3, 0), (None, 4), (1, 0)], "conv_id BIGINT, turn BIGINT")
    merge_turns(table, log, 4)
    merge_turns(table, more, 4)
    assert rows(table.read()) == rows(last_turns(log.union(more)))


def test_the_log_says_where_to_start(spark, workspace):
    target, records = PathTarget(spark, workspace.path("t")), PathTarget(spark, workspace.path("log"))
    log = LoadLog(records, "t")
    source = spark.range(10).selectExpr("id", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int)) at")
    assert log.last_watermark() is None
    assert logged_load(source.where("id < 4"), target, "at", log).new_records == 4
    assert log.last_watermark() == "2024-01-04 00:00:00"
    assert logged_load(source.where("id < 4"), target, "at", log).new_records == 0
    done = logged_load(source, target, "at", log)
    assert (done.new_records, done.watermark) == (6, "2024-01-04 00:00:00")
    got = [(r["load_no"], r["new_records"], r["watermark"]) for r in records.read().orderBy("load_no").collect()]
    assert got == [(1, 4, "2024-01-04 00:00:00"), (2, 6, "2024-01-10 00:00:00")]
    # A target set back to an earlier state is looked into whole.
    back = PathTarget(spark, workspace.path("back"))
    back.append(source.where("id < 2"))
    assert resolve_watermark(back, "at", log.last_watermark()) == "2024-01-02 00:00:00"
    other = LoadLog(records, "another")
    assert other.last_watermark() is None
    empty = PathTarget(spark, workspace.path("nulls"))
    assert logged_load(source.selectExpr("id", "cast(null as timestamp_ntz) at"), empty, "at", other).new_records == 0
    assert not empty.exists()


def test_a_folders_schema_is_kept_beside_it(spark, workspace):
    target = PathTarget(spark, workspace.path("evolving"))
    target.append(spark.createDataFrame([(1, "x")], "a INT, b STRING"))
    target.append(spark.createDataFrame([(2, 0.5)], "a INT, c DOUBLE"))
    assert [f.name for f in target.known_schema()] == ["a", "b", "c"]
    assert rows(target.read()) == [(1, "x", None), (2, None, 0.5)]
    with pytest.raises(ValueError):
        target.append(spark.createDataFrame([("y",)], "a STRING"))
    # Files of other writers, and folders of before, are read by their footers.
    spark.createDataFrame([(3, True)], "a INT, d BOOLEAN").write.mode("append").parquet(target.path)
    assert rows(target.read(merge=True).select("a", "d")) == [(1, None), (2, None), (3, True)]
    other = PathTarget(spark, workspace.path("plain"))
    spark.range(2).write.parquet(other.path)
    assert other.known_schema() is None and other.read().count() == 2
    other.append(spark.range(2, 3).withColumn("e", F.lit(1)))
    assert rows(other.read()) == [(0, None), (1, None), (2, 1)]
