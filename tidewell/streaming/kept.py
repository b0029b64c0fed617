"""State kept by key between loads, so that a load costs what it brings and not all history.

The state has one row a key and is stored in buckets of the key. What a load brings is
reduced to one row a key, shuffled into as many buckets and merged by a full outer join, in
which the state is read as it lies: no exchange, however much of it there is. The result is
written in the same buckets as the next version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.names import quote
from tidewell.sinks.versions import VersionedTable
from tidewell.streaming.incremental import latest_versions

BUCKETS = 64


def merged(state: DataFrame, batch: DataFrame, key: str, newer: Column) -> DataFrame:
    """One row for each key of either side: the batch's where ``newer`` says so, or is alone.

    ``newer`` compares columns of ``s`` (state) and ``b`` (batch). Both sides have the same
    columns and one row a key; a null key is one key.
    """
    named = F.col(quote(key)).isNotNull()
    left, right = F.col(f"s.{quote(key)}"), F.col(f"b.{quote(key)}")
    # A null-safe comparison hides the buckets; the one row of a null key goes by itself.
    parts = ((named, left == right), (~named, left.eqNullSafe(right)))
    here, there = F.col("s._here").isNotNull(), F.col("b._there").isNotNull()
    take = there & (~here | newer)
    columns = [
        F.when(take, F.col(f"b.{quote(c)}")).otherwise(F.col(f"s.{quote(c)}")).alias(c)
        for c in batch.columns
        if c != "_there"
    ]
    known, nameless = (
        state.where(some).alias("s").join(batch.where(some).alias("b"), same, "full_outer").select(columns)
        for some, same in parts
    )
    return known.unionByName(nameless)


def _version(side: str, columns: list[str]) -> Column:
    return F.struct(*(F.col(f"{side}.{quote(c)}") for c in columns))


def merge_latest(
    state: VersionedTable, batch: DataFrame, key: str, watermark_column: str, buckets: int = BUCKETS
) -> DataFrame:
    """Bring the latest versions in ``state`` up to date with the rows of one load.

    Equal to ``latest_versions`` over all rows ever loaded, with its ties; also when a load is
    given twice or late. A load with other columns than the state's is an error.
    """
    newest = latest_versions(batch, key, watermark_column)
    if not state.exists():
        return state.replace(newest, key, buckets)
    return state.replace(latest_plan(state.read(), newest, key, watermark_column), key, buckets)


def latest_plan(state: DataFrame, newest: DataFrame, key: str, watermark_column: str) -> DataFrame:
    """The merge of one load's latest versions into the state's."""
    if set(state.columns) != set(newest.columns):
        raise ValueError("the load's columns are not those of the state")
    others = [c for c in state.columns if c not in (key, watermark_column)]
    order = [watermark_column, *others]
    newer = _version("b", order) > _version("s", order)
    return merged(
        state.withColumn("_here", F.lit(1)),
        newest.select(state.columns).withColumn("_there", F.lit(1)),
        key,
        newer,
    )


def last_turns(log: DataFrame) -> DataFrame:
    """(conv_id, turn): the last turn of each conversation of a log."""
    return log.groupBy("conv_id").agg(F.max("turn").alias("turn"))


def merge_turns(state: VersionedTable, turns: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Bring the last turns up to date with turns that were appended to the log."""
    last = last_turns(turns)
    if not state.exists():
        return state.replace(last, "conv_id", buckets)
    plan = merged(
        state.read().withColumn("_here", F.lit(1)),
        last.withColumn("_there", F.lit(1)),
        "conv_id",
        F.col("b.turn") > F.col("s.turn"),
    )
    return state.replace(plan, "conv_id", buckets)
