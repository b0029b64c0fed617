"""Spreading small inputs over the cluster, and size checks for broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Largest table, in bytes, that may be sent whole to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024

# Stored bytes of a table that make up one partition of an explicit shuffle,
# and the fewest that are worth a task of their own.
SHUFFLE_BYTES = 64 * 1024 * 1024
LEAST_BYTES = 64 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan; runs no job."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def _split_bytes(df: DataFrame) -> int:
    """The session's typed setting, so every way of writing a size is understood."""
    return int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def _worth_slots(df: DataFrame, stored: int) -> int:
    """Tasks a small input of ``stored`` bytes is dealt to: the cores, or fewer."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(slots, -(-stored // LEAST_BYTES)))


def spread(df: DataFrame) -> DataFrame:
    """Deal ``df`` out over the cores when its scan is too small to fill them.

    An input with at least one full file split per core already spreads by
    itself and is returned as it is: no shuffle at scale. Rows are dealt round
    robin, so no value can make a partition hot.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    stored = estimated_bytes(df)
    if stored >= slots * _split_bytes(df):
        return df
    return df.repartition(_worth_slots(df, stored))


def partitions_for(df: DataFrame, stored: int | None = None) -> int:
    """How many partitions to shuffle ``df`` into, by its stored size unless that is given."""
    stored = estimated_bytes(df) if stored is None else stored
    return max(_worth_slots(df, stored), -(-stored // SHUFFLE_BYTES))
