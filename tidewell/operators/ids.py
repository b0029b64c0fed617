"""Row identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.partitioning import partitions_for
from tidewell.sinks.tables import COMPACT
from tidewell.workspace import Workspace

# monotonically_increasing_id() holds the partition above this many bits and
# the row's position inside the partition below.
_POSITION_BITS = 33


def unique_id() -> Column:
    """A unique, increasing, not contiguous id; costs no shuffle."""
    return F.monotonically_increasing_id()


def dense_ids(
    df: DataFrame,
    workspace: Workspace,
    order_by: list[str] | None = None,
    id_col: str = "chunk_id",
    keyed: bool = False,
) -> DataFrame:
    """Contiguous ids from 0, in the order of ``order_by`` or else in fetch order.

    Rows are written with their position in their partition; the id is that
    position plus the number of rows in earlier partitions. Only those counts,
    one row per partition, are ranked and broadcast: no window runs over the
    data. Rows with equal ``order_by`` values keep their fetch order and, since
    that is part of the range partitioning, spread over partitions however many
    they are. ``keyed`` says that ``order_by`` identifies a row and that ``df``
    is a written table, which spares the first of the two writes.
    """
    if order_by and not keyed:
        df = workspace.stage(df.withColumn("_fetched", unique_id()), f"fetched-{id_col}", COMPACT)
        order_by = [*order_by, "_fetched"]
    if order_by:
        df = df.repartitionByRange(partitions_for(df), *order_by).sortWithinPartitions(*order_by)
    placed = workspace.stage(
        df.drop("_fetched").withColumn("_place", unique_id()), f"placed-{id_col}", COMPACT
    )
    part = F.shiftright("_place", _POSITION_BITS)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
        )
    )
    position = F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(id_col, F.col("_offset") + position)
        .drop("_part", "_offset", "_place")
    )
