"""Fetching rows by id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.operators.knn import Hits
from tidewell.partitioning import BROADCAST_BYTES

# Hits of at most so many bytes, ids of at most so many rows, come to the driver, so
# that a filter made of them can reach the scan.
PRUNE_BYTES = 1 << 20
PRUNE_IDS = 10_000

# Terms of such a filter at most.
MOST_RANGES = 256


def id_ranges(ids: list[int], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges, both ends included, that hold all ids; ``most`` at most, of the widest gaps between."""
    ordered = sorted(set(ids))
    gaps = sorted(
        range(1, len(ordered)), key=lambda i: ordered[i] - ordered[i - 1], reverse=True
    )
    neighbours = [i for i in gaps if ordered[i] - ordered[i - 1] == 1]
    cuts = sorted(set(gaps[: most - 1]) - set(neighbours))
    edges = [0, *cuts, len(ordered)]
    return [(ordered[a], ordered[b - 1]) for a, b in zip(edges, edges[1:]) if b > a]


def among(column: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a column lies in one of the ranges; plain comparisons, which reach a file scan.

    Joined in a balanced tree, so that many terms don't nest deeply.
    """
    terms = [
        column == low if low == high else (column >= low) & (column <= high)
        for low, high in ranges
    ]
    while len(terms) > 1:
        pairs = zip(terms[::2], terms[1::2])
        rest = terms[len(terms) - len(terms) % 2 :]
        terms = [reduce(Column.__or__, pair) for pair in pairs] + rest
    return terms[0] if terms else F.lit(False)


def fetch_hits(
    hits: Hits,
    table: DataFrame,
    key: str,
    broadcast_bytes: int = BROADCAST_BYTES,
    prune_bytes: int = PRUNE_BYTES,
) -> DataFrame:
    """Join ranked hits with the table that holds their text, keeping the rank.

    Very few hits are searched at once and come to the driver; a filter made of their
    ids is pushed into the scan, where it rules out files, row groups and pages. Hits
    known to be few are broadcast, so the text is read once and not shuffled; otherwise
    Spark chooses the join.
    """
    size = hits.max_bytes
    if size is not None and size <= min(prune_bytes, broadcast_bytes):
        rows = hits.rows.toArrow()
        ids = [i for i in rows[key].unique().to_pylist() if i is not None]
        given = table.sparkSession.createDataFrame(rows, hits.rows.schema)
        return table.where(among(F.col(key), id_ranges(ids))).join(F.broadcast(given), key)
    few = size is not None and size <= broadcast_bytes
    return table.join(F.broadcast(hits.rows) if few else hits.rows, key)


def rows_with_ids(
    table: DataFrame, ids: DataFrame, key: str, prune_ids: int = PRUNE_IDS
) -> DataFrame:
    """Rows of ``table`` whose ``key`` is in ``ids`` (each row once).

    Up to ``prune_ids`` different whole-number ids are also made a filter for the scan.
    """
    wanted = ids.select(key).where(F.col(key).isNotNull()).distinct()
    if dict(table.dtypes)[key] in ("int", "bigint"):
        known = wanted.limit(prune_ids + 1).toArrow()[key].to_pylist()
        if len(known) <= prune_ids:
            table = table.where(among(F.col(key), id_ranges(known)))
            wanted = F.broadcast(table.sparkSession.createDataFrame([(i,) for i in known], wanted.schema))
    return table.join(wanted, key, "left_semi")
