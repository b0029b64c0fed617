"""Dear computations on texts, made once for each distinct text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.workspace import Workspace

# A text of so great a share of the rows, and of so many at least, is joined by broadcast.
HOT_SHARE = 1000
LEAST_HOT = 1000


def per_distinct(
    df: DataFrame,
    text_col: str,
    workspace: Workspace,
    compute: Callable[[Column], Column],
    output: str,
) -> DataFrame:
    """``df`` with ``output`` computed from ``text_col``, once for each distinct text.

    Worth its two shuffles where the computation is dear. ``df`` is read three times and
    should be a written table. Texts go by fingerprints of 128 bits, a null as an empty text.
    A text that more than one row in ``HOT_SHARE`` has is joined back by broadcast, so that
    it makes no partition hot; there are fewer of these than ``HOT_SHARE``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.withColumns({"_one": F.xxhash64(text), "_two": F.xxhash64(F.lit(7), text)})
    keys = ["_one", "_two"]
    distinct = keyed.groupBy(keys).agg(F.first(text).alias("_text"), F.count(F.lit(1)).alias("_rows"))
    found = workspace.stage(
        distinct.select(*keys, "_rows", compute(F.col("_text")).alias(output)), f"distinct-{output}"
    )
    rows = found.agg(F.sum("_rows")).first()[0] or 0
    hot = F.col("_rows") > max(rows // HOT_SHARE, LEAST_HOT)
    often = F.broadcast(found.where(hot).drop("_rows"))
    rest = keyed.join(often.select(keys), keys, "left_anti").join(found.where(~hot).drop("_rows"), keys)
    return rest.unionByName(keyed.join(often, keys)).select(*df.columns, output)
