"""The saved vector index: vectors by id, and the position of each id.

Positions are numbered on ids alone. A vector is copied once, from where it is stored to the
index, and never shuffled; what a search finds is few rows, and these are given their
positions by the mapping.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.operators.ids import dense_ids
from tidewell.operators.knn import DEFAULT_K, Hits, find_nearest
from tidewell.operators.lookup import fetch_hits
from tidewell.sinks.tables import lookup_options
from tidewell.workspace import Workspace


@dataclass(frozen=True)
class SavedIndex:
    vectors: DataFrame
    """``(id, embedding)``"""
    mapping: DataFrame
    """``(vec_pos, id)``"""
    id_col: str


def id_mapping(vectors: DataFrame, workspace: Workspace, id_col: str = "chunk_id") -> DataFrame:
    """Position of every id, counted from 0 in id order. Reads the ids only."""
    return dense_ids(
        vectors.select(id_col), workspace, [id_col], id_col="vec_pos", keyed=True
    ).select("vec_pos", id_col)


def save_index(
    vectors: DataFrame,
    folder: str,
    workspace: Workspace,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
) -> None:
    """Write both tables of the index. ``vectors`` must be a written table.

    The mapping is in the order of ids and prepared for lookups by id.
    """
    stored_vectors(vectors, id_col, vector_col).write.mode("overwrite").parquet(f"{folder}/vectors")
    placed = id_mapping(vectors, workspace, id_col).sortWithinPartitions(id_col)
    options = lookup_options(id_col)
    placed.write.options(**options).mode("overwrite").parquet(f"{folder}/mapping")


def stored_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """What the index keeps of the vectors: a narrow copy."""
    return vectors.select(id_col, F.col(vector_col).alias("embedding"))


def load_index(spark: SparkSession, folder: str, id_col: str = "chunk_id") -> SavedIndex:
    return SavedIndex(
        spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/mapping"), id_col
    )


def search_index(
    queries: DataFrame, index: SavedIndex, k: int = DEFAULT_K, **columns
) -> Hits:
    """Nearest ids, with the position that each has; equal distances rank by id, as positions do."""
    found = find_nearest(queries, index.vectors, k, corpus_id=index.id_col, **columns)
    mapping = index.mapping.withColumn(index.id_col, F.col(index.id_col).cast("bigint"))
    return Hits(fetch_hits(found, mapping, index.id_col), found.max_bytes)
