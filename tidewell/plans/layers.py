"""The three document layers: raw text, chunks, vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.names import qualified
from tidewell.operators.chunk import CHUNK_OVERLAP, CHUNK_SIZE, chunk_documents
from tidewell.operators.embed import Encoder, HashedWords, embed
from tidewell.operators.ids import dense_ids, unique_id
from tidewell.partitioning import spread
from tidewell.sinks.tables import COMPACT, ensure_schema, replace_table
from tidewell.workspace import Workspace

# Names of the layer tables.
RAW_TABLE = "raw_documents"
CHUNK_TABLE = "silver_chunks"
VECTOR_TABLE = "gold_embeddings"


def raw_documents(documents: DataFrame, source_file: str, text: str) -> DataFrame:
    """Source name, untouched text and load time."""
    return documents.select(
        F.col(source_file).cast("string").alias("source_file"),
        F.col(text).alias("raw_content"),
        F.current_timestamp().alias("ingestion_time"),
    )


def chunk_layer(
    raw: DataFrame,
    workspace: Workspace,
    dense: bool = False,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """``(source_file, chunk_text, chunk_id)``.

    Ids are unique, and given in the one pass that cuts the text. ``dense``
    makes them contiguous in document and chunk order, for a range shuffle and
    two staged writes.
    """
    pieces = chunk_documents(
        spread(raw.select("source_file", "raw_content")),
        "source_file",
        text_col="raw_content",
        size=size,
        overlap=overlap,
    )
    if dense:
        pieces = dense_ids(pieces, workspace, ["source_file", "chunk_no"])
    else:
        pieces = pieces.withColumn("chunk_id", unique_id())
    return pieces.select("source_file", "chunk_text", "chunk_id")


def vector_layer(
    chunks: DataFrame, encoder: Callable[[], Encoder] = HashedWords, dealt: bool = False
) -> DataFrame:
    """The chunk layer with a vector per chunk. ``dealt``: its files fill the cores already."""
    return embed(chunks if dealt else spread(chunks), "chunk_text", encoder)


@dataclass(frozen=True)
class Layers:
    raw: DataFrame
    chunks: DataFrame
    vectors: DataFrame


def build_chunks(
    spark: SparkSession,
    documents: DataFrame,
    schema: str,
    workspace: Workspace,
    source_file: str = "source_file",
    text: str = "raw_content",
    dense: bool = False,
    location: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The raw and the chunk layer as tables of ``schema``, replacing what is there."""
    ensure_schema(spark, schema, location)
    raw = replace_table(
        raw_documents(documents, source_file, text), qualified(schema, RAW_TABLE), options=COMPACT
    )
    chunks = replace_table(
        chunk_layer(raw, workspace, dense),
        qualified(schema, CHUNK_TABLE),
        lookup_key="chunk_id",
        options=COMPACT,
    )
    return raw, chunks


def build_layers(
    spark: SparkSession,
    documents: DataFrame,
    schema: str,
    workspace: Workspace,
    source_file: str = "source_file",
    text: str = "raw_content",
    dense: bool = False,
    encoder: Callable[[], Encoder] = HashedWords,
    location: str | None = None,
) -> Layers:
    """Write each layer as a table of ``schema``, replacing what is there.

    Every layer is read back from its table, so nothing is computed twice. Dense ids
    deal the chunks out in even ranges, so those are not dealt out again to be encoded.
    """
    raw, chunks = build_chunks(
        spark, documents, schema, workspace, source_file, text, dense, location
    )
    vectors = replace_table(
        vector_layer(chunks, encoder, dealt=dense), qualified(schema, VECTOR_TABLE), options=COMPACT
    )
    return Layers(raw, chunks, vectors)
