"""Bringing the vector layer up to date with the documents, at the cost of what changed.

The layer and the state of its documents are kept in folders of buckets, by a hash of the
source name. A refresh compares fingerprints: only documents that are new or have another
text are cut and encoded, those that are gone leave, and only buckets with a change are
written again, each in place of its old rows. The state is written last, so a refresh
that failed is simply made again: its changes are found anew, and rows it had written
already are replaced.

Texts are never shuffled whole: fingerprints are, and the chunks of changed documents. Vectors
are kept packed, as most of what a refresh writes are rows it copies: they go through as they
are, and only a reader makes arrays of them. A folder has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tidewell.operators.chunk import CHUNK_OVERLAP, CHUNK_SIZE, chunk_documents
from tidewell.operators.embed import Encoder, HashedWords, packed_embedding, unpacked
from tidewell.partitioning import spread
from tidewell.sinks.tables import PathTarget
from tidewell.workspace import Workspace

# Buckets of a new layer, and changed documents whose names may be broadcast.
BUCKETS = 64
BROADCAST_NAMES = 100_000

_KEY = "source_file"
_STATE = "source_file string, documents bigint, one decimal(38,0), two decimal(38,0), bucket int"
# ``embedding`` is null but in rows of layers that were kept as arrays.
_STORED = (
    "source_file string, chunk_no bigint, chunk_text string, embedding array<float>, packed binary, bucket int"
)


@dataclass(frozen=True)
class Refresh:
    """What one refresh did: documents by kind of change, and buckets written again."""

    added: int
    changed: int
    deleted: int
    buckets: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(_KEY), F.lit(buckets)).cast("int").alias("bucket")


def document_state(documents: DataFrame, buckets: int) -> DataFrame:
    """(source_file, documents, one, two, bucket): a fingerprint of each name's texts.

    Several rows of a name count together, in any order.
    """
    text = F.coalesce("raw_content", F.lit(""))

    def total(value: Column) -> Column:
        return F.sum(value.cast("decimal(20,0)")).cast("decimal(38,0)")

    return (
        documents.groupBy(_KEY)
        .agg(
            F.count(F.lit(1)).alias("documents"),
            total(F.xxhash64(text)).alias("one"),
            total(F.xxhash64(F.lit(7), text)).alias("two"),
        )
        .withColumn("bucket", _bucket(buckets))
    )


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(source_file, bucket, kind) of every name that was added, changed or deleted."""
    old = before.select(_KEY, *(F.col(c).alias(f"old_{c}") for c in ("documents", "one", "two", "bucket")))
    same = F.lit(True)
    for column in ("documents", "one", "two"):
        same = same & F.col(column).eqNullSafe(F.col(f"old_{column}"))
    kind = (
        F.when(F.col("old_bucket").isNull(), "added")
        .when(F.col("bucket").isNull(), "deleted")
        .when(~same, "changed")
    )
    compared = now.withColumn("_here", F.lit(True)).join(
        old.withColumnRenamed(_KEY, "_name"), F.col(_KEY).eqNullSafe(F.col("_name")), "full_outer"
    )
    return compared.select(
        F.when(F.col("_here"), F.col(_KEY)).otherwise(F.col("_name")).alias(_KEY),
        F.coalesce("bucket", "old_bucket").alias("bucket"),
        kind.alias("kind"),
    ).where("kind is not null")


def _write(rows: DataFrame, path: str, affected: list[int]) -> None:
    """Put ``rows`` in place of what the affected buckets hold."""
    spark = rows.sparkSession
    written = Observation()
    counted = rows.observe(written, F.collect_set("bucket").alias("buckets"))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket"
    ).parquet(path)
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for bucket in set(affected) - set(written.get["buckets"]):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        folder.getFileSystem(conf).delete(folder, True)


def _named(rows: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """Rows whose name is, or is not, among ``names``, nulls being equal."""
    return rows.join(
        names.select(F.col(_KEY).alias("_name")), F.col(_KEY).eqNullSafe(F.col("_name")), how
    )


def read_layer(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, chunk_no, chunk_text, embedding, bucket) of the layer as it stands."""
    vector = F.coalesce("embedding", unpacked(F.col("packed")))
    return _stored(spark, folder).withColumn("embedding", vector).drop("packed")


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """The layer's rows as they are kept."""
    if not PathTarget(spark, f"{folder}/vectors").exists():
        return _nothing(spark, _STORED)
    return spark.read.schema(_STORED).parquet(f"{folder}/vectors")


def _nothing(spark: SparkSession, columns: str) -> DataFrame:
    schema = T.StructType.fromDDL(columns)
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def refresh_layer(
    documents: DataFrame,
    folder: str,
    workspace: Workspace,
    encoder: Callable[[], Encoder] = HashedWords,
    buckets: int = BUCKETS,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> Refresh:
    """Make the layer in ``folder`` that of ``documents`` (source_file, raw_content).

    A first refresh builds it. ``buckets``, the encoder and the chunk sizes must stay those of
    the first one. Names may be null or repeat.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col(_KEY).cast("string"), "raw_content")
    state = PathTarget(spark, f"{folder}/state")
    before = state.read(T.StructType.fromDDL(_STATE)) if state.exists() else _nothing(spark, _STATE)
    now = workspace.stage(document_state(documents, buckets), "state")
    diff = workspace.stage(changes(now, before), "changes")
    counted = {r["kind"]: r["count"] for r in diff.groupBy("kind").count().collect()}
    affected = [r["bucket"] for r in diff.select("bucket").distinct().collect()]
    if not affected:
        return Refresh(0, 0, 0, 0)
    few = sum(counted.values()) <= BROADCAST_NAMES
    names = F.broadcast(diff) if few else diff
    fresh = _named(documents, names.where("kind <> 'deleted'"), "left_semi")
    cut = chunk_documents(spread(fresh), _KEY, text_col="raw_content", size=size, overlap=overlap)
    # Chunks of one bucket come together, in as many tasks as their bytes need.
    cut = cut.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket")
    new = cut.withColumns(
        {
            "embedding": F.lit(None).cast("array<float>"),
            "packed": packed_embedding(F.col("chunk_text"), encoder),
        }
    )
    kept = _named(_stored(spark, folder).where(F.col("bucket").isin(affected)), names, "left_anti")
    columns = [_KEY, "chunk_no", "chunk_text", "embedding", "packed", "bucket"]
    _write(kept.select(columns).unionByName(new.select(columns)), f"{folder}/vectors", affected)
    _write(now.where(F.col("bucket").isin(affected)), f"{folder}/state", affected)
    return Refresh(*(counted.get(kind, 0) for kind in ("added", "changed", "deleted")), len(affected))
