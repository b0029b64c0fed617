"""From raw documents to packed training sequences, in five stages.

Every stage works on what its predecessor kept, and returns the columns of
``documents`` except the last, whose rows are the packed pieces. ``run`` writes each
stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.llm.common import scratch, scratch_scope
from tidewell.llm.decontaminate import is_contaminated
from tidewell.llm.ngram_join import BROADCAST_ROWS, placed_sets, set_fingerprint
from tidewell.llm.packing import pack_documents
from tidewell.llm.quality import THRESHOLD, fit_quality, quality_score
from tidewell.llm.secrets import fit_thresholds, redacted

# SQL can't express the trained and the tokenising stages.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_score(model, F.col("text")) >= THRESHOLD)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, one with the least id, of each group of near duplicates.

    Rows are told apart by id and set of word shingles, so a text goes only with a near
    copy of it, whatever ids repeat or are null; of rows that have both in common one stays,
    and a null id comes after all others. Rows without words are linked with nothing and
    stay. The ids that go are counted, and broadcast only if few.
    """
    workspace = scratch(spark, "distinct")
    placed = workspace.stage(placed_sets(docs), "placed")
    gone = _side(placed.where("n > 0 and doc_id <> component_id").select("doc_id").distinct())
    twice = placed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    twice = workspace.stage(twice.select("doc_id"), "twice")
    if twice.isEmpty() and placed.where("doc_id is null").isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = _side(twice)
    lone = docs.where("doc_id is not null").join(twice, "doc_id", "left_anti")
    several = docs.join(twice, "doc_id", "left_semi").select(docs.columns)
    several = several.unionByName(docs.where("doc_id is null"))
    several = several.withColumn("_set", set_fingerprint(F.col("text")))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n", "set_1", "set_2")
    first = placed.where("n > 0").groupBy("component").agg(F.min(key).alias("first"))
    first = first.select(
        F.col("first.doc_id").alias("_id"), F.struct("first.n", "first.set_1", "first.set_2").alias("_first")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_set") == F.col("_first"))
    chosen = several.join(first, same, "left_semi").dropDuplicates(["doc_id", "_set"])
    return (
        lone.join(gone, "doc_id", "left_anti")
        .select(docs.columns)
        .unionByName(chosen.select(docs.columns))
        .unionByName(several.where("_set.n = 0").select(docs.columns))
    )


def _side(ids: DataFrame) -> DataFrame:
    """Ids as one side of a join, broadcast if they were counted as few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return docs.where(~is_contaminated(docs, benchmark, F.col("text")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a fixed word; ``n_chars`` follows the text."""
    clean = docs.withColumn("text", redacted(fit_thresholds(docs), F.col("text")))
    if "n_chars" in docs.columns:
        length = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
        clean = clean.withColumn("n_chars", length)
    return clean.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("ngram_join", keep_distinct),
    ("decontamination", keep_uncontaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; what a stage staged for itself goes with it."""
    workspace = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch_scope():
            docs = workspace.stage(stage(spark, docs, sf_dir), name)
    return docs
