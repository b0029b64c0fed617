"""Full-replace writes, append targets that gain columns, and run records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewell.functions.names import quote

# Where a folder's schema is kept, beside the data.
SCHEMA_FILE = "_tidewell_schema.json"

# Bytes of a row group, and of its Bloom filter at most, in tables for lookups.
LOOKUP_GROUP_BYTES = 16 << 20
LOOKUP_BLOOM_BYTES = 128 << 10

# Parquet options of tables that copy whole texts: what is written is their larger cost.
COMPACT = {"compression": "zstd"}


def ensure_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    escaped = (location or "").replace("\\", "\\\\").replace("'", "\\'")
    place = f" LOCATION '{escaped}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quote(name)}{place}")


def use_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"USE {quote(name)}")


def lookup_options(key: str, row_group_bytes: int = LOOKUP_GROUP_BYTES) -> dict[str, str]:
    """Parquet options of a table whose rows are looked up by ``key``.

    Small row groups, and a Bloom filter of the key in each; a filter on the key then
    rules out what its range or its Bloom filter excludes.
    """
    return {
        "parquet.block.size": str(row_group_bytes),
        f"parquet.bloom.filter.enabled#{key}": "true",
        "parquet.bloom.filter.adaptive.enabled": "true",
        "parquet.bloom.filter.max.bytes": str(LOOKUP_BLOOM_BYTES),
    }


def replace_table(
    df: DataFrame,
    name: str,
    format: str = "parquet",
    lookup_key: str | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Write ``df`` as the whole content of table ``name`` and read it back.

    With ``lookup_key`` each file is in the key's order and prepared for lookups by it.
    ``options`` are those of the format.
    """
    if lookup_key is not None:
        df = df.sortWithinPartitions(lookup_key)
    writer = df.write.format(format).options(**(options or {})).mode("overwrite")
    if lookup_key is not None:
        writer = writer.options(**lookup_options(lookup_key))
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def _bare(kind: T.DataType) -> T.DataType:
    """The type with everything inside nullable, as files are read."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_bare(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_bare(kind.keyType), _bare(kind.valueType), True)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _bare(f.dataType), True) for f in kind])
    return kind


def _added_fields(known: T.StructType, batch: T.StructType) -> list[T.StructField]:
    """Fields only the batch has; a changed type is refused, as it would be unreadable."""
    types = {field.name.lower(): field.dataType for field in known}
    added = []
    for field in batch:
        have = types.get(field.name.lower())
        if have is None:
            added.append(field)
        elif _bare(have) != _bare(field.dataType):
            raise ValueError(
                f"column {field.name!r} is {have.simpleString()} in the target "
                f"but {field.dataType.simpleString()} in the batch"
            )
    return added


class CatalogTarget:
    """A catalog table that gains the columns new batches bring.

    They are added to the table's schema before the append, so a reader needs
    no per-file schema merge however many files there are.
    """

    def __init__(self, spark: SparkSession, name: str, format: str = "parquet") -> None:
        self.spark = spark
        self.name = name
        self.format = format

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, batch: DataFrame) -> None:
        if not self.exists():
            batch.write.format(self.format).saveAsTable(self.name)
            return
        added = _added_fields(self.read().schema, batch.schema)
        if added:
            columns = ", ".join(
                f"{quote(f.name)} {f.dataType.simpleString()}" for f in added
            )
            self.spark.sql(f"ALTER TABLE {self.name} ADD COLUMNS ({columns})")
        given = {name.lower(): name for name in batch.columns}
        aligned = [
            F.col(quote(given[f.name.lower()])).alias(f.name)
            if f.name.lower() in given
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in self.read().schema
        ]
        batch.select(*aligned).write.insertInto(self.name)


class PathTarget:
    """A folder of Parquet files read with the union of the files' schemas.

    The union is kept beside the data after every append, in a file that readers of the folder
    skip, so neither a read nor an append opens the footers of all files. A folder that has
    none yet, or was written to by others, is read with ``merge``. One writer at a time:
    plain files have no commit that spans writers.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path

    def exists(self) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        return path.getFileSystem(conf).exists(path)

    def _schema_file(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{SCHEMA_FILE}")
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        return path.getFileSystem(conf), path

    def known_schema(self) -> T.StructType | None:
        """The schema kept beside the data."""
        files, path = self._schema_file()
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return T.StructType.fromJson(json.loads(text))

    def _keep_schema(self, schema: T.StructType) -> None:
        files, path = self._schema_file()
        stream = files.create(path, True)
        try:
            stream.write(schema.json().encode("utf-8"))
        finally:
            stream.close()

    def read(self, schema: T.StructType | None = None, merge: bool = False) -> DataFrame:
        """``schema`` is used where the caller knows it; ``merge`` looks into every footer."""
        known = schema if schema is not None or merge else self.known_schema()
        if known is not None:
            return self.spark.read.schema(known).parquet(self.path)
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)

    def append(self, batch: DataFrame) -> None:
        known = self.read().schema if self.exists() else T.StructType([])
        added = _added_fields(known, batch.schema)
        if added:  # before the data: a column without rows harms no reader
            self._keep_schema(T.StructType([*known, *(T.StructField(f.name, _bare(f.dataType)) for f in added)]))
        batch.write.mode("append").parquet(self.path)


def index_stats(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Number of vectors and their dimension; an error where it is not uniform."""
    sizes = F.size(vector_col)
    ragged = (F.min(sizes) != F.max(sizes)) | (F.count(vector_col) != F.count(F.lit(1)))
    return vectors.agg(
        F.count(F.lit(1)).alias("num_vectors"),
        F.when(
            ragged,
            F.raise_error(F.lit("vectors of unequal dimension")).cast("bigint"),
        )
        .otherwise(F.max(sizes))
        .cast("bigint")
        .alias("embedding_dim"),
    )


def append_run_record(stats: DataFrame, target: CatalogTarget | PathTarget, run_name: str) -> None:
    """Add the one-row statistics of a run to the run table."""
    target.append(
        stats.select(
            F.lit(run_name).alias("run_name"), "*", F.current_timestamp().alias("run_time")
        )
    )
