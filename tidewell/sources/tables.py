"""Tables, views and rows given in the program."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from tidewell.functions.names import quote

RAW_DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("source_file", T.StringType(), True),
        T.StructField("raw_content", T.StringType(), True),
    ]
)


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def catalog_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def inline_rows(
    spark: SparkSession,
    rows: Sequence[tuple],
    schema: T.StructType = RAW_DOCUMENT_SCHEMA,
) -> DataFrame:
    """Rows held by the program, always with an explicit schema."""
    return spark.createDataFrame(list(rows), schema)


def _literal(value: object) -> str:
    """SQL text of a plain value."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (bool, int, float)):
        return repr(value)
    raise TypeError(f"no literal for {type(value).__name__}")


def values_view(
    spark: SparkSession, name: str, columns: Sequence[str], rows: Sequence[tuple]
) -> DataFrame:
    """A temporary view over a ``VALUES`` relation."""
    relation = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    heads = ", ".join(map(quote, columns))
    spark.sql(
        f"CREATE OR REPLACE TEMP VIEW {quote(name)} AS "
        f"SELECT * FROM VALUES {relation} AS data({heads})"
    )
    return spark.sql(f"SELECT * FROM {quote(name)}")
