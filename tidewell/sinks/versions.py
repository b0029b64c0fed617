"""Tables replaced as a whole without a gap: each version is a table, a view names the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.names import qualified

# Property of the view that names its version's table.
_VERSION = "tidewell.version"


class VersionedTable:
    """A view over the latest complete version of a table.

    A replacement is written under a name of its own and the view is moved to it when it is
    complete. A write that fails leaves the view where it was, so readers always get one whole
    version; those that have begun go on with the one they began with, as the last version
    but one is kept. A frame that reads the view may replace it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, schema: str, table: str, format: str = "parquet") -> None:
        self.spark = spark
        self.schema = schema
        self.table = table
        self.format = format
        self.name = qualified(schema, table)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def version(self) -> str | None:
        """The table that the view shows now."""
        if not self.exists():
            return None
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").where(F.col("key") == _VERSION)
        return rows.first()["value"]

    def replace(self, df: DataFrame, key: str | None = None, buckets: int = 0) -> DataFrame:
        """Make ``df`` the table's content, in ``buckets`` of ``key`` if these are given."""
        before = self.version()
        after = f"{self.table}__{uuid.uuid4().hex}"
        writer = df.write.format(self.format).mode("errorifexists")
        if buckets:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        try:
            writer.saveAsTable(qualified(self.schema, after))
        except BaseException:
            self.spark.sql(f"DROP TABLE IF EXISTS {qualified(self.schema, after)}")
            raise
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {self.name} TBLPROPERTIES ('{_VERSION}' = '{after}') "
            f"AS SELECT * FROM {qualified(self.schema, after)}"
        )
        self._drop_others({before, after})
        return self.read()

    def _drop_others(self, kept: set[str | None]) -> None:
        found = self.spark.sql(f"SHOW TABLES IN {qualified(self.schema)} LIKE '{self.table}__*'")
        for row in found.select("tableName").collect():
            if row["tableName"] not in kept:
                self.spark.sql(f"DROP TABLE IF EXISTS {qualified(self.schema, row['tableName'])}")
