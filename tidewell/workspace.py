"""Tables staged in the folder every executor can reach.

Stages that several later steps read, or whose rows must not be recomputed
(row positions, for instance), are written once as Parquet. A lost executor
then costs a re-read, never a recomputation with different partitioning.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, as the session names it.

    Only a single-machine session without that setting gets a temporary
    folder; a cluster session without it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder shared by all executors"
        )
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tidewell-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


class Workspace:
    """A uniquely named folder of staged tables under the shared root.

    As a context manager it removes its folder on leaving; use it so when the
    results have been written elsewhere by then.
    """

    def __init__(self, spark: SparkSession, label: str = "work") -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/tidewell-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        """Write ``df`` once, with Parquet ``options``, and return the written table."""
        target = self.path(name)
        df.write.options(**(options or {})).mode("overwrite").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def clear(self) -> None:
        """Delete the folder and all that was staged in it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        path.getFileSystem(conf).delete(path, True)

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()
