"""What the layers cost to write."""

import glob
import uuid

import pyarrow.parquet as pq

from tidewell.plans.layers import build_layers, vector_layer
from tidewell.workspace import Workspace


def codecs(folder):
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)]
    groups = [f.row_group(g) for f in files for g in range(f.num_row_groups)]
    return {group.column(c).compression for group in groups for c in range(group.num_columns)}


def test_layers_and_their_stages_are_written_compactly(spark, workspace):
    rows = [(f"d{i}", f"words of text {i} " * 60) for i in range(200)]
    documents = spark.createDataFrame(rows, "source_file STRING, raw_content STRING")
    staged = Workspace(spark, "staged")
    layers = build_layers(
        spark, documents, f"s{uuid.uuid4().hex}", staged, dense=True, location=workspace.path("tables")
    )
    assert codecs(staged.root) == codecs(workspace.path("tables")) == {"ZSTD"}
    ids = [r["chunk_id"] for r in layers.vectors.orderBy("source_file", "chunk_id").collect()]
    assert ids == list(range(len(ids))) and len(ids) > 200
    plan = vector_layer(layers.chunks, dealt=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan
