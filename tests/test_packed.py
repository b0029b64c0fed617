"""Packed vectors, and layers that keep them so."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewell.operators.embed import embedding, packed_array, packed_embedding, unpacked, unpacked_array
from tidewell.plans.refresh import read_layer, refresh_layer
from tidewell.workspace import Workspace

SCHEMA = "source_file STRING, raw_content STRING"


def test_packed_arrays_come_back():
    matrix = np.array([[0.0, -0.0, 1.5], [np.inf, 1e-45, -2.0]], np.float32)
    packed = packed_array(matrix)
    assert packed.to_pylist() == [row.tobytes() for row in matrix]
    rows = [None, packed[1].as_py(), b"", packed[0].as_py(), None]
    for kind in (pa.binary(), pa.large_binary()):
        column = pa.array(rows, kind)
        assert unpacked_array(column).to_pylist() == [None, matrix[1].tolist(), [], matrix[0].tolist(), None]
        assert unpacked_array(column.slice(3)).to_pylist() == [matrix[0].tolist(), None]
        assert unpacked_array(column.slice(4)).to_pylist() == [None]
        assert unpacked_array(column.slice(0, 0)).to_pylist() == []


def test_packed_embedding_is_the_embedding(spark):
    texts = ["a b a", "", None, "a b a", "c", "ß ü"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, t STRING").repartition(2)
    both = rows.select(embedding(F.col("t")).alias("e"), unpacked(packed_embedding(F.col("t"))).alias("u"))
    assert both.where("e <=> u").count() == len(texts)


def test_a_refresh_keeps_vectors_packed_and_reads_arrays_kept_before(spark, workspace):
    place = workspace.path("layer")

    def refresh(rows):
        refresh_layer(spark.createDataFrame(rows, SCHEMA), place, Workspace(spark, "refresh"), buckets=1)
        return sorted((r["source_file"], r["chunk_text"], r["embedding"]) for r in read_layer(spark, place).collect())

    first = refresh([("a", "one"), ("b", "two words")])
    files = spark.read.parquet(f"{place}/vectors")
    assert dict(files.dtypes)["packed"] == "binary"
    assert files.where("embedding is null and length(packed) = 4 * 384").count() == 2
    # As an earlier version wrote it.
    arrays = workspace.stage(read_layer(spark, place), "arrays")
    arrays.write.mode("overwrite").partitionBy("bucket").parquet(f"{place}/vectors")
    assert refresh([("a", "one"), ("b", "two words")]) == first
    assert refresh([("a", "one"), ("b", "three")])[0] == first[0]
    assert spark.read.parquet(f"{place}/vectors").where("packed is null").count() == 1
