import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators.embed import HashedWords, embed
from tidewell.sinks.tables import index_stats


def test_buckets():
    assert HashedWords().bucket("hello") == 42
    assert HashedWords().bucket("spark") == 122


def test_vectors_count_words_and_have_unit_length():
    vectors = HashedWords().encode(["hello spark hello", "", "a  b"])
    assert vectors.shape == (3, 384) and vectors.dtype == np.float32
    assert vectors[0, 42] == np.float32(2 / np.sqrt(5)) and vectors[0, 122] == np.float32(1 / np.sqrt(5))
    assert not vectors[1].any()
    assert np.count_nonzero(vectors[2]) == 2


def test_any_encoder_fits(spark):
    class Lengths:
        def encode(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([("ab",), ("abcd",), (None,)], "t STRING")
    found = embed(rows, "t", Lengths)
    assert found.schema["embedding"].dataType.simpleString() == "array<float>"
    assert sorted(r.embedding for r in found.collect()) == [[0, 1], [2, 1], [4, 1]]


def test_a_model_is_made_once_per_worker(spark, workspace):
    log = workspace.path("loads")

    class Slow:
        def __init__(self):
            os.makedirs(log, exist_ok=True)
            open(os.path.join(log, uuid.uuid4().hex), "w").close()

        def encode(self, texts):
            return np.ones((len(texts), 1))

    rows = spark.range(400, numPartitions=40).select(F.col("id").cast("string").alias("t"))
    assert embed(rows, "t", Slow).where("embedding[0] = 1").count() == 400
    loads = len(os.listdir(log))
    assert 1 <= loads < 40
    # A later call with the same maker finds the models of before in the workers.
    for _ in range(3):
        assert embed(rows, "t", Slow).where("embedding[0] = 1").count() == 400
    assert len(os.listdir(log)) <= max(loads, 4)


def test_index_stats(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "embedding ARRAY<FLOAT>")
    assert tuple(index_stats(rows).first()) == (2, 2)
    assert tuple(index_stats(rows.where("false")).first())[0] == 0
    ragged = rows.unionByName(rows.select(F.array(F.lit(1.0).cast("float")).alias("embedding")))
    with pytest.raises(Exception, match="unequal dimension"):
        index_stats(ragged).collect()


def test_vectors_are_made_in_bounded_parts(spark):
    """However many texts a batch has, so few are encoded at once; order and copies stay."""
    from tidewell.operators import embed as module

    texts = [f"w{i} w{i % 7}  x{'' if i % 3 else ' w'}" for i in range(9_000)]
    counted = HashedWords().encode(texts)
    for i in (0, 255, 256, 4095, 4096, 8_999):
        want = np.zeros(384)
        for word in texts[i].split():
            want[HashedWords().bucket(word)] += 1
        assert np.array_equal(counted[i], (want / np.sqrt((want * want).sum())).astype(np.float32))

    class Few(HashedWords):
        def encode(self, texts):
            assert len(texts) <= 4096
            return super().encode(texts)

    for rows in (texts, texts + texts[:50]):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string").coalesce(1)
        found = {r["id"]: r["embedding"] for r in module.embed(docs, "text", Few).collect()}
        assert all(np.array_equal(np.float32(found[i]), counted[i % 9_000]) for i in range(len(rows)))
