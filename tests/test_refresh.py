"""Refreshing the vector layer: equal to a rebuild, at the cost of what changed."""

import os
import uuid

import numpy as np
import pytest

from tidewell.operators.chunk import chunk_documents
from tidewell.operators.embed import HashedWords, embed, embed_distinct
from tidewell.plans.refresh import Refresh, read_layer, refresh_layer

SCHEMA = "source_file STRING, raw_content STRING"


def logging_encoder(folder):
    os.makedirs(folder, exist_ok=True)

    class Logged(HashedWords):
        """Writes down every text it encodes."""

        def encode(self, texts):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as log:
                log.write("".join(text + "\n" for text in texts))
            return super().encode(texts)

    return Logged


def encoded(folder):
    found = []
    for name in os.listdir(folder):
        with open(os.path.join(folder, name)) as log:
            found += log.read().splitlines()
        os.remove(os.path.join(folder, name))
    return sorted(found)


def rows_of(frame):
    return sorted(
        ((r["source_file"], r["chunk_no"], r["chunk_text"], tuple(r["embedding"])) for r in frame.collect()), key=repr
    )


def rebuilt(documents):
    return rows_of(embed(chunk_documents(documents, "source_file", text_col="raw_content"), "chunk_text"))


@pytest.fixture
def refresh(spark, workspace):
    log = workspace.path("log")

    def run(rows, buckets=8):
        documents = spark.createDataFrame(rows, SCHEMA).repartition(3)
        from tidewell.workspace import Workspace

        done = refresh_layer(
            documents, workspace.path("layer"), Workspace(spark, "refresh"), logging_encoder(log), buckets
        )
        assert rows_of(read_layer(spark, workspace.path("layer"))) == rebuilt(documents)
        return done, encoded(log)

    return run


def test_only_changes_are_cut_and_encoded(refresh):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(f"d{i}", f"text {i}") for i in range(40)] + [("long", long)]
    done, texts = refresh(rows)
    assert (done.added, done.changed, done.deleted) == (41, 0, 0)
    assert refresh(rows) == (Refresh(0, 0, 0, 0), [])
    rows = rows[2:] + [("new", "fresh words")]
    rows[0] = ("d2", "other words")
    done, texts = refresh(rows)
    assert (done.added, done.changed, done.deleted) == (1, 1, 2) and done.buckets <= 4
    assert texts == ["fresh words", "other words"]


def test_buckets_without_rows_leave(refresh):
    assert refresh([("a", "x"), ("b", "y")], buckets=64)[0].added == 2
    assert refresh([("a", "x")], buckets=64) == (Refresh(0, 0, 1, 1), [])
    done, texts = refresh([("a", " \n")], buckets=64)  # no chunk left, but the document is known
    assert done.changed == 1 and texts == []
    assert refresh([("a", " \n")], buckets=64)[0] == Refresh(0, 0, 0, 0)
    assert refresh([("a", "z")], buckets=64)[1] == ["z"]


def test_null_and_repeated_names(refresh):
    rows = [(None, "no name"), ("a", "one"), ("a", "two"), ("b", None), ("b", "")]
    done, texts = refresh(rows)
    assert done.added == 3 and texts == ["no name", "one", "two"]
    assert refresh(rows[::-1]) == (Refresh(0, 0, 0, 0), [])
    rows[0], rows[2] = (None, "still none"), ("a", "three")
    done, texts = refresh(rows)
    assert done.changed == 2 and texts == ["one", "still none", "three"]
    assert refresh(rows[1:])[0].deleted == 1


def test_a_refresh_that_failed_is_made_again(spark, refresh, workspace, monkeypatch):
    from tidewell.plans import refresh as module

    refresh([("a", "one"), ("b", "two")])
    write = module._write

    def failing(rows, path, affected):
        if path.endswith("state"):
            raise RuntimeError("lost")
        write(rows, path, affected)

    monkeypatch.setattr(module, "_write", failing)
    with pytest.raises(RuntimeError):
        refresh([("a", "three"), ("c", "four")])
    monkeypatch.setattr(module, "_write", write)
    done, texts = refresh([("a", "three"), ("c", "four")])
    assert (done.added, done.changed, done.deleted) == (1, 1, 1)
    assert refresh([("a", "three"), ("c", "four")])[0] == Refresh(0, 0, 0, 0)


def test_each_distinct_text_is_encoded_once(spark, workspace):
    log = workspace.path("log")
    texts = ["hot"] * 3000 + [f"t{i % 50}" for i in range(500)] + [None, "", "single"]
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = workspace.stage(spark.createDataFrame(rows, "id INT, t STRING").repartition(7), "rows")
    found = embed_distinct(frame, "t", workspace, logging_encoder(log))
    got = {r["id"]: tuple(r["embedding"]) for r in found.collect()}
    assert encoded(log) == sorted({t or "" for t in texts})
    want = HashedWords().encode([t or "" for t in texts])
    assert len(got) == len(rows) and all(np.array_equal(got[i], want[i]) for i in got)
    assert found.columns == ["id", "t", "embedding"]
    plan = found._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan  # the hot text
    assert embed_distinct(frame.where("false"), "t", workspace, HashedWords, "e2").count() == 0
