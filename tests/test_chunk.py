import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewell.operators.chunk import _intervals, chunk_documents, chunks, split_text

WORDS = " ".join(f"w{i:03d}" for i in range(200))

LENGTHS = [
    ("", []),
    (" ".join(["abcd"] * 100), [499]),
    (" ".join(["abcd"] * 101), [499, 54]),
    (WORDS, [499, 499, 99]),
    (" ".join(["z" * 60] * 9), [487, 60]),
    (" ".join(["z" * 60] * 10), [487, 121]),
    ("y" * 500, [500]),
    ("x" * 501, [500, 51]),
    ("x" * 1200, [500, 500, 300]),
    ("aa " + "y" * 600 + " bb", [2, 499, 151, 2]),
]


@pytest.mark.parametrize("text,lengths", LENGTHS)
def test_fixture_lengths(text, lengths):
    assert [len(c) for c in split_text(text)] == lengths


def test_chunks_start_with_the_overlap():
    assert [c[:4] for c in split_text(WORDS)] == ["w000", "w090", "w180"]


def stated_rules(text, size, overlap):
    """The packing rules word by word, kept as lists of pieces."""
    pieces, piece = [], ""
    for char in text:
        if char == " " and piece:
            pieces.append(piece)
            piece = ""
        piece += char
    if piece:
        pieces.append(piece)

    def packed(run):
        found, held = [], []
        for item in run:
            if sum(map(len, held)) + len(item) > size:
                if held:
                    found.append("".join(held))
                while held and (
                    sum(map(len, held)) > overlap or sum(map(len, held)) + len(item) > size
                ):
                    held.pop(0)
            held.append(item)
        return found + (["".join(held)] if held else [])

    found, run = [], []
    for item in pieces:
        if len(item) < size:
            run.append(item)
            continue
        found += packed(run) + packed(list(item))
        run = []
    found += packed(run)
    return [c.strip(" ") for c in found if c.strip(" ")]


words = st.lists(st.text(alphabet="abcdé", min_size=1, max_size=30), max_size=60).map(" ".join)


@settings(max_examples=600, deadline=None, database=None)
@given(words, st.integers(4, 40), st.integers(0, 39))
def test_same_as_the_stated_rules(text, size, overlap):
    overlap = min(overlap, size - 1)
    assert split_text(text, size, overlap) == stated_rules(text, size, overlap)


def covered_by_intervals(text):
    at = 0
    for lo, hi in _intervals(text, 50, 10):
        assert lo < hi and hi - lo <= 50 and not text[at:lo].strip(" ")
        assert at - lo <= 10
        at = hi
    assert not text[at:].strip(" ")


@settings(max_examples=200, deadline=None, database=None)
@given(words)
def test_chunks_are_short_and_cover_every_word(text):
    covered_by_intervals(text)
    assert all(0 < len(c) <= 50 for c in split_text(text, 50, 10))


def test_equal_stretches_are_told_apart():
    covered_by_intervals("a a a a a a a aaa aaaa a aaaaaaa aaaaaaaaaaaaaaaaaa aaaaaaaaaaaaaaaaaaa a")


def test_column_drops_empty_documents(spark):
    rows = spark.createDataFrame(
        [(1, "<p></p>"), (2, None), (3, "One  Two"), (4, "word " * 300)], "id INT, t STRING"
    )
    found = chunk_documents(rows, "id", text_col="t").orderBy("id", "chunk_no").collect()
    assert [r.id for r in found] == [3] + [4] * 4
    assert found[0].chunk_text == "one two"
    assert [r.chunk_no for r in found[1:]] == [0, 1, 2, 3]
    assert rows.select(chunks(F.col("t"))).count() == 4


def test_overlap_must_be_smaller_than_the_chunk():
    with pytest.raises(ValueError):
        chunks("t", 10, 10)


def test_long_batches_are_cut_in_parts(spark, monkeypatch):
    """Parts of a batch are given back one by one; every document keeps its own chunks."""
    from tidewell.operators import chunk as module

    yielded = []
    monkeypatch.setattr(module.F, "arrow_udf", lambda run, kind: lambda text: run)
    run = module.chunks(None)
    texts = [f"w{i} " * 200 for i in range(5_000)]
    for part in run(iter([pa.array(t[:-1] for t in texts), pa.array([], pa.string())])):
        assert sum(len(c) for row in part.to_pylist() for c in row) < 1.5 * module.HELD_CHARS
        yielded += part.to_pylist()
    assert yielded == [module.split_text(t[:-1]) for t in texts]
