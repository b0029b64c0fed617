import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewell.functions.text import clean_text, preview, prompt

CLEANED = [
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("<p>Hello</p>  World", "hello world"),
    ("a<br>b", "ab"),
    ("A B", "a b"),
    ("A\x1cB", "a b"),
    ("A\x0bB", "a b"),
    ("<<a>b>", "b>"),
    ("<>", "<>"),
    ("x < y and z > w", "x w"),
    ("5 < 6", "5 < 6"),
]


def cleaned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    found = rows.select("i", clean_text(F.col("t")).alias("c")).collect()
    return [c for _, c in sorted(map(tuple, found))]


def test_clean_fixtures(spark):
    assert cleaned(spark, [t for t, _ in CLEANED]) == [c for _, c in CLEANED]


def test_clean_matches_its_rule_and_is_idempotent(spark):
    alphabet = "<>ab Z/\t\n\r\x0b\x0c\x1c\x1f\x85   　İßΣ"
    texts = []

    @settings(max_examples=300, database=None)
    @given(st.text(alphabet=alphabet, max_size=30))
    def gather(text):
        texts.append(text)

    gather()
    once = cleaned(spark, texts)
    assert once == [re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", t)).strip().lower() for t in texts]
    assert cleaned(spark, once) == once


def test_preview_and_prompt(spark):
    row = spark.createDataFrame([("f.txt", "x" * 150, "why?")], "s STRING, t STRING, q STRING")
    shown, asked, bare = row.select(
        preview(F.col("s"), F.col("t")),
        prompt(F.col("t"), F.col("q")),
        prompt(F.lit(None).cast("string"), F.col("q")),
    ).first()
    assert shown == "Found in f.txt: " + "x" * 100 + "..."
    lines = asked.split("\n")
    assert lines[1:] == ["", "Context:", "x" * 150, "", "Question:", "why?", "", "Answer:"]
    assert lines[0].endswith('say "I don\'t know".')
    assert bare.split("\n")[2:4] == ["Context:", ""]
