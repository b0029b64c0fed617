"""Collocations against counts of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewell.llm import collocations as col
from tidewell.llm.collocations import collocations
from tidewell.llm.queries import op11_collocations

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least, keep=2000):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= least}
    covered = {
        (lang, p[i : i + k])
        for (lang, p), a in found.items()
        for k in range(2, len(p))
        for i in range(len(p) - k + 1)
        if a >= count[lang, p[i : i + k]]
    }
    ranked = defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in covered:
            cuts = [(count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p))]
            score, k = min((1000 * a * total[lang] // (l * r), k) for k, (l, r) in enumerate(cuts))
            ranked[lang].append((-score, -a, " ".join(p).encode(), *cuts[k]))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, total[lang], -score)
        for lang, items in ranked.items()
        for rank, (score, a, p, l, r) in enumerate(sorted(items)[:keep], 1)
    )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    rows = [("en", None), ("en", ""), ("x", " . ,"), (None, "\x0b" * 9)]
    for _ in range(400):
        words = rng.choices(["a", "B", "c", "é", "dd", "\x00", "E f"], k=rng.randrange(60))
        text = "".join(w + rng.choice([" ", "\t ", ". ", "\n", " "]) for w in words)
        rows.append((rng.choice(["en", None, "fr", "und"]), text))
    return rows + [("en", "the same passage in many rows again")] * 300 + [("fr", "one two " * 3000)]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    return docs.selectExpr("*", "1 as n", "'x' as phrase", "2 as words", "3 as route")


def got(*args):
    return sorted(tuple(r) for r in collocations(*args).collect())


def test_all_phrases(spark, rows):
    assert got(frame(spark, rows), 20) == expected(rows, 20)


def test_heavy_prefixes_small_blocks_and_many_partitions(spark, rows, monkeypatch):
    monkeypatch.setattr(col, "HEAVY", 30)
    monkeypatch.setattr(col, "PARTITION_BYTES", 1000)
    monkeypatch.setattr(col.blocks, "__defaults__", (200,))
    docs = frame(spark, rows)
    assert got(docs, 20) == expected(rows, 20)
    assert got(docs, 3, 50) == expected(rows, 3, 50)


def test_a_full_sieve_prunes_nothing_and_loses_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(col, "SLOTS", 32)
    assert got(frame(spark, rows), 20) == expected(rows, 20)



def test_quicksort_abandons_rare_partitions():
    rng = np.random.default_rng(1)
    keys = [np.zeros(2000, np.int64), *rng.integers(1, 6, (5, 2000))]
    weight = rng.integers(1, 4, 2000)
    found = {}
    for at, words, n in col.frequent_prefixes(keys, weight, np.full(2000, 2), 50):
        key = tuple(int(keys[i + 1][at]) for i in range(words))
        assert key not in found
        found[key] = n
    want = Counter()
    for row in range(2000):
        for words in range(2, 6):
            want[tuple(int(keys[i + 1][row]) for i in range(words))] += int(weight[row])
    assert found == {key: n for key, n in want.items() if n >= 50}


def test_registered_query_on_repeated_rows(spark, tmp_path):
    rows = [("en", "Of the reed and of the thand, of the")] * 60 + [(None, "x y")] * 100
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(tuple(r) for r in op11_collocations(spark, str(tmp_path)).collect())
    assert found == expected(rows, 100)
    assert ("und", 1, "x y", 100, 100, 100, 200, 2000) in found


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts as of a corpus of 4e12 words, given in place of counted ones."""
    counts = [
        ("en", None, 0, 4_000_000_000_000), ("en", "p", 1, 5_000_000_000),
        ("en", "q", 1, 7_000_000_001), ("en", "p q", 2, 3_000_000_000),
    ]
    frame = spark.createDataFrame(counts, "lang string, phrase string, words int, n long")
    monkeypatch.setattr(col, "phrase_counts", lambda *_: frame)
    row = collocations(frame).first()
    assert 1000 * row["a"] * row["n"] > 1 << 63 and row["l"] * row["r"] > 1 << 64
    assert row["score"] == 1000 * row["a"] * row["n"] // (row["l"] * row["r"])
