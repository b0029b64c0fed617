"""Suffix dedup of many texts under one id, against brute force."""

import random
from collections import Counter

from tidewell.llm.suffix_dedup import DEPTH, remove_repeats


def expected(texts):
    counts = Counter(t[i : i + DEPTH] for t in texts for i in range(len(t) - DEPTH + 1))
    rows = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - DEPTH + 1):
            if counts[t[i : i + DEPTH]] > 1:
                gone[i : i + DEPTH] = b"\1" * DEPTH
        kept = bytes(c for c, g in zip(t, gone) if not g)
        rows.append((len(t), sum(gone), kept))
    return sorted(rows)


def test_many_texts_of_a_null_and_of_a_repeated_id(spark):
    rng = random.Random(7)

    def some(n):
        return "".join(rng.choices("abcdefgh ", k=n))

    shared = [some(rng.randint(210, 260)) for _ in range(40)]
    rows = []
    for i in range(3000):
        text = some(rng.randint(1, 120)) + (rng.choice(shared) if i % 2 else "") + some(rng.randint(1, 120))
        rows.append((None if i % 3 else 7, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in remove_repeats(docs).collect()]
    assert sorted(got) == expected([t.encode() for _, t in rows])
