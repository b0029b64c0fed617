"""Periodic runs against a plain loop over all lags."""

import hashlib
import random
import zlib

import pytest

from tidewell.llm import periodic_runs as runs
from tidewell.llm.queries import op12_periodic_runs


def expected(words, shortest=12):
    found = []
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            stretch = words[at : end + q]
            if end > at and len(stretch) >= max(shortest, 2 * q):
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((at, len(stretch), q))
            at = end + 1
    return sorted(found)


def some_words(rng):
    if rng.random() < 0.1:  # Fibonacci words are full of runs
        one, two = [0], [0, 1]
        while len(two) < rng.randrange(5, 250):
            one, two = two, two + one
        return two[:250]
    words = [rng.randrange(rng.choice([1, 2, 3, 20, 60])) for _ in range(rng.choice([0, 3, 12, 40, 200]))]
    for _ in range(rng.randrange(3)):
        root = [rng.randrange(100) for _ in range(rng.randrange(1, 70))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = (root * 6)[: rng.randrange(1, 4 * len(root) + 20)]
    return words


@pytest.mark.parametrize("rounds", [0, 1, 64])
def test_runs_are_those_of_all_lags(monkeypatch, rounds):
    monkeypatch.setattr(runs, "ROUNDS", rounds)
    rng = random.Random(rounds)
    for _ in range(60):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 8))]
        got = runs.find_runs([" ".join(map(str, words)).encode() for words in texts])
        assert [(n, found) for n, found, _ in got] == [(len(w), expected(w)) for w in texts]


def test_long_texts_are_no_square_work():
    for words in ([1] * 300_000, list(range(100_000)) * 2):
        n, found, collapsed = runs.find_runs([" ".join(map(str, words)).encode()])[0]
        assert found == [(0, n, len(set(words)))] and len(collapsed.split()) == len(set(words))


def test_collapsing_keeps_the_first_period():
    text = b" x a b c a b c\ta b c a b c\n a y"
    assert runs.find_runs([text, b"", b" \n"]) == [
        (15, [(1, 13, 3)], b"x a b c y"), (0, [], b""), (0, [], b""),
    ]


def planted(key, words):
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{w}" for w in some_words(rng))) for i in range(80)]
    rows += [(None, "a b " * 20), (3, None), (4, ""), (10, " \x0b\x0c "), (10, "q " * 40), (10, "q " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as found", "2 as runs")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for key, text in rows:
        words = (text or "").encode().split()
        words = words if key is None else planted(key, words)
        found = expected(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in found), default=None)
        longest = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        digests = (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        want.append((key, len(found), *longest, *digests))
    got = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
