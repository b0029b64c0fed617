"""Planted keys outside the base patterns, and runs of words that are no secrets."""

import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import secrets
from tidewell.llm.secrets import fit_thresholds, scan_secrets

BASE62 = string.ascii_letters + string.digits
SYLLABLES = "the reed th and er on who re tion al ing ous ment ver con pro est ly ra ne lo si".split()


def key(rng, n, symbols=BASE62):
    return "".join(rng.choice(symbols) for _ in range(n))


def prose(rng, n):
    words = ("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))
    return " ".join(w if rng.random() < 0.95 else str(rng.randint(1, 2024)) for w in words)


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = scan_secrets(docs, fit_thresholds(docs)).where(F.size("spans") > 0).collect()
    return {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] for r in rows}


def test_one_key_of_a_rare_length(spark):
    rng = random.Random(3)
    long = key(rng, 200)
    found = scanned(spark, [prose(rng, 300) for _ in range(40)] + [f"x {long} y"])
    assert found == {40: [long]}


def test_padding_does_not_change_the_class(spark):
    rng = random.Random(5)
    keys = [key(rng, 127) + "=" for _ in range(3)]
    found = scanned(spark, [prose(rng, 300) for _ in range(40)] + keys)
    assert found == {40 + i: [k] for i, k in enumerate(keys)}


@pytest.mark.parametrize("n", [20, 24, 32, 40])
def test_planted_keys_of_ordinary_length(spark, n):
    rng = random.Random(n)
    texts = [prose(rng, 300) for _ in range(40)]
    keys = {len(texts) + i: key(rng, n) for i in range(20)}
    names = []
    for i in range(20):
        words = [w for w in prose(rng, 12).split() if w.isalpha()]
        names.append(("".join(w.title() for w in words) + str(i), "/".join(words) + "/v2", "_".join(words) + "_1")[i % 3])
    texts += [f"see {k} there" for k in keys.values()] + [f"in {name} is" for name in names]
    found = scanned(spark, texts)
    assert len(found.keys() & keys.keys()) >= (16 if n < 32 else 19)
    assert all(found[i] == [keys[i]] for i in found.keys() & keys.keys())
    assert len(found.keys() - keys.keys()) <= 2


def test_keys_in_runs_of_no_alphabet(spark):
    rng = random.Random(11)
    keys = [key(rng, n) for n in (24, 32, 40) for _ in range(8)]
    shapes = ["AUTH={}", "sig={}&x", "/v1/ab_{}", "client_key={}", "key-{}/a+b"]
    texts = [prose(rng, 300) for _ in range(40)]
    texts += ["go " + shapes[i % len(shapes)].format(k) + " on" for i, k in enumerate(keys)]
    found = scanned(spark, texts)
    held = [any(k in span for span in found.get(40 + i, [])) for i, k in enumerate(keys)]
    assert sum(held) >= 22
    assert all(i >= 40 for i in found)


def test_controls_come_from_whole_texts(spark):
    """All prose lies behind the first 8,192 characters of the only long document."""
    rng = random.Random(17)
    long = key(rng, 48)
    found = scanned(spark, [" " * 9_000 + prose(rng, 12_000), f"x {long} y"])
    assert found == {1: [long]}


def test_controls_come_from_every_document(spark):
    """Counts are those of all words, however the documents are dealt; large ones scaled, none lost."""
    rng = random.Random(19)
    texts = [prose(rng, 50) + f" only{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} " for i in range(5000)]
    docs = spark.createDataFrame([(i, t + key(rng, 24)) for i, t in enumerate(texts)], "doc_id long, text string")
    want = Counter(word for text in texts for word in re.findall("[A-Za-z]+|[0-9]+", text))
    for parts in (1, 7):
        counts = secrets.word_counts(docs.repartition(parts))
        assert {r["word"]: r["n"] for r in counts.collect()} == want
    for most in (1 << 18, 1 << 10):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(secrets, "PROSE_WORDS", most)
            groups, n = secrets.word_groups(counts.cache())
            rows = groups.collect()
        assert len(rows) == n and max(len(r["words"]) for r in rows) < 1.1 * secrets.GROUP_WORDS
        dealt = Counter(word for r in rows for word in r["words"])
        assert dealt.keys() == want.keys()
        assert most < 1 << 18 or dealt == want


@pytest.mark.parametrize("common", [0, 1, 40])
def test_large_prose_is_dealt_whole(spark, common):
    """More words than are dealt one by one: each as often as it is counted, in groups of like size."""
    rng = random.Random(23)
    want = {f"rare{i}": rng.randint(1, 40) for i in range(0 if common == 1 else 5000)}
    want |= {f"common{i}": 300_000 // common + i for i in range(common)}
    want |= {f"more{i}": 400 for i in range(0 if common else 1000)}
    assert sum(want.values()) > max(secrets.PROSE_WORDS, 2 * len(want))
    counts = spark.createDataFrame(list(want.items()), "word string, n long")
    groups, n = secrets.word_groups(counts)
    rows = groups.collect()
    assert {r["group"] for r in rows} == set(range(n)) and len(rows) == n
    assert max(len(r["words"]) for r in rows) < 1.1 * secrets.GROUP_WORDS
    assert Counter(word for r in rows for word in r["words"]) == want
    if common == 40:
        # Words come mixed: no tenth of a group is of one word.
        for words in (r["words"] for r in rows):
            tenth = Counter(words[: len(words) // 10])
            assert max(tenth.values()) < 0.1 * tenth.total()


def test_windows_are_tested_as_their_rows_are():
    rng = random.Random(29)
    for alphabet in secrets.EVERY:
        text = "".join(rng.choice(alphabet[: rng.choice((1, 3, 99))]) for _ in range(70_000))
        windows = secrets.Windows(text, alphabet)
        for n in (20, 33, 640):
            at = np.array([0, *rng.sample(range(len(text) - n), 200), len(text) - n])
            rows = [r for r in (text[a : a + n] for a in at) if not (r.isalpha() or r.isdigit())]
            want = [secrets.randomness(secrets.coded(r, alphabet)[None], alphabet)[0] for r in rows]
            np.testing.assert_allclose(windows.randomness(at, n), want, rtol=1e-9, atol=1e-300)


def test_the_pipelines_stage_learns_from_all_words(spark, monkeypatch):
    """The controls of its secrets stage hold the words of a large corpus as often as they stand."""
    rng = random.Random(31)
    text, secret = prose(rng, 10_000), key(rng, 48)
    docs = spark.createDataFrame([(i, text) for i in range(60)] + [(60, f"x {secret} y")], "doc_id long, text string")
    known, count = [], secrets.control_counts
    monkeypatch.setattr(secrets, "control_counts", lambda *given: known.extend(count(*given)) or known)
    clean = corpus_pipeline.redact_secrets(spark, docs, "").collect()
    assert {r["doc_id"]: r["text"] for r in clean} == dict.fromkeys(range(60), text) | {60: "x [SECRET] y"}
    (size,) = {size for size, _, _ in known}
    symbols = sum(n for _, _, n in known) * secrets.LEAST_LENGTHS[size // len(secrets.EVERY)]
    assert symbols > 0.95 * 60 * sum(c.isalpha() for c in text)
