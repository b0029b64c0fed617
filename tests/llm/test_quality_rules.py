"""Quality rules: counts by plain loops, the exact bound, and what the verdicts guarantee."""

import math
import random
import re
from collections import Counter

import numpy as np

from tidewell.llm import quality_rules as rules
from tidewell.llm.queries import op13_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words, seen, repeated_lines = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated_lines += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    n = len(words)
    failed = n < 50 or 100 * len(marked) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated_lines, len(marked), failed


def test_counts_of_odd_texts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(None, None), (1, ""), (2, " \n\t\x0b "), (3, "a " * 50), (3, "a " * 50), (4, "é ö x\n\nx\n x\nx\r\n")]
    for i in range(200):
        parts = rng.choices(["ab", "Çd", "#", "x|y", "!?", "　", "\x1c"], k=rng.randrange(150))
        rows.append((10 + i, "".join(p + rng.choice(" \n\t\x0c ") for p in parts)))
    rows.append((400, "long " * 300_000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("*", "'en' as lang", "1 as n_words", "2 as kept", "3 as step", "4 as stratum")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [tuple(r)[:8] for r in op13_quality_rules(spark, str(tmp_path)).collect()]
    want = [(i, *expected(t), not expected(t)[-1]) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_binomial_tail_is_exact():
    for n in (1, 7, 60, 400):
        for rate in (0.02, 0.3):
            for k in range(0, n, max(1, n // 9)):
                want = sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))
                assert math.isclose(rules.binomial_tail(k, n, rate), want, rel_tol=1e-9)
    assert rules.binomial_tail(5, 5, 0.1) == 1.0


def test_a_cutoff_needs_evidence():
    # No failure among n shows a rate of 2 % at level 0.05 from n = 149 on.
    assert [rules.certified_steps({}, n, 3, 0.02, 0.05) for n in (0, 148, 149)] == [0, 0, 3]
    # The sequence stops at the first step that fails, whatever comes after.
    assert rules.certified_steps({2: 20, 3: 0}, 400, 3, 0.02, 0.05) == 1


def test_false_rejection_stays_within_the_risk():
    """Over many holdouts, cutoffs whose true rate exceeds the risk are rarely in force."""
    rng = np.random.default_rng(4)
    true_rate = np.array([0.01, 0.025, 0.06])  # of steps 1 to 3, as a whole so far
    wrong = 0
    for _ in range(400):
        drawn = rng.random(600)
        first = np.searchsorted(true_rate, drawn) + 1
        tally = Counter(int(step) for step in first[drawn < true_rate[-1]])
        wrong += rules.certified_steps(tally, 600, 3, 0.02, 0.05) >= 2
    assert wrong <= 0.05 * 400 + 3 * math.sqrt(0.05 * 0.95 * 400)


def test_a_path_takes_the_rule_that_costs_least():
    good = np.arange(1000) < 900
    values = np.zeros((1000, 2))
    values[:, 0] = np.where(good, np.arange(1000) % 50, 1000)  # tells junk without cost
    values[:, 1] = np.arange(1000) % 7  # tells nothing
    assert rules.lay_path(values, good) == [(0, 49.0)]
    assert rules.lay_path(values, np.ones(1000, bool)) == []


def corpus(spark, folder, good, junk):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(good + junk):
        words = [f"w{rng.randrange(10_000)}" for _ in range(80)]
        if i >= good:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en" if i % 4 else None))
        labels.append((i, int(i < good)))
    rows.append((good + junk, " ".join(f"w{i}###" for i in range(80)), "fr"))  # no label there
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return {r["doc_id"]: r for r in op13_quality_rules(spark, str(folder)).collect()}


def test_verdicts_reject_junk_where_labels_suffice(spark, tmp_path):
    found = corpus(spark, tmp_path, 1500, 300)
    assert all(found[i]["kept"] for i in range(1500) if i % 4)
    assert all(not found[i]["kept"] and found[i]["rule"] == "symbols" for i in range(1500, 1800) if i % 4)
    assert found[1800]["kept"] and found[1800]["certified"] == 0 and found[1800]["rule"] is None


def test_too_few_labels_reject_nothing(spark, tmp_path):
    found = corpus(spark, tmp_path, 150, 60)
    assert all(row["kept"] and row["certified"] == 0 for row in found.values())


def test_paths_are_laid_by_every_labelled_document(spark, workspace):
    """More documents a language and class than a sample of a few thousand holds."""
    rng = np.random.default_rng(8)
    good = np.arange(11_000) % 11 < 10
    values = np.round(rng.normal(0, 1, (len(good), len(rules.SIGNS))), 3)
    values[:, 4] = -0.0
    values[~good, :3] += np.round(rng.exponential(1.5, (int((~good).sum()), 3)), 3)
    strata = np.where(np.arange(len(good)) % 5 < 4, "en", "fr")
    rows = [(int(i), str(s), bool(g), v.tolist(), True) for i, (s, g, v) in enumerate(zip(strata, good, values))]
    rows += [(1_000_000 + i, "en", True, [99.0] * len(rules.SIGNS), False) for i in range(50)]
    schema = "doc_id long, stratum string, good boolean, signs array<double>, lays_path boolean"
    labelled = workspace.stage(spark.createDataFrame(rows, schema).repartition(3), "labelled")
    want = {None: rules.lay_path(values, good)}
    for name in ("en", "fr"):
        want[name] = rules.lay_path(values[strata == name], good[strata == name])
    assert len(want[None]) > 10
    assert rules.lay_paths(labelled, workspace) == want
    with_few = spark.createDataFrame([r for r in rows if r[1] == "fr"][:1500], schema)
    want = rules.lay_paths(with_few, workspace)
    assert rules.lay_paths(with_few, workspace, most_cells=0) == want and want["fr"] == want[None]
