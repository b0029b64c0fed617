"""Voters, and a label model that is fitted to voters of known accuracy and dependence."""

import numpy as np
import pyarrow as pa

from tidewell.llm.common import text_bytes
from tidewell.llm.toxicity import Linear, fit_label_model, pattern_votes, train_toxicity


def test_patterns():
    insults = {"glurk", "über"}
    texts = [
        "you are such a GLURK.", "your long and winding story of a glurk", "a glurk you", "glurk",
        "What?! no", "one! two?", "he said STOP now", "STO", "noooo way", "nooo", "gl0rk", "B2B", "a 100$ bill", "",
    ]
    found = pattern_votes(texts, insults)
    assert found[:, 0].tolist() == [1] + [0] * 13
    assert np.flatnonzero(found[:, 1]).tolist() == [4]
    assert np.flatnonzero(found[:, 2]).tolist() == [0, 6]
    assert np.flatnonzero(found[:, 3]).tolist() == [8]
    assert np.flatnonzero(found[:, 4]).tolist() == [10, 11]
    assert not pattern_votes(texts, set())[:, 0].any()


def voters(rng, y, rates):
    """Answers that are right at the given rates and silent otherwise or wrong."""
    answers = []
    for right, silent in rates:
        draw = rng.random(len(y))
        truth = np.where(y == 1, 1, -1)
        answers.append(np.where(draw < right, truth, np.where(draw < right + silent, 0, -truth)))
    return np.stack(answers, axis=1).astype(np.int8)


def test_rates_of_independent_voters_are_found():
    rng = np.random.default_rng(1)
    y = (rng.random(6000) < 0.3).astype(int)
    rates = [(0.8, 0.1), (0.7, 0.2), (0.6, 0.3), (0.75, 0.0), (0.65, 0.2), (0.5, 0.45)]
    model = fit_label_model(voters(rng, y, rates))
    assert abs(model.share[1] - 0.3) < 0.05
    for i, (right, _) in enumerate(rates):
        assert abs(model.rates[1, i, 2] - right) < 0.06 and abs(model.rates[0, i, 0] - right) < 0.06
    assert ((model.posterior(voters(rng, y, rates)) >= 0.5) == y).mean() > 0.85


def test_copies_of_a_voter_do_not_outvote_the_others():
    rng = np.random.default_rng(2)
    y = (rng.random(6000) < 0.4).astype(int)
    good = voters(rng, y, [(0.8, 0.0)] * 5)
    poor = voters(rng, y, [(0.6, 0.0)])
    answers = np.concatenate([good, np.repeat(poor, 3, axis=1)], axis=1)
    model = fit_label_model(answers)
    assert (model.own[5:] < 0.6 * model.own[:5].min()).all()
    assert ((model.posterior(answers) >= 0.5) == y).mean() > 0.88


def test_labels_of_one_class_give_their_share():
    def score(model: Linear):
        return model.score(*text_bytes(pa.array(["a b", ""], pa.large_string())))

    assert np.allclose(score(train_toxicity(["x"], np.array([1.0]), [])), 1)
    assert np.allclose(score(train_toxicity(["x"], np.array([0.0]), [])), 0)
    assert np.allclose(score(train_toxicity([], np.zeros(0), [])), 0.5)
    assert np.allclose(score(train_toxicity(["x"] * 3, np.ones(3), [], share=0.25)), 0.25)
