"""The network's scores at the labels' true shares."""

import numpy as np

from tidewell.llm.quality import train_network


def test_bias_is_moved_to_the_true_share():
    texts = [w * 20 for w in ("good words ", "junk ### ") for _ in range(20)]
    labels = np.repeat([1.0, 0.0], 20)
    even, most = (train_network(texts, labels, epochs=1, true_share=s) for s in (0.5, 6 / 7))
    assert np.isclose(most.out_bias - even.out_bias, np.log(6))
    sample = train_network(texts[:25], labels[:25], epochs=1)
    assert np.isclose(sample.out_bias, train_network(texts[:25], labels[:25], epochs=1, true_share=0.8).out_bias)
