"""The language model's network is no smaller than it was first written: the state, the topics and the
n-grams, with outputs and inputs for single words besides those for classes."""

import numpy as np

from sluice.llm import lm


def test_the_network_has_its_sizes():
    v = lm.vocabulary(np.arange(lm.OWN_WORDS, dtype=np.uint64), np.arange(lm.OWN_WORDS) % lm.SPELLINGS, np.arange(lm.OWN_WORDS) + 1)
    w = lm.start_weights(v)
    assert (lm.TOPICS, lm.LOW) == (8, 1) and lm.HIDDEN >= 20 and v.classes >= 33
    assert w["e"].shape == (lm.OWN_WORDS + 33, 2 * lm.HIDDEN) and w["u"].shape == (lm.OWN_WORDS, lm.HIDDEN) and w["v"].shape == (lm.HIDDEN, v.classes)
