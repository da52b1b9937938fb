"""The stretches of a batch in which a secret may stand."""

from __future__ import annotations

import numpy as np

from twinfold.llm import secrets_crf


def test_all_open_stretches_are_decoded_at_once(monkeypatch):
    draw = np.random.default_rng(3)
    trans = secrets_crf._allowed(draw.normal(size=(4, 3)))
    sizes = np.array([1, 5, 2, 1, 9])
    scores = draw.normal(size=(sizes.sum(), 3))
    ends = np.cumsum(sizes)
    one_by_one = [secrets_crf.viterbi(scores[e - n:e], trans) for e, n in zip(ends, sizes)]
    assert np.array_equal(secrets_crf.viterbi_of_each(scores, sizes, trans), np.concatenate(one_by_one))
    calls = []
    each = secrets_crf.viterbi_of_each
    monkeypatch.setattr(secrets_crf, "viterbi_of_each", lambda *a: calls.append(1) or each(*a))
    scores = np.tile([[0.0, 0.0, 99.0], [0.0, 0.0, 0.0]], (500, 1))
    scores[-1] = 0.0, 0.0, 99.0
    secrets_crf.decode(scores, secrets_crf.SecretModel(np.zeros((1, 3)), np.zeros((4, 3))))
    assert calls == [1]
