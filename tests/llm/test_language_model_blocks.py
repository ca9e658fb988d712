"""Texts are hashed and looked up many at a time; what is learned and scored doesn't depend on how many."""

import random

import numpy as np

from gridlore.llm import language_model
from gridlore.llm.language_model import Bits, Tables, Training, spell

GATES = (language_model.word_hash(b"the"),)


def runs(n):
    rng = random.Random(7)
    vocabulary = [b"the", b"cat", b"sat", b"on", "dög".encode(), b"a", b"extraordinarily", b"x1"]
    return [language_model.running(b" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 400)))) for _ in range(n)]


def learned(texts):
    counts = np.zeros((int(language_model.STARTS[-1]) // 16, 16), np.int32)
    language_model._count(counts, texts, GATES)
    tables = Tables(*language_model._chances(*language_model._by_slot(counts)))
    training = Training(tables, GATES)
    training.read(texts)
    return counts, training, spell(tables, training.weights, texts, training.counts, GATES)


def test_blocks_change_no_result(monkeypatch):
    texts = runs(60)
    counts, training, scores = learned(texts)
    for together, window in ((1, 100), (10_000, 333), (1_000_000, 1_000_000)):
        monkeypatch.setattr(language_model, "TOGETHER", together)
        monkeypatch.setattr(language_model, "WINDOW", window)
        other = learned(texts)
        assert (other[0] == counts).all() and other[1].steps == training.steps
        assert np.allclose(other[1].weights, training.weights, rtol=1e-5) and (other[1].counts == training.counts).all()
        assert np.allclose(other[2], scores, rtol=1e-6)


def test_texts_side_by_side_have_the_slots_of_each_alone():
    texts, room = [t + b" " for t in [b"the cat ", b"", b"a the", *runs(5)]], language_model.Room()
    both = Bits(texts, GATES, True, room).slots.copy()
    assert (both == np.concatenate([Bits([t], GATES, True, room).slots for t in texts], 1)).all()
