"""The language model's bits stand in the running text: contexts, mixer and map against plain Python."""

import math
import random

import numpy as np
import pytest

from gridlore.llm import language_model
from gridlore.llm.language_model import Bits, Tables, Training, spell


def texts(n, seed=5):
    rng = random.Random(seed)
    vocabulary = ["the", "cat", "sat", "on", "mat", "dög", "ran", "a", "x1"]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12))) for _ in range(n)]


def trained(runs, gates=()):
    counts = np.zeros((int(language_model.STARTS[-1]) // 16, 16), np.int32)
    language_model._count(counts, runs, gates)
    tables = Tables(*language_model._chances(*language_model._by_slot(counts)))
    training = Training(tables, gates)
    training.read(runs)
    return tables, training, counts


def test_a_word_costs_less_after_the_word_it_follows():
    """A model of word types gives `b` the same chance wherever it stands."""
    runs = [language_model.running(t) for t in [b"red fox", b"old owl"] * 300]
    tables, training, _ = trained(runs)
    cost = lambda t: spell(tables, training.weights, [language_model.running(t)], training.counts)[0]
    assert cost(b"red fox") > cost(b"red owl") + 1
    assert cost(b"old owl") > cost(b"old fox") + 1


def test_counts_are_those_of_the_slots():
    runs = [language_model.running(t.encode()) for t in texts(40)]
    _, _, counts = trained(runs)
    n, n1 = language_model._by_slot(counts)
    want = np.zeros((2, n.size), np.int64)
    bits = Bits([p for t in runs for p in language_model._pieces(t)], (), True)
    for slots in bits.slots:
        np.add.at(want[0], slots, 1)
        np.add.at(want[1], slots[bits.value > 0], 1)
    assert (n.reshape(-1) == want[0]).all() and (n1.reshape(-1) == want[1]).all()


def test_scores_are_those_of_a_plain_mixer():
    """50 texts, each bit by itself: gate, weighted sum, map, and the mean of both chances."""
    gates = tuple(language_model.word_hash(w) for w in (b"the", b"on"))
    runs = [language_model.running(t.lower().encode()) for t in texts(50)]
    tables, training, _ = trained(runs, gates)
    chance, weights = tables.chance.reshape(-1), training.weights
    got = spell(tables, weights, runs, training.counts, gates)
    for text, score in zip(runs, got):
        bits = Bits(language_model._pieces(text), gates, True)
        slots, value, mixed, refined = bits.slots, bits.value, 0.0, 0.0
        assert len(value) == 8 * (len(text) + 1)
        for i, y in enumerate(value):
            byte, k = bits.data[i // 8], i % 8
            gate = sum((tables.chance[slots[c][i] // 16, 0] >= 2) << g for g, c in enumerate(language_model.GATING))
            x = sum(float(weights[gate][c]) * float(chance[slots[c][i]]) / language_model.SCALE for c in range(len(slots)))
            x = max(-12.0, min(12.0, x))
            low = min(math.floor(x), 11)
            ends = []
            for step in (low, low + 1):
                at = ((256 | int(byte)) >> (8 - k)) * language_model.CLASSES + step + 12
                n, n1 = training.counts[:, at]
                p = (n1 + 8 / (1 + math.exp(-step))) / (n + 8)
                ends.append(math.log(p / (1 - p)))
            z = (x + ends[0] + (ends[1] - ends[0]) * (x - low)) / 2
            sign = -1 if y else 1
            mixed -= math.log1p(math.exp(sign * x))
            refined -= math.log1p(math.exp(sign * z))
        want = np.logaddexp(mixed, refined) - math.log(2)
        assert score == pytest.approx(want / math.log(10), rel=1e-4)


def test_a_gate_word_counts_from_where_it_stands():
    gates = (language_model.word_hash(b"the"),)
    plain, gated = (Bits([b"ab the cd", b"cd"], g) for g in ((), gates))
    differs = (plain.row[len(language_model.BYTES)] != gated.row[len(language_model.BYTES)]).any(1)
    assert differs.tolist() == [False] * 7 + [True] * 3 + [False] * 3


def test_long_texts_go_on_in_pieces(monkeypatch):
    runs = [language_model.running(b"one two three four five six seven " * 20), b""]
    tables, training, _ = trained(runs)
    assert spell(tables, training.weights, runs)[0] < spell(tables, training.weights, runs)[1] < 0
    monkeypatch.setattr(language_model, "PIECE", 64)
    pieces = language_model._pieces(runs[0])
    assert b"".join(pieces) == runs[0] + b" " and max(map(len, pieces)) == 64
    assert math.isfinite(spell(tables, training.weights, runs)[0])
