"""Counts of the language model's tables as they are shuffled."""

import numpy as np

from gridlore.llm import language_model


def test_counts_come_back_and_take_a_byte_each_where_small():
    rng = np.random.default_rng(1)
    for most in (1, 255, 256, 70_000, 2**31 - 1):
        counts = rng.integers(0, most, language_model.BLOCK, dtype=np.int32)
        counts[7] = most
        cell = language_model.packed(counts)
        assert len(cell) == language_model.BLOCK * -(-most.bit_length() // 8)
        assert (language_model.unpacked(cell) == counts).all()
