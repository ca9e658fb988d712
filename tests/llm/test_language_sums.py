"""Language sums: the one table of weighted n-grams gives what the tables by length give."""

import math
import random

import pytest

from gridlore.llm.language import LONGEST, STEP, UNSEEN, Model


def test_an_unseen_word_is_the_mean_over_its_places():
    rng = random.Random(3)
    grams = [{"".join(rng.choice("<abc>") for _ in range(size)): [rng.random(), rng.random()] for _ in range(4 ** size // 2)} for size in range(1, LONGEST + 1)]
    model = Model(["x", "y"], {"known": [0.5, -0.5]}, grams)
    for word in ("a", "abc", "cab" * 5, "zzz", "ab" * 40):
        padded, want = f"<{word}>", [0.0, 0.0]
        for i in range(len(padded)):
            sizes = [s for s in range(LONGEST, 0, -1) if padded[i:i + s] in grams[s - 1]]
            if sizes:
                want = [w + STEP ** (LONGEST - sizes[0]) * v for w, v in zip(want, grams[sizes[0] - 1][padded[i:i + sizes[0]]])]
        assert model.of(word) == pytest.approx([UNSEEN * w / len(padded) for w in want])
        assert len(model.weighted) >= max(map(len, grams))
    total = [3 * 0.5 + 2 * model.of("abc")[0], 3 * -0.5 + 2 * model.of("abc")[1]]
    name, score = model.predict("known abc known ABC known")
    assert name == "xy"[total.index(max(total))]
    assert score == pytest.approx(1 / (1 + math.exp(min(total) - max(total))))
