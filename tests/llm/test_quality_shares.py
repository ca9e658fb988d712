"""Scores on both sides of PER_LABEL."""

import random

import pytest

from gridlore.llm import quality


def test_a_cut_label_keeps_its_share(spark, monkeypatch):
    """Six good to one bad; half of each look the same, so their score is the share of good among them."""
    rng = random.Random(11)
    rows, unclear = [], []
    for i in range(2100):
        good, ws = i % 7 != 0, ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
        if rng.random() < 0.5:
            unclear.append(i)
            ws = [w + "," for w in ws]
        elif not good:
            ws = [w.upper() + "!!" for w in ws]
        rows.append((i, " ".join(ws), int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")

    def mean():
        got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, quality.learn(docs)).collect()}
        return sum(got[i] for i in unclear) / len(unclear)

    monkeypatch.setattr(quality, "PER_LABEL", 3_000)
    every = mean()
    monkeypatch.setattr(quality, "PER_LABEL", 300)
    cut = mean()
    print("unclear documents:", every, cut)
    assert every == pytest.approx(6 / 7, abs=0.05)
    assert cut == pytest.approx(every, abs=0.05)
