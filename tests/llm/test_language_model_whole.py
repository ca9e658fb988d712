"""What the language model learns from all texts and all word types."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridlore.llm import language_model


def test_gate_words_count_every_copy(spark):
    """Texts with many copies each: a hash sample has all copies of a text or none."""
    texts = [f"w{k} w{k} v{k}" for k in range(8)]
    docs = spark.range(48_000).select(F.array(*map(F.lit, texts))[F.floor(F.sqrt(F.col("id") / 750)).cast("int")].alias("text"))
    counts = Counter()
    for i in range(48_000):
        counts.update(texts[int((i / 750) ** 0.5)].split())
    want = sorted(counts, key=lambda w: (-counts[w], w))[:language_model.GATES]
    assert language_model._gate_words(docs) == want


def test_mixer_reads_every_type(spark, monkeypatch):
    words = [f"{'ab' * (k % 3)}{k}" for k in range(400)]
    tables = np.zeros((2, int(language_model.STARTS[-1])), np.float32)
    types = spark.createDataFrame([(w,) for w in words], "word string").repartition(8)
    alone = language_model.train_mixer(tables, sorted(w.encode() for w in words))
    assert np.allclose(language_model._mixer(types, tables, len(words)), alone)
    monkeypatch.setattr(language_model, "MIX_TYPES", 100)
    parts = [[r["word"].encode() for r in part] for part in types.coalesce(4).rdd.glom().collect()]
    assert sum(map(len, parts)) == 400
    want = sum(len(p) * language_model.train_mixer(tables, sorted(p)) for p in parts if p) / 400
    assert np.allclose(language_model._mixer(types, tables, len(words)), want)
    assert language_model._mixer(types.limit(0), tables, 0).shape == alone.shape
