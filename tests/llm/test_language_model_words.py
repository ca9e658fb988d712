"""Words are cut, counted, hashed and looked up many at a time in tasks: the results against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.llm import language_model
from gridlore.llm.language_model import Room, word_hash, word_hashes


def rows(n, seed=3):
    rng = random.Random(seed)
    signs = ["A", "b", "Z", "ä", "İ", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", "word "]
    return [(rng.choice([None, "", "".join(rng.choice(signs) for _ in range(rng.randrange(0, 40)))]), rng.random() < 0.3) for _ in range(n)]


def plain(text):
    return (text or "").encode().lower().split()


def test_running_texts_are_words_and_blanks():
    for text, _ in rows(500):
        assert language_model.running((text or "").encode()) == b"".join(w + b" " for w in plain(text))


def test_vocabulary_counts_words_of_training_texts_and_keeps_the_others(spark, monkeypatch):
    monkeypatch.setattr(language_model, "COUNTED", 100)
    docs, want = rows(300), Counter()
    for text, out in docs:
        for w in plain(text):
            want[w] += not out
    texts = spark.createDataFrame(docs, "text string, out boolean").select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), "out")
    found = language_model._vocabulary(texts.repartition(3)).collect()
    assert {bytes(r["word"]): r["c"] for r in found} == dict(want) and len(found) == len(want)
    assert all(np.uint64(r["h"] % (1 << 64)) == word_hash(bytes(r["word"])) for r in found)


def test_hashes_do_not_depend_on_what_stands_around(monkeypatch):
    runs = [language_model.running((text or "").encode()) for text, _ in rows(200)] + [b"x" * 300 + b" a "]
    want = [word_hash(w) for r in runs for w in r.split()]
    for piece, together in ((64, 1), (64, 500), (65_536, 65_536)):
        monkeypatch.setattr(language_model, "PIECE", piece)
        monkeypatch.setattr(language_model, "TOGETHER", together)
        assert word_hashes(runs, Room()).tolist() == want


@pytest.mark.parametrize("n", [0, 1, 2, 5_000])
def test_finder_finds_all_keys_and_no_other(n):
    numbers = np.random.default_rng(n).permutation(np.unique(np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 20_000))[:10_002])
    numbers[:2] = 0, -1
    numbers = np.unique(numbers)[::-1]
    find = language_model._finder(numbers[:n])
    assert find(numbers).tolist() == [*range(n), *[n] * (len(numbers) - n)]


def test_other_gates_than_the_commonest_keep_their_weights():
    rng = np.random.default_rng(2)
    numbers, gate = rng.normal(size=(6, 400)).astype(np.float32), rng.integers(0, 3, 100).astype(np.uint8)
    weights = rng.normal(size=(language_model.N_GATES, 6)).astype(np.float32)
    dot, others = language_model._mixed(weights, numbers, gate, Room())
    assert np.allclose(dot, np.clip((weights[np.repeat(gate, 4)].T * numbers).sum(0), -12, 12), atol=1e-5)
    assert sorted([others[0][0], *(g for g, _, _ in others[1:])]) == [0, 1, 2]


@pytest.mark.parametrize("docs", [rows(60), [(None, False)], []])
def test_base_columns_are_those_of_plain_python(spark, monkeypatch, docs):
    monkeypatch.setattr(language_model, "LEXICON", 3)  # the rest is joined
    table = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_model.score_texts(table).collect()}
    out = {r["doc_id"]: r["out"] for r in table.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 1).alias("out")).collect()}
    counts, ends = Counter(), sum(not x for x in out.values())
    for k, (text, _) in enumerate(docs):
        if not out[k]:
            counts.update(plain(text))
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    assert len(got) == len(docs)
    for k, (text, _) in enumerate(docs):
        cs = [*(counts[w] for w in plain(text)), ends]
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (len(cs), sum(c > 0 for c in cs), n)
        assert got[k]["base_score"] == pytest.approx(sum(np.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in cs))
        assert got[k]["score"] < 0
