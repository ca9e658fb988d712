"""Forced-boundary encoding against the tokenizer's own, on awkward tables and on the test documents."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from gridlore.llm import bpe
from gridlore.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("word_bpe_49k.json")
RULES = bpe.read_vocabulary(PATH)
ODD = ["", "  \n\t", "<|endoftext|>hi<|startoftext|>there", "<|ENDOFTEXT|> x", "<|endoftext|", "It's we'll I'D  can't 'st's", "a1b2--c_d!!?",
       "Å Å é é ǅ İstanbul ẞ ΣΑΣ", "x" * 5000, "aaaa" * 3000, "漢字かな交じり文", "🙂🙂‍↔️ á", "a\x1cb\x1db\x85c d​e﻿f", "\x00\x01 \x7f",
       "١٢٣ 4½ ²", "one two " * 20_000]


@pytest.fixture(scope="module")
def own():
    return tokenizers.Tokenizer.from_file(PATH)


def noise():
    rng, spans = random.Random(3), [(32, 127), (32, 127), (0xA0, 0x250), (0x370, 0x1000), (0x3000, 0x9FFF), (0x1F300, 0x1F700), (0, 32)]
    return ["".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(rng.randrange(40))) for _ in range(2000)]


def test_ids_and_texts_equal_the_tokenizers_own(spark, own):
    texts = [None, *ODD, *ODD[:3], *noise()]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = bpe.encode(docs, RULES).select("k", "ids", bpe.decoded(F.col("ids"), RULES).alias("back")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = own.encode(texts[r["k"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["back"] == own.decode(want, skip_special_tokens=False)


def test_a_cut_is_never_inside_a_token():
    e = bpe.encoder(RULES)
    split = lambda words: [(f, bool(x)) for f, x in zip(*e.fragments(words))]
    assert split(["hello"]) == [("hello", True)]
    a, b = next((a, b) for a in "qxzjv" for b in "qxzjv" if not e.inside[ord(a), ord(b)])
    assert split(["hello", "a" + a + b + "a", "x"]) == [("hello", True), ("a" + a, False), (b + "a", True), ("x", True)]
    assert not any(a + b in token.removesuffix("</w>") for token in e.vocab)


def test_memory_of_pieces_is_bounded(monkeypatch, own):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    e = bpe.Encoder(RULES)
    for text in noise()[:300]:
        assert e.encode(text) == own.encode(text, add_special_tokens=False).ids
        assert len(e.pieces) <= 10 + 20


def test_empty_table_clashing_columns_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(bpe, "TOGETHER", 3)
    docs = spark.createDataFrame([(1, "a b", 7, None), (1, "a b", 7, None), (None, None, None, "x")], "doc_id long, text string, n_tokens long, ids_ string")
    rows = bpe.encode(docs, RULES).collect()
    assert [len(r["ids"]) for r in rows] == [2, 2, 0] and rows[0]["n_tokens"] == 7
    assert bpe.encode(docs.limit(0), RULES).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumnRenamed("ids_", "IDS"), RULES)
    ids = spark.createDataFrame([([0, 99_999, 49407],), ([],), (None,)], "ids array<int>")
    assert [r[0] for r in ids.select(bpe.decoded(F.col("ids"), RULES)).collect()] == ["! <|endoftext|>", "", None]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables are not here")
def test_query_equals_the_tokenizers_own(spark, own):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = QUERIES["op12_bpe"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(own.decode(ids, skip_special_tokens=False))
