"""Fragments that many words share are merged once."""

import pytest

from gridlore.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("word_bpe_49k.json")


def test_a_fragment_is_merged_once(monkeypatch):
    own, merged, merge = bpe.Encoder(bpe.read_vocabulary(PATH)), [], bpe.Encoder.merge
    monkeypatch.setattr(bpe.Encoder, "merge", lambda self, f, ends: merged.append((f, ends)) or merge(self, f, ends))
    texts = ["".join(a + b) for a in ("treé", "qzé", "élé", "x" * 70) for b in ("ux", "pa", "ux,", "zq!")]
    texts = [" ".join(texts[k:k + 3]) for k in range(len(texts))]
    want = [tokenizers.Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids for t in texts]
    assert own.encode_all(texts) == want
    short = [m for m in merged if len(m[0]) <= bpe.SHORT]
    assert len(short) == len(set(short))
    again = len(merged)
    assert own.encode_all(texts) == want
    assert not [m for m in merged[again:] if len(m[0]) <= bpe.SHORT]
