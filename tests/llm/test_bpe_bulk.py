"""New pieces of a batch are normalised, cut and merged together."""

import random

import pytest

from gridlore.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    return tokenizers.Tokenizer.from_file(PATH)


def test_a_batch_is_normalised_once(own):
    e, calls = bpe.Encoder(bpe.read_vocabulary(PATH)), []
    normalize = e.normalize
    e.normalize = lambda t: calls.append(t) or normalize(t)
    texts = [f" né{k} ́x{k}  Σας{k}Σ, it's{k} " for k in range(50)] + ["", " "]
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    flat, sizes = e.encode_flat(texts)
    assert flat.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
    assert len(calls) == 1
    assert e.encode_all(texts) == want and len(calls) == 1


def test_fragments_of_all_lengths_merge_as_the_library_does():
    e, rng = bpe.Encoder(bpe.read_vocabulary(PATH)), random.Random(5)
    fragments = ["".join(rng.choice("aeinorst") for _ in range(n)) for n in [1, 2, 3, *range(1, bpe.SHORT + 1)] * 5] + ["aaaaaaa", "eeee"]
    for ends in (False, True):
        flat, sizes = e.merged(fragments, bpe.np.full(len(fragments), ends))
        assert flat.tolist() == [k for f in fragments for k in e.merge(f, ends)]
        assert sizes.tolist() == [len(e.merge(f, ends)) for f in fragments]
    assert e.merged([], bpe.np.zeros(0, bool))[0].tolist() == []


def test_long_pieces_are_not_remembered(own):
    e = bpe.Encoder(bpe.read_vocabulary(PATH))
    texts = ["ab " + "xyz" * 40 + " ab", "é" * 90 + " ab", "<|endoftext|>" + "q" * 70 + "\x1cab"]
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert e.encode_all(texts) == want
        assert max(map(len, e.pieces)) <= bpe.SHORT
        assert len(e.ids_of_pieces) == len(e.pieces) and len(e.ids_of_parts) == sum(map(len, e.parts))
