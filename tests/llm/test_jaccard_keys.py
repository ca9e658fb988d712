"""Open keys are compared key by key, and common shingles don't bring unrelated sets together."""

import random

import numpy as np
import pyarrow as pa
import pytest

from gridlore.llm import jaccard


def shingles(rng, n):
    return np.unique(rng.integers(0, 2**63, n).astype(np.uint64))


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_a_common_passage_is_no_key(percent):
    """Unrelated sets around one passage share no key; linking sets still do, also where nearly all is common."""
    rng = np.random.default_rng(percent)
    passage = shingles(rng, 40)
    common = jaccard.Common(rng.permutation(passage))
    with_passage = [np.union1d(shingles(rng, n), passage) for n in rng.integers(250, 400, 60)]
    keys = np.concatenate([np.unique(jaccard.segment_keys(s, percent, common)) for s in with_passage])
    assert len(np.unique(keys)) == len(keys)
    if percent < 100:
        without = np.concatenate([np.unique(jaccard.segment_keys(s, percent)) for s in with_passage])
        assert len(np.unique(without)) < len(without)
    for own in (*range(0, 60), 100, 300):
        for held in (0, 1, 7, 40):
            b = np.union1d(shingles(rng, own), rng.permutation(passage)[:held])
            if not len(b):
                continue
            for small in {len(b) * percent // 100, -(-len(b) * percent // 100), len(b)} - {0}:
                a = np.sort(rng.permutation(b)[:small])
                if jaccard.linked(a, b, percent):
                    assert np.intersect1d(jaccard.segment_keys(a, percent, common), jaccard.segment_keys(b, percent, common)).size
            for c in (np.union1d(rng.permutation(b)[len(b) // 12:], shingles(rng, len(b) // 12)), np.union1d(b, passage)):
                if jaccard.linked(c, b, percent):
                    assert np.intersect1d(jaccard.segment_keys(c, percent, common), jaccard.segment_keys(b, percent, common)).size


def test_common_shingles_come_last_and_in_order():
    s = np.arange(1, 9, dtype=np.uint64) << np.uint64(50)
    rare, late = jaccard.Common(s[[6, 0, 3]]).split(s)
    assert rare.tolist() == s[[1, 2, 4, 5, 7]].tolist() and late.tolist() == s[[6, 0, 3]].tolist()


def cuts(rng, columns, names):
    at = sorted(rng.choices(range(len(columns[0]) + 1), k=rng.randrange(9)))
    for a, b in zip([0, *at], [*at, len(columns[0])]):
        yield pa.RecordBatch.from_arrays([pa.array(c[a:b], pa.int64()) for c in columns], names=names)


@pytest.mark.parametrize("seed", range(40))
def test_keys_go_on_in_the_next_batch(seed):
    rng = random.Random(seed)
    rows = sorted((rng.randrange(5), rng.randrange(9)) for _ in range(rng.randrange(30)))
    members = {k: sorted({n for q, n in rows if q == k}) for k, _ in rows}
    want = {(m[0], n, k if len(m) > 2 else None) for k, m in members.items() for n in m[1:]}
    got = [tuple(r.values()) for b in jaccard._starred(cuts(rng, list(zip(*rows)) or [[], []], ["k", "node"])) for r in b.to_pylist()]
    assert set(got) == want
    assert len([r for r in got if r[2] is not None]) == len([r for r in want if r[2] is not None])


def test_an_open_key_has_its_own_nodes_alone(spark):
    """Keys 10 and 20 hang together by node 3, but no node of one is held against one of the other; key 30 is settled."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    keyed = frame([(1, 2, 10), (1, 3, 10), (3, 4, 20), (3, 5, 20), (3, 9, 20), (6, 7, 30), (6, 8, 30), (2, 4, None)], "a long, b long, k long")
    roots = frame([(6, 6), (7, 6), (8, 6), (4, 4), (9, 4)], "node long, root long")
    sizes = frame([(n, 80 if n == 5 else 100) for n in range(1, 10)], "node long, n long")
    nodes = jaccard._open(keyed, roots, sizes)
    assert sorted((r["block"], r["node"], r["comp"]) for r in nodes.collect()) == [
        (10, 1, 1), (10, 2, 2), (10, 3, 3), (20, 3, 3), (20, 4, 4), (20, 5, 5), (20, 9, 4)]
    assert sorted(tuple(r) for r in jaccard._paired(nodes, 80).collect()) == [(2, 3, 100, 100), (4, 5, 100, 80), (5, 9, 80, 100)]
    assert sorted(tuple(r) for r in jaccard._paired(nodes, 81).collect()) == [(2, 3, 100, 100)]
    assert jaccard._open(keyed.where("k = 30 OR k IS NULL"), roots, sizes) is None


def linked_texts(texts, width, percent):
    sets = {d: {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} for d, w in texts.items()}
    root = {d: d for d in texts}
    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) * 100 >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


@pytest.mark.parametrize("paired", [2, 64])
def test_texts_around_one_passage(spark, monkeypatch, paired):
    """Copies at the edge of the percentage, all with the same passage, in trees and in pairs."""
    rng = random.Random(paired)
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "SAMPLED", 1)
    passage, texts = [f"p{k}" for k in range(15)], {}
    for family in range(14):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 20, 60]))]
        for _ in range(9):
            ws = list(base)
            for _ in range(rng.randrange(0, 1 + len(ws) // 12)):
                ws[rng.randrange(len(ws))] = f"w{rng.randrange(3000)}"
            texts[len(texts)] = ws[:5] + passage + ws[5:]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, width=3, percent=80).collect()}
    want = linked_texts(texts, 3, 80)
    assert got == want and 14 < len(set(want.values())) < len(texts)
