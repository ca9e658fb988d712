"""What the near-duplicate join holds and moves at once."""

import numpy as np
import pyarrow as pa
import pytest

from gridlore.llm import jaccard


def near(rng, n, size, own):
    """n sets that share about size - own of their size shingles."""
    base = rng.integers(0, 2**63, size).astype(np.uint64)
    return [np.unique(np.concatenate([rng.permutation(base)[own:], rng.integers(0, 2**63, own).astype(np.uint64)])) for _ in range(n)]


def signs(sets, comps):
    return np.array([jaccard.bitmap(s) for s in sets]), np.array([len(s) for s in sets]), comps


def test_lists_are_taken_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(jaccard, "WORDS", 10)
    lists = [[1] * n for n in (3, 4, 0, 5, 30, 1, 9, 0, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64()))], names=["h"]).slice(1)
    parts = [[len(x) for x in p.column(0).to_pylist()] for p in jaccard._portions(batch, 0)]
    assert parts == [[4, 0, 5], [30], [1, 9, 0], [1]]
    assert not list(jaccard._portions(batch.slice(0, 0), 0))


@pytest.mark.parametrize("one_tree", [True, False])
def test_a_walk_holds_few_pairs(monkeypatch, one_tree):
    """Sets that are all alike, though no two link: no pair of upper nodes is ruled out."""
    rng = np.random.default_rng(3)
    sets = near(rng, 120, 80, 10)
    seen, may_link = [], jaccard.SignatureTree.may_link

    def watched(self, other, level, i, j, percent):
        seen.append(len(i))
        return may_link(self, other, level, i, j, percent)

    monkeypatch.setattr(jaccard, "AT_ONCE", 640)
    monkeypatch.setattr(jaccard.SignatureTree, "may_link", watched)
    comps = np.arange(len(sets))
    assert jaccard.tree_links(sets, None if one_tree else sets, comps, None if one_tree else comps + 1000, 99)[120:] == []
    assert max(seen) <= 640


@pytest.mark.parametrize("percent", [60, 85])
def test_partners_hold_every_link(percent):
    rng = np.random.default_rng(percent)
    sets = [s for own in (2, 6, 15, 30) for s in near(rng, 15, 90, own)] + near(rng, 20, 90, 90)
    order = rng.permutation(len(sets))
    sets, comps = [sets[k] for k in order], rng.integers(0, 60, len(sets))
    links = {(i, j) for i in range(len(sets)) for j in range(i) if comps[i] != comps[j] and jaccard.linked(sets[i], sets[j], percent)}
    assert links
    found, _ = jaccard.tree_partners(signs(sets, comps), None, percent)
    assert {k for pair in links for k in pair} <= set(np.flatnonzero(found)) and not found.all()
    a, b = jaccard.tree_partners(signs(sets[::2], comps[::2]), signs(sets[1::2], comps[1::2]), percent)
    across = [sorted(pair, key=lambda k: k % 2) for pair in links if sum(pair) % 2]
    assert all(a[i // 2] and b[j // 2] for i, j in across)


def test_sets_move_only_where_a_link_may_be(spark):
    """Two linking sets tied to a third: bitmaps rule the third out, so that its set isn't made."""
    rng = np.random.default_rng(8)
    b = np.unique(rng.integers(0, 2**63, 142).astype(np.uint64))
    sets = {1: np.unique(rng.integers(0, 2**63, 142).astype(np.uint64)), 2: np.sort(rng.permutation(b)[:130]), 3: b}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    held = frame([(k, bytearray(s.tobytes())) for k, s in sets.items()], "node long, s binary")
    asked = []

    def make(wanted):
        asked.extend(r["node"] for r in wanted.collect())
        return held.join(wanted, "node")

    links = jaccard._open_links(
        frame([(1, 2), (1, 3)], "a long, b long"), frame([], "node long, root long"),
        frame([(k, len(s)) for k, s in sets.items()], "node long, n long"), make, 85, jaccard._signed(held))
    assert [sorted((r["a"], r["b"])) for r in links.collect()] == [[2, 3]]
    assert sorted(asked) == [2, 3]
