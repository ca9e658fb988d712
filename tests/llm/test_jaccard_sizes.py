"""Links between sets whose sizes differ by as much as the percentage allows."""

import numpy as np
import pytest

from gridlore.llm import jaccard


def shingles(rng, n):
    return np.unique(rng.integers(0, 2**63, n).astype(np.uint64))


@pytest.mark.parametrize("percent", [50, 60, 70, 80, 85, 100])
def test_segment_keys_of_a_subset(percent):
    """A set and the largest set around it that still links share a key."""
    rng = np.random.default_rng(percent)
    for small in (*range(1, 60), 100, 137, 250, 999):
        b = shingles(rng, small * 100 // percent)
        a = np.sort(rng.permutation(b)[:small])
        assert jaccard.linked(a, b, percent)
        if len(a) < len(b):
            assert np.intersect1d(jaccard.segment_keys(a, percent), jaccard.segment_keys(b, percent)).size, (small, len(b))


@pytest.mark.parametrize("small,large,percent", [(22, 27, 80), (38, 47, 80), (114, 142, 80), (100, 166, 60), (30, 60, 50)])
def test_trees_meet_when_the_common_centre_fails(spark, small, large, percent):
    """Two linking sets, each tied only to a third that neither is linked with."""
    rng = np.random.default_rng(small)
    b, centre = shingles(rng, large), shingles(rng, large)
    sets = {1: centre, 2: np.sort(rng.permutation(b)[:small]), 3: b}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    links = jaccard._open_links(
        frame([(1, 2), (1, 3)], "a long, b long"), frame([], "node long, root long"),
        frame([(k, len(s)) for k, s in sets.items()], "node long, n long"),
        frame([(k, bytearray(s.tobytes())) for k, s in sets.items()], "node long, s binary"), percent)
    assert [sorted((r["a"], r["b"])) for r in links.collect()] == [[2, 3]]
