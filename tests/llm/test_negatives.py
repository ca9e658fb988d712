"""Hard negatives against brute force, pruned and not, on awkward tables."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import connect, differences
from gridlore.llm import negatives
from gridlore.llm.queries import QUERIES, SQL

SCHEMA = "id long, label long, q array<bigint>, score long, rank string"
def anchor():
    return F.col("id") % 10 == 0



def brute(rows, positives=5, negatives_=5, low=80, high=100, limit=2 ** 63):
    """rows: {id: (label, vector)}."""
    dot = lambda a, b: max(-limit, min(limit - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for a, (label, q) in rows.items():
        if a % 10:
            continue
        scores = {i: dot(q, v) for i, (_, v) in rows.items() if i != a and len(v) == len(q)}
        near = sorted((i for i in scores if rows[i][0] == label), key=lambda i: (-scores[i], i))[:positives]
        for p in near:
            fit = [i for i in scores if rows[i][0] != label and low * scores[p] <= 100 * scores[i] <= high * scores[p]]
            for rank, i in enumerate(sorted(fit, key=lambda i: (-scores[i], i))[:negatives_], 1):
                out.append((a, p, rank, i, scores[p], scores[i]))
    return sorted(out)


def got(spark, rows, **more):
    listed = [(i, label, v, 0, "") for i, (label, v) in rows.items()]
    return sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(listed, SCHEMA), anchor(), **more).collect())


def clustered(seed, n, dim=6, spread=40):
    """Short and long vectors around a few directions, with repeated vectors and ties."""
    rng = random.Random(seed)
    heads = [[rng.randrange(-200, 200) for _ in range(dim)] for _ in range(4)]
    rows = {}
    for i in range(n):
        if i % 9 == 8:
            rows[i] = (rng.randrange(3), list(rows[rng.randrange(i)][1]))
        else:
            scale = rng.choice([1, 1, 3])
            rows[i] = (rng.randrange(3), [scale * (x + rng.randrange(-spread, spread)) for x in rng.choice(heads)])
    return rows


@pytest.mark.parametrize("bucket,sample", [(4096, 2048), (7, 0), (16, 20)])
def test_equals_brute_force(spark, monkeypatch, bucket, sample):
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    monkeypatch.setattr(negatives, "SAMPLE", sample)
    rows = clustered(bucket, 300)
    want = brute(rows)
    assert len(want) > 100 and got(spark, rows) == want


def test_blocks_of_anchors_and_other_bounds(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 4000)
    rows = clustered(5, 120)
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, positives=2, negatives=3, low=50, high=90) == brute(rows, 2, 3, 50, 90)


def test_coordinates_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    heads = rng.normal(size=(20, 12))
    heads /= np.sqrt((heads ** 2).sum(1))[:, None] / 3
    q = np.floor(256 * (heads[rng.integers(0, 20, 2000)] + 0.1 * rng.normal(size=(2000, 12)))).astype(np.int64)
    norms = np.sqrt((q.astype(float) ** 2).sum(1))
    bucket = negatives.Bucket(np.arange(2000), 1, q, norms)
    block = negatives.Anchors([0], [1], [q[0]], [[(0, 5, None, None)]], True)
    exact = q @ q[0]
    read = 0
    for least in np.sort(exact)[::-1][[1, 5, 50, 150]]:
        at = bucket.candidates(block.unit[0], block.focus[0], block.norm[0], int(least))
        assert at is not None and set(np.flatnonzero(exact >= least)) <= set(at.tolist())
        read += len(at)
    assert read < 0.3 * 4 * 2000
    assert len(bucket.candidates(block.unit[0], block.focus[0], block.norm[0], int(bucket.longest * block.norm[0] * 1.1))) == 0


def test_nulls_repeats_dimensions_zeros_and_an_empty_table(spark):
    rows = {0: (1, [5, 5]), 1: (1, [4, 4]), 2: (2, [4, 4]), 3: (2, [3, 4]), 10: (3, [1, 1, 1]), 11: (3, [2, 2, 2]), 12: (1, [1, 1, 2]),
            20: (4, [0, 0]), 21: (4, [7, 7]), 22: (5, [0, 0]), 30: (6, []), 31: (6, []), 32: (7, []), 40: (8, [9, 9]), 50: (9, [-3, -3]), 51: (9, [1, 1])}
    want = brute(rows)
    listed = [(i, label, v, 0, "") for i, (label, v) in rows.items()]
    bad = [(None, 1, [5, 5], 0, ""), (60, None, [5, 5], 0, ""), (61, 1, None, 0, ""), (62, 2, [5, None], 0, None), (3, 2, [3, 4], None, ""), (3, 2, [300, 4], None, "")]
    df = spark.createDataFrame(listed + bad, SCHEMA)
    assert sorted(tuple(r) for r in negatives.hard_negatives(df, anchor()).collect()) == want
    assert {r[0] for r in want} >= {0, 20, 30} and not {r[0] for r in want} & {40, 50}
    assert negatives.hard_negatives(df.limit(0), anchor()).collect() == []
    assert negatives.hard_negatives(df, F.col("id") == 7).collect() == []


def test_large_components_are_exact_and_held_at_64_bits(spark):
    rows = {0: (1, [2 ** 40, 3]), 1: (1, [2 ** 20, 7]), 2: (2, [2 ** 20, 6]), 3: (2, [2 ** 20, 8]), 4: (1, [2 ** 40, 1]), 5: (3, [2 ** 40, 2])}
    assert got(spark, rows) == brute(rows)
    fixed = spark.createDataFrame([([0.5, -0.001, 1e30, -1e30],)], "v array<float>").select(negatives.fixed_point(F.col("v"))).first()[0]
    assert fixed == [128, -1, 2 ** 63 - 1, -(2 ** 63)]


def test_vectors_that_are_not_finite_are_told(spark):
    rows = [([1.0],), ([None],), ([float("nan")],), ([float("inf"), 1.0],), (None,), ([],)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [r[0] for r in df.select(negatives.usable(F.col("v"))).collect()] == [True, False, False, False, False, True]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test tables are not here")
def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    want = connect(folder).execute(SQL["op11_hard_negatives"]).df()
    assert len(want) and differences(QUERIES["op11_hard_negatives"](spark, folder).toPandas(), want) is None
