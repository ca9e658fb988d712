"""Targets of domains of very unlike shares."""

import math
import random
import warnings

import pytest

from gridlore.llm import mixing


def totals(spark, rows, targets, **more):
    members = spark.createDataFrame(rows, "p array<double>, n_tokens long")
    rated = members.withColumn("rate", mixing.fit_rates(members, targets, **more)).collect()
    assert all(r["rate"] >= more.get("floor", 0) and math.isfinite(r["rate"]) for r in rated)
    return [sum(r["rate"] * r["n_tokens"] * r["p"][k] for r in rated) for k in range(len(targets))]


def one_hot(shares):
    return [([float(k == j) for j in range(len(shares))], n) for k, n in enumerate(shares)]


@pytest.mark.parametrize("shares", [(90, 5, 3, 2), (97, 1, 1, 1), (9997, 1, 1, 1)])
def test_a_hot_domain(spark, shares):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert totals(spark, one_hot(shares), [1.0] * 4) == pytest.approx([sum(shares) / 4] * 4, rel=2e-4)


def test_soft_members_and_a_domain_without_target(spark):
    rng, rows = random.Random(12), []
    for _ in range(600):
        k = rng.choices(range(3), (95, 3, 2))[0]
        p = [0.7 * (k == j) + 0.1 for j in range(3)]
        rows.append((p, rng.randrange(5, 500)))
    rows += [([1.0, 0.0, 0.0], 9_000), ([0.0, 1.0, 0.0], 300), ([0.0, 0.0, 1.0], 300)]
    whole = sum(n for _, n in rows)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert totals(spark, rows, [1.0] * 3) == pytest.approx([whole / 3] * 3, rel=2e-4)
        assert totals(spark, rows, [1.0, 1.0, 0.0]) == pytest.approx([whole / 2, whole / 2, 0], rel=2e-3, abs=2e-4 * whole)


def test_targets_that_no_rates_meet(spark):
    with pytest.warns(UserWarning, match="miss their targets"):
        totals(spark, [([0.5, 0.5], 100), ([0.6, 0.4], 50)], [1.0, 9.0])
