"""Faults that were found once: each case by itself."""

import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlore.llm import jaccard, mixing, pii, quality, toxicity


def test_long_runs_of_digits_take_linear_time():
    start = time.time()
    assert pii.base_spans("7" * 1_000_000) == []
    assert time.time() - start < 10
    assert pii.base_spans("a1.2.3.4.5.6.7.8 300.1.1.1 10.0.0.256") == [(1, 8, "ip"), (9, 16, "ip")]


def test_ip_spans_equal_the_plain_pattern():
    plain = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
    rng = np.random.default_rng(4)
    for _ in range(3000):
        text = "".join(rng.choice(list("12.. a"), rng.integers(0, 40)))
        want = [m.span() for m in plain.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [(a, b) for a, b, k in pii.base_spans(text) if k == "ip"] == want


def test_added_spans_keep_clear_of_a_long_span_before_many_short_ones():
    inside = [(k, k + 7, "ip") for k in range(0, 42, 7)]
    iban = "GB82WEST12345698765432"
    text = "1.1.1.1" * 6 + "......" + iban
    at = text.index(iban)
    base = [(0, at + len(iban) + 4, "email"), *inside]
    assert pii.added_spans(text, base) == []
    assert pii.added_spans(text, inside) == [(at, at + len(iban), "iban")]


def test_mixing_keeps_all_other_columns(spark):
    rows = [(i, "a b c d" if i % 3 else "x y z w", "u" if i % 3 else "v", f"p{i}", -1.0, "mine", i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, p string, rate double, posterior string, __chance2 long")
    known = mixing.learn_memberships(docs, "lang")
    got = mixing.mix(docs, known, {d: 1.0 for d in known.domains})
    assert got.columns == ["doc_id", "text", "lang", "p", "rate", "posterior", "__chance2", "n_tokens", "copies"]
    for r in got.collect():
        assert r["p"] == f"p{r['doc_id']}" and r["rate"] >= 0 and len(r["posterior"]) == 2


@pytest.mark.parametrize("learn", [toxicity.learn, quality.learn])
def test_labels_may_have_a_text_column_repeats_and_unknown_ids(spark, learn):
    docs = spark.createDataFrame([(i, "foul words here" if i % 2 else "GOOD words there", i) for i in range(200)], "doc_id long, text string, y long")
    rows = [(i, i % 2, i % 2, "not this") for i in range(200)] * 2 + [(9999, 1, 1, None), (None, 0, 0, None), (3, None, None, None)]
    judged = spark.createDataFrame(rows, "doc_id long, toxic int, quality int, text string")
    model = learn(judged, docs=docs)
    assert model is not None
    scored = (toxicity.score_toxicity if learn is toxicity.learn else quality.score_quality)(docs, model)
    by = {r["doc_id"] % 2: r["score"] for r in scored.collect()}
    assert by[1] > 0.5 > by[0]


def test_kneser_ney_equals_a_plain_model():
    rng = np.random.default_rng(6)
    texts = [(int(rng.integers(2)), rng.integers(1, 12, rng.integers(1, 30)).tolist()) for _ in range(60)]
    pairs = [Counter(), Counter()]
    for c, h in texts:
        pairs[c].update(zip([0] + h[:-1], h))
    keys = sorted(set(pairs[0]) | set(pairs[1]))
    counts = toxicity.Counts(*(np.array([k[i] for k in keys]) for i in (0, 1)), [np.array([p[k] for k in keys], np.int32) for p in pairs])
    words = sorted({x for k in keys for x in k})
    for discount in (1.0, 3.0):
        after = [Counter(w for _, w in p) for p in pairs]
        classes = {w: 0.5 + sum(a[w] > 0 for a in after) for w in [*words, None]}
        whole, d = sum(classes.values()), toxicity.DISCOUNT

        def chance(c, b, w):
            lower = (max(after[c][w] - d, 0) + d * len(after[c]) * classes.get(w, 0.5) / whole) / len(pairs[c])
            starts = sum(n for (x, _), n in pairs[c].items() if x == b)
            if not starts:
                return lower
            mass = sum(min(n, discount) for (x, _), n in pairs[c].items() if x == b)
            return (max(pairs[c][b, w] - discount, 0) + mass * lower) / starts

        for c in (0, 1):  # each history's chances, with that of a word not known, sum to 1
            for b in words:
                assert sum(chance(c, b, w) for w in [*words, 999]) == pytest.approx(1, abs=1e-6)
        text = [3, 5, 999, 5, 5, 1, 11, 998, 997]
        want = [np.log(chance(1, b, w) / chance(0, b, w)) for b, w in zip([0, *text], text)]
        assert counts.model(discount).ratios(np.array(text), np.array([0])) == pytest.approx(want, abs=1e-4)


def test_measures_don_t_depend_on_how_texts_are_batched(monkeypatch):
    lists = pa.array([[1, 2, 3], [], [2] * 50, [4], [1, 2]] * 4, pa.list_(pa.int64()))
    counts = toxicity.Counts(np.array([0, 1, 2]), np.array([1, 2, 3]), [np.array([3, 1, 0], np.int32), np.array([0, 4, 5], np.int32)])
    whole = toxicity._measures(counts.model(1.0), lists)
    for n in (1, 7, 60):
        monkeypatch.setattr(toxicity, "TOGETHER", n)
        assert np.array_equal(toxicity._measures(counts.model(1.0), lists), whole)
    assert len(toxicity._measures(counts.model(1.0), lists.slice(0, 0))) == 0


def test_bitmaps_rule_out_no_link(spark):
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 2**63, 400, np.uint64))
    sets = {0: base}
    for k in range(1, 60):
        own = base.copy()
        own[rng.choice(len(own), 5 * k, replace=False)] = rng.integers(0, 2**63, 5 * k, np.uint64)
        sets[k] = np.unique(own)
    ties = spark.createDataFrame([(0, k) for k in range(1, 60)], "a long, b long")
    rows = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in sets.items()], "node long, s binary")
    left = {r["b"] for r in jaccard._possible(ties, rows, 80).collect()}
    linked = {k for k in range(1, 60) if jaccard.linked(sets[0], sets[k], 80)}
    assert linked <= left and len(left) < len(linked) + 15 < 45
