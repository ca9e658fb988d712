"""Known values in texts: by a broadcast index and by a join, with hot words, and without moving texts."""

import contextlib
import io
import re

import pytest

import gridlore as g
from gridlore.operators import grounding

TEXTS = [
    (1, "The North Star sails at noon; the star is bright.", "north star"), (2, "the north wind", ""), (3, "Northern Starfish", "starfish"),
    (4, "a*b is not (north star)", "a*b"), (5, None, None), (6, "", "x"), (7, "the the the --- !!", ""), (None, "north star", None),
    (8, "\\Q\\E north  star", "north star"), (9, "überfahrt Über Fahrt", "überfahrt"),
]
VALUES = ["north star", "star", "the north", "northern", "starfish", "a*b", "---", "überfahrt", "\\q\\e", "noon", "the", "fahrt"]


def brute(stray):
    word = re.compile(r"\w")
    out = []
    for i, text, evidence in TEXTS:
        low, known = (text or "").lower(), (evidence or "").lower()
        holds = lambda t, v: re.search(rf"(?<!\w){re.escape(v)}(?!\w)", t) is not None
        out += [(i, v) for v in VALUES if holds(low, v) and not (stray and holds(known, v))]
    assert word
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [200_000, 0])
def test_values_equal_a_plain_search(spark, monkeypatch, most):
    monkeypatch.setattr(grounding, "BROADCAST_VALUES", most)
    monkeypatch.setattr(grounding, "RARE_BY", 1.0)
    df = spark.createDataFrame(TEXTS, "id int, text string, evidence string")
    values = spark.createDataFrame([(v,) for v in VALUES], "value string")
    got = g.mentioned_values(df, ["id"], "text", values).collect()
    assert sorted([(r["id"], r["value"]) for r in got], key=str) == brute(False)
    got = g.stray_values(df, values, ["id"], "text", "evidence").collect()
    assert sorted([(r["id"], r["value"]) for r in got], key=str) == brute(True)


def test_a_value_is_found_by_its_rarest_word(spark, monkeypatch):
    monkeypatch.setattr(grounding, "RARE_BY", 1.0)
    df = spark.createDataFrame([(i, "everywhere is the harbour" + (" otter" if i == 7 else "")) for i in range(50)], "id int, text string")
    values = spark.createDataFrame([("everywhere otter",), ("harbour",), ("nowhere harbour",)], "value string")
    assert {r["value"]: r["_w"] for r in grounding._index(values, df, "text").collect()} == {
        "everywhere otter": "otter", "harbour": "harbour", "nowhere harbour": "nowhere"}


def test_texts_are_not_shuffled(spark):
    claims = spark.range(1000).selectExpr("id as claim_id", "concat('the harbour ', id % 7, ' north star') as claim", "'north star' as evidence")
    values = spark.createDataFrame([("north star",), ("harbour",), ("the harbour",)], "value string")
    for df in (g.ground_claims(claims, ["claim_id"], "claim", "evidence", values=values), g.makes_data_claims(claims, ["claim_id"], "claim", values),
               g.stray_values(claims, values, ["claim_id"], "claim", "evidence")):
        shown = io.StringIO()
        with contextlib.redirect_stdout(shown):
            df.explain("formatted")
        moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", shown.getvalue())
        assert not [m for m in moved if re.search(r"\b(claim|evidence|_t|_e|_a)#", m)]
        assert df.count() in (1000, 2000, 1000 * 2)


def test_an_index_of_nothing_and_no_texts(spark):
    df = spark.createDataFrame(TEXTS, "id int, text string, evidence string")
    none = spark.createDataFrame([], "value string")
    assert g.mentioned_values(df, ["id"], "text", none).count() == 0
    assert g.mentioned_values(df.limit(0), ["id"], "text", spark.createDataFrame([("star",)], "value string")).count() == 0
    assert g.ground_claims(df, ["id"], "text", "evidence", values=none).count() == len(TEXTS)
