"""Text checks on small tables."""

import pytest
from pyspark.sql import functions as F

import gridlore as g


def test_masking_follows_the_order_of_patterns(spark):
    texts = [
        ("mail jo.doe+x@mail.example.org now", "mail [REDACTED_EMAIL].org now", 1),
        ("card 4111 1111 1111 1111", "card [REDACTED_CARD]", 1),
        ("ssn 123-45-6789, id 1234 5678 9012", "ssn [REDACTED_SSN], id [REDACTED_AADHAAR]", 2),
        ("pan ABCDE1234F", "pan [REDACTED_PAN]", 1),
        ("call (415) 555-0132 or 415.555.0132", "call [REDACTED_PHONE] or [REDACTED_PHONE]", 2),
        ("call +91-98765-43210 or +1-415-555-0132", "call [REDACTED_PHONE] or +1-[REDACTED_PHONE]", 2),
        ("id 4155550132 and [REDACTED_CARD]", "id 4155550132 and [REDACTED_CARD]", 0),
        ("é1234 5678 9012", "é1234 5678 9012", 0),
        (None, None, 0),
    ]
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "id int, text string")
    masked = {r["id"]: r["text"] for r in g.mask_pii(df, "text").collect()}
    counts = {r["id"]: r["redactions"] for r in g.pii_counts(df, "text").collect()}
    assert [(masked[i], counts[i]) for i in range(len(texts))] == [t[1:] for t in texts]


CLAIMS = [  # one for each rule: claim, evidence, whether it says more than the evidence
    ("The weir gauge read 7.4 metres.", "weir 6.1", True),
    ("Depth was 4. Wind was 31.", "depth 4", True),
    ("Swimmers left due to the storm.", "swimmers 12", True),
    ("Lane use is expected to climb.", "lane use 40", True),
    ("I cannot compute the exact depth.", "depth 4", True),
    ("Oak 12 and Elm 7", "Oak 7\nElm 12", True),
    ("Seen were Oak, Elm and Rowan.", "seen: Oak, Elm", True),
    ("Глубина 9", "Глубина 4", True),
    ("Oak 7 and Elm 12", "Oak 7\nElm 12", False),
    ("The pool was full on 3 evenings.", "full evenings: 3", False),
    (None, "depth 4", False),
]


def test_claims_are_rejected_for_what_they_add(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CLAIMS)], "id int, claim string, evidence string, bad boolean")
    rows = {r["id"]: r for r in g.ground_claims(df, ["id"], "claim", "evidence").collect()}
    for i, (claim, _, bad) in enumerate(CLAIMS):
        assert rows[i]["trustworthy"] is not bad, (claim, rows[i]["problems"])


def test_numbers_and_labels(spark):
    text = "On 2024-03-01 Laptop 1,250.5 fell -3, has 5 and Laptop 9"
    row = spark.createDataFrame([(text,)], "t string").select(
        g.numbers_in(F.col("t")).alias("n"), g.labelled_numbers(F.col("t")).alias("l"),
    ).first()
    assert row["n"] == [2024.0, 3.0, 1.0, 1250.5, -3.0, 5.0, 9.0]
    assert [(p["label"], p["number"]) for p in row["l"]] == [("laptop", 1250.5), ("fell", -3.0)]


@pytest.mark.parametrize("printed, single, disagree", [
    ("Distinct herds: 9", "9", False), ("Fee: $1,200", "1200", False), ("Occupied: 25.0%", "0.25", False),
    ("Mean depth: 2.72", "2.71828", False), ("Distinct herds: 9", "8", True), ("Distinct herds: 9", "8\n", True),
    ("Distinct herds: 2", "herd\nHill\nFold", False), ("Leader: Elm", "Elm", False),
])
def test_agreement(spark, printed, single, disagree):
    df = spark.createDataFrame([(printed, single)], "printed string, single string")
    assert g.results_agree(df, "printed", "single").first()["disagree"] is disagree


def test_values_are_found_as_whole_words(spark):
    table = spark.createDataFrame([("Laptop",), ("Sales Rep",), ("c++",), ("AB",), ("12.5",), ("---",)], "v string")
    values = g.known_values(table)
    assert {r["value"] for r in values.collect()} == {"laptop", "sales rep", "c++", "---"}
    claims = spark.createDataFrame(
        [(1, "A laptop for the sales rep", "sales rep"), (2, "Laptops only", ""), (3, "uses c++ --- well", "")],
        "id int, claim string, evidence string",
    )
    found = {(r["id"], r["value"]) for r in g.stray_values(claims, values, ["id"], "claim", "evidence").collect()}
    assert found == {(1, "laptop"), (3, "c++"), (3, "---")}


@pytest.mark.parametrize("text, claims", [
    ("Herds graze at Hillfold and Marsh.", True), ("It rained on 12 days.", True), ("Shall I look at another column?", False),
    ("", False), (None, False),
])
def test_data_claims(spark, text, claims):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert g.makes_data_claims(df, ["id"], "text").first()["makes_claim"] is claims
