"""The operators of the training-data pipeline against brute force and on awkward tables."""

import hashlib
import math
import os
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.llm import (
    decontamination, jaccard, language, language_model, mixing, pii, quality, quality_rules, secrets, toxicity,
)
from gridlore.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_words long"

# Nulls in every column, an empty and a blank text, repeated rows, one very long text, and a column named like a result.
ODD = [
    (None, None, None, None, None), (1, "", "en", "a", 1), (2, " \n\t ", "en", "a", None), (3, "one two", None, "a", 1),
    (3, "one two", None, "a", 1), (4, "It is " * 40_000, "en", None, 5), (None, "no id here at all", "fr", "a", 2),
    (5, "Ünïcode Größe ñandú – 漢字 🙂", "de", "a", 3), (6, "x" * 100_000, "en", "a", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def blanks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# quality rules

def rule_counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    threes = Counter(zip(ws, ws[1:], ws[2:]))
    hit = set()
    for i in range(len(ws) - 2):
        if threes[tuple(ws[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_counts(spark, odd):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "#|", "\n", "d\t"]) for _ in range(rng.randrange(60))), "en", "s", 0)
            for i in range(10, 80)]
    docs = odd.where("doc_id IS NOT NULL").union(spark.createDataFrame(rows, SCHEMA))
    got = quality_rules.judge(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        n, chars, symbols, dup, repeat = rule_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_quality_rules_fit(spark):
    """Expectation-maximisation in SQL against the same rounds in Python."""
    rng = random.Random(2)
    rows = Counter()
    for _ in range(3000):
        good = rng.random() < 0.7
        rows[tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) == good else -1) for a in (0.9, 0.8, 0.7))] += 1
    patterns = spark.createDataFrame([(list(v), n) for v, n in rows.items()], "votes array<int>, n long")
    fit = quality_rules.accuracies(patterns, 3).first()
    prior, acc = 0.7, [0.8] * 3
    for _ in range(quality_rules.ROUNDS):
        p = {v: 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(x * math.log(a / (1 - a)) for x, a in zip(v, acc))))) for v in rows}
        acc = [min(0.99, max(0.55, sum(n * (p[v] if v[k] > 0 else 1 - p[v]) for v, n in rows.items() if v[k]) / sum(n for v, n in rows.items() if v[k])))
               for k in range(3)]
        prior = min(0.95, max(0.05, sum(n * p[v] for v, n in rows.items()) / sum(rows.values())))
    assert fit["prior"] == pytest.approx(prior, abs=1e-6)
    assert fit["accuracy"] == pytest.approx(acc, abs=1e-6)


# personal data

def naive_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card":
                doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), ("email", "ip", "card", "phone").index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii_against_plain_patterns():
    rng = random.Random(3)
    pieces = ["a.b@c.d", "@", "x@y", ".com", " 10.0.0.1", "999.1.1.1.5", "4111 1111-1111 1111", "+1 (499) 555-6503", " ", "é🙂", "79927398713", ".", "-", "+", "0"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        base, every = pii.spans_of(text)
        assert [f"{k}:{a}:{b}" for a, b, k in base] == naive_spans(text), text
        assert set(base) <= set(every)


def test_pii_added_kinds():
    text = "Transfer to IBAN GB82 WEST 1234 5698 7654 32 now; GB83 WEST 1234 5698 7654 32 is wrong. " + "and " * 20 + "Call 030 1234 5678, ssn 123-45-6789"
    kinds = [k for _, _, k in pii.spans_of(text)[1]]
    assert kinds == ["iban", "loose_phone", "national_id"]


# decontamination

def test_decontamination_short_and_long_items(spark, odd):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate((0, 1, 3, 9, 10, 11, 25, 25))] + [(2, "é ß 漢"), (None, "w1 w2"), (9, None)]
    texts = []
    for i in range(100, 160):
        ws = rng.choices(vocabulary, k=rng.randrange(30))
        _, item = items[rng.randrange(2, 8)]
        texts.append((i, " ".join(ws + item.upper().split()[rng.randrange(3):] + ws), "en", "s", 0))
    docs = spark.createDataFrame(texts, SCHEMA).union(odd.where("doc_id IS NOT NULL"))
    own = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = [(str(k), tuple(own(t)[s:s + 10])) for k, t in items if k is not None
               for s in range(max(1, len(own(t)) - 9)) if own(t)]
    got = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    texts = {r["doc_id"]: own(r["text"]) for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        ws, hit, found = texts[r["doc_id"]], set(), set()
        if len(ws) < 1000:
            for item, win in windows:
                for s in range(len(ws) - len(win) + 1):
                    if tuple(ws[s:s + len(win)]) == win:
                        hit |= set(range(s, s + len(win)))
                        found.add(item)
            assert (r["n_words"], r["n_hit"], r["items"]) == (len(ws), len(hit), sorted(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(r["items"]).encode()).hexdigest()


# near duplicates

def brute_components(texts, width, percent):
    sets = {d: (set(zip(*(blanks(t)[i:] for i in range(width)))) if len(blanks(t)) >= width else {tuple(blanks(t))} - {()}) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_components(spark, width, percent):
    """Families of copies with more and more edits, so that some links run over third texts and some ties fail."""
    rng = random.Random(width)
    texts, i = {}, 0
    for size in (3, 6, 9, 20, 60, 300):
        for _ in range(3):
            ws = [f"t{rng.randrange(400)}" for _ in range(size)]
            for _ in range(14):
                texts[i] = " ".join(ws)
                i += 1
                for _ in range(rng.randrange(1, 2 + size // 25)):
                    ws[rng.randrange(len(ws))] = f"t{rng.randrange(400)}"
    texts[i], texts[i + 1], texts[i + 2] = "", None, texts[0]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, width=width, percent=percent).collect()}
    want = brute_components(texts, width, percent)
    assert got == want
    kept = {r["doc_id"] for r in jaccard.keep_one(docs, width=width, percent=percent).collect()}
    assert kept == {d for d, (_, c) in want.items() if c == d}


def test_signature_trees_lose_no_link():
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 2**63, 80).astype(np.uint64)) for _ in range(6)]
    sets = []
    for b in base:
        for _ in range(12):
            own = b.copy()
            own[rng.integers(0, len(own), rng.integers(0, 14))] = rng.integers(0, 2**63, 1).astype(np.uint64)
            sets.append(np.unique(own))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if jaccard.linked(sets[i], sets[j], 85)}
    found = jaccard.tree_links(sets, None, np.arange(len(sets)), None, 85)
    halves = jaccard.tree_links(sets[::2], sets[1::2], np.arange(0, len(sets), 2), np.arange(1, len(sets), 2), 85)

    def classes(edges):
        parent = list(range(len(sets)))
        for a, b in edges:
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        out = []
        for x in range(len(sets)):
            while parent[x] != x:
                x = parent[x]
            out.append(x)
        return out

    assert classes(found) == classes(want)
    assert {tuple(sorted(e)) for e in halves} <= {tuple(sorted(e)) for e in want}
    assert classes(halves) == classes({(i, j) for i, j in want if i % 2 != j % 2})


@pytest.mark.parametrize("edges_a_task", [7, 250_000])
def test_components_of_a_path_and_a_star(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr(jaccard, "EDGES", edges_a_task)
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 20)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{100 + k: 100 for k in range(20)}}


# language model

def test_spelling_sums_to_one():
    """Over all words of one byte the chances and what is left for longer words make 1, so each is below it."""
    tables = np.zeros((2, int(language_model.STARTS[-1])), np.float32)
    bits = language_model.Bits([b"the", b"then", b"a"])
    for slots in bits.slots:
        np.add.at(tables[0], slots, 1)
        np.add.at(tables[1], slots[bits.value > 0], 1)
    weights = language_model.train_mixer(tables, [b"the", b"then", b"a"])
    first = [10 ** x for x in language_model.spell(tables, weights, [bytes([k]) for k in range(256) if k != 32])]
    assert 0 < sum(first) + 10 ** language_model.spell(tables, weights, [b""])[0] < 1
    assert language_model.spell(tables, weights, [b"the"])[0] > language_model.spell(tables, weights, [b"qzx"])[0]


def test_base_scores(spark, odd):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(
        spark.createDataFrame([(i, f"the cat {i} sat on the mat", "en", "s", 0) for i in range(20, 60)], SCHEMA))
    rows = {r["doc_id"]: blanks(r["text"]) + ["\n"] for r in docs.collect()}
    out = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in rows}
    counts = Counter(w for d, ws in rows.items() if not out[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in language_model.score_texts(docs).collect():
        ws = rows[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out[r["doc_id"]], len(ws), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert math.isfinite(r["score"]) and r["score"] < 0


# learning from labels

@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        ws = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 200))]
        bad, low = i % 4 == 0, i % 5 == 0
        if bad:
            ws = [w if rng.random() > 0.05 else rng.choice(["foul", "vile"]) for w in ws]
        if low:
            ws = [w.upper() + "!!" for w in ws]
        rows.append((i, " ".join(ws), int(bad), int(not low)))
    letters = "abcdefghij"
    rows = [(i, t.translate(str.maketrans(string.digits, letters)), b, q) for i, t, b, q in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")


def test_toxicity(judged, odd, empty):
    scorer = toxicity.learn(judged.where("doc_id % 3 <> 0"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(judged, scorer).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in judged.collect() if r["doc_id"] % 3 == 0}
    assert sum(got[d] == y for d, y in truth.items()) >= 0.9 * len(truth)
    rows = toxicity.score_toxicity(odd, scorer).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.learn(judged.where("toxic = 1")) is None
    assert toxicity.score_toxicity(empty, None).count() == 0


def test_quality(judged, odd, empty):
    model = quality.learn(judged.where("doc_id % 3 <> 0"))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(judged, model).collect()}
    truth = {r["doc_id"]: r["quality"] for r in judged.collect() if r["doc_id"] % 3 == 0}
    assert sum((got[d] >= 0.5) == y for d, y in truth.items()) >= 0.95 * len(truth)
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.keep_good(odd, model).columns == odd.columns
    assert quality.score_quality(empty, None).count() == 0


def test_attention_gradient():
    """The network's own loss goes down, and the weights of a bag sum to 1."""
    rng = np.random.default_rng(1)
    x, first = rng.normal(size=(60, quality.N_FEATURES)), np.arange(0, 60, 3)
    y = (np.add.reduceat(x[:, 0], first) > 0).astype(float)
    net = quality.train(x, first, y)
    p = net.score(x, first)
    assert ((p > 0.5) == y).mean() >= 0.9
    alpha = net.forward(x, first)[4]
    assert np.add.reduceat(alpha, first) == pytest.approx(np.ones(len(first)))


def test_language(spark, odd, empty):
    rows = [(i, w * 3, lang, "s", 0) for i, (w, lang) in enumerate([("the cat and the dog ", "en"), ("der hund und die katze ", "de")] * 30)]
    model = language.learn(spark.createDataFrame(rows, SCHEMA))
    assert model.predict("the dog")[0] == "en" and model.predict("katzen")[0] == "de"
    assert model.predict("123 !")[0] == "und" and model.predict(None) == ("und", 0.0)
    assert language.identify(odd, model).count() == len(ODD)
    nothing = language.learn(empty)
    assert language.identify(odd, nothing).where("lang_pred <> 'und'").count() == 0


# secrets

def test_secrets(spark, odd, empty):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["tion", "ing", "the", "er", "al"]) for _ in range(rng.randrange(1, 6)))
    rows, planted = [], {}
    for i in range(20, 120):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        planted[i] = value
        rows.append((i, " ".join(word() for _ in range(30)) + f' token = "{value}" ' + " ".join(word() for _ in range(9)), "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA).union(odd)
    lexicon = secrets.learn_lexicon(docs)
    forest = secrets.train_forest(secrets.label_by_rule(secrets.findings(docs, lexicon)))
    got = secrets.scan(docs, lexicon, forest).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[r["doc_id"]][r["start"]:r["end"]] == r["value"] for r in got)
    assert {r["doc_id"]: r["value"] for r in got if r["is_secret"]} == planted
    cleaned = secrets.redact(docs, lexicon, forest)
    assert cleaned.count() == docs.count() and cleaned.columns == docs.columns
    for r in cleaned.where("doc_id >= 20").collect():
        assert r["text"] == texts[r["doc_id"]].replace(planted[r["doc_id"]], "[SECRET]")
    bare = secrets.train_forest(secrets.label_by_rule(secrets.findings(empty, lexicon)))
    assert secrets.scan(odd, secrets.learn_lexicon(empty), bare).where("is_secret").count() == 0


# mixing

def test_mixing(spark, odd, empty):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice(("der die das und" if i % 4 == 0 else "the a of and").split()) for _ in range(rng.randrange(5, 60))),
             "de" if i % 4 == 0 else "en", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = mixing.learn_memberships(docs, "lang")
    got = mixing.mix(docs, known, {"de": 1.0, "en": 1.0}).collect()
    totals = [sum(r["rate"] * r["n_tokens"] * r["posterior"][k] for r in got) for k in (0, 1)]
    whole = sum(r["n_tokens"] for r in got)
    assert totals == pytest.approx([whole / 2] * 2, rel=0.01)
    assert all(r["rate"] >= 0 and r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) for r in got)
    assert mixing.mix(docs, known, floor=1.0).where("rate < 1 OR copies < 1").count() == 0
    assert mixing.mix(odd, known).count() == len(ODD)
    nothing = mixing.learn_memberships(empty, "lang")
    assert {r["rate"] for r in mixing.mix(odd, nothing).collect()} == {1.0}
    assert mixing.mix(empty, known).count() == 0


# all of them

def test_awkward_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    known = odd.where("doc_id IS NOT NULL").count()
    for f, n in ((quality_rules.judge, len(ODD)), (pii.find_pii, len(ODD)), (jaccard.jaccard_components, len(ODD)),
                 (language_model.score_texts, len(ODD)), (lambda d: decontamination.decontaminate(d, items), len(ODD))):
        assert f(odd).count() == n
        assert f(empty).count() == 0
    assert decontamination.decontaminate(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontamination.clean_rows(odd, items).count() == len(ODD) - 2
    # the repeated row is there once; the null ids and the texts without words stay
    assert jaccard.keep_one(odd).count() == len(ODD) - 1
    assert known == len(ODD) - 2


@tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    from checks.compare import connect, differences

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in SQL:
        assert differences(got, connect(FOLDER).execute(SQL[name]).df()) is None
    elif name != "op1_secret_scan":
        assert sorted(got["doc_id"]) == sorted(r[0] for r in docs.select("doc_id").collect())


@tables
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, FOLDER)
        assert docs.columns[:len(names)] == names
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    assert docs.count() > 0 and docs.where(F.col("rate") < 1).count() == 0
