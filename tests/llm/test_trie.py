"""The prefix trie against a plain one, burst and not, and on awkward tables."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from checks.compare import connect, differences
from gridlore.llm import trie
from gridlore.llm.queries import QUERIES, SQL, with_openings

SCHEMA = "conv_id long, turn long, role string, text string, node_id string, n long"


def plain(convs):
    """{path: [least, parent's least, members, children, leaves, saved, digest]} of {id: [(role, text), …]}."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[:d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = own + sum(saved[k] for k in kids[p])
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def built(convs, limit):
    t = trie.prefix_trie(convs, limit)
    met = t.nodes.join(trie.ends_digest(t.ends), "node_id", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return sorted(tuple(r) for r in met.collect())


def some_conversations(seed, n):
    rng = random.Random(seed)
    words = [("user", "a"), ("user", "bb"), ("bot", "a"), ("bot", "ünï🙂"), ("", "")]
    out = {}
    for c in range(n):
        if out and rng.random() < 0.3:
            old = out[rng.choice(list(out))]
            out[c] = old[:rng.randrange(len(old) + 1)] + [rng.choice(words) for _ in range(rng.randrange(3))]
        else:
            out[c] = [rng.choice(words) for _ in range(rng.randrange(7))]
    out[n] = [("user", "a")] * 60
    out[n + 1] = [("user", "a")] * 60 + [("bot", "end")]
    return out


@pytest.mark.parametrize("limit", [1, 7, 60, 10_000])
def test_trie_equals_a_plain_one(spark, limit):
    convs = some_conversations(limit, 120)
    rows = [(c, k, r, t, None, None) for c, ts in convs.items() for k, (r, t) in enumerate(ts)]
    turnless = [c for c, ts in convs.items() if not ts]
    seqs = trie.sequences(spark.createDataFrame(rows, SCHEMA)).union(
        spark.createDataFrame([(c, bytearray()) for c in turnless], "conv_id long, seq binary"))
    assert built(seqs, limit) == plain(convs)


def test_conversations_that_grow_by_a_turn_need_no_burst_each(spark, monkeypatch):
    monkeypatch.setattr(trie, "ROUNDS", 3)
    convs = {c: [("u", str(k)) for k in range(c)] for c in range(1, 40)}
    rows = [(c, k, r, t, None, None) for c, ts in convs.items() for k, (r, t) in enumerate(ts)]
    assert built(trie.sequences(spark.createDataFrame(rows, SCHEMA)), 5) == plain(convs)


def test_nulls_repeats_and_an_empty_table(spark):
    rows = [(1, None, "u", "first", "x", 1), (1, 5, None, "later", "x", 1), (1, 5, "u", None, "x", None), (1, 5, "u", None, "x", None),
            (None, 1, "u", "nobody", None, None), (2, None, "u", "first", None, 7), (3, 1, "u", "first", None, 7)]
    seqs = trie.sequences(spark.createDataFrame(rows, SCHEMA))
    got = built(seqs, 1)
    assert [r[:5] for r in got if r[1] < 2] == [(1, 0, None, 3, 1), (1, 1, 1, 3, 1)]
    # two turns of one number and text are two turns; the nameless row takes no part
    assert max(r[1] for r in got) == 4 and got[-1][3] == 1
    assert built(trie.sequences(spark.createDataFrame([], SCHEMA)), 5) == []
    t = trie.prefix_trie(spark.createDataFrame([(7, bytearray()), (8, bytearray())], "conv_id long, seq binary"))
    assert [(r["conv_id"], r["depth"], r["n_convs"], r["n_leaves"], r["saved_tokens"]) for r in t.nodes.collect()] == [(7, 0, 2, 1, 0)]


def test_a_hot_end_is_digested_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "JOINED", 7)
    ends = spark.range(1000).select(F.lit(bytearray(b"n")).alias("node_id"), F.col("id").alias("conv_id"))
    want = hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()
    assert [r["ends_sha256"] for r in trie.ends_digest(ends).collect()] == [want]


def test_openings_are_those_of_the_hundred_below(spark):
    rows = [(c, k, "u", f"{c}/{k}", None, None) for c in (100, 101, 102, 199, 207) for k in range(4)]
    got = {r["conv_id"]: bytes(r["seq"]) for r in with_openings(trie.sequences(spark.createDataFrame(rows, SCHEMA))).collect()}
    own = {r["conv_id"]: bytes(r["seq"]) for r in trie.sequences(spark.createDataFrame(rows, SCHEMA)).collect()}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6 * trie.WIDTH
        assert got[c] == own.get(c - c % 100, b"")[:h] + own[c][h:]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables are not here")
def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op13_prefix_trie"](spark, folder).toPandas()
    assert differences(got, connect(folder).execute(SQL["op13_prefix_trie"]).df()) is None
