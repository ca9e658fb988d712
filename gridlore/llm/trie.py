"""The prefix trie of conversations, built as a burst trie.

A turn's id is WIDTH bytes: the md5 of its role and text and, so that a node knows what its text is worth, the number of
code points of the text. A conversation is the ids of its turns laid end to end, so that bytes compare as turns do.

1. Copies of a conversation are one sequence with a count.
2. All sequences lie in one container under the root. A container that holds more turns than CONTAINER is burst: its head
   goes on to the last node that all its sequences share, and they are dealt to new containers by their next turn id.
   A round looks only at sequences that the round before has moved.
3. Containers are dealt to tasks, sorted, and swept: a task keeps the nodes of one container.
4. Heads, the nodes above containers, are summed up from what their containers report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm.text import saved, ship, whole

ship(__name__)

WIDTH = 20
# Turns that a container may hold before it is burst; rounds of bursts, beyond which containers are swept as they are
# (only conversations that go on ever deeper, each one turn longer than the last, come to that); rows that may be
# broadcast; ids that are joined to one text before they are sent on.
CONTAINER, ROUNDS, BROADCAST_ROWS, JOINED = 300_000, 40, 200_000, 20_000


def turn_id(role: Column, text: Column) -> Column:
    """WIDTH bytes that name a turn; a null role or text is an empty one."""
    r, t = whole(role), whole(text)
    name = F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t))
    return F.unhex(F.concat(name, F.lpad(F.hex(F.length(t)), 8, "0")))


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, seq) of every conversation. Turns are ordered by number, a missing one first, turns of one number by
    their id. Rows without a conversation's id take no part. Texts aren't shuffled."""
    named = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("n"), turn_id(F.col(role), F.col(text)).alias("id")).alias("t"))
    listed = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return listed.select("conv_id", F.unhex(F.array_join(F.transform("ts", lambda t: F.hex(t["id"])), "")).alias("seq"))


def _upto(seq: Column, size: Column) -> Column:
    return F.substring(seq, F.lit(1), size)


def _shared(a: Column, b: Column) -> Column:
    """The bytes of the turns that two sequences begin with alike."""
    turns = F.least(F.length(a), F.length(b)) / WIDTH
    alike = lambda n: _upto(a, (n * WIDTH).cast("int")) == _upto(b, (n * WIDTH).cast("int"))
    # halving: lo turns are alike, hi + 1 aren't known to be
    start = F.struct(F.lit(0).cast("long").alias("lo"), turns.cast("long").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("long")
        ok = alike(mid)
        return F.struct(F.when(ok, mid).otherwise(s["lo"]).alias("lo"),
                        F.when(ok, s["hi"]).otherwise(F.greatest(mid - 1, s["lo"])).alias("hi"))

    return (F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve)["lo"] * WIDTH).cast("int")


def contained(distinct: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """distinct (seq, n, first) with `at`, the bytes of the head of its container, and `own`: the sequence ends at a head
    and is in no container."""
    open_, closed = distinct.withColumns({"at": F.lit(0), "own": F.lit(False)}), None
    for _ in range(ROUNDS):
        head = _upto(F.col("seq"), F.col("at"))
        large = saved(open_.where(~F.col("own")).groupBy(head.alias("head")).agg(
            F.count("*").alias("rows"), F.sum((F.length("seq") - F.col("at")) / WIDTH).alias("turns"),
            F.min("seq").alias("low"), F.max("seq").alias("high")).where((F.col("rows") > 1) & (F.col("turns") > limit)).select(
            "head", _shared(F.col("low"), F.col("high")).alias("to")))
        n = large.count()  # each has more than limit turns, so there are few
        if n == 0:
            break
        large = F.broadcast(large) if n <= BROADCAST_ROWS else large
        met = open_.withColumn("head", head).join(large, "head", "left")
        burst = F.col("to").isNotNull() & ~F.col("own")
        still = met.where(~burst).select("seq", "n", "first", "at", "own")
        closed = still if closed is None else closed.union(still)
        size = F.length("seq")
        open_ = saved(met.where(burst).select(
            "seq", "n", "first", F.least(F.col("to") + WIDTH, size).alias("at"), (size == F.col("to")).alias("own")))
    return open_ if closed is None else closed.union(open_)


_NODE = ("top boolean, head binary, path binary, depth long, first long, parent_first long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of containers from their rows (head, seq, n, first), sorted by head and seq."""
    types = [pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 7]
    names = ["top", "head", "path", "depth", "first", "parent_first", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    head, prev, nodes, stack, done = None, b"", [], [], []
    # a node: [digest so far, depth, parent, first, n, children, leaves, saved, code points of its text]

    def close(upto: int) -> None:
        while len(stack) > upto:
            i = stack.pop()
            node = nodes[i]
            node[7] += (node[4] - 1) * node[8]
            node[6] += node[5] == 0
            if node[2] >= 0:
                up = nodes[node[2]]
                up[3] = min(up[3], node[3])
                up[4] += node[4]
                up[5] += 1
                up[6] += node[6]
                up[7] += node[7]

    def finish() -> None:
        close(0)
        for node in nodes:
            up = node[2]
            done.append((up < 0, head if up < 0 else None, node[0].digest(), node[1], node[3],
                         None if up < 0 else nodes[up][3], *node[4:8]))
        nodes.clear()

    def out() -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * len(names)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        for own, seq, n, first in zip(*(c.to_pylist() for c in batch.columns)):
            if own != head:
                finish()
                head, prev = own, None
            base = len(head)
            if prev is None:
                size = base
                last = int.from_bytes(head[-4:], "big") if head else 0
                nodes.append([hashlib.md5(head), base // WIDTH, -1, first, 0, 0, 0, 0, last])
                stack.append(0)
            else:
                size, most = base, min(len(prev), len(seq))
                while size < most and prev[size:size + WIDTH] == seq[size:size + WIDTH]:
                    size += WIDTH
                close(1 + (size - base) // WIDTH)
            for at in range(size, len(seq), WIDTH):
                up = stack[-1]
                name = nodes[up][0].copy()
                name.update(seq[at:at + WIDTH])
                stack.append(len(nodes))
                nodes.append([name, at // WIDTH + 1, up, first, 0, 0, 0, 0, int.from_bytes(seq[at + 16:at + 20], "big")])
            end = nodes[stack[-1]]
            end[4] += n
            end[3] = min(end[3], first)
            prev = seq
            if len(done) > 50_000:
                yield out()
    finish()
    yield out()


@dataclass
class Trie:
    """nodes: a row for each node, named by node_id, the md5 of its turns' ids; parent_id is null for the root alone.
    ends: (node_id, conv_id), the node at which each conversation ends."""

    nodes: DataFrame
    ends: DataFrame


def prefix_trie(convs: DataFrame, limit: int = CONTAINER) -> Trie:
    """The trie of convs (conv_id integer, seq: see sequences).

    Nodes have conv_id, the least member, depth, parent_conv_id, n_convs (members), n_children, n_leaves, saved_tokens
    (code points that members needn't repeat, over the subtree) and the code points of their own text. Equal
    conversations end at one node. An empty sequence ends at the root; no conversations, no nodes. A row with a null
    id or seq takes no part. What a task holds are the nodes of a container, and a conversation's ids (not its texts).
    """
    convs = saved(convs.where("conv_id IS NOT NULL AND seq IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "seq"))
    ends = convs.select(F.unhex(F.md5("seq")).alias("node_id"), "conv_id")
    distinct = saved(convs.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("first")))
    placed = saved(contained(distinct, limit).withColumn("head", _upto(F.col("seq"), F.col("at"))))
    swept = saved(placed.where("NOT own").select("head", "seq", "n", "first").repartition("head")
                  .sortWithinPartitions("head", "seq").mapInArrow(_sweep, _NODE))
    tops = swept.where("top").withColumn("parent", _upto(F.col("head"), F.length("head") - WIDTH))
    # what each head gets from right below it, then what it gets from all below
    near = tops.where(F.length("head") > 0).select(
        F.col("parent").alias("at"), "first", "n_convs", F.lit(1).alias("kids"), "n_leaves", "saved_tokens")
    near = near.union(placed.where("own").select(F.col("seq").alias("at"), "first", F.col("n").alias("n_convs"), F.lit(0), F.lit(0), F.lit(0)))
    sums = [F.min("first").alias("first"), *(F.sum(c).alias(c) for c in ("n_convs", "kids", "n_leaves", "saved_tokens"))]
    near = near.groupBy("at").agg(*sums)
    above = lambda: F.explode(F.sequence(F.lit(0), F.length("at"), F.lit(WIDTH))).alias("size")
    far = near.select("at", "first", "n_convs", "kids", "n_leaves", "saved_tokens", above()).select(
        _upto(F.col("at"), F.col("size")).alias("path"), "first", "n_convs",
        F.when(F.col("size") == F.length("at"), F.col("kids")).otherwise(0).alias("kids"), "n_leaves", "saved_tokens")
    heads = saved(far.groupBy("path").agg(*sums).withColumn("worth", _points(F.col("path")) * (F.col("n_convs") - 1)))
    worth = heads.select("worth", F.col("path").alias("at")).select("worth", "at", above()).select(
        _upto(F.col("at"), F.col("size")).alias("path"), "worth")
    none = F.lit(0).cast("long")
    more = worth.select("path", "worth", none.alias("kids")).union(heads.where(F.length("path") > 0).select(
        _upto(F.col("path"), F.length("path") - WIDTH), none, F.lit(1)))
    more = more.groupBy("path").agg(F.sum("worth").alias("more_saved"), F.sum("kids").alias("more_kids"))
    heads = saved(heads.join(more, "path").select(
        "path", "first", "n_convs", (F.col("kids") + F.col("more_kids")).alias("n_children"), "n_leaves",
        (F.col("saved_tokens") + F.col("more_saved")).alias("saved_tokens")))
    up = heads.select(F.col("path").alias("parent"), F.col("first").alias("parent_conv_id"))
    if heads.count() <= BROADCAST_ROWS:
        up = F.broadcast(up)
    named = lambda rows: rows.select(
        F.unhex(F.md5("path")).alias("node_id"), (F.length("path") / WIDTH).cast("long").alias("depth"), F.col("first").alias("conv_id"),
        "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    columns = ["node_id", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    own = heads.withColumn("parent", F.when(F.length("path") > 0, _upto(F.col("path"), F.length("path") - WIDTH)))
    inner = swept.select(F.col("path").alias("node_id"), "depth", F.col("first").alias("conv_id"), F.col("parent_first").alias("parent_conv_id"),
                         "n_convs", "n_children", "n_leaves", "saved_tokens", "top", "head")
    first = inner.where("top").withColumn("parent", F.when(F.length("head") > 0, _upto(F.col("head"), F.length("head") - WIDTH)))
    first = first.drop("parent_conv_id").join(up, "parent", "left")
    nodes = inner.where("NOT top").select(*columns).union(first.select(*columns)).union(named(own.join(up, "parent", "left")))
    return Trie(nodes, ends)


def _points(path: Column) -> Column:
    """The code points of the text of a node's last turn; 0 for the root."""
    size = F.length(path)
    return F.when(size > 0, F.conv(F.hex(F.substring(path, size - 3, F.lit(4))), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node_id, ends_sha256): the SHA-256 of each node's conversations, ascending and comma-joined.

    Ids are sorted over all tasks and joined to texts of JOINED ids there, so that a node at which very many
    conversations end is spread out; the digest itself goes over those texts one after the other.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            rows: list[tuple] = []
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (n != node or len(ids) >= JOINED):
                    rows.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = n
                ids.append(c)
            yield batch_of(rows)
        yield batch_of([(node, ids[0], ",".join(map(str, ids)))] if ids else [])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.string())],
                                          names=["node_id", "least", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            got: list[tuple] = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n == node:
                    sha.update(b",")
                else:
                    if sha is not None:
                        got.append((node, sha.hexdigest()))
                    node, sha = n, hashlib.sha256()
                sha.update(ids.encode())
            yield done(got)
        yield done([(node, sha.hexdigest())] if sha is not None else [])

    def done(rows: list[tuple]) -> pa.RecordBatch:
        a, b = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.string())], names=["node_id", "ends_sha256"])

    texts = ends.repartitionByRange("node_id", "conv_id").sortWithinPartitions("node_id", "conv_id").mapInArrow(
        join, "node_id binary, least long, ids string")
    return texts.repartition("node_id").sortWithinPartitions("node_id", "least").mapInArrow(
        digest, "node_id binary, ends_sha256 string")
