"""Exact n-gram Jaccard join: keys find what may link, signature trees compare what the keys leave open.

1. Each text becomes a set of hashed word shingles. Equal sets are one node, named by a 64-bit digest.
2. Sets that may link share a key: hash space is cut into more segments than two linking sets can differ in, so one
   segment holds the same shingles in both (an exact pigeonhole, no cap and no chance). Nodes that share a key are tied
   to the least of them: as many ties as members, never all pairs. Keys are made of shingles that few sets hold, as far as
   these do (a sample says which many hold, which orders shingles and changes no result).
3. Ties that the sets' bitmaps rule out are no links. The others are verified on the sets: one for each node first, then
   those between components that are still apart. Most groups of copies are settled by that.
4. A key whose members lie in several components after that is open. Few members are paired, those of different
   components and of sizes that may link, and go the way of ties. Among many, and only between different components, two
   signature trees are walked together: nodes hold OR-combined bitmaps and size ranges and are left as soon as the
   largest possible overlap is too small. A key's members are cut into parts of bounded size, by size and by hash. They
   are walked on the bitmaps first; only the sets of nodes that may have a partner are dealt and compared.
Sets are made from the texts where they are needed, and moved only for nodes that may have a link.
Hashes are 64-bit; that two shingles or sets share one is left to chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm.text import ascii_lower, saved, ship, whole, words

ship(__name__)

WIDTH, PERCENT = 4, 85
# Nodes, and bytes of their sets, that one task compares with as many others; rows that may be broadcast (24 bytes
# each); pairs of tree nodes that are tried at once; members of a hot centre that one task verifies; edges in one task.
PART, PART_BYTES, BROADCAST_ROWS, AT_ONCE, PER_SALT, EDGES = 20_000, 24_000_000, 300_000, 200_000, 512, 250_000
# Words that are made into sets at once, keys that are sent at once, and nodes or digests that a task remembers.
WORDS, KEYS, REMEMBERED = 250_000, 500_000, 300_000
BITS, FAN = 4096, 8
# Members of an open key that are paired; more are compared by trees.
PAIRED = 64
# A shingle is common if COMMON_FROM of each SAMPLED-th text hold it; only so many are told to the tasks, the most common.
SAMPLED, COMMON_FROM, COMMON = 32, 3, 500_000
# Sizes of neighbouring classes and bands differ by these factors, or by more where linking sets may (see _factor).
CLASS, BAND = 1.4, 1.2


def hashed_words(text: Column) -> Column:
    """Hashes of the words between blanks, A-Z lower-cased."""
    return F.transform(words(ascii_lower(whole(text))), lambda w: F.xxhash64(w))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]], ends - ends[0]


def shingle_sets(lists: pa.Array, width: int) -> list[np.ndarray]:
    """For each list of word hashes its sorted distinct shingles; a list shorter than width is one shingle."""
    values, ends = _flat(lists)
    values = values.astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(values), np.uint64)
        for k in range(width):
            moved = np.zeros(len(values), np.uint64)
            moved[:max(0, len(values) - k)] = values[k:]
            rolled = _mix(rolled * np.uint64(0x9E3779B97F4A7C15) + moved + np.uint64(k + 1))
        for a, b in zip(ends[:-1], ends[1:]):
            if b - a >= width:
                out.append(np.unique(rolled[a:b - width + 1]))
            elif b > a:
                one = np.uint64(b - a)
                for v in values[a:b]:
                    one = _mix(np.array([one * np.uint64(0x9E3779B97F4A7C15) + v]))[0]
                out.append(np.array([one]))
            else:
                out.append(np.array([], np.uint64))
    return out


def _portions(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose lists in column k hold WORDS items or are a single one, so that what is made of them at once
    stays small however long the texts are."""
    ends, start = batch.column(k).offsets.to_numpy(), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + WORDS, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _factor(least: float, percent: int) -> float:
    """least, or what the sizes of linking sets may differ by (100/percent) and a margin for rounding, so that linking
    sets lie in the same class or in neighbouring ones."""
    return max(least, 1.01 * 100 / percent)


class Common:
    """Shingles that many sets hold, and their places in an order from the least common on."""

    def __init__(self, shingles: np.ndarray):
        """shingles: in that order."""
        by = np.argsort(shingles)
        self.shingles, self.places = shingles[by], by
        self.may = np.zeros(1 << 20, bool)
        self.may[self.shingles >> np.uint64(44)] = True

    def split(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of s that aren't common, as they were, and those that are, the least common first."""
        own = np.flatnonzero(self.may[s >> np.uint64(44)])
        if not len(own):
            return s, s[:0]
        at = np.searchsorted(self.shingles, s[own])
        at[at == len(self.shingles)] = 0
        found = self.shingles[at] == s[own]
        return np.delete(s, own[found]), s[own[found]][np.argsort(self.places[at[found]])]


def segment_keys(s: np.ndarray, percent: int, common: Common | None = None) -> np.ndarray:
    """Keys such that two different sets that link share one.

    Sizes fall into classes up to U, each CLASS times the one before, or more for a low percent (_factor). Linking sets lie in the same class or in neighbouring
    ones, so a set gets the keys of its own class, and of the next if a partner can be there. Sets of at most U differ in
    at most H = 2U(100-p)/(100+p) shingles; of H + 1 + x segments at least 1 + x are equal. A set with more than x empty
    segments also gets its prefix as keys, since its equal segments may all be empty; a partner whose equal segments are
    all empty has as many, and linking sets share a shingle of their prefixes.
    Segments hold the shingles that aren't common: of these, linking sets don't differ in more. Prefixes take common ones
    last, from the least common on.
    """
    n, keys, factor = len(s), [], _factor(CLASS, percent)
    rare, late = common.split(s) if common else (s, s[:0])
    own = int(np.ceil(np.log(n) / np.log(factor) - 1e-9)) if n > 1 else 0
    classes = [own] + ([own + 1] if n * 100 > int(factor ** own + 1e-6) * percent - 100 else [])
    with np.errstate(over="ignore"):
        mixed = _mix(rare)
        for c in classes:
            largest = max(1, int(factor ** c + 1e-6))
            h = 2 * largest * (100 - percent) // (100 + percent)
            x = 1 + h // 16
            count = h + 1 + x
            at = ((rare >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), at[1:] != at[:-1])))
            seed = _mix(np.array([c * 1_000_003 + 1], np.uint64))
            if len(first):
                keys.append(_mix(np.add.reduceat(mixed, first) + _mix(at[first] + seed)))
            if count - len(first) > x:
                prefix = np.concatenate([rare, late])[:n - -(-n * percent // 100) + 1]
                keys.append(_mix(prefix + _mix(seed + np.uint64(7))))
    return np.concatenate(keys).view(np.int64)


def _digest(s: np.ndarray) -> int | None:
    """The name of a set; None for an empty one."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def _rows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, uid (a hash of the text), n (set size) and node (null for an empty set)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, 2):
                sets = shingle_sets(part.column(2), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_digest(s) for s in sets], pa.int64())], names=["id", "uid", "n", "node"])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(whole(F.col(text_col))).alias("uid"),
                       hashed_words(F.col(text_col)).alias("h")).mapInArrow(run, f"id {id_type}, uid long, n long, node long")


def _common(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """The common shingles, from the least common on: of each SAMPLED-th different text those that COMMON_FROM hold. They
    order shingles, so that sets meet at rare ones; whichever are named here, linking sets share a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, 0):
                sets = shingle_sets(part.column(0), width)
                s, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.array([], np.uint64), np.array([], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], names=["s", "n"])

    text = whole(F.col(text_col))
    some = docs.select(F.xxhash64(text).alias("uid"), text.alias("t")).where(F.pmod("uid", F.lit(SAMPLED)) == 0).dropDuplicates(["uid"])
    held = some.select(hashed_words(F.col("t")).alias("h")).mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    most = held.where(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "s").limit(COMMON).select("s").toArrow()
    return most.column("s").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[::-1].copy()


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node) in order, (a, b, k): a key's least node with each other one. k: the key, null if only two nodes
    have it."""
    # of the last key: its least node and second one, held back; or, if it has more, its least node and last one, sent
    k, b, more = np.array([], np.int64), np.array([], np.int64), False
    for batch in chain(batches, [None]):
        if batch is not None:
            k, b = (np.concatenate([x, batch.column(c).to_numpy()]) for c, x in enumerate((k, b)))
        if not len(k):
            continue
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (b[1:] != b[:-1])))
        k, b = k[new], b[new]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        sizes = np.diff(np.append(first, len(k)))
        many = sizes > 2
        many[0] |= more
        sent = np.ones(len(k), bool)
        sent[first] = False
        if more:
            sent[1] = False
        if batch is not None and not many[-1]:
            sent[first[-1]:] = False
        centre, each = np.repeat(b[first], sizes), np.repeat(many, sizes)
        two, all_of = sent & ~each, sent & each
        pairs = np.unique(np.stack([centre[two], b[two]], 1), axis=0) if two.any() else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([pairs[:, 0], centre[all_of]])), pa.array(np.concatenate([pairs[:, 1], b[all_of]])),
             pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(k[all_of])])], names=["a", "b", "k"])
        more, start = bool(many[-1]), first[-1]
        kept = [start, -1] if more else slice(start, None)
        k, b = k[kept], b[kept]


def _keyed(docs: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """(a, b, k): the nodes of each key, as _starred has them. Keys are made on the way to the shuffle and written nowhere
    else; common shingles come last, so that few of them are those of many nodes."""
    names = _common(docs, text_col, width)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Common(names) if len(names) else None
        emitted: set[int] = set()
        keys, nodes, held = [], [], 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(
                np.array(nodes, np.int64), [len(x) for x in keys]))], names=["k", "node"])

        for batch in batches:
            for part in _portions(batch, 0):
                for s in shingle_sets(part.column(0), width):
                    node = _digest(s)
                    if node is not None and node not in emitted:
                        keys.append(segment_keys(s, percent, common))
                        nodes.append(node)
                        held += len(keys[-1])
                        if len(emitted) < REMEMBERED:
                            emitted.add(node)
                    if held >= KEYS:
                        yield sent()
                        keys, nodes, held = [], [], 0
        if keys:
            yield sent()

    keyed = docs.select(hashed_words(F.col(text_col)).alias("h")).mapInArrow(local, "k long, node long")
    return keyed.repartition("k").sortWithinPartitions("k", "node").mapInArrow(_starred, "a long, b long, k long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each node of one task's edges with the least node that these edges reach from it."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while (up := parent[x]) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = root(a), root(b)
            if p != q:
                parent[max(p, q)] = min(p, q)
    pairs = [(x, root(x)) for x in parent]
    found = np.array([x for x in pairs if x[0] != x[1]], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])


def _with_roots(stars: DataFrame) -> DataFrame:
    """(node, root) of the edges (u, v) from each node to its root, with the roots themselves."""
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the connected component, for nodes of the saved edges (a, b). Each task
    joins what it can of its EDGES edges; where there is more than one task, large and small stars alternate over what
    is left until nothing changes, written to the checkpoint folder each round."""
    edges = edges.where("a <> b").select("a", "b")
    tasks = 1 + edges.count() // EDGES  # few edges don't need a file for each shuffle partition
    edges = edges.coalesce(tasks).mapInArrow(_forest, "u long, v long")
    if tasks == 1:
        return _with_roots(saved(edges))
    edges = saved(edges.distinct().coalesce(tasks))
    n = edges.count()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(both.where("v < u").join(least, "u").where("v = m").select("u", "v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = saved(small.where("u <> v").distinct().coalesce(tasks))
        # both tables hold different rows, so equal counts and nothing new mean the same edges
        before, n = n, after.count()
        if n == before and not after.join(edges, ["u", "v"], "left_anti").head(1):
            return _with_roots(after)
        edges = after


def bitmap(s: np.ndarray) -> np.ndarray:
    """BITS bits, those that a set's shingles fall on."""
    bits = np.zeros(BITS, bool)
    bits[(s >> np.uint64(13)) & np.uint64(BITS - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _bitmaps(cells) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.uint64).reshape(-1, BITS // 64)


def _written(sets: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([s.tobytes() for s in sets], pa.binary())]


def _signs(sets: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())]


def _signed(sets: DataFrame) -> DataFrame:
    """(node, n, bits) of sets (node, s)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_signs(own)], names=["node", "n", "bits"])

    return sets.select("node", "s").mapInArrow(run, "node long, n long, bits binary")


def _of_nodes(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int, signs: bool = False) -> DataFrame:
    """(node, s): the sorted set, as bytes, of one document for each node of wanted (node, id, uid); or its signs (node, n,
    bits). They are dealt anew only where rows repeat id and text."""
    n, make = wanted.count(), _signs if signs else _written
    names = ["node", "n", "bits"] if signs else ["node", "s"]
    wanted = wanted.select("node", "id", "uid")
    if n <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    base = docs.select(F.col(id_col).alias("__id"), F.xxhash64(whole(F.col(text_col))).alias("__uid"), F.col(text_col).alias("__text"))
    met = base.join(wanted, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__uid") == F.col("uid")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for node in batch.column(0).to_pylist():
                fresh.append(node not in seen)
                if len(seen) < REMEMBERED:
                    seen.add(node)
            for part in _portions(batch.filter(pa.array(fresh, pa.bool_())), 1):
                yield pa.RecordBatch.from_arrays([part.column(0), *make(shingle_sets(part.column(1), width))], names=names)

    found = saved(met.select("node", hashed_words(F.col("__text")).alias("h")).mapInArrow(
        run, "node long, n long, bits binary" if signs else "node long, s binary"))
    return found if found.count() == n else saved(found.dropDuplicates(["node"]))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are alike enough."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(ties: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ties (a, b) that are links. A set goes once to the nodes' join and once to its centre, which comes first there;
    a centre with many ties is copied as often as its ties are split."""
    salts = ties.groupBy("a").agg((F.count("*") / PER_SALT + 1).cast("int").alias("salts"))
    split = ties.join(salts, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    centres = salts.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    met = sets.join(split.union(centres), "node").select("a", "salt", (F.col("node") != F.col("a")).alias("late"), F.col("node").alias("b"), "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, centre = None, None  # a centre's ties may go on in the next batch
        for batch in batches:
            left, right = [], []
            for a, late, b, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                own = np.frombuffer(s.as_buffer(), np.uint64)
                if not late:
                    of, centre = a, own.copy()
                elif of == a and linked(centre, own, percent):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return met.repartition("a", "salt").sortWithinPartitions("a", "salt", "late").mapInArrow(run, "a long, b long")


def _possible(ties: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ties (a, b) that the sets' bitmaps don't rule out, with sizes na and nb: two sets share at most the bits that
    both have set and the shingles that fall together on bits. Bitmaps are moved in place of sets. sets: (node, s), or
    their signs (node, n, bits)."""
    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                na, nb = (part.column(k).to_numpy() for k in (2, 4))
                a, b = (_bitmaps(part.column(k).to_pylist()) for k in (3, 5))
                count = lambda x: np.bitwise_count(x).sum(1, dtype=np.int64)
                most = count(a & b) + np.minimum(na - count(a), nb - count(b))
                yield part.select([0, 1, 2, 4]).filter(pa.array((100 + percent) * most >= percent * (na + nb)))

    signed = sets if "bits" in sets.columns else saved(_signed(sets))
    side = lambda x: signed.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("bits").alias("bits" + x))
    met = ties.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "bitsa", "nb", "bitsb")
    return met.mapInArrow(rule_out, "a long, b long, na long, nb long")


class SignatureTree:
    """Levels of nodes over sets ordered by size and bitmap: each node has the OR of its bitmaps, its least and largest
    size, the most shingles that fall together on bits in one of its sets, and its component if it has only one."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        self.order = np.lexsort((bits[:, 0], comps, sizes))
        bits, sizes, comps = bits[self.order], sizes[self.order], comps[self.order]
        spare = sizes - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, sizes, sizes, spare, comps, comps)]
        while len(bits) > 1:
            starts = np.arange(0, len(bits), FAN)
            bits, low, high, spare, c0, c1 = self.levels[-1]
            bits = np.bitwise_or.reduceat(bits, starts)
            self.levels.append((bits, np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts),
                                np.maximum.reduceat(spare, starts), np.minimum.reduceat(c0, starts), np.maximum.reduceat(c1, starts)))

    @classmethod
    def of(cls, sets: list[np.ndarray], comps: np.ndarray) -> SignatureTree:
        bits = np.array([bitmap(s) for s in sets], np.uint64).reshape(len(sets), BITS // 64)
        return cls(bits, np.array([len(s) for s in sets], np.int64), comps)

    def may_link(self, other: SignatureTree, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes of a level can hold a link between different components."""
        a, low_a, high_a, spare_a, c0, c1 = self.levels[min(level, len(self.levels) - 1)]
        b, low_b, high_b, spare_b, d0, d1 = other.levels[min(level, len(other.levels) - 1)]
        ok = (high_a[i] * 100 >= percent * low_b[j]) & (high_b[j] * 100 >= percent * low_a[i])
        ok &= ~((c0[i] == c1[i]) & (d0[j] == d1[j]) & (c0[i] == d0[j]))
        kept = np.flatnonzero(ok)
        for x in range(0, len(kept), 8192):
            part = kept[x:x + 8192]
            most = np.bitwise_count(a[i[part]] & b[j[part]]).sum(1) + np.minimum(spare_a[i[part]], spare_b[j[part]])
            ok[part] = (100 + percent) * most >= percent * (low_a[i[part]] + low_b[j[part]])
        return ok


def _walk(ta: SignatureTree, tb: SignatureTree, percent: int, settled=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) in the trees' orders of sets whose bitmaps don't rule a link out, a few at a time; of one tree with
    itself, each pair once. The trees are walked together from their roots. Of the pairs of a level only so many go down
    at once as make AT_ONCE below; the others wait as they are. settled(level, i, j): pairs that need no look."""
    depth, most = max(len(ta.levels), len(tb.levels)) - 1, max(1, AT_ONCE // FAN ** 2)
    stack = [(depth, np.array([0]), np.array([0]), True)]
    while stack:
        level, i, j, fresh = stack.pop()
        if fresh and ta is tb:
            upper = i <= j
            i, j = i[upper], j[upper]
        if settled is not None:
            left = ~settled(level, i, j)
            i, j = i[left], j[left]
        if fresh:
            ok = ta.may_link(tb, level, i, j, percent)
            i, j = i[ok], j[ok]
        if level == 0:
            yield i, j
            continue
        if len(i) > most:
            stack.append((level, i[most:], j[most:], False))
            i, j = i[:most], j[:most]
        down = []
        for tree, at in ((ta, i), (tb, j)):
            if level > len(tree.levels) - 1:
                down.append((at[:, None], np.ones((len(at), 1), bool)))
            else:
                kids = at[:, None] * FAN + np.arange(FAN)
                down.append((kids, kids < len(tree.levels[level - 1][0])))
        (a, oka), (b, okb) = down
        both = oka[:, :, None] & okb[:, None, :]
        stack.append((level - 1, np.broadcast_to(a[:, :, None], both.shape)[both], np.broadcast_to(b[:, None, :], both.shape)[both], True))


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, cl: np.ndarray, cr: np.ndarray | None,
               percent: int) -> list[tuple[int, int]]:
    """Links between components, enough of them to join all that are linked: both trees are walked together, and pairs of
    sets whose components have met already aren't compared. right None: left with itself."""
    sets_b, cb = (left, cl) if right is None else (right, cr)
    if not len(left) or not len(sets_b):
        return []
    ta = SignatureTree.of(left, cl)
    tb = ta if right is None else SignatureTree.of(right, cr)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in _walk(ta, tb, percent):
        for x, y in zip(ta.order[i], tb.order[j]):
            p, q = root(int(cl[x])), root(int(cb[y]))
            if p != q and linked(left[x], sets_b[y], percent):
                parent[p] = q
                out.append((int(cl[x]), int(cb[y])))
    return out


class _Found:
    """Which nodes of a tree have a possible partner, for its leaves and, at each level, whether all below it have."""

    def __init__(self, tree: SignatureTree):
        self.levels = [np.zeros(len(level[0]), bool) for level in tree.levels]

    def add(self, at: np.ndarray) -> None:
        self.levels[0][at] = True
        for k in range(1, len(self.levels)):
            self.levels[k] = np.logical_and.reduceat(self.levels[k - 1], np.arange(0, len(self.levels[k - 1]), FAN))

    def at(self, level: int, i: np.ndarray) -> np.ndarray:
        return self.levels[min(level, len(self.levels) - 1)][i]


def tree_partners(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets of each side (bitmaps, sizes, components) may link with one of the other side in another component, by
    bitmaps alone; pairs of which both are known to aren't looked at. right None: left with itself."""
    if not len(left[1]) or right is not None and not len(right[1]):
        return np.zeros(len(left[1]), bool), np.zeros(0 if right is None else len(right[1]), bool)
    ta = SignatureTree(*left)
    tb = ta if right is None else SignatureTree(*right)
    fa = _Found(ta)
    fb = fa if right is None else _Found(tb)
    for i, j in _walk(ta, tb, percent, lambda level, i, j: fa.at(level, i) & fb.at(level, j)):
        if len(i):
            fa.add(i)
            fb.add(j)
    out = []
    for tree, found in ((ta, fa), (tb, fb)):
        own = np.zeros(len(tree.order), bool)
        own[tree.order] = found.levels[0]
        out.append(own)
    return out[0], out[1]


def _apart(ties: DataFrame, roots: DataFrame) -> DataFrame:
    """The ties (a, b) whose ends lie in different components."""
    named = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias("r" + side))
    met = ties.join(named("a"), "a", "left").join(named("b"), "b", "left")
    return met.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _open(ties: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame | None:
    """(node, n, comp, block) of the nodes in blocks that ties hold together though verified ones don't, where a block has
    all nodes of its components; None if no tie is left open. sizes: (node, n) of the sets. Of ties (a, b, k) a block has
    the nodes of a key k, and no others."""
    named = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias("r" + side))
    root = lambda side: F.coalesce("r" + side, side)
    met = ties.join(named("a"), "a", "left").join(named("b"), "b", "left")
    if "k" in ties.columns:
        met = met.where("k IS NOT NULL").select("k", "a", "b", root("a").alias("ca"), root("b").alias("cb"))
        apart = met.groupBy("k").agg(F.max(F.col("ca") != F.col("cb")).alias("apart")).where("apart").select("k")
        met = saved(met.join(apart, "k"))
        if not met.head(1):
            return None
        # a centre comes once with each of its ties
        nodes = met.select("k", F.col("b").alias("node"), F.col("cb").alias("comp")).union(
            met.groupBy("k").agg(F.first("a").alias("node"), F.first("ca").alias("comp")))
        return saved(nodes.join(sizes, "node").select("node", "n", "comp", F.col("k").alias("block")))
    left = saved(met.select(root("a").alias("a"), root("b").alias("b")).where("a <> b").distinct())
    if not left.head(1):
        return None
    blocks = components(left)
    nodes = sizes.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("comp"))
    return saved(nodes.join(blocks.select(F.col("node").alias("comp"), F.col("root").alias("block")), "comp").select(
        "node", "n", "comp", "block"))


def _paired(nodes: DataFrame, percent: int) -> DataFrame:
    """The different pairs (a, b, na, nb) of nodes (node, n, comp, block) of a block that lie in different components and are
    of sizes that may link; without the pairs of a block's least node, which were its ties."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.array([], np.int64) for _ in range(4)]  # a block may go on in the next batch
        for batch in chain(batches, [None]):
            if batch is not None:
                held = [np.concatenate([x, batch.column(c).to_numpy()]) for c, x in enumerate(held)]
            block, node, n, comp = held
            upto = len(block) if batch is None or not len(block) else int(np.searchsorted(block, block[-1]))
            held = [x[upto:] for x in held]
            block, node, n, comp = block[:upto], node[:upto], n[:upto], comp[:upto]
            tied, found, d = np.concatenate(([True], block[1:] != block[:-1])) if upto else np.array([], bool), [], 1
            while d < upto and (same := block[d:] == block[:-d]).any():
                i = np.flatnonzero(same & ~tied[:-d] & (comp[d:] != comp[:-d]) & (
                    np.minimum(n[d:], n[:-d]) * 100 >= np.maximum(n[d:], n[:-d]) * percent))
                found.append(np.stack([node[i], node[i + d], n[i], n[i + d]], 1))
                d += 1
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, c]) for c in range(4)], names=["a", "b", "na", "nb"])

    rows = nodes.select("block", "node", "n", "comp").repartition("block").sortWithinPartitions("block", "node")
    return rows.mapInArrow(run, "a long, b long, na long, nb long").distinct()


def _dealt(nodes: DataFrame, held: DataFrame, weight: Column, percent: int):
    """The rows of held for nodes (node, n, comp, block), grouped by what one task compares: a part of a block's band of
    size with itself (p is -1 - q), or two parts (sides 0 and 1). weight: bytes of a row. Where a row has to go is found
    by ids and sizes alone."""
    # bands of size: linking sets lie in the same band or in neighbouring ones
    nodes = saved(nodes.withColumn("band", F.floor(F.log("n") / F.log(F.lit(_factor(BAND, percent)))).cast("int")))
    # a block that one task can hold is one band of its own, to which each set goes once
    whole = saved(nodes.groupBy("block").agg(((F.count("*") <= PART) & (F.sum(weight) <= PART_BYTES)).alias("whole")).where("whole"))
    nodes = nodes.join(F.broadcast(whole) if whole.count() <= BROADCAST_ROWS else whole, "block", "left").withColumn(
        "band", F.when(F.col("whole"), -1).otherwise(F.col("band"))).drop("whole")
    parts = nodes.groupBy("block", "band").agg(
        (F.greatest(F.count("*") / PART, F.sum(weight) / PART_BYTES) + 1).cast("int").alias("parts"))
    near = parts.select("block", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    below = parts.select("block", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    plan = parts.join(near, ["block", "band"], "left").join(below, ["block", "band"], "left")
    # a row for each block and band, broadcast where they are few: a block may hold a third of all nodes
    plan = saved(plan)
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    own = nodes.join(plan, ["block", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    turn = lambda band, p, q, side: F.struct(band.alias("band"), p.alias("p"), q.alias("q"), F.lit(side).alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    none = F.array().cast("array<struct<band:int,p:int,q:int,side:int>>")
    part, band = F.col("part"), F.col("band")
    # negative p marks the meeting of two parts of one band; else p is of the lower band and q of the upper
    same = F.transform(upto(F.col("parts")), lambda q: F.struct(
        band.alias("band"), (-1 - F.least(part, q)).alias("p"), F.greatest(part, q).alias("q"), F.when(part <= q, 0).otherwise(1).alias("side")))
    up = F.when(F.col("above").isNotNull(), F.transform(upto(F.col("above")), lambda q: turn(band, part, q, 0))).otherwise(none)
    down = F.when(F.col("below").isNotNull(), F.transform(upto(F.col("below")), lambda p: turn(band - 1, p, part, 1))).otherwise(none)
    turns = own.select("node", "block", "comp", F.concat(same, up, down).alias("turns"))
    dealt = held.join(turns, "node").withColumn("t", F.explode("turns")).select("block", "comp", *held.columns, "t.*")
    return dealt.groupBy("block", "band", "p", "q")


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame | None] | None:
    """What a group of `_dealt` compares: two parts, one with itself, or nothing if a part met none."""
    left, right = (pdf[pdf["side"] == k] for k in (0, 1))
    if len(right):
        return left, right
    return (left, None) if pdf["p"].iloc[0] == -1 - pdf["q"].iloc[0] else None


def _partners(nodes: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The nodes that may link with one of their block in another component, by their bitmaps alone."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.array([], np.int64)
        if (sides := _sides(pdf)) is not None:
            left, right = sides
            held = lambda x: (_bitmaps(x["bits"]), x["n"].to_numpy(np.int64), x["comp"].to_numpy(np.int64))
            a, b = tree_partners(held(left), None if right is None else held(right), percent)
            found = left["node"].to_numpy(np.int64)[a]
            if right is not None:
                found = np.concatenate([found, right["node"].to_numpy(np.int64)[b]])
        return pd.DataFrame({"node": found})

    return _dealt(nodes, signed, F.lit(BITS // 8 + 32), percent).applyInPandas(run, "node long").distinct()


def _open_links(ties: DataFrame, roots: DataFrame, sizes: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame],
                percent: int, signed: DataFrame | None = None) -> DataFrame | None:
    """Links (a, b) between components that verified ties don't join; None if no tie is left open or none may link.
    sizes: (node, n) of the sets; sets: (node, s), or what makes them for some nodes; signed: (node, n, bits). Blocks are
    walked on the bitmaps first, then those nodes compare their sets that may have a partner."""
    nodes = _open(ties, roots, sizes)
    return None if nodes is None else _block_links(nodes, sets, percent, signed)


def _block_links(nodes: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame], percent: int,
                 signed: DataFrame | None = None) -> DataFrame | None:
    """Links (a, b) between different components of a block of nodes (node, n, comp, block); None if none may link."""
    signed = saved(_signed(sets)) if signed is None else signed
    wanted = saved(_partners(nodes, signed, percent))
    if not wanted.head(1):
        return None
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    sets = sets(wanted) if callable(sets) else sets

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        if (sides := _sides(pdf)) is not None:
            read = lambda x: [np.frombuffer(s, np.uint64) for s in x["s"]]
            left, right = sides
            comps = left["comp"].to_numpy(np.int64), None if right is None else right["comp"].to_numpy(np.int64)
            found = tree_links(read(left), None if right is None else read(right), *comps, percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return _dealt(nodes.join(few, "node"), sets, F.col("n") * 8, percent).applyInPandas(run, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """id, uid, n, component_id and keeper (whether the row has the least id of its component, nulls last)."""
    rows = saved(_rows(docs, id_col, text_col, width))
    keyed = saved(_keyed(docs, text_col, width, percent))
    ties = saved(keyed.select("a", "b").distinct())
    roots = None
    if ties.head(1):
        wanted = ties.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        first = saved(rows.join(wanted, "node").groupBy("node").agg(
            F.min(F.struct("id", "uid")).alias("f"), F.min("n").alias("n")).select("node", "f.*", "n"))
        signed = _of_nodes(docs, first, id_col, text_col, width, signs=True)

        def sets(wanted: DataFrame) -> DataFrame:
            return _of_nodes(docs, saved(first.join(wanted, "node")), id_col, text_col, width)

        # a tie of sizes too far apart is no link; its bitmaps needn't meet
        sized = lambda side: first.select(F.col("node").alias(side), F.col("n").alias("n" + side))
        alike = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        near = saved(_possible(ties.join(sized("a"), "a").join(sized("b"), "b").where(alike), signed, percent))
        links = near.select("a", "b").limit(0)
        if near.head(1):
            tied = sets(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
            # first one tie for each node, that of the nearest sizes; then those whose ends still lie in different components
            chosen = near.groupBy("b").agg(F.min_by("a", F.struct(F.abs(F.col("na") - F.col("nb")), "a")).alias("a")).select("a", "b")
            links = saved(_verified(chosen, tied, percent))
            roots = saved(components(links))
            rest = saved(_apart(near.select("a", "b"), roots).join(chosen, ["a", "b"], "left_anti"))
            if rest.head(1):
                links = links.union(saved(_verified(rest, tied, percent)))
        roots = saved(components(links))
        nodes = _open(keyed, roots, first.select("node", "n"))
        if nodes is not None:
            many = saved(nodes.groupBy("block").count().where(F.col("count") > PAIRED).select("block"))
            large = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
            more = []
            near = saved(_possible(_paired(nodes.join(large, "block", "left_anti"), percent), signed, percent))
            if near.head(1):
                tied = sets(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
                more.append(saved(_verified(near.select("a", "b"), tied, percent)))
            if many.head(1) and (found := _block_links(nodes.join(large, "block"), sets, percent, signed)) is not None:
                more.append(saved(found))
            for found in more:
                links = links.union(found)
            if any(found.head(1) for found in more):
                roots = saved(components(links))
    if roots is not None:
        rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        rows = rows.withColumn("root", F.col("node"))
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")
    least = rows.where("root IS NOT NULL").groupBy(F.col("root").alias("r")).agg(F.min(rank).alias("first"))
    least = saved(least)
    if least.count() <= BROADCAST_ROWS:
        least = F.broadcast(least)
    met = rows.join(least, F.col("root") == F.col("r"), "left")
    return met.select("id", "uid", "n", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
                      (F.col("root").isNull() | ((F.col("first.uid") == F.col("uid")) & F.col("first.id").eqNullSafe(F.col("id")))).alias("keeper"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                       percent: int = PERCENT) -> DataFrame:
    """Per row of docs: the id, n_shingles and component_id, the smallest id reachable by links of at least percent.

    Null and empty texts have no shingles and are linked with nothing. Rows that repeat are one class. A row with a
    null id takes part; its component's id is null only if no row of it has one. An empty table gives no rows.
    """
    found = _grouped(docs, id_col, text_col, width, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that have the smallest id of their component (null ids last, then the
    least hash of the text); of rows that repeat id and text one stays. Rows without shingles all stay."""
    found = saved(_grouped(docs, id_col, text_col, width, percent))
    gone = found.where("NOT keeper").select(F.col("id").alias("__gone_id"), F.col("uid").alias("__gone_uid")).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    uid = F.xxhash64(whole(F.col(text_col)))
    kept = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__gone_id")) & (uid == F.col("__gone_uid")), "left_anti")
    twice = found.where("keeper AND n > 0").groupBy("id", "uid").count().where("count > 1").select(
        F.col("id").alias("__two_id"), F.col("uid").alias("__two_uid"))
    if twice.head(1):
        same = F.col(id_col).eqNullSafe(F.col("__two_id")) & (uid == F.col("__two_uid"))
        kept = kept.join(twice, same, "left_anti").union(kept.join(twice, same, "left_semi").withColumn(
            "__u", uid).dropDuplicates([id_col, "__u"]).drop("__u"))
    return kept
