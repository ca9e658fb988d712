"""Hard negatives by coordinate pruning.

Vectors become integers, so that scores (inner products) are exact. They are laid out by label, then by length from the
longest down, and cut into buckets. A bucket has, for each coordinate, its normalised values in sorted order. For an
anchor q and a bucket:

1. the least score that still matters, over the anchor's length and the bucket's largest, is the least cosine c;
2. if c > 1 the bucket is left out;
3. of the anchor's FOCUS largest coordinates each allows the range of values that a vector within the angle acos(c) of q
   can have there. The narrowest range is read off its sorted list, the others are asked of what it yields, then the
   most that a row can score by its focus coordinates and its length;
4. what is left is verified by exact scores.
Least scores start from a bounded sample of rows that every task compares first, and rise while it goes on.

Anchors are a stated part of the rows. They are sent to the tasks in blocks of bounded size; rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.text import saved, ship

ship(__name__)

# Rows of a bucket; rows of the sample; coordinates of an anchor that prune; bytes of the anchors sent at a time.
BUCKET, SAMPLE, FOCUS, BLOCK_BYTES = 4096, 2048, 4, 32_000_000
# Beyond this inner products may leave 64 bits and are made of Python's integers.
SMALL = 2 ** 24


def fixed_point(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as 64-bit integers, which hold the largest where they are exceeded."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad), F.lit(False))


def laid_out(rows: DataFrame) -> DataFrame:
    """(id, label, q, dim, norm), one row an id (the least by label and vector), by label, dimension and falling length;
    written to the checkpoint folder. Long runs of one length are dealt by id."""
    one = rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.*")
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    order = ["label", "dim", F.desc("norm"), "id"]
    placed = one.select("id", "label", "q", F.size("q").alias("dim"), norm.alias("norm"))
    return saved(placed.repartitionByRange(*order).sortWithinPartitions(*order))


class Best:
    """The k best (score, id) with a score of at most `high` and at least `low`; `low` rises to the k-th score."""

    __slots__ = ("k", "low", "high", "rows")

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high, self.rows = k, low, high, []

    def put(self, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero((scores >= self.low) & (scores <= self.high))
        if len(at) > self.k:
            # the k-th largest score and all its equals; ids decide below
            kth = np.partition(scores[at], len(at) - self.k)[len(at) - self.k]
            at = at[scores[at] > kth].tolist() + sorted(at[scores[at] == kth].tolist(), key=lambda x: ids[x])[:self.k]
        if len(at):
            self.rows = sorted(self.rows + [(int(scores[x]), int(ids[x])) for x in at], key=lambda r: (-r[0], r[1]))[:self.k]
            if len(self.rows) == self.k:
                self.low = max(self.low, self.rows[-1][0])


class Bucket:
    """Rows of one label and dimension with their normalised coordinates in sorted order."""

    def __init__(self, ids: np.ndarray, label, q: np.ndarray, norms: np.ndarray):
        self.ids, self.label, self.q, self.norms = ids, label, q, norms
        self.large = q.size > 0 and int(max(abs(int(q.max())), abs(int(q.min())))) >= SMALL
        self.longest = float(norms.max()) if len(norms) else 0.0
        self.real = q.astype(np.float64)
        self.unit = self.real / np.maximum(norms, 1e-300)[:, None]
        self.orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows by their f-th coordinate, and the coordinates; made when first asked for."""
        if f not in self.orders:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.orders[f] = order, self.unit[order, f]
        return self.orders[f]

    def candidates(self, unit: np.ndarray, focus: np.ndarray, norm: float, least: int) -> np.ndarray | None:
        """The rows that may score `least` against an anchor; None for all of them."""
        if least <= 0 or norm == 0 or self.longest == 0:
            return None if least <= 0 else np.array([], int)
        cosine = least / (norm * self.longest) - 1e-9
        if cosine > 1:
            return np.array([], int)
        angle = np.arccos(cosine)
        own = np.arccos(np.clip(unit[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, own + angle)) - 1e-9
        high = np.cos(np.maximum(0.0, own - angle)) + 1e-9
        places = []
        for f, a, b in zip(focus, low, high):
            values = self.sorted(int(f))[1]
            places.append((np.searchsorted(values, a, "left"), np.searchsorted(values, b, "right")))
        narrow = min(range(len(focus)), key=lambda k: places[k][1] - places[k][0])
        a, b = places[narrow]
        if b - a == len(self.ids):
            return None
        found = self.sorted(int(focus[narrow]))[0][a:b]
        for k, f in enumerate(focus):
            if k != narrow:
                x = self.unit[found, f]
                found = found[(x >= low[k]) & (x <= high[k])]
        # the focus coordinates together, the rest at its best; shorter rows need a wider cosine than the bucket's longest
        part, own = self.unit[np.ix_(found, focus)], unit[focus]
        rest = np.sqrt(np.maximum(0, 1 - (part * part).sum(1)) * max(0.0, 1 - float(own @ own)))
        return found[(part @ own + rest + 1e-9) * self.norms[found] * norm >= least]

    def scores(self, anchor: np.ndarray, real: np.ndarray, large: bool, at: np.ndarray | None) -> np.ndarray:
        """Exact scores: sums of products below 2^53 are exact in floating point."""
        if large or self.large:
            rows = self.q if at is None else self.q[at]
            limit = 2 ** 63
            exact = [max(-limit, min(limit - 1, sum(int(x) * int(y) for x, y in zip(row, anchor)))) for row in rows]
            return np.array(exact, np.int64)
        return ((self.real if at is None else self.real[at]) @ real).astype(np.int64)


class Anchors:
    """A block of anchors: ids, labels, vectors, and what each one looks for: (key, k, low, high) where low None stands
    for no bound. same: among rows of its label, else among all others."""

    def __init__(self, ids, labels, q: list, wanted: list[list[tuple]], same: bool):
        self.ids, self.labels, self.wanted, self.same = ids, labels, wanted, same
        self.q = [np.asarray(x, np.int64) for x in q]
        self.real = [x.astype(float) for x in self.q]
        self.norm = [float(np.sqrt((x * x).sum())) for x in self.real]
        self.large = [len(x) > 0 and int(max(abs(int(x.max())), abs(int(x.min())))) >= SMALL for x in self.q]
        self.unit = [x / max(n, 1e-300) for x, n in zip(self.real, self.norm)]
        self.focus = [np.argsort(-np.abs(x), kind="stable")[:FOCUS] for x in self.unit]

    def lists(self) -> list[list[Best]]:
        none, most = -(2 ** 63), 2 ** 63 - 1
        return [[Best(k, none if low is None else low, most if high is None else high) for _, k, low, high in w] for w in self.wanted]

    def meet(self, bucket: Bucket, best: list[list[Best]]) -> None:
        for k, own in enumerate(best):
            if not own or (self.labels[k] == bucket.label) != self.same or len(self.q[k]) != bucket.q.shape[1]:
                continue
            at = bucket.candidates(self.unit[k], self.focus[k], self.norm[k], min(b.low for b in own))
            if at is not None and len(at) == 0:
                continue
            scores = bucket.scores(self.q[k], self.real[k], self.large[k], at)
            ids = bucket.ids if at is None else bucket.ids[at]
            if self.same:
                other = ids != self.ids[k]
                scores, ids = scores[other], ids[other]
            least = min(b.low for b in own)
            kept = scores >= least
            scores, ids = scores[kept], ids[kept]
            for b in own:
                b.put(scores, ids)


def _buckets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Bucket]:
    """Buckets of rows (id, label, q, dim, norm) in their order."""
    ids, qs, norms, of = [], [], [], None

    def done() -> Bucket:
        return Bucket(np.concatenate(ids), of[0], np.concatenate(qs), np.concatenate(norms))

    for batch in batches:
        if batch.num_rows == 0:
            continue
        labels, dims = batch.column(1).to_pylist(), batch.column(3).to_pylist()
        all_ids, all_norms = batch.column(0).to_numpy(), batch.column(4).to_numpy()
        lists = batch.column(2)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        start = 0
        while start < batch.num_rows:
            key, have = (labels[start], dims[start]), sum(map(len, ids))
            if of is not None and (key != of or have >= size):
                yield done()
                ids, qs, norms, have = [], [], [], 0
            of, stop = key, start
            while stop < batch.num_rows and stop - start < size - have and (labels[stop], dims[stop]) == key:
                stop += 1
            ids.append(all_ids[start:stop])
            qs.append(values[offsets[start]:offsets[stop]].reshape(stop - start, key[1]))
            norms.append(all_norms[start:stop])
            start = stop
    if ids:
        yield done()


def _search(rows: DataFrame, sample: list, anchors: Anchors, id_type: str = "long") -> DataFrame:
    """(anchor: place in the block, key, id, score): what each task's rows hold for the block's lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = anchors.lists()
        first = True
        for bucket in _buckets(batches, BUCKET):
            if first:
                # the sample sets least scores; its rows are found again where they lie
                first, tried = False, anchors.lists()
                for s in sample:
                    anchors.meet(s, tried)
                for own, seen in zip(best, tried):
                    for b, t in zip(own, seen):
                        b.low = t.low
            anchors.meet(bucket, best)
        out = [(k, w[0], i, s) for k, (own, wanted) in enumerate(zip(best, anchors.wanted)) for b, w in zip(own, wanted) for s, i in b.rows]
        a, b, c, d = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64())],
                                         names=["anchor", "key", "id", "score"])

    return rows.select("id", "label", "q", "dim", "norm").mapInArrow(run, "anchor int, key long, id long, score long")


def _sample(rows: DataFrame, n: int) -> list[Bucket]:
    """About SAMPLE rows as buckets: those whose hashed id is low."""
    part = int(1e6 * min(1.0, SAMPLE / max(n, 1)))
    got = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < part).orderBy("label", "dim", "id").limit(2 * SAMPLE).toArrow()
    return list(_buckets(got.combine_chunks().to_batches(), BUCKET))


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "id", label_col: str = "label", vector_col: str = "q",
                   positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows hold integer vectors (see fixed_point); anchor says of a row's id whether it is an anchor (over the column `id`).
    Each anchor's positives are its first `positives` other rows of its label; for each the first `negatives` rows of other
    labels that score at least `low` and at most `high` percent of it. Higher scores come first, then smaller ids.

    Rows without an id, a label or a vector, or with a null component, take no part. Of rows that share an id the least by
    label and vector does. Vectors of another dimension than the anchor's aren't compared with it. An anchor alone in its
    label, or without a row in range, yields nothing; so does an empty table. Other columns aren't read.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<bigint>").alias("q"))
    kept = kept.where("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL AND NOT exists(q, x -> x IS NULL)")
    placed = laid_out(kept)
    n = placed.count()
    asked = saved(placed.where(anchor).select("id", "label", "q", "dim"))
    most, count = asked.agg(F.max("dim"), F.count("*")).first()
    out = []
    if n and count:
        sample = _sample(placed, n)
        blocks = 1 + count * (16 * most + 400) // BLOCK_BYTES
        for k in range(blocks):
            # by hash: blocks of about BLOCK_BYTES, whatever the ids are
            block = asked.where(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(blocks)) == k).orderBy("id").toArrow()
            ids, labels, q = (block.column(c).to_pylist() for c in ("id", "label", "q"))
            near = Anchors(ids, labels, q, [[(0, positives, None, None)] for _ in ids], True)
            found = _search(placed, sample, near)
            first = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "id")
            top = saved(found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives))
            chosen: list[list[tuple]] = [[] for _ in ids]
            # at most `positives` rows for each anchor of the block
            for r in top.where("score >= 0").select("anchor", "id", "score").orderBy("anchor", "id").collect():
                chosen[r["anchor"]].append((r["id"], negatives, -(-low * r["score"] // 100), high * r["score"] // 100))
            far = Anchors(ids, labels, q, chosen, False)
            met = _search(placed, sample, far)
            ranked = met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
            names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), "anchor int, anchor_id long"))
            positive = top.select("anchor", F.col("id").alias("key"), F.col("score").alias("positive_score"))
            out.append(ranked.join(positive, ["anchor", "key"]).join(names, "anchor").select(
                "anchor_id", F.col("key").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score")))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    got = out[0]
    for more in out[1:]:
        got = got.union(more)
    return got
