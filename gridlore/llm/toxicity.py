"""Toxicity from two class-conditional Kneser-Ney models that share their backoff counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm.sampling import per_label, with_texts
from gridlore.llm.text import let, share, ship, whole

ship(__name__)

# The models are counted over about PER_CLASS labelled documents of each class, and the score is calibrated on about
# CALIBRATE others, which also choose among the discounts of pairs. Words of the texts that are measured together.
PER_CLASS, CALIBRATE, DISCOUNT, PAIR_DISCOUNTS = 4_000, 6_000, 0.75, (1.0, 2.0, 4.0, 8.0, 16.0)
TOGETHER = 200_000
FEATURES = 5


def hashed_words(text: Column) -> Column:
    """The hashes of the lower-cased words of letters, in order."""
    return F.transform(F.array_remove(F.split(F.lower(whole(text)), r"[^\p{L}]+"), ""), lambda w: F.xxhash64(w))


def _pairs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each word and the one before it; the first word of a text follows 0."""
    before = np.concatenate(([0], words[:-1])) if len(words) else words
    before[first] = 0
    with np.errstate(over="ignore"):
        x = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words.astype(np.uint64)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32)), before


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key stands in sorted keys; len(keys) where it doesn't."""
    at = np.searchsorted(keys, wanted)
    ok = at < len(keys)
    ok[ok] = keys[at[ok]] == wanted[ok]
    return np.where(ok, at, len(keys))


class KneserNey:
    """Two interpolated Kneser-Ney word-pair models, 0 ordinary and 1 toxic.

    A pair's count, less a discount, over the count of its first word; the mass taken off goes to the second word's
    continuation probability, which counts after how many different words it comes, not how often. That one, discounted
    again, backs off to one table for both classes: the continuation count of a word over classes, in how many of them it
    occurs. So a rare word weighs about the same in both, and what one class often uses isn't lent to the other, as it would
    be if the shared table counted the words before it. Pairs that count no more than the discount give all they have to
    the backoff, so that only the others are kept."""

    def __init__(self, words, shared, pairs, classes):
        self.words, self.shared, self.pairs, self.classes = words, shared, pairs, classes

    def ratios(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log P(word | the one before, toxic) - log P(word | the one before, ordinary) for each word of texts laid end
        to end; first holds the places where texts begin."""
        pairs, before = _pairs(words, first)
        w, h, p = _find(self.words, words), _find(self.words, before), _find(self.pairs, pairs)
        out = np.zeros(len(words))
        for sign, c in zip((-1, 1), self.classes):
            word = (np.maximum(c["after"][w] - DISCOUNT, 0) + DISCOUNT * c["types"] * self.shared[w]) / c["pairs"]
            seen = c["starts"][h]
            pair = (c["left"][p] + c["mass"][h] * word) / np.maximum(seen, 1)
            # a word that never came first has no pairs of its own
            out += sign * np.log(np.where(seen > 0, pair, word))
        return out


class Counts:
    """How often each pair of words occurs in the sample's ordinary and toxic texts."""

    def __init__(self, before: np.ndarray, word: np.ndarray, n: list[np.ndarray]):
        self.n, self.words = n, np.unique(np.concatenate([word, before]))
        self.second, self.head = np.searchsorted(self.words, word), np.searchsorted(self.words, before)
        flat = np.stack([before, word], 1).reshape(-1)
        self.keys = _pairs(flat, np.array([], int))[0][1::2] if len(word) else np.array([], np.uint64)

    def _table(self, at: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
        """Sums by word; the last place is that of words that aren't known."""
        return np.append(np.bincount(at, by, minlength=len(self.words)).astype(np.float32), np.float32(0))

    @cached_property
    def tables(self) -> tuple[np.ndarray, list[dict]]:
        """The shared table and the classes', which are the same for every discount of pairs."""
        classes, shared = [], np.full(len(self.words) + 1, 0.5)
        for n in self.n:
            there = n > 0
            after = self._table(self.second[there])
            shared += after > 0
            classes.append({"after": after, "types": max(float((after > 0).sum()), 1.0), "pairs": max(float(there.sum()), 1.0),
                            "starts": self._table(self.head, n)})
        return (shared / shared.sum()).astype(np.float32), classes

    def model(self, discount: float) -> KneserNey:
        """The models whose pairs are discounted by so much."""
        kept = np.flatnonzero(np.maximum(*self.n) > discount)
        kept = kept[np.argsort(self.keys[kept])]
        shared, classes = self.tables
        own = [{**c, "mass": self._table(self.head, np.minimum(n, discount)),
                "left": np.append(np.maximum(n[kept] - discount, 0), 0).astype(np.float32)} for c, n in zip(classes, self.n)]
        return KneserNey(self.words, shared, self.keys[kept], own)


def count(rows: DataFrame) -> Counts:
    """The counts of rows (label '0' or '1', h: hashed words), made by Spark over the bounded sample."""
    steps = let(F.col("h"), lambda h: F.transform(h, lambda w, i: F.struct(
        w.alias("w"), F.when(i > 0, F.get(h, F.greatest(i - 1, F.lit(0)))).otherwise(F.lit(0).cast("long")).alias("b"))))
    placed = rows.select("label", F.explode(steps).alias("s")).select("label", "s.w", "s.b")
    got = placed.groupBy("b", "w").agg(
        *(F.sum(F.when(F.col("label") == c, 1).otherwise(0)).cast("int").alias(f"n{c}") for c in "01")).toArrow()
    b, w, *n = (got.column(k).to_numpy() for k in ("b", "w", "n0", "n1"))
    return Counts(b, w, n)


def _measures(model: KneserNey, lists: pa.Array) -> np.ndarray:
    """See _measured; texts are measured about TOGETHER words at a time, however many a batch has."""
    ends = lists.offsets.to_numpy()
    starts = np.unique(np.searchsorted(ends, np.arange(ends[0], ends[-1] + 1, TOGETHER)).clip(0, len(lists)))
    cuts = np.unique(np.concatenate(([0], starts, [len(lists)])))
    parts = [_measured(model, lists.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:])]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


def _measured(model: KneserNey, lists: pa.Array) -> np.ndarray:
    """For each text: the mean log ratio, the sum over the root of the length, the mean of the three highest ratios, the
    highest, and 1. Texts without words get zeros."""
    ends = lists.offsets.to_numpy()
    words = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), FEATURES))
    out[:, 4] = 1.0
    full = np.flatnonzero(sizes)
    if len(full):
        first = ends[:-1][full]
        r = model.ratios(words, first)
        total = np.add.reduceat(r, first)
        out[full, 0], out[full, 1] = total / sizes[full] * 10, total / np.sqrt(sizes[full])
        for i, a in zip(full, first):
            own = r[a:a + sizes[i]]
            high = np.partition(own, -3)[-3:] if len(own) > 3 else own
            out[i, 2], out[i, 3] = high.mean(), high.max()
    return out


class Scorer:
    """A model and the weights of the logistic curve that turns its measures into a score."""

    def __init__(self, model: KneserNey, weights: np.ndarray):
        self.model, self.weights = model, weights

    def score(self, lists: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_measures(self.model, lists) @ self.weights, -30, 30)))


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return float(-np.mean(np.log(np.where(y > 0, p, 1 - p))))


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          docs: DataFrame | None = None) -> Scorer | None:
    """A scorer from rows with a label of 0 or 1; None if one of the labels is missing. Three in four sampled documents
    are counted, the fourth calibrates.

    docs: the texts, if labelled holds ids and labels alone; rows are then drawn before any text is read.
    Null labels and ids without a text are left out, a null text is an empty one.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(
        F.col(label_col).cast("int").alias("y"), F.col(id_col).alias("key"),
        (F.lit(None) if docs is not None else F.col(text_col)).cast("string").alias("t"))
    fourth = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(17)), F.lit(4)) == 0
    drawn = per_label(rows.where(~fourth), F.col("y"), F.col("key"), PER_CLASS)
    rest = per_label(rows.where(fourth), F.lit("all"), F.col("key"), CALIBRATE)
    if docs is not None:
        drawn, rest = (with_texts(x, docs, id_col, text_col) for x in (drawn, rest))
    # copies of a text count once
    counts = count(drawn.select("label", hashed_words(F.col("t")).alias("h")).dropDuplicates())
    if min(n.sum() for n in counts.n) == 0:
        return None
    models = [counts.model(d) for d in PAIR_DISCOUNTS]
    names = [f"x{m}_{k}" for m in range(len(models)) for k in range(FEATURES)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([_measures(m, batch.column(1)) for m in models], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(len(names)))], names=["y", *names])

    got = rest.select("y", hashed_words(F.col("t")).alias("h")).mapInArrow(measure, "y int, " + ", ".join(f"{k} double" for k in names)).toPandas()
    if got["y"].nunique() < 2:
        return Scorer(models[0], np.array([1.0, 0.0, 0.0, 0.0, 0.0]))
    got = got.sort_values(list(got.columns))
    y, x = got["y"].to_numpy(float), got[names].to_numpy().reshape(len(got), len(models), FEATURES)
    curves = [_curve(x[:, m], y) for m in range(len(models))]
    best = min(range(len(models)), key=lambda m: _loss(x[:, m], y, curves[m]))
    return Scorer(models[best], curves[best])


def score_toxicity(docs: DataFrame, scorer: Scorer | None, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.5) -> DataFrame:
    """Per row of docs: the id, held_out (crc32 of the id modulo 5 is 0), score and predicted.

    Null and empty texts get the score that the calibration gives to no evidence; without a scorer every score is 0.
    Rows that repeat get a result each; a null id isn't held out. An empty table gives no rows.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scorer.score(batch.column(2)) if scorer else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"])

    return docs.select(F.col(id_col), (share(F.col(id_col), 5) == 0).alias("held_out"),
                       hashed_words(F.col(text_col)).alias("h")).mapInArrow(run, schema)
