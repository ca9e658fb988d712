"""Quality by attention-based multiple-instance learning: a document is a bag of passages, labelled as a whole."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.sampling import label_sizes, per_label, with_texts
from gridlore.llm.text import share, ship, whole

ship(__name__)

# A passage is PASSAGE words; the network is trained on about PER_LABEL documents of each label.
PASSAGE, PER_LABEL = 48, 3_000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 16, 250, 0.02, 1e-3, 5
CAPITALS, SYMBOLS, DIGITS, STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*<>{}[]~^=_\\", b"0123456789", b".,;:?"
BEYOND = bytes(range(128, 256))
N_FEATURES = 14


def passages(text: str) -> list[list[float]]:
    """The features of each passage of a whole text; a text without words is one passage of zeros."""
    words = text.split()
    if not words:
        return [[0.0] * N_FEATURES]
    out, seen, total = [], set(), math.log1p(len(words))
    for i in range(0, len(words), PASSAGE):
        own = words[i:i + PASSAGE]
        raw = "".join(own).encode("utf-8", "surrogatepass")
        n, k = len(raw), len(own)
        part = lambda chars: (n - len(raw.translate(None, chars))) / n  # noqa: E731,B023
        threes = list(zip(own, own[1:], own[2:]))
        again = sum(t in seen for t in threes)
        fresh = set(threes)
        seen |= fresh
        out.append([
            part(CAPITALS), part(SYMBOLS), part(DIGITS), part(STOPS), part(BEYOND), raw.count(b"!") / k, raw.count(b"|") / k,
            len(set(own)) / k, again / max(1, len(threes)), 1 - len(fresh) / max(1, len(threes)), n / k / 10,
            sum(len(w) <= 3 for w in own) / k, k / PASSAGE, total / 8])
    return out


class Attention:
    """tanh encoding of each passage, gated attention over the bag, a logistic score of the weighted encoding."""

    def __init__(self, mean, scale, w, v, u, a, c):
        self.mean, self.scale, self.w, self.v, self.u, self.a, self.c = mean, scale, w, v, u, a, c

    def forward(self, x: np.ndarray, first: np.ndarray):
        """x: the passages of all bags, laid end to end; first: where each bag begins. Every bag has a passage."""
        x = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], 1)
        h = np.tanh(x @ self.w)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = np.clip((t * g) @ self.a, -20, 20)
        e = np.exp(e)
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        alpha = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(h * alpha[:, None], first)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c[:-1] + self.c[-1], -30, 30)))
        return x, h, t, g, alpha, bag, z, p

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)[-1]


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> Attention:
    """Adam on the mean logistic loss of the bags, from a fixed seed; the same rows give the same network. weights: for
    how many bags each one stands, in the loss and in the features' mean and scale; by default one."""
    rng = np.random.default_rng(SEED)
    weights = np.ones(len(y)) if weights is None else weights
    by_passage = np.repeat(weights, np.diff(np.append(first, len(x))))
    mean = np.average(x, 0, by_passage)
    scale = np.sqrt(np.average((x - mean) ** 2, 0, by_passage))
    net = Attention(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 0.3, (x.shape[1] + 1, HIDDEN)),
                    rng.normal(0, 0.3, (HIDDEN, HIDDEN)), rng.normal(0, 0.3, (HIDDEN, HIDDEN)),
                    rng.normal(0, 0.3, HIDDEN), np.append(rng.normal(0, 0.3, HIDDEN), 0.0))
    names = ("w", "v", "u", "a", "c")
    m, s = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    for step in range(1, EPOCHS + 1):
        xs, h, t, g, alpha, bag, z, p = net.forward(x, first)
        out = weights * (p - y) / weights.sum()
        dz = out[:, None] * net.c[:-1]
        dalpha = (dz[bag] * h).sum(1)
        de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, first)[bag])
        dt, dg = de[:, None] * net.a * g * (1 - t * t), de[:, None] * net.a * t * g * (1 - g)
        dh = (dz[bag] * alpha[:, None] + dt @ net.v.T + dg @ net.u.T) * (1 - h * h)
        grads = {"w": xs.T @ dh, "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": np.append(z.T @ out, out.sum())}
        for k in names:
            grad = grads[k] + DECAY * getattr(net, k)
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.999 * s[k] + 0.001 * grad * grad
            move = RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
            setattr(net, k, getattr(net, k) - move)
    return net


def _bags(texts) -> tuple[np.ndarray, np.ndarray]:
    bags = [passages(t) for t in texts]
    sizes = np.array([len(b) for b in bags])
    return np.array([p for b in bags for p in b]), np.concatenate(([0], np.cumsum(sizes)[:-1]))


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          docs: DataFrame | None = None) -> Attention | None:
    """A network from rows with a label of 0 or 1; None if one is missing. Passages are encoded by Spark; the driver
    gets those of about PER_LABEL documents of each label, whole (56 bytes for each 48 words of a text). Each counts for as
    many as its label has for one that was drawn, so that the labels keep their true shares.

    docs: the texts, if labelled holds ids and labels alone; rows are then drawn before any text is read.
    Null labels and ids without a text are left out, a null text is an empty one.
    """
    base = labelled.where(F.col(label_col).isin(0, 1)).select(
        F.col(label_col).cast("int").alias("y"), F.col(id_col).alias("key"),
        (F.lit(None) if docs is not None else F.col(text_col)).cast("string").alias("t"))
    sizes = label_sizes(base, F.col("y"))
    drawn = per_label(base, F.col("y"), F.col("key"), PER_LABEL, sizes)
    if docs is not None:
        drawn = with_texts(drawn, docs, id_col, text_col)
    drawn = drawn.select("y", F.col("key").cast("string").alias("id"), whole(F.col("t")).alias("t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [[v for p in passages(c.as_py()) for v in p] for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.list_(pa.float32()))],
                                             names=["y", "id", "x"])

    got = drawn.mapInArrow(encode, "y int, id string, x array<float>").toPandas()
    if got["y"].nunique() < 2:
        return None
    got = got.sort_values(["id", "y"], ignore_index=True, na_position="last")
    bags = [np.asarray(b, float).reshape(-1, N_FEATURES) for b in got["x"]]
    first = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
    counts = got["y"].value_counts()
    weights = got["y"].map({y: sizes[str(y)] / n for y, n in counts.items()}).to_numpy(float)
    return train(np.concatenate(bags), first, got["y"].to_numpy(float), weights)


def score_quality(docs: DataFrame, model: Attention | None, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.3) -> DataFrame:
    """Per row of docs: the id, held_out (crc32 of the id modulo 5 is 0), score and predicted.

    Null and empty texts are one passage of zeros; without a model every score is 0.5. Rows that repeat get a result
    each; a null id isn't held out. An empty table gives no rows. Other columns are not read.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s = batch.num_rows, []
            for a in range(0, n, 256):
                texts = [c.as_py() for c in batch.column(2)[a:a + 256]]
                s.append(model.score(*_bags(texts)) if model else np.full(len(texts), 0.5))
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"])

    return docs.select(F.col(id_col), (share(F.col(id_col), 5) == 0).alias("held_out"),
                       whole(F.col(text_col)).alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Attention | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores threshold or more: scored beside each row in one pass
    over the texts, without a join."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            keep = []
            for a in range(0, batch.num_rows, 256):
                part = [c.as_py() or "" for c in texts[a:a + 256]]
                keep.append(model.score(*_bags(part)) >= threshold if model else np.ones(len(part), bool))
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, schema)
