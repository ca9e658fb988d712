"""Language identification: known words by their log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.sampling import per_label
from gridlore.llm.text import share, ship

ship(__name__)

WORD = re.compile(r"[^\W\d_]+")
# Learnt from about PER_LANGUAGE documents of each language; the tables keep the most frequent words and n-grams.
PER_LANGUAGE, WORDS, GRAMS, LONGEST = 4_000, 50_000, 20_000, 4
SIZES = range(LONGEST, 0, -1)
# An unseen word counts for less than a known one, and each step to a shorter n-gram costs a little more.
UNSEEN, STEP = 0.3, 0.4
# At most so many words' worth of evidence go into the score, so that long texts don't all score 1. Each task keeps what
# it found for CACHE unseen words of up to SHORT letters.
EVIDENCE, CACHE, SHORT = 25.0, 200_000, 64


class Model:
    """Log frequencies by language of words and of n-grams of 1 to 4 signs."""

    def __init__(self, languages: list[str], known: dict[str, list[float]], grams: list[dict[str, list[float]]]):
        self.languages, self.known, self.grams = languages, known, grams
        self.seen: dict[str, list[float]] = {}
        # the same n-grams in one table, each times the weight of its length
        self.weighted = {g: [STEP ** (LONGEST - size) * x for x in v] for size, table in enumerate(grams, 1) for g, v in table.items() if len(g) == size}

    def _unseen(self, word: str) -> list[float]:
        """The mean over the word's places of the longest n-gram known there, times the weight of an unseen word."""
        padded, get, found = f"<{word}>", self.weighted.get, []
        for i in range(len(padded)):
            for size in SIZES:
                v = get(padded[i:i + size])
                if v is not None:
                    found.append(v)
                    break
        if not found:
            return [0.0] * len(self.languages)
        return [UNSEEN * t / len(padded) for t in map(sum, zip(*found))]

    def of(self, word: str) -> list[float]:
        v = self.known.get(word)
        if v is None:
            v = self.seen.get(word)
            if v is None:
                v = self._unseen(word)
                if len(word) <= SHORT:
                    if len(self.seen) >= CACHE:
                        self.seen.clear()
                    self.seen[word] = v
        return v

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the highest sum, ties by name, and its share of the softened likelihood."""
        counts = Counter(WORD.findall(text.lower())) if text else {}
        if not counts or not self.languages or not any(c.isalpha() for w in counts for c in w):
            return "und", 0.0
        times = list(counts.values())
        n = sum(times)
        total = [math.sumprod(times, x) for x in zip(*map(self.of, counts))]
        scale = min(1.0, EVIDENCE / n)
        top = max(total)
        odds = [math.exp((t - top) * scale) for t in total]
        best = total.index(top)
        return self.languages[best], odds[best] / sum(odds)


def _logs(rows, languages: list[str]) -> dict[str, list[float]]:
    """Log frequencies, with 0.5 added, centred so that a word equally frequent everywhere weighs nothing."""
    counts: dict[str, list[float]] = {}
    for r in rows:
        counts.setdefault(r["g"], [0.0] * len(languages))[languages.index(r["label"])] = float(r["n"])
    sums = [sum(v[j] for v in counts.values()) + 0.5 * len(counts) for j in range(len(languages))]
    out = {}
    for g, v in counts.items():
        logs = [math.log((x + 0.5) / s) for x, s in zip(v, sums)]
        middle = sum(logs) / len(logs)
        out[g] = [x - middle for x in logs]
    return out


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the rows with a language and a text. Counting is distributed; the tables are bounded by WORDS and
    GRAMS (ties by the word), so only they come to the driver. Without such rows the model knows no language."""
    rows = labelled.where(F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("l"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    drawn = per_label(rows, F.col("l"), F.col("id"), PER_LANGUAGE)
    words = (drawn.select("label", F.explode(F.split(F.lower("t"), r"[^\p{L}]+")).alias("g")).where(F.length("g") > 0)
             .groupBy("label", "g").agg(F.count("*").alias("n")).persist())
    try:
        def top(counts: DataFrame, k: int):
            best = counts.groupBy("g").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "g").limit(k)
            return counts.join(F.broadcast(best), "g").select("label", "g", "n").collect()

        languages = sorted(r["label"] for r in words.select("label").distinct().collect())
        known = _logs(top(words, WORDS), languages)
        grams = []
        for size in range(1, LONGEST + 1):
            padded = F.concat(F.lit("<"), F.col("g"), F.lit(">"))
            cut = words.select("label", "n", padded.alias("g")).where(F.length("g") >= size).select(
                "label", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("g") - size + 1),
                                                    lambda i: F.substring("g", i, F.lit(size)))).alias("g"))
            grams.append(_logs(top(cut.groupBy("label", "g").agg(F.sum("n").alias("n")), GRAMS), languages))
    finally:
        words.unpersist()
    return Model(languages, known, grams)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, held_out (crc32 of the id modulo 3 is 1), lang_pred and score.

    Texts that are null or have no letter, and all texts if the model knows no language, get `und` and a score of 0.
    Rows that repeat get a result each; a null id isn't held out. An empty table gives no rows.
    """
    tables = (model.languages, model.known, model.grams)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*tables)
        for batch in batches:
            found = [own.predict(cell.as_py()) for cell in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col), (share(F.col(id_col), 3) == 1).alias("held_out"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
