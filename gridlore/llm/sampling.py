"""Bounded samples of labelled rows, drawn without a shuffle and the same on every run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LABELS = 1000
# Drawn rows (an id and a label) that may be broadcast to their texts.
BROADCAST_IDS = 100_000


def label_sizes(rows: DataFrame, label: Column) -> dict[str, int]:
    """The rows of each label, named by its string; null labels are left out."""
    named = rows.select(label.cast("string").alias("label")).where(F.col("label").isNotNull())
    sizes = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    return sizes


def per_label(rows: DataFrame, label: Column, key: Column, bound: int, sizes: dict[str, int] | None = None) -> DataFrame:
    """rows of which each label keeps about `bound` at most: those whose hashed key falls under bound over the label's
    count; all of a label's rows where it has no more. Null labels are left out. Adds the column `label` as a string.
    sizes: the result of label_sizes, where it is known."""
    if sizes is None:
        sizes = label_sizes(rows, label)
    named = rows.withColumn("label", label.cast("string")).where(F.col("label").isNotNull())
    if not sizes:
        return named
    part = reduce(lambda c, d: c.when(F.col("label") == d, F.lit(int(1e6 * min(1.0, bound / sizes[d])))),
                  sorted(sizes), F.when(F.lit(False), 0))
    return named.where(F.pmod(F.xxhash64(key.cast("string")), F.lit(1_000_000)) < part)


def with_texts(drawn: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """drawn (key, label columns …) with `t`, the text of the document of that id. Drawn rows come from the labels alone, so
    that texts are read where they lie; only drawn rows too many to broadcast are met by a shuffle. Of labels that repeat
    an id the least counts; documents that repeat an id each get it."""
    one = drawn.groupBy("key").agg(F.min("y").alias("y"), F.min("label").alias("label"))
    if one.count() <= BROADCAST_IDS:
        one = F.broadcast(one)
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("t")).join(one, "key")
