"""Benchmark decontamination by a join of all windows; no fingerprints are selected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm.text import ascii_lower, let, whole

WORDS_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5
# The benchmark's windows are broadcast up to this many rows of 40 bytes and its item ids; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def benchmark_words(text: Column) -> Column:
    """Words of letters, digits and anything beyond ASCII, with A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(whole(text)), WORDS_APART), "")


def _grams(hashes: Column, n: int) -> Column:
    """A hash for each n words in a row."""
    return F.when(F.size(hashes) >= n, F.transform(
        F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(n)))
    )).otherwise(F.array().cast("array<bigint>"))


def _long_windows(hashes: Column) -> Column:
    """Each window of ten words: where it starts, its fingerprint, and the hashes of its two halves.

    The fingerprint is the least hash of the window's six 5-grams. Two equal windows have the same fingerprint, so no
    shared span of ten words is missed; the halves then extend a hit over the whole window.
    """
    of = lambda g: F.when(F.size(g) >= WINDOW - GRAM + 1, F.transform(
        F.sequence(F.lit(0), F.size(g) - (WINDOW - GRAM + 1)),
        lambda i: F.struct(i.alias("at"), F.lit(WINDOW).alias("n"),
                           F.least(*(F.get(g, i + k) for k in range(WINDOW - GRAM + 1))).alias("print"),
                           F.get(g, i).alias("head"), F.get(g, i + GRAM).alias("tail"))))
    return let(_grams(hashes, GRAM), of)


def _short_windows(hashes: Column, n: int) -> Column:
    """Each n words in a row, for items that have no more than n: all of them are one gram."""
    return let(_grams(hashes, n), lambda g: F.transform(
        g, lambda x, i: F.struct(i.alias("at"), F.lit(n).alias("n"), x.alias("print"), x.alias("head"), x.alias("tail"))))


_TYPE = "array<struct<at:int,n:int,print:bigint,head:bigint,tail:bigint>>"


def _windows(hashes: Column, lengths: list[int]) -> Column:
    def of(h: Column) -> Column:
        parts = [_long_windows(h) if n == WINDOW else _short_windows(h, n) for n in lengths]
        parts = [F.coalesce(p.cast(_TYPE), F.array().cast(_TYPE)) for p in parts]
        return reduce(lambda a, b: F.concat(a, b), parts) if parts else F.array().cast(_TYPE)
    return let(hashes, of)


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per different window of the benchmark, with the ids of the items that hold it, as sorted strings."""
    hashed = items.select(F.col(id_col).cast("string").alias("item"),
                          F.transform(benchmark_words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("h"))
    own = F.when(F.size("h") >= WINDOW, _windows(F.col("h"), [WINDOW]))
    for n in range(1, WINDOW):
        own = own.when(F.size("h") == n, _windows(F.col("h"), [n]))
    flat = hashed.where(F.col("item").isNotNull()).select("item", F.explode(own).alias("w")).select("item", "w.*")
    return flat.groupBy("n", "print", "head", "tail").agg(F.sort_array(F.collect_set("item")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, n_words, n_hit, n_items, items_sha256, contaminated, and items (sorted strings).

    A window is 10 consecutive words of an item, or all words of an item that has fewer; a document's word is hit if it
    lies in any occurrence of a window. Null and empty texts have no words and no hits; items without words or id have
    no windows; items that repeat count once per id. Rows that repeat get a result each, also with null ids. Without
    items nothing is hit; without documents there are no rows. Other columns are not read.
    """
    windows = item_windows(items, item_id_col, item_text_col)
    found = windows.groupBy("n").count().collect()  # ten rows at most
    lengths = sorted((r["n"] for r in found), reverse=True)
    if sum(r["count"] for r in found) <= BROADCAST_ROWS:
        windows = F.broadcast(windows)
    base = docs.select(F.col(id_col).alias("__id"), whole(F.col(text_col)).alias("__text"))
    uid = F.xxhash64("__text").alias("__uid")
    rows = base.select("__id", uid, _windows(
        F.transform(benchmark_words(F.col("__text")), lambda w: F.xxhash64(w)), lengths).alias("ws"))
    rows = rows.select("__id", "__uid", F.explode("ws").alias("w")).select("__id", "__uid", "w.*")
    hits = rows.join(windows, ["n", "print", "head", "tail"]).groupBy("__id", "__uid").agg(
        F.sort_array(F.collect_set(F.struct("at", "n"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["at"] + x["n"]).alias("end"),
            (s["words"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(s["end"], x["at"]))).alias("words")))["words"]
    hits = hits.select(F.col("__id").alias("__hid"), F.col("__uid").alias("__huid"), covered.alias("n_hit"), "items")
    sizes = base.select("__id", uid, F.size(benchmark_words(F.col("__text"))).cast("long").alias("n_words"))
    out = sizes.join(hits, F.col("__id").eqNullSafe(F.col("__hid")) & (F.col("__uid") == F.col("__huid")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("__id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items_), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), items_.alias("items"))


def clean_rows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of the benchmark. Rows with a null id are told
    apart by their text, so that none is lost or dropped with another."""
    judged = decontaminate(docs.select(F.struct(F.col(id_col), F.xxhash64(whole(F.col(text_col))).alias("u")).alias("__key"),
                                       F.col(text_col).alias("__t")), items, "__key", "__t", **names)
    bad = judged.where("contaminated").select(
        F.col(f"__key.{id_col}").alias("__bad_id"), F.col("__key.u").alias("__bad_u")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__bad_id")) & (F.xxhash64(whole(F.col(text_col))) == F.col("__bad_u"))
    return docs.join(bad, same, "left_anti")
