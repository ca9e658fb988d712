"""Weak supervision over quality rules: votes, accuracies by expectation-maximisation, one posterior per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm.text import SPACE, let, saved, whole

SYMBOLS = "#*$%&|<>"

# Each rule: name, when it votes bad, when it votes good; otherwise it abstains. The facts are columns of `facts`.
RULES = (
    ("symbols", "n_symbols > 0.08 * word_chars", "n_symbols <= 0.01 * word_chars"),
    ("repeated_lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
    ("repeated_words", "n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.1 * n_words"),
    ("word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words",
     "word_chars BETWEEN 4 * n_words AND 9 * n_words"),
    ("capitals", "n_capitals > 0.4 * word_chars", "n_capitals <= 0.1 * word_chars"),
    ("exclamations", "n_exclamations > 0.1 * n_words", "n_exclamations <= 0.01 * n_words"),
    ("distinct_words", "n_distinct_words < 0.2 * least(n_words, 400)", "n_distinct_words >= 0.4 * least(n_words, 400)"),
)
ROUNDS = 30
LEAST, MOST = 0.55, 0.99


def _repeat_words(tokens: Column) -> Column:
    """Words inside a window of three that the text holds twice or more: sort windows by hash, keep the starts of those
    that equal a neighbour, and measure the union of [start, start + 3)."""

    def of(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - 3)
        windows = F.transform(starts, lambda i: F.struct(
            F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")))
        twice = let(F.sort_array(windows), lambda s: F.filter(
            s, lambda x, k: (F.get(s, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]))))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    return let(tokens, lambda ws: F.when(F.size(ws) >= 4, of(ws)).otherwise(F.lit(0).cast("long")))


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def facts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column `facts` of the counts that the rules read; every count is of the whole text."""
    text = whole(F.col(text_col))
    tokens = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.withColumn("facts", F.struct(
        let(tokens, lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.size(F.array_distinct(ws)).cast("long").alias("n_distinct_words"),
            _repeat_words(ws).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda ls: F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        _without(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
    ))


def votes(rules: tuple = RULES) -> Column:
    """One vote per rule from the columns of the facts: -1 bad, 1 good, 0 abstains."""
    return F.array(*(F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for _, bad, good in rules))


def _total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + of(x))


def _log_odds(votes_: Column, prior: Column, accuracy: Column) -> Column:
    return F.log(prior / (1 - prior)) + F.aggregate(
        F.zip_with(votes_, accuracy, lambda v, a: v * F.log(a / (1 - a))), F.lit(0.0), lambda s, x: s + x)


def accuracies(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """One row (prior, accuracy array) from rows (votes, n): expectation-maximisation with abstaining voters that are
    independent given the class. There are at most 3 ** n_rules patterns, whatever the number of documents. An accuracy
    stays in [0.55, 0.99], so that a rule is never read backwards; a rule that never votes keeps its start of 0.8."""
    bounded = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))

    def step(state: Column, items: Column) -> Column:
        judged = F.transform(items, lambda x: F.struct(
            x["votes"].alias("votes"), x["n"].cast("double").alias("n"),
            (1 / (1 + F.exp(-_log_odds(x["votes"], state["prior"], state["accuracy"])))).alias("p")))

        def update(all_: Column) -> Column:
            def accuracy(k: int) -> Column:
                voted = _total(all_, lambda x: F.when(x["votes"][k] != 0, x["n"]).otherwise(0.0))
                right = _total(all_, lambda x: F.when(x["votes"][k] > 0, x["n"] * x["p"])
                               .when(x["votes"][k] < 0, x["n"] * (1 - x["p"])).otherwise(0.0))
                return F.when(voted > 0, bounded(right / voted, LEAST, MOST)).otherwise(0.8)

            prior = _total(all_, lambda x: x["n"] * x["p"]) / _total(all_, lambda x: x["n"])
            return F.struct(F.coalesce(bounded(prior, 0.05, 0.95), F.lit(0.5)).alias("prior"),
                            F.array(*(accuracy(k) for k in range(n_rules))).alias("accuracy"))

        return let(judged, update)

    start = F.struct(F.lit(0.7).alias("prior"), F.array(*[F.lit(0.8)] * n_rules).alias("accuracy"))
    gathered = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("items"))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: step(s, F.col("items")))
    return gathered.select(F.when(F.size("items") > 0, fitted).otherwise(start).alias("fit")).select("fit.*")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES,
          threshold: float = 0.5) -> DataFrame:
    """Per row of docs: its id, the counts, the votes, base_failed, p_good (the posterior) and kept.

    Rules vote or abstain; a document is kept if it has 50 words, at most half of them repeated, and a posterior of at
    least threshold. Null and empty texts have no words: not kept. Rows that repeat get a result each, the same one.
    An empty table gives no rows. Other columns are not read.
    """
    counted = facts(docs.select(F.col(id_col), F.col(text_col).alias("__text")), "__text").select(
        id_col, "facts.w.*", "facts.l.*", "facts.word_chars", "facts.n_symbols", "facts.n_exclamations", "facts.n_capitals")
    voted = saved(counted.withColumn("votes", votes(rules)))
    fit = accuracies(voted.groupBy("votes").agg(F.count("*").alias("n")), len(rules)).first()
    odds = reduce(lambda a, b: a + b, (
        F.get("votes", F.lit(k)) * F.log(F.lit(a / (1 - a))) for k, a in enumerate(fit["accuracy"])),
        F.log(F.lit(fit["prior"] / (1 - fit["prior"]))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (voted.withColumn("base_failed", failed).withColumn("p_good", 1 / (1 + F.exp(-odds)))
            .withColumn("kept", ~failed & (F.col("p_good") >= threshold)))
