"""A training corpus from `documents`: quality, near duplicates, benchmark passages, secrets, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import decontamination, jaccard, mixing, quality, secrets
from gridlore.llm.text import saved, share, table

QUALITY_FROM = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more stay. The classifier learns from labelled documents whose id's crc32 modulo 5
    isn't 0."""
    known = table(spark, sf_dir, "labels").select("doc_id", "quality").where(share(F.col("doc_id"), 5) != 0)
    return quality.keep_good(docs, quality.learn(known, docs=docs), threshold=QUALITY_FROM)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group joined by a similarity of 0.8 on five-word shingles, the document with the smallest id stays."""
    return jaccard.keep_one(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or all words of a shorter one, go."""
    return decontamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become [SECRET], and n_chars follows the text."""
    lexicon = secrets.learn_lexicon(docs)
    forest = secrets.train_forest(secrets.label_by_rule(secrets.findings(docs, lexicon)))
    cleaned = secrets.redact(docs, lexicon, forest)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages are brought to shares that go by the square root of their tokens. Every document stays, with a rate of
    at least 1, and is there as many times as its rate says, numbered by copy."""
    mixed = mixing.mix(docs, mixing.learn_memberships(docs, "lang"), floor=1.0)
    return mixed.select(*docs.columns, "n_tokens", "posterior", "rate",
                        F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("copies"), F.lit(1)))).alias("copy"))


STAGES = [
    ("quality classifier", quality_stage), ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage), ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
]

# Training a network and a forest, and connected components, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
