"""Masking of personal data in text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.functions.columns import col, require

__all__ = ["mask_pii", "pii_counts", "mask_conversations", "PII_PATTERNS"]

# Patterns in the order they are applied, each with its placeholder.
PII_PATTERNS = (
    ("email", r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}", "[REDACTED_EMAIL]"),
    ("card", r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b", "[REDACTED_CARD]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    ("aadhaar", r"\b\d{4}\s\d{4}\s\d{4}\b", "[REDACTED_AADHAAR]"),
    ("pan", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "[REDACTED_PAN]"),
    ("phone", r"\(\d{3}\)\s?\d{3}[-.\s]\d{4}", "[REDACTED_PHONE]"),
    ("phone", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b", "[REDACTED_PHONE]"),
    ("phone", r"\+\d{1,3}[-.\s]?\d{4,5}[-.\s]?\d{4,5}\b", "[REDACTED_PHONE]"),
    ("phone", r"\+\d{1,3}[-.\s]?\d{3,4}[-.\s]?\d{3,4}[-.\s]?\d{0,4}\b", "[REDACTED_PHONE]"),
)
KINDS = ("email", "card", "ssn", "aadhaar", "pan", "phone")

# Words, digits and boundaries follow Unicode, so accented letters count as letters.
_UNICODE = "(?U)"


def _replace(c: Column, pattern: str, placeholder: str) -> Column:
    return F.regexp_replace(c, _UNICODE + pattern, placeholder)


def _guards(c: Column) -> tuple[Column, Column]:
    """What a text must hold for the first pattern, and for all others, to match at all.

    Most texts hold neither an @ nor a digit and skip the patterns.
    """
    return F.contains(c, F.lit("@")), c.rlike(_UNICODE + r"\d")


def _masked(c: Column) -> Column:
    has_at, has_digit = _guards(c)
    (_, email, placeholder), *others = PII_PATTERNS
    first = F.when(has_at, _replace(c, email, placeholder)).otherwise(c)
    rest = first
    for _, pattern, mark in others:
        rest = _replace(rest, pattern, mark)
    return F.when(has_digit, rest).otherwise(first)


def mask_pii(df: DataFrame, name: str) -> DataFrame:
    """Replace personal data in a text column by placeholders."""
    require(df, name)
    return df.withColumn(name, _masked(col(name)))


def _occurrences(c: Column, mark: str) -> Column:
    without = F.replace(c, F.lit(mark), F.lit(""))
    return ((F.length(c) - F.length(without)) / F.lit(len(mark))).cast("int")


def pii_counts(df: DataFrame, name: str) -> DataFrame:
    """Add the number of replacements per kind and in all.

    No pattern can match a placeholder, so the placeholders that masking adds are the
    replacements made.
    """
    require(df, name)
    marks = {kind: mark for kind, _, mark in PII_PATTERNS}
    rows = df.withColumn("_masked", _masked(col(name)))
    counts = {
        k: F.coalesce(_occurrences(F.col("_masked"), marks[k]) - _occurrences(col(name), marks[k]), F.lit(0))
        for k in KINDS
    }
    counted = rows.withColumns({f"n_{k}": c for k, c in counts.items()}).drop("_masked")
    return counted.withColumn("redactions", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)))


def mask_conversations(
    df: DataFrame, conversation: str = "conv_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The masked messages, and the number of replacements per conversation."""
    require(df, conversation, text)
    counted = pii_counts(df.select(col(conversation), col(text)), text)
    totals = counted.groupBy(col(conversation)).agg(
        F.sum("redactions").alias("redactions"), F.count(F.lit(1)).alias("messages")
    )
    return mask_pii(df, text), totals
