"""What each column is for: number, category or date; identifier or measure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.functions import names as N
from gridlore.functions.columns import (
    as_ts, col, integer_columns, numeric_columns, text_columns, time_columns,
)
from gridlore.functions.shapes import named, per_column, stacked, value_frequencies

__all__ = ["Roles", "column_roles", "roles_of", "primary_measure", "date_columns", "stats_date_columns"]

_ROLE_SCHEMA = (
    "position int, column string, role string, parse_ratio double, is_date_name boolean, "
    "measure_name boolean, is_identifier boolean"
)


def _parse_ratios(df: DataFrame) -> DataFrame:
    """Per column: rows, non-missing values and the share of rows that read as dates."""
    dates = set(time_columns(df))
    texts = set(text_columns(df))

    def facts(name):
        parsed = F.count(as_ts(df, name)) if name in texts | dates else F.lit(0).cast("long")
        return {"rows": F.count(F.lit(1)), "parsed": parsed}

    return per_column(df, df.columns, facts)


# A sketch of different values that is that far below their number settles it; ids count as dense while their range is at most
# so many times their number; values that one row of bits stands for.
SKETCH_ERROR, SKETCH_BELOW, DENSE, SEGMENT = 0.02, 0.85, 64, 32_768


def _unique_integers(df: DataFrame) -> DataFrame | None:
    """(column, all_unique) of the integer columns: whether their values are all different.

    One scan settles most: more values than their range has room for, or a sketch far below their number, can't be
    unique. What is left is counted: dense values as bits, a row for each SEGMENT of their range, others as values.
    """
    candidates = [n for n in integer_columns(df) if not N.is_identifier_name(n)]
    if not candidates:
        return None
    seen = per_column(df, candidates, lambda n: {
        "filled": F.count(col(n)), "low": F.min(col(n)).cast("long"), "high": F.max(col(n)).cast("long"), "sketch": F.approx_count_distinct(col(n), SKETCH_ERROR)}).collect()
    facts = {r["column"]: r for r in seen}  # a row per column
    room = {n: r["high"] - r["low"] + 1 if r["filled"] else 0 for n, r in facts.items()}
    open_ = [n for n, r in facts.items() if r["filled"] and room[n] >= r["filled"] and r["sketch"] >= SKETCH_BELOW * r["filled"]]
    dense = [n for n in open_ if room[n] <= DENSE * facts[n]["filled"]]
    rest = [n for n in open_ if n not in dense]
    unique = {n: False for n in candidates}
    if dense:
        offset = {n: col(n).cast("long") - F.lit(facts[n]["low"]) for n in dense}
        rows = stacked(df, [offset[n] for n in dense])
        bits = rows.groupBy("place", F.floor(F.col("value") / SEGMENT).alias("segment")).agg(
            F.bitmap_construct_agg(F.pmod("value", F.lit(SEGMENT))).alias("bits"))
        counted = named(bits.groupBy("place").agg(F.sum(F.bitmap_count("bits")).alias("d")), dense).collect()
        unique.update({r["column"]: r["d"] == facts[r["column"]]["filled"] for r in counted})
    if rest:
        counted = value_frequencies(df, rest).groupBy("column").agg(F.max("n").alias("most")).collect()
        unique.update({r["column"]: r["most"] == 1 for r in counted})
    return df.sparkSession.createDataFrame(list(unique.items()), "column string, all_unique boolean")


def column_roles(df: DataFrame) -> DataFrame:
    """One row per column: position, role, date parse ratio and what its name suggests."""
    numeric, dates = set(numeric_columns(df)), set(time_columns(df))
    facts = _parse_ratios(df)
    hints = [
        F.struct(
            F.lit(n).alias("column"),
            F.lit("numeric" if n in numeric else "date" if n in dates else "other").alias("kind"),
            F.lit(N.hints_date_role(n)).alias("date_hint"),
            F.lit(N.is_date_name(n)).alias("is_date_name"),
            F.lit(N.is_measure_name(n)).alias("measure_name"),
            F.lit(N.is_identifier_name(n)).alias("id_name"),
        )
        for n in df.columns
    ]
    # names are constants of the schema: picked by position, no join
    meta = F.element_at(F.array(*hints), F.col("position") + 1)
    ratio = F.try_divide(F.col("parsed").cast("double"), F.col("rows").cast("double"))
    rows = facts.withColumn("meta", meta).withColumn("ratio", ratio)
    unique = _unique_integers(df)
    if unique is None:
        is_identifier = F.col("meta.id_name")
    else:
        rows = rows.join(F.broadcast(unique), "column", "left")  # one row per column
        is_identifier = F.col("meta.id_name") | (
            F.coalesce(F.col("all_unique"), F.lit(False)) & (F.col("rows") > 20)
        )
    role = (
        F.when(F.col("meta.kind") != "other", F.col("meta.kind"))
        .when(F.col("ratio") >= 0.8, "date")
        .when(F.col("meta.date_hint") & (F.col("ratio") >= 0.6), "date")
        .otherwise("categorical")
    )
    return rows.select(
        "position", "column", role.alias("role"),
        F.when(F.col("meta.kind") != "numeric", F.col("ratio")).alias("parse_ratio"),
        F.col("meta.is_date_name").alias("is_date_name"),
        F.col("meta.measure_name").alias("measure_name"),
        is_identifier.alias("is_identifier"),
    )


@dataclass(frozen=True)
class Roles:
    """Column names by role, in table order."""

    numeric: list[str]
    categorical: list[str]
    dates: list[str]
    identifiers: list[str]

    @property
    def measures(self) -> list[str]:
        return [n for n in self.numeric if n not in self.identifiers]

    @property
    def primary(self) -> str | None:
        return N.pick_primary(self.measures or self.numeric)

    @property
    def secondary(self) -> str | None:
        return next((m for m in self.measures if m != self.primary), None)


def roles_of(df: DataFrame) -> Roles:
    """Run ``column_roles`` and read its rows: one per column of the schema."""
    rows = column_roles(df).orderBy("position").collect()
    by = lambda role: [r["column"] for r in rows if r["role"] == role]
    return Roles(
        by("numeric"), by("categorical"), by("date"),
        [r["column"] for r in rows if r["is_identifier"]],
    )


def primary_measure(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """One row: the primary and the secondary measure."""
    roles = roles or roles_of(df)
    return df.sparkSession.createDataFrame(
        [(roles.primary, roles.secondary)], "primary string, secondary string"
    )


def date_columns(df: DataFrame) -> DataFrame:
    """Date columns by typed column, by content, or by name, with the reason."""
    why = (
        F.when(F.col("column").isin(time_columns(df)), "type")
        .when(F.col("role") == "date", "content")
        .when(F.col("is_date_name"), "name")
    )
    return column_roles(df).select("position", "column", why.alias("reason")).filter("reason is not null")


def stats_date_columns(df: DataFrame) -> DataFrame:
    """Date columns for quick statistics: typed, or hinted by name and 80 % of values parse."""
    typed = set(time_columns(df))
    texts = [n for n in text_columns(df) if N.hints_date_stats(n)]
    names = [n for n in df.columns if n in typed or n in texts]
    if not names:
        return df.sparkSession.createDataFrame([], "position int, column string")
    facts = per_column(
        df, names,
        lambda n: {"ok": F.count(as_ts(df, n)), "filled": F.count(F.lit(1)) if n in typed else F.count(n)},
    )
    share = F.try_divide(F.col("ok").cast("double"), F.col("filled"))
    return facts.filter(F.col("column").isin(list(typed)) | (share >= 0.8)).select("position", "column")
