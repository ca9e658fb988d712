"""Facts about a table, gathered once, of which the gate's and the report's sections are projections.

Each part reads the source once (quantiles: four times, duplicates: twice) when it is first asked for, and is kept: a row
per column on the driver's side, larger tables in the checkpoint folder. What an earlier part has settled is not computed
by a later one: a column whose least and largest values are equal is constant, numbers that set five of 64 bits by their
hash are five at least, and a sketch tells which text columns could be different in almost every row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.functions import names as N
from gridlore.functions.columns import (
    as_day, as_number, as_ts, col, dtype_of, is_floating, measure, missing, numeric_columns, present, strip, text_columns,
    time_columns, without_nan,
)
from gridlore.functions.positions import use_checkpoint_folder
from gridlore.functions.quantiles import exact_quantiles
from gridlore.functions.shapes import COLUMNS_PER_SCAN, long_numbers, named, union_all, value_frequencies

__all__ = ["TableFacts", "repeated_rows"]

# Error of the sketch of different texts; modes named; repeated digests that may be broadcast (16 bytes each).
SKETCH_ERROR, NAMED_MODES, BROADCAST_DIGESTS = 0.02, 5, 300_000
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def kept(df: DataFrame) -> DataFrame:
    """The rows in the checkpoint folder, written now."""
    use_checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same as a columnar table, of which later scans read only their columns; types are those that Parquet holds."""
    use_checkpoint_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quartile_facts(df: DataFrame, names: list[str], finite: bool) -> DataFrame:
    """Per number column: n, quartiles, fences, values outside them (0 when the IQR is 0) and the outermost inside."""
    values = long_numbers(df, names)
    if finite:
        values = values.filter(F.abs("value") != float("inf"))
    q = exact_quantiles(values, ["place"], QUARTILES)
    iqr = F.col("q3") - F.col("q1")
    limits = q.select("place", "n", "q1", "median", "q3", iqr.alias("iqr"), (F.col("q1") - 1.5 * iqr).alias("low"), (F.col("q3") + 1.5 * iqr).alias("high"))
    below, above = F.col("value") < F.col("low"), F.col("value") > F.col("high")
    # a row per column on the small side
    counted = values.join(F.broadcast(limits), "place").groupBy("place").agg(
        F.count_if((F.col("iqr") > 0) & (below | above)).alias("outliers"), F.count_if(below | above).alias("outside"),
        F.min(F.when(~below, F.col("value"))).alias("whisker_low"), F.max(F.when(~above, F.col("value"))).alias("whisker_high"),
        *[F.max(c).alias(c) for c in ("n", "q1", "median", "q3", "iqr", "low", "high")])
    return named(counted, names)


def text_facts(freq: DataFrame) -> DataFrame:
    """Of (column, value, n): different values, as written and once blanks and case are unified, and rows in the unified
    categories that occur more than once. Values are counted before they are trimmed, and trimmed before they are folded."""
    trimmed = freq.groupBy("column", strip(F.col("value")).alias("v")).agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"))
    folded = trimmed.groupBy("column", F.lower("v").alias("k")).agg(
        F.sum("values").alias("values"), F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n"))
    return folded.groupBy("column").agg(
        F.sum("values").alias("distinct"), F.sum("forms").alias("raw"), F.count(F.lit(1)).alias("unified"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("affected"))


def frequency_facts(freq: DataFrame) -> DataFrame:
    """Of (column, value, n): different values, filled rows, the highest frequency, its first value and how many have it."""
    by_n = freq.groupBy("column", "n").agg(F.count(F.lit(1)).alias("values"), F.min("value").alias("first"))
    return by_n.groupBy("column").agg(
        F.sum("values").alias("unique_values"), F.sum(F.col("n") * F.col("values")).alias("filled"), F.max("n").alias("top_frequency"),
        F.max_by("first", "n").alias("top_value"), F.max_by("values", "n").alias("n_modes"))


def repeated_rows(df: DataFrame) -> DataFrame:
    """Each row that occurs more than once, with `_copies`; missing equals missing.

    Two 64-bit digests of every row are counted; only rows whose digest occurs again are compared whole.
    """
    marked = _digested(df)
    return _compared(marked, _again(marked))


def _digested(df: DataFrame) -> DataFrame:
    clean = without_nan(df)
    plain = [col(n) + F.lit(0.0) if is_floating(f.dataType) else col(n) for n, f in zip(clean.columns, clean.schema)]
    # a missing value leaves a hash as it is: which are missing is hashed as well
    gaps = F.concat(F.lit(""), *[F.when(col(n).isNull(), "1").otherwise("0") for n in clean.columns])
    keys = [F.xxhash64(*plain, gaps).alias("__digest_a"), F.xxhash64(F.lit(7919), gaps, *reversed(plain)).alias("__digest_b")]
    return clean.select("*", *keys)


def _again(marked: DataFrame) -> DataFrame:
    """The digests that occur more than once."""
    return marked.groupBy("__digest_a", "__digest_b").agg(F.count(F.lit(1)).alias("__times")).filter("__times > 1").drop("__times")


def _compared(marked: DataFrame, again: DataFrame) -> DataFrame:
    whole = marked.join(again, ["__digest_a", "__digest_b"], "left_semi").drop("__digest_a", "__digest_b")
    return whole.groupBy(*[col(n) for n in whole.columns]).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")


def group_facts(df: DataFrame, keys: list[str], m: str) -> DataFrame:
    """(dimension, category, total, average, count) of all keys in one scan: rows are combined per category before the
    shuffle. Rows without the category or the measure are left out."""
    v = measure(df, m).cast("double")
    cells = [F.struct(F.lit(k).alias("dimension"), present(df, k).cast("string").alias("category")) for k in keys]
    rows = df.select(v.alias("__v"), F.explode(F.array(*cells)).alias("__c")).filter("__v is not null and __c.category is not null")
    return rows.groupBy("__c.dimension", "__c.category").agg(F.sum("__v").alias("total"), F.avg("__v").alias("average"), F.count("__v").alias("count"))


def day_facts(df: DataFrame, dates: list[str], m: str | None) -> DataFrame:
    """(column, day, n, value, filled) of all date columns in one scan; value is the sum of m, or of rows without m."""
    v = measure(df, m).cast("double") if m else F.lit(1.0)
    cells = [F.struct(F.lit(d).alias("column"), as_day(df, d).alias("day")) for d in dates]
    rows = df.select(v.alias("__v"), F.explode(F.array(*cells)).alias("__c")).filter("__c.day is not null")
    return rows.groupBy("__c.column", "__c.day").agg(F.count(F.lit(1)).alias("n"), F.sum("__v").alias("value"))


class TableFacts:
    """The facts of one table. Parts are gathered when they are first used and kept as long as the object is."""

    def __init__(self, df: DataFrame):
        self.df, self.spark = df, df.sparkSession
        self._of_some: dict[tuple, DataFrame] = {}
        self.numbers, self.texts, self.times = numeric_columns(df), text_columns(df), time_columns(df)

    # --- one row per column, from one scan --------------------------------------------------------------------

    def _facts_of(self, n: str, all_missing: Column) -> list[Column]:
        df, zero = self.df, F.lit(0).cast("long")
        v = present(df, n).cast("double") if n in self.numbers else None
        text, none = n in self.texts, F.lit(None).cast("double")
        finite = F.when(F.abs(v) != float("inf"), v + F.lit(0.0)) if v is not None else None
        count, big = F.count(v) if v is not None else zero, F.abs(v) == float("inf") if v is not None else None
        d = count.cast("double")
        skew = F.try_divide(F.skewness(v) * F.sqrt(d * (d - 1)), d - 2) if v is not None else none
        ordered = not any(x in dtype_of(df, n).simpleString() for x in ("map<", "variant"))
        # at most one value: whatever the type, its least and its largest are the same
        single = F.coalesce(F.min(present(df, n)) == F.max(present(df, n)), F.lit(True)) if ordered else F.count_distinct(F.to_json(F.struct(col(n)))) <= 1
        # each different value sets one of 64 bits: as many values at least as bits
        bits = F.coalesce(F.bit_count(F.bit_or(F.when(finite.isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(finite), F.lit(64)).cast("int"))))),
                          F.lit(0)) if v is not None else F.lit(0)
        return [
            F.count(F.lit(1)).alias("rows"), F.count(present(df, n)).alias("filled"),
            (F.count_if(all_missing) if n == df.columns[0] else zero).alias("empty_rows"),
            (F.count(as_number(df, n)) if text else zero).alias("numbers"),
            (F.count(as_ts(df, n)) if text and N.is_date_name(n) else zero).alias("dates"),
            (F.count_if(big) if v is not None else zero).alias("infinite"),
            (F.coalesce(F.max(F.when(v == float("inf"), 1)), F.lit(0)) + F.coalesce(F.max(F.when(v == float("-inf"), 1)), F.lit(0))
             if v is not None else F.lit(0)).alias("infinities"),
            F.lit(text).alias("is_text"), F.lit(N.is_measure_name(n)).alias("measure_name"),
            (F.count_if(v < 0) if v is not None else zero).alias("negative"),
            (F.count_if(col(n) != strip(col(n))) if text else zero).alias("blanks"),
            single.alias("single"), bits.alias("bits"),
            (F.approx_count_distinct(col(n), SKETCH_ERROR) if text else zero).alias("sketch"),
            count.alias("count"), (F.avg(v) if v is not None else none).alias("mean"),
            (F.stddev_samp(v) if v is not None else none).alias("std"), (F.var_samp(v) if v is not None else none).alias("variance"),
            (F.min(v) if v is not None else none).alias("min"), (F.max(v) if v is not None else none).alias("max"),
            (F.when((count >= 3) & (F.min(v) < F.max(v)), skew).when(count >= 3, F.lit(0.0)) if v is not None else none).alias("skew"),
        ]

    @cached_property
    def columns(self) -> DataFrame:
        """Position, column and its facts: one scan of each COLUMNS_PER_SCAN columns, then a table as long as the schema."""
        df, frames = self.df, []
        all_missing = reduce(lambda a, n: a & missing(df, n), df.columns, F.lit(True))
        for start in range(0, len(df.columns), COLUMNS_PER_SCAN):
            chunk = df.columns[start:start + COLUMNS_PER_SCAN]
            packed = [F.struct(F.lit(start + i).alias("position"), F.lit(n).alias("column"), *self._facts_of(n, all_missing)).alias(f"c{i}")
                      for i, n in enumerate(chunk)]
            frames.append(df.agg(*packed).select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(chunk))]))))
        found = union_all(frames)
        self.rows_of_columns = found.collect()
        return self.spark.createDataFrame(self.rows_of_columns, found.schema)

    @cached_property
    def known(self) -> dict[str, dict]:
        """The same by column name."""
        self.columns
        return {r["column"]: r.asDict() for r in self.rows_of_columns}

    @property
    def size(self) -> int:
        return self.rows_of_columns[0]["rows"] if self.known else 0

    # --- values ------------------------------------------------------------------------------------------------

    @cached_property
    def variants(self) -> DataFrame:
        """Per text column with values: distinct, raw, unified, affected. Columns with one value aren't counted again."""
        names = [n for n in self.texts if not self.known[n]["single"]]
        one = [(n, 1, 1, 1, k["filled"] if k["filled"] > 1 else 0) for n in self.texts if (k := self.known[n])["single"] and k["filled"]]
        schema = "column string, distinct long, raw long, unified long, affected long"
        alone = self.spark.createDataFrame(one, schema)
        if not names:
            return alone
        return kept(text_facts(value_frequencies(self.df, names)).select(*alone.columns).union(alone))

    def distinct_texts(self, least: float) -> DataFrame:
        """(column, distinct) of text columns in which at least that share of values could be different by the sketch, whose
        error is far below the fifth that it is given here."""
        if "variants" in self.__dict__:
            return self.variants.select("column", "distinct")
        names = [n for n in self.texts if (k := self.known[n])["filled"] and k["sketch"] >= 0.8 * least * k["filled"]]
        if not names:
            return self.spark.createDataFrame([], "column string, distinct long")
        return value_frequencies(self.df, names).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))

    def several(self, names: list[str], least: int) -> dict[str, bool]:
        """Whether number columns hold at least that many different finite values. Bits settle it where enough are set; the
        values of the others are counted, which are few unless very many share a handful of bits."""
        out = {n: self.known[n]["bits"] >= least for n in names}
        open_ = [n for n in names if not out[n] and not self.known[n]["single"]]
        if open_:
            found = value_frequencies(self.df, open_).groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()
            out.update({r["column"]: r["d"] - self.known[r["column"]]["infinities"] >= least for r in found})
        return out

    @cached_property
    def frequencies(self) -> DataFrame:
        """Per column with values: unique_values, filled, top_frequency, top_value, n_modes, and `modes`, the first
        NAMED_MODES of them."""
        return self._frequencies(self.df.columns)

    def frequencies_of(self, names: list[str]) -> DataFrame:
        """The same of some columns: the values of no other are counted, unless all have been."""
        if "frequencies" in self.__dict__:
            return self.frequencies.filter(F.col("column").isin(names))
        return self._kept_of("frequencies", names, self._frequencies)

    def _kept_of(self, part: str, names: list[str], make: Callable[[list[str]], DataFrame]) -> DataFrame:
        key = (part, *names)
        if key not in self._of_some:
            self._of_some[key] = make(names)
        return self._of_some[key]

    def _frequencies(self, names: list[str]) -> DataFrame:
        freq = value_frequencies(self.df, names)
        facts = frequency_facts(freq)
        # as many modes as are named, per column; the limit is applied before the shuffle as well
        place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
        top = freq.withColumn("place", place).filter(F.col("place") <= NAMED_MODES)
        top = top.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("place", "n", "value"))).alias("__top"))
        modes = F.transform(F.filter("__top", lambda t: t["n"] == F.col("top_frequency")), lambda t: t["value"])
        return kept(facts.join(F.broadcast(top), "column").withColumn("modes", modes).drop("__top"))

    # --- numbers -----------------------------------------------------------------------------------------------

    def _quartiles(self, names: list[str], finite: bool) -> DataFrame:
        found = quartile_facts(self.df, names, finite) if names else None
        schema = "column string, outliers long, outside long, whisker_low double, whisker_high double, n long, q1 double, median double, q3 double, iqr double, low double, high double"
        return self.spark.createDataFrame(found.collect() if names else [], found.schema if names else schema)

    @cached_property
    def quartiles(self) -> DataFrame:
        """Quartiles, fences and outliers of all number columns with values."""
        return self._quartiles([n for n in self.numbers if self.known[n]["count"]], False)

    def quartiles_of(self, names: list[str]) -> DataFrame:
        """The same of some number columns: the others aren't read for it, unless all have been."""
        if "quartiles" in self.__dict__:
            return self.quartiles.filter(F.col("column").isin(names))
        filled = [n for n in names if n in self.numbers and self.known[n]["count"]]
        return self._kept_of("quartiles", filled, lambda some: self._quartiles(some, False))

    @cached_property
    def finite_quartiles(self) -> DataFrame:
        """The same over finite values: only columns that hold an infinite one are read again."""
        wild = [n for n in self.numbers if self.known[n]["infinite"]]
        rest = [n for n in self.numbers if n not in wild]
        if not wild:
            return self.quartiles
        if "quartiles" in self.__dict__:
            return self.quartiles.filter(F.col("column").isin(rest)).unionByName(self._quartiles(wild, True))
        return self._quartiles([n for n in self.numbers if self.known[n]["count"]], True)

    # --- rows --------------------------------------------------------------------------------------------------

    @cached_property
    def duplicate_rows(self) -> int:
        """How many rows repeat an earlier one."""
        if not self.size:
            return 0
        marked = _digested(self.df)
        again = kept(_again(marked))
        times = again.count()
        if not times:  # no digest occurs again: the rows needn't be read and moved to be compared
            return 0
        again = F.broadcast(again) if times <= BROADCAST_DIGESTS else again
        return _compared(marked, again).agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0))).first()[0]

    @property
    def missing_cells(self) -> int:
        return sum(k["rows"] - k["filled"] for k in self.known.values())

    @cached_property
    def summary(self) -> DataFrame:
        """One row: rows, columns by type, missing cells and duplicate rows."""
        row = (self.known and self.size or 0, len(self.df.columns), len(self.numbers), len(self.texts), len(self.times), self.missing_cells, self.duplicate_rows)
        return self.spark.createDataFrame([row], "rows long, columns int, numeric_columns int, categorical_columns int, datetime_columns int, "
                                                 "missing_cells long, duplicate_rows long")
