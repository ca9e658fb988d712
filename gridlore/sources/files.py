"""Reading and writing tables as files."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.functions import names as N
from gridlore.functions.columns import as_ts, col, text_columns

__all__ = ["read_csv", "dedupe_columns", "unique_names", "promote_dates", "write_csv", "write_table", "preview"]


# Cells that stand for a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
_NUMBER_TYPES = ("int", "bigint", "double")
_PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def unique_names(names: list[str]) -> list[str]:
    """``a, a, a`` becomes ``a, a_2, a_3``; a number whose name is taken, before or after, is passed over."""
    taken, used, out = set(names), set(), []
    for n in names:
        new = n
        if n in used:
            new = next(x for x in (f"{n}_{k}" for k in count(2)) if x not in taken)
            taken.add(new)
        used.add(new)
        out.append(new)
    return out


def dedupe_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def _header(spark: SparkSession, path: str, encoding: str, multi_line: bool) -> list[str]:
    """The header's own names: Spark's reader would rename repeated ones."""
    first = (
        spark.read.option("header", False).option("inferSchema", False)
        .option("encoding", encoding).option("escape", '"').option("multiLine", multi_line).csv(path).first()
    )
    if first is None:
        raise ValueError(f"no header line in {path}")
    return ["" if v is None else v for v in first]


def read_csv(
    spark: SparkSession, path: str, max_cols: int | None = None, max_rows: int | None = None,
    encoding: str | None = None, schema: T.StructType | None = None, multi_line: bool = False,
    missing: tuple[str, ...] = MISSING,
) -> DataFrame:
    """Read a CSV with a header.

    Without an encoding UTF-8 is tried and Latin-1 used if bytes do not decode.
    Repeated names are numbered. Files without columns or rows, or above the given
    limits, are refused. Give ``schema`` to avoid the type-inference pass over large files.
    ``multi_line`` reads line breaks inside quotes, one file to a task. Cells that are a token of ``missing`` are
    missing; a column that is text only because of them gets the type of its other cells.
    """
    tried = encoding or "UTF-8"
    names = _header(spark, path, tried, multi_line)
    if encoding is None and _undecodable(spark, path):
        tried = "ISO-8859-1"
        names = _header(spark, path, tried, multi_line)
    if max_cols is not None and len(names) > max_cols:
        raise ValueError(f"{path} has {len(names)} columns, over the limit of {max_cols}")
    reader = (
        spark.read.option("header", True).option("mode", "FAILFAST").option("encoding", tried)
        .option("enforceSchema", True).option("escape", '"').option("multiLine", multi_line)
    )
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path)
    df = df.toDF(*unique_names(names)) if len(df.columns) == len(names) else dedupe_columns(df)
    if df.isEmpty():
        raise ValueError(f"nothing but a header in {path}")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"{path} is over the limit of {max_rows} rows")
    return _without_tokens(df, missing, retype=schema is None)


def _without_tokens(df: DataFrame, tokens: tuple[str, ...], retype: bool) -> DataFrame:
    """Text cells that are one of the tokens become missing."""
    texts = text_columns(df) if tokens else []
    if not texts:
        return df
    cells = {n: F.when(~F.trim(col(n)).isin(list(tokens)), col(n)) for n in texts}
    if not retype:
        return df.withColumns(cells)
    plain = lambda n: F.when(cells[n].rlike(_PLAIN_NUMBER), F.trim(cells[n]))
    facts = df.agg(*[F.array(
        F.count(col(n)), F.count(cells[n]), *(F.count(plain(n).try_cast(t)) for t in _NUMBER_TYPES),
    ).alias(f"n{i}") for i, n in enumerate(texts)]).first()  # one row
    for i, n in enumerate(texts):
        before, after, *fit = facts[i]
        if before > after > 0:
            kind = next((t for t, k in zip(_NUMBER_TYPES, fit) if k == after), None)
            if kind:
                cells[n] = F.trim(cells[n]).try_cast(kind)
    return df.withColumns(cells)


def _undecodable(spark: SparkSession, path: str) -> bool:
    """Does any line hold a byte sequence that UTF-8 does not know."""
    lines = spark.read.text(path)
    return not lines.filter(~F.is_valid_utf8("value")).isEmpty()


def promote_dates(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Turn text columns with a date-like name into timestamps when enough values parse."""
    names = [n for n in text_columns(df) if N.may_promote(n)]
    if not names:
        return df
    ratios = df.agg(*[
        F.try_divide(F.count(as_ts(df, n)).cast("double"), F.count(col(n))).alias(f"r{i}")
        for i, n in enumerate(names)
    ]).first()  # one row
    chosen = [n for i, n in enumerate(names) if (ratios[i] or 0.0) >= threshold]
    return df.withColumns({n: as_ts(df, n) for n in chosen}) if chosen else df


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.option("escape", "\"").mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Write as Parquet, JSON, ORC or CSV."""
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def preview(df: DataFrame, n: int, order_by: list) -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(*order_by).limit(n)
