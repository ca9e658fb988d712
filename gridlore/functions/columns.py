"""Column helpers: quoting, type groups, missing values, text and date coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITESPACE = " \t\n\r\x0b\f"

_NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(?i)[+-]?inf(inity)?$"

# The text shapes accepted as dates, each with its format.
_ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"
_DATE_SHAPES = (
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Z][a-z]{3,8} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{3,8} \d{4}$", "d MMMM yyyy"),
)


def col(name: str) -> Column:
    """Reference a column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def require(df: DataFrame, *names: str) -> None:
    """Raise before any job runs when a named column does not exist."""
    for name in names:
        if name not in df.columns:
            close = [c for c in df.columns if name.lower() in c.lower()]
            hint = f" Did you mean '{close[0]}'?" if close else ""
            raise ValueError(f"Column '{name}' not found.{hint} Available: {', '.join(df.columns[:8])}")


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def integer_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    ]


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so that one rule covers missing values."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_floating(dtype_of(df, name)) else c


def missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    return c.isNull() | F.isnan(c) if is_floating(dtype_of(df, name)) else c.isNull()


def without_nan(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if is_floating(f.dataType)]
    return df.withColumns({n: present(df, n) for n in floats}) if floats else df


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def fold(c: Column) -> Column:
    """Trimmed, lower-cased text: the form in which categories are compared."""
    return F.lower(strip(c))


def to_number(c: Column) -> Column:
    """Text to double; thousands commas are dropped and anything else is NULL."""
    plain = strip(F.replace(c, F.lit(","), F.lit("")))
    return F.when(plain.rlike(_NUMBER_SHAPE), plain.try_cast("double"))


def to_ts(c: Column) -> Column:
    """Text to timestamp over a fixed list of shapes; anything else is NULL."""
    plain = strip(c)
    parsed = F.when(plain.rlike(_ISO_SHAPE), plain.try_cast("timestamp_ntz"))
    for shape, fmt in _DATE_SHAPES:
        parsed = parsed.when(
            plain.rlike(shape), F.try_to_timestamp(plain, F.lit(fmt)).cast("timestamp_ntz")
        )
    return parsed


def as_number(df: DataFrame, name: str) -> Column:
    """Any column as a double without NaN; text is coerced."""
    dtype = dtype_of(df, name)
    if isinstance(dtype, T.StringType):
        return to_number(col(name))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return present(df, name).cast("double")
    return F.lit(None).cast("double")


def measure(df: DataFrame, name: str) -> Column:
    """A measure to aggregate: numeric columns keep their type, text is coerced."""
    return present(df, name) if isinstance(dtype_of(df, name), T.NumericType) else as_number(df, name)


def as_ts(df: DataFrame, name: str) -> Column:
    """Any column as a zone-free timestamp; text is coerced."""
    dtype = dtype_of(df, name)
    if isinstance(dtype, T.TimestampNTZType):
        return col(name)
    if isinstance(dtype, (T.DateType, T.TimestampType)):
        return col(name).cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        return to_ts(col(name))
    return F.lit(None).cast("timestamp_ntz")


def as_day(df: DataFrame, name: str) -> Column:
    c = col(name) if isinstance(dtype_of(df, name), T.DateType) else as_ts(df, name)
    return c.cast("date")


def rows_total(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("rows")).scalar()


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))
