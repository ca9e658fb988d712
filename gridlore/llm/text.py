"""Column helpers that the operators of this subpackage share."""

from __future__ import annotations

import string
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def ship(name: str) -> None:
    """Send the functions of this module to Python workers by value, so that they needn't have the library installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def numbers(values) -> Column:
    """A literal array of doubles, folded to a constant by the optimizer."""
    return F.split(F.lit(" ".join(repr(float(x)) for x in values)), " ").cast("array<double>")


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Texts of ASCII alone take the quick way."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column, separators: str = SPACE) -> Column:
    """What lies between runs of separators, in order."""
    return F.array_remove(F.split(whole(text), separators), "")


def share(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(-1))


def keep_checkpoints(spark: SparkSession) -> None:
    """Point Spark at the folder in spark.checkpoint.dir. Only a local session without that setting uses the warehouse; on a
    cluster its default is a folder of the driver's machine, so that the setting is asked for."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("Set spark.checkpoint.dir to a shared folder.")
            folder = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
        sc.setCheckpointDir(folder)


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder, so that later steps and lost executors don't compute them again."""
    keep_checkpoints(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
