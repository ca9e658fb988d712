"""Row positions in a global order, computed by all tasks of a distributed sort."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def use_checkpoint_folder(spark: SparkSession) -> None:
    """Point Spark at the shared checkpoint folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a shared folder.")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(folder)


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in ``order``.

    The sort is range-partitioned, so every task numbers its own slice; the slice
    offsets (one row per partition) are summed and added. The sorted rows are
    checkpointed because both steps must see the same slices.
    """
    use_checkpoint_folder(df.sparkSession)
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.checkpoint(eager=False)
    slice_no = F.shiftright("_id", 33)
    sizes = placed.groupBy(slice_no.alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    # A running sum over one row per sort partition.
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_slice", slice_no).join(F.broadcast(offsets), "_slice")
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, F.col("_before") + within + 1).drop("_id", "_slice", "_before")
