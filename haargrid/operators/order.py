"""Places of rows in their group's order, without gathering a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haargrid.functions.tables import settled


def numbered(rows: DataFrame, key: str, order: list[Column], name: str = "ordinal") -> DataFrame:
    """``rows`` with their place within their key by ``order``, from 0.

    Rows are dealt out by range, so a key of any size is as many tasks as it takes; counts of each partition's runs give what
    comes before. ``order`` should tell the rows of a key apart.
    """
    by = [F.col(key), *order]
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    placed = settled(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("run_", F.shiftright(at, 33)).withColumn("place_", at.bitwiseAND((1 << 33) - 1)))
    runs = placed.groupBy(key, "run_").agg(F.count("*").alias("rows_"), F.min("place_").alias("first_"))
    earlier = Window.partitionBy(key).orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)
    shift = runs.select(key, "run_", (F.coalesce(F.sum("rows_").over(earlier), F.lit(0)) - F.col("first_")).alias("shift_"))
    return placed.join(shift, [key, "run_"]).withColumn(name, F.col("place_") + F.col("shift_")).drop("run_", "place_", "shift_")
