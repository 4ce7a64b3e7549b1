"""Statistics of measurements by (thingi_id, level): pivots, aggregates, extremes, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haargrid.functions.tables import settled

METHODS = ("can", "ds", "vdb")


def clean(col: str):
    """NaN counts as missing."""
    c = F.col(col).cast("double")
    return F.when(~F.isnan(c), c)


def level_pivot(stats: DataFrame, col: str, levels: list[int]) -> DataFrame:
    """A row for each thing, a column for each level with its first value; things without any value go."""
    wide = stats.groupBy("thingi_id").pivot("level", levels).agg(F.first(clean(col), ignorenulls=True))
    names = [f"l{x}" for x in levels]
    return wide.toDF("thingi_id", *names).dropna(how="all", subset=names)


def long(stats: DataFrame, suffix: str = "bytes") -> DataFrame:
    """(thingi_id, level, method, value) of each method's column."""
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), clean(f"{m}_{suffix}").alias("value")) for m in METHODS])
    return stats.select("thingi_id", "level", F.inline(pairs))


def level_aggregate(stats: DataFrame) -> DataFrame:
    """Rows, mean and exact median for each level and method; missing values count as rows only.

    Equal values are counted before they are gathered for the median, so its state follows the
    number of different values.
    """
    counts = long(stats).groupBy("level", "method", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("level", "method").agg(
        F.sum("n").alias("n"), (F.sum(F.col("value") * F.col("n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("n")))).alias("mean"), F.percentile("value", 0.5, F.col("n")).alias("median")
    )


def extremal(stats: DataFrame, num: str, den: str, n: int = 10) -> DataFrame:
    """The n smallest and n largest ratios of each level, both in ascending order; with under 2n rows some are in both.

    Ranks are limited before the shuffle, so a level of very many rows costs n rows for each task.
    """
    r = stats.filter((F.col(num) > 0) & (F.col(den) > 0)).select("level", "thingi_id", (F.col(num) / F.col(den)).alias("ratio"))

    def top(block: str, *order):
        w = Window.partitionBy("level").orderBy(*order)
        return r.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).withColumn("block", F.lit(block))

    low = top("smallest", F.col("ratio"), F.col("thingi_id"))
    high = top("largest", F.col("ratio").desc(), F.col("thingi_id").desc())
    return low.unionByName(high)


def slopes(stats: DataFrame) -> DataFrame:
    """Growth rates (log2) of mean and median between neighbouring levels, for each method; missing where the lower is not positive."""
    agg = long(stats).filter(F.col("value").isNotNull()).groupBy("level", "method", "value").agg(F.count("*").alias("k"))
    agg = agg.groupBy("level", "method").agg((F.sum(F.col("value") * F.col("k")) / F.sum("k")).alias("mean"), F.percentile("value", 0.5, F.col("k")).alias("median"), F.sum("k").alias("n"))
    w = Window.partitionBy("method").orderBy("level")  # a row for each level by now
    nxt = lambda c: F.lead(c).over(w)
    pairs = agg.select("method", F.col("level").alias("lo"), nxt("level").alias("hi"), F.col("mean").alias("mean_lo"), nxt("mean").alias("mean_hi"), F.col("median").alias("median_lo"), nxt("median").alias("median_hi"), F.col("n").alias("n_lo"), nxt("n").alias("n_hi"))
    rate = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.log2(F.col(b) / F.col(a)))
    return pairs.filter(F.col("hi").isNotNull()).withColumn("rate_mean", rate("mean_lo", "mean_hi")).withColumn("rate_median", rate("median_lo", "median_hi"))


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't there yet: appends can be repeated."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def slice_of(items: DataFrame, order: str, i: int, n: int) -> DataFrame:
    """The i-th of n slices in order; bounds are rounded half to even.

    Positions come from counts by range partition, not from one window over all rows.
    """
    ranged = items.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranged = settled(ranged)
    counts = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect())  # a number for each partition
    total, before, offsets = sum(c for _, c in counts), 0, []
    for p, c in counts:
        offsets += [F.lit(p), F.lit(before)]
        before += c
    if not offsets:
        return items.limit(0).withColumn("row", F.lit(0).cast("long"))
    row = F.col("row") + F.create_map(*offsets)[F.col("part")].cast("long")
    lo, hi = round(i * total / n), round((i + 1) * total / n)
    return ranged.withColumn("row", row).filter((F.col("row") >= lo) & (F.col("row") < hi)).drop("part")


def unequal_cells(grids: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(first, second, cells): for each pair of reconstructions how many cells differ; missing cells count as such.

    Cells of all grids meet in one shuffle, so a further grid costs no further joins.
    """
    from functools import reduce

    names = sorted(grids)
    rows = reduce(DataFrame.unionByName, [grids[n].select(*keys, F.lit(n).alias("of"), F.col("value").cast("double").alias("value")) for n in names])
    wide = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("of") == n, F.col("value"))).alias(n) for n in names])
    pairs = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), (~F.col(a).eqNullSafe(F.col(b))).alias("differs")) for i, a in enumerate(names) for b in names[i + 1 :]]
    return wide.select(F.inline(F.array(*pairs))).groupBy("first", "second").agg(F.count_if("differs").alias("cells"))
