"""Images end to end: trees of the largest grid of powers of two in an image, compressed, resampled and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haargrid.functions import paths
from haargrid.functions.tables import settled
from haargrid.operators import coarsen, sparse

#: Details up to it go.
LOSSLESS = 1e-7


def boxes(cells: DataFrame, cap: int | None = None) -> DataFrame:
    """(grid, low_x .., level_x ..) of each image: its largest grid of powers of two, sides apart and capped if asked; one cell deep."""
    size = cells.groupBy(F.col("tree_id").alias("grid")).agg((F.max("x") + 1).alias("x"), (F.max("y") + 1).alias("y"))
    lx, ly = sparse.base_levels([F.col("x"), F.col("y")], cap)
    return size.select("grid", *[F.lit(0).cast("long").alias(f"low_{c}") for c in "xyz"], lx.cast("int").alias("level_x"), ly.cast("int").alias("level_y"), F.lit(0).alias("level_z"))


def resampled(leaves: DataFrame, box: DataFrame, coarser: int = 0) -> DataFrame:
    """(tree_id, x, y, value) at ``coarser`` levels above each box's own: what leaves cover there, by area.

    A leaf that is larger than a cell is dealt out to its cells, smaller ones are added up; no finer raster is made.
    """
    out = leaves.join(box.withColumnRenamed("grid", "tree_id"), "tree_id")
    weight, cell = F.lit(1.0), []
    for d, c in enumerate("xy"):
        target = F.greatest(F.col(f"level_{c}") - coarser, F.lit(0))
        own = paths.level(F.col("refs"), d)
        up, down = F.greatest(target - own, F.lit(0)), F.greatest(own - target, F.lit(0))
        low = F.call_function("shiftright", F.call_function("shiftleft", paths.index(F.col("path"), F.col("refs"), d).cast("long"), up), down)
        cell.append((low, up))
        weight = weight / F.call_function("shiftleft", F.lit(1).cast("long"), down)
    out = out.select("tree_id", "value", weight.alias("weight"), *[a.alias(n) for (low, up), c in zip(cell, "xy", strict=True) for a, n in ((low, f"at_{c}"), (up.cast("int"), f"up_{c}"))])
    last = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("up_x") + F.col("up_y")) - 1
    each = out.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    x = F.col("at_x") + F.call_function("shiftright", F.col("i"), F.col("up_y"))
    y = F.col("at_y") + F.col("i").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("up_y")) - 1)
    return each.groupBy("tree_id", x.alias("x"), y.alias("y")).agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def compressed(cells: DataFrame, threshold: float = LOSSLESS, cap: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(boxes, full trees, canonical trees) of images (tree_id, x, y, value)."""
    box = settled(boxes(cells, cap))
    full = settled(sparse.full(cells.withColumnRenamed("tree_id", "grid").withColumn("z", F.lit(0).cast("long")), box))
    return box, full, settled(coarsen.canonical(full, threshold).select("tree_id", "path", "refs", "value"))


def summary(box: DataFrame, full: DataFrame, after: DataFrame) -> DataFrame:
    """For each image boxes and nodes before and after, the largest and the mean difference."""
    def size(leaves, name):
        inner = leaves.select("tree_id", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda k: F.substr("path", F.lit(1), k))).alias("node")).distinct()
        return inner.groupBy("tree_id").agg(F.count("*").alias(f"nodes_{name}")).join(leaves.groupBy("tree_id").agg(F.count("*").alias(f"boxes_{name}")), "tree_id")

    a, b = resampled(full, box).withColumnRenamed("value", "a"), resampled(after, box).withColumnRenamed("value", "b")
    e = a.join(b, ["tree_id", "x", "y"]).groupBy("tree_id").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_difference"), F.avg(F.col("a") - F.col("b")).alias("mean_difference"))
    return size(full, "before").join(size(after, "after"), "tree_id").join(e, "tree_id")
