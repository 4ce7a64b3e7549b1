"""The Haar transform of trees, and its inverse, as one aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haargrid.functions import paths


def _steps(leaves: DataFrame) -> DataFrame:
    """A row for each leaf and ancestor: the ancestor's path and refinement, the leaf's slot there and its share of it."""
    at = F.sequence(F.lit(0), F.size("refs") - 1)
    up = leaves.filter(F.size("refs") > 0).select("*", F.explode(at).alias("d"))
    below = F.aggregate(F.slice("refs", F.col("d") + 1, F.size("refs")), F.lit(0), lambda a, r: a + paths.bits(r))
    return up.select(
        "tree_id", "path", "value", "d",
        F.substr("path", F.lit(1), F.col("d")).alias("node"),
        F.element_at("refs", F.col("d") + 1).alias("ref"),
        paths.slot(F.col("path"), F.col("d")).alias("slot"),
        F.pow(F.lit(2.0), -below).alias("share"),
    )


def forward(leaves: DataFrame) -> DataFrame:
    """(tree_id, path, j, c) of all inner nodes: j = 0 the mean, j > 0 details.

    A coefficient is a signed sum over the leaves below, so sums start before the shuffle
    and one shuffle serves all levels.
    """
    s = _steps(leaves)
    s = s.select("*", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), paths.bits(F.col("ref"))) - 1)).alias("j"))
    return s.groupBy("tree_id", F.col("node").alias("path"), "j").agg(F.sum(paths.sign(F.col("slot"), F.col("j")) * F.col("value") * F.col("share")).alias("c"))


def inverse(leaves: DataFrame, coefs: DataFrame) -> DataFrame:
    """Leaf values from the root's mean and all ancestors' details: one join, one aggregation.

    ``leaves`` gives the shape; its values aren't read. A tree of one leaf has no coefficients and is left out.
    """
    s = _steps(leaves.withColumn("value", F.lit(0.0)))
    c = coefs.select("tree_id", F.col("path").alias("node"), "j", "c").filter((F.col("j") > 0) | (F.col("node") == ""))
    return s.join(c, ["tree_id", "node"]).groupBy("tree_id", "path").agg(F.sum(paths.sign(F.col("slot"), F.col("j")) * F.col("c")).alias("value"))


def node_means(leaves: DataFrame) -> DataFrame:
    """Means of all inner nodes, without a transform."""
    return _steps(leaves).groupBy("tree_id", F.col("node").alias("path")).agg(F.sum(F.col("value") * F.col("share")).alias("mean"), F.first("ref").alias("ref"))
