"""Jobs over thresholds: the comparison of methods, rows of a sweep, rows of statistics, stages that are stored and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haargrid.functions.tables import settled
from haargrid.operators import coarsen, grid, order, restructure
from haargrid.sources import files, masks

VALUE_BITS = 32


def stages(leaves: DataFrame, thresholds: list[float], bound: str = "flat") -> DataFrame:
    """Leaves of (threshold, variant): canonical trees ("can"), and those restructured afterwards ("ds").

    The threshold is part of a tree's key, so all of them share each round and leave the loop tree by tree.
    """
    every = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    keyed = leaves.select("tree_id", "path", "refs", "value", every).withColumn("tree_id", F.struct("threshold", "tree_id")).drop("threshold")
    own = F.col("tree_id.threshold")
    can = settled(coarsen.canonical(keyed, own, bound).select("tree_id", "path", "refs", "value"))
    ds = restructure.batched(can, own, bound).select("tree_id", "path", "refs", "value")
    both = can.withColumn("variant", F.lit("can")).unionByName(ds.withColumn("variant", F.lit("ds")))
    return settled(both.select(own.alias("threshold"), "variant", F.col("tree_id.tree_id").alias("tree_id"), "path", "refs", "value"))


def _keyed(stage: DataFrame, keys: list[str]) -> DataFrame:
    """Trees of all stages as trees of one table: the id is (keys, tree)."""
    return stage.withColumn("tree_id", F.struct(*keys, "tree_id"))


def sizes(stage: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """(keys, tree_id, nodes, boxes, topo_bits, ref_counts, n_nonbg_leaves) of every tree."""
    s = grid.tree_stats(_keyed(stage, keys), dims)
    nonbg = stage.groupBy(*keys, "tree_id").agg(F.count_if(F.col("value") != 0).alias("n_nonbg_leaves"))
    return s.select(*[F.col(f"tree_id.{k}").alias(k) for k in keys], F.col("tree_id.tree_id").alias("tree_id"), "nodes", "boxes", "topo_bits", "ref_counts").join(nonbg, [*keys, "tree_id"])


def cell_errors(stage: DataFrame, cells: DataFrame, keys: list[str], dims: int, level: int) -> DataFrame:
    """(keys, tree_id, cell, value): each cell with the value of the leaf that holds it, however the tree is refined.

    ``cells`` has (tree_id, coordinates, value) of grids of 2 ** level cells a side.
    """
    at = ["tree_id", *grid.AXES[:dims]]
    inside = grid.filled(stage.select(*keys, "tree_id", "path", "refs", "value"), dims, level).select(*keys, *at, "value")
    return inside.join(cells.select(*at, F.col("value").alias("cell")), at)


def comparison(leaves: DataFrame, thresholds: list[float], dims: int, level: int) -> DataFrame:
    """For each threshold and method the nodes, boxes, bits, the ratio to the dense grid and the largest error, over all trees.

    Methods: the given trees, canonical, restructured, and the dense grid. ``leaves`` are trees over grids of
    2 ** level cells a side.
    """
    keys = ["threshold", "variant"]
    every = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    given = leaves.select("tree_id", "path", "refs", "value", every).withColumn("variant", F.lit("given"))
    stage = settled(given.unionByName(stages(leaves, thresholds)))
    total = sizes(stage, keys, dims).groupBy(*keys).agg(F.sum("nodes").alias("nodes"), F.sum("boxes").alias("boxes"), F.sum("topo_bits").alias("topo_bits"))
    cells = grid.rasterise(leaves, dims, level)
    errors = cell_errors(stage, cells, keys, dims, level).groupBy(*keys).agg(F.max(F.abs(F.col("cell") - F.col("value"))).alias("max_error"), F.count("*").alias("cells"))
    rows = total.join(errors, keys).withColumn("coeff_bits", F.col("boxes") * VALUE_BITS)
    dense = rows.filter("variant = 'given'").select("threshold", F.lit("dense").alias("variant"), F.lit(0).cast("long").alias("nodes"), F.col("cells").alias("boxes"), F.lit(0).cast("long").alias("topo_bits"), F.lit(0.0).alias("max_error"), "cells", (F.col("cells") * VALUE_BITS).alias("coeff_bits"))
    bits = F.col("topo_bits") + F.col("coeff_bits")
    return rows.unionByName(dense).select(*keys, "nodes", "boxes", "topo_bits", "coeff_bits", bits.alias("total_bits"), (bits / (F.col("cells") * VALUE_BITS)).alias("ratio_to_dense"), "max_error")


def _bytes(bits: Column | str) -> Column:
    return F.ceil((F.col(bits) if isinstance(bits, str) else bits) / 8).cast("long")


def voxel_summary(voxels: DataFrame, bits_per_value: int) -> DataFrame:
    """For each grid what the usual sparse tree of 8, 16 and 32 cells a side needs for its stored voxels."""
    t = files.voxel_topology(voxels)
    leaf = F.col("level") == 0
    s = t.groupBy("grid").agg(F.sum("mask_bits").alias("topo_bits"), F.max(F.when(leaf, F.col("nodes"))).alias("leaf_nodes"), F.max(F.when(leaf, F.col("voxels"))).alias("active"))
    return s.select(
        "grid", "topo_bits", _bytes("topo_bits").alias("topo_bytes"), F.col("active").alias("active_leaf_voxels"), (F.col("leaf_nodes") * 512 * bits_per_value).alias("dense_value_bits"),
        (F.col("active") * bits_per_value).alias("active_value_bits"), F.col("active").alias("active_leaf"), (F.col("leaf_nodes") * 512 - F.col("active")).alias("inactive_leaf"), F.lit(0).cast("long").alias("active_tiles"),
        F.col("active").alias("total_leaf_coefficients"), F.col("active").alias("total_coefficients"), _bytes(F.col("topo_bits") + F.col("leaf_nodes") * 512 * bits_per_value).alias("file_bytes"),
    )


def approximate_topology(voxels: DataFrame) -> DataFrame:
    """What is known of a sparse tree without counting its inner masks: leaf masks exactly, two masks of each inner node's children roughly."""
    t = files.voxel_topology(voxels)
    leaf = F.col("level") == 0
    s = t.groupBy("grid").agg(F.sum(F.when(leaf, F.col("nodes")).otherwise(0)).alias("leaf_count"), F.sum(F.when(leaf, 0).otherwise(F.col("nodes"))).alias("non_leaf_count"), F.max(F.when(leaf, F.col("voxels"))).alias("active_voxels"))
    own, rest = F.col("leaf_count") * 512, F.col("non_leaf_count") * 2 * 4096
    return s.select("grid", "leaf_count", "non_leaf_count", "active_voxels", own.alias("leaf_topo_bits"), rest.alias("internal_topo_bits_approx"), (own + rest).alias("total_topo_bits_approx"))


def sweep_rows(leaves: DataFrame, thresholds: list[float], dims: int, level: int, voxels: DataFrame) -> DataFrame:
    """A row of the 26 columns for each threshold and variant, over all trees as one data set.

    Sizes of a library that may be absent stay empty; files of voxels are taken as topology and dense leaf values.
    """
    keys = ["threshold", "variant"]
    stage = stages(leaves, thresholds)
    size = sizes(stage, keys, dims).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("nodes", "boxes", "topo_bits", "n_nonbg_leaves")], F.sum(_bytes("topo_bits")).alias("desc_raw_bytes"))
    e, s = F.abs(F.col("cell") - F.col("value")), F.abs(F.col("value"))
    norms = cell_errors(stage, grid.rasterise(leaves, dims, level), keys, dims, level).groupBy(*keys).agg(
        F.max(e).alias("Linf_error"), F.avg(e).alias("L1_error"), F.sqrt(F.avg(e * e)).alias("L2_error"), F.max(s).alias("Linf_sol"), F.avg(s).alias("L1_sol"), F.sqrt(F.avg(s * s)).alias("L2_sol")
    )
    whole = voxel_summary(voxels, VALUE_BITS).agg(F.sum("file_bytes").alias("vdb_orig_file_bytes"), F.sum("topo_bits").alias("vdb_orig_topo_bits"), F.sum("active_leaf_voxels").alias("vdb_orig_active_voxels"), F.sum("total_coefficients").alias("vdb_orig_total_coefficients"))
    rows = size.join(norms, keys).withColumn("n_leaves", F.col("boxes")).withColumn("values_raw_bytes", F.col("boxes") * 4).withColumn("raw_total_bytes", F.col("desc_raw_bytes") + F.col("values_raw_bytes"))
    rows = rows.withColumn("one", F.lit(1)).join(whole.withColumn("one", F.lit(1)), "one")
    return files.conform(rows.withColumn("ratio_raw_vs_vdb", F.try_divide(F.col("raw_total_bytes").cast("double"), F.col("vdb_orig_file_bytes"))), files.SWEEP)


def stats_rows(leaves: DataFrame, voxels: DataFrame, things: DataFrame, threshold: float, dims: int) -> DataFrame:
    """A row of the 33 columns for each thing and level: ``things`` has (tree_id, thingi_id, level). ``voxels.grid`` is a tree's id too.
    Values are single bits."""
    keys = ["threshold", "variant"]
    size = sizes(stages(leaves, [threshold]), keys, dims)
    coeffs, desc = _bytes("boxes"), _bytes("topo_bits")
    out = None
    for v in ("can", "ds"):
        part = size.filter(F.col("variant") == v).select(
            "tree_id", *[F.col(c).alias(f"{v}_{c}") for c in ("nodes", "boxes", "topo_bits", "ref_counts")], (coeffs + desc).alias(f"{v}_raw_total_bytes"), desc.alias(f"{v}_desc_raw_bytes"), coeffs.alias(f"{v}_coeffs_raw_bytes")
        )
        out = part if out is None else out.join(part, "tree_id", "left")
    vdb = voxel_summary(voxels, 1)
    vdb = vdb.select(F.col("grid").alias("tree_id"), *[F.col(c).alias(f"vdb_{c}") for c in vdb.columns[1:]])
    return files.conform(things.join(out, "tree_id").join(vdb, "tree_id", "left"), files.STATS)


# stored stages


def save_stage(leaves: DataFrame, path: str, stage: str, threshold: float, dims: int, background: float = 0.0) -> None:
    """Shapes, packed masks and values that differ from the background, below ``path`` by stage and threshold.

    Leaves are numbered in order; the mask has one bit for each, and values are numbered by the rank of their leaf's bit. Saving a
    stage again replaces it.
    """
    at = f"{path}/stage={stage}/threshold={threshold}"
    rows = settled(order.numbered(leaves.select("tree_id", "path", "refs", "value"), "tree_id", [F.col("path")]).withColumn("stored", F.col("value") != background))
    mask = settled(masks.pack(rows.select("tree_id", "ordinal", "stored")))
    rows.select("tree_id", "ordinal", "path", "refs").write.mode("overwrite").parquet(f"{at}/shape")
    mask.write.mode("overwrite").parquet(f"{at}/mask")
    masks.ranked(rows.filter("stored").select("tree_id", "ordinal", "value"), mask).select("tree_id", "rank", "value").write.mode("overwrite").parquet(f"{at}/values")


def read_stage(spark: SparkSession, path: str, stage: str, threshold: float, background: float = 0.0) -> DataFrame:
    """Leaves of a stored stage; a mask that doesn't fit the values is an error."""
    at = f"{path}/stage={stage}/threshold={threshold}"
    shape, mask, values = (spark.read.parquet(f"{at}/{name}") for name in ("shape", "mask", "values"))
    set_bits = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w))
    n = mask.groupBy("tree_id").agg(F.sum(set_bits).alias("bits")).join(values.groupBy("tree_id").agg(F.count("*").alias("n"), F.max("rank").alias("last")), "tree_id", "full")
    if not n.filter((F.coalesce("bits", F.lit(0)) != F.coalesce("n", F.lit(0))) | (F.coalesce("last", F.lit(-1)) + 1 != F.coalesce("n", F.lit(0)))).isEmpty():
        raise ValueError(f"values and mask differ in {at}")
    rows = masks.ranked(shape, mask).join(values, ["tree_id", "rank"], "left")
    return rows.select("tree_id", "path", "refs", F.when(F.col("stored"), F.col("value")).otherwise(background).alias("value"))


def world(cells: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Cells with their place in the world: (x, y, z, 1) times a matrix of four rows of three."""
    c = [F.col("x"), F.col("y"), F.col("z"), F.lit(1.0)]
    return cells.select("*", *[sum((c[r] * F.lit(float(matrix[r][k])) for r in range(1, 4)), c[0] * F.lit(float(matrix[0][k]))).alias(f"world_{n}") for k, n in enumerate("xyz")])


# cuts of partitioned runs


def default_splits(levels: list[Column], workers: int) -> list[Column]:
    """How often each dimension is cut for about eight parts a worker; three levels stay below a part, one cut at least."""
    from math import ceil, log2

    s = max(1, ceil(log2(max(8 * workers, 8)) / len(levels)))
    return [F.least(F.lit(s), F.greatest(F.lit(1), x - 3)) for x in levels]
