"""Grids from trees, and comparisons of grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haargrid.functions import paths
from haargrid.operators import descriptor

AXES = "xyz"


def filled(leaves: DataFrame, dims: int, level: int) -> DataFrame:
    """Each leaf's row for every cell of a grid of 2 ** level cells a side that lies in it, with the cell's coordinates.

    Low corner and sides are computed once a leaf; one explode numbers its cells, and bits of the number are coordinates.
    """
    marked = leaves.withColumn("steps", paths.steps(F.col("path"), F.col("refs"))).select(*leaves.columns, *[paths.marked_index(F.col("steps"), d).alias(f"at_{d}") for d in range(dims)])
    sided = marked.select("*", *[(F.lit(level) - paths.marked_level(F.col(f"at_{d}"))).alias(f"side_{d}") for d in range(dims)])
    boxes = sided.select("*", *[(F.call_function("shiftleft", F.col(f"at_{d}"), F.col(f"side_{d}")) - (1 << level)).alias(f"low_{d}") for d in range(dims)])
    last = F.call_function("shiftleft", F.lit(1).cast("long"), sum((F.col(f"side_{d}") for d in range(dims)), F.lit(0))) - 1
    cells, done, out = boxes.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), last))), F.lit(0), []
    for d in range(dims):
        side = F.col(f"side_{d}")
        own = F.call_function("shiftright", F.col("cell"), done).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), side) - 1)
        out.append((F.col(f"low_{d}") + own).alias(AXES[d]))
        done = done + side
    return cells.select(*leaves.columns, *out)


def rasterise(leaves: DataFrame, dims: int, level: int) -> DataFrame:
    """Cells (tree_id, coordinates, value) of a grid of 2 ** level cells a side; a leaf finer than that is an error of the caller."""
    return filled(leaves.select("tree_id", "path", "refs", "value"), dims, level).select("tree_id", *AXES[:dims], "value")


def fill(leaves: DataFrame, dims: int, level: int, background: float = 0.0) -> DataFrame:
    """The cells that differ from the background: a sparse grid."""
    return rasterise(leaves.filter(F.col("value") != background), dims, level)


def joined(a: DataFrame, b: DataFrame, keys: list[str], background: float = 0.0) -> DataFrame:
    """Two sparse grids cell by cell, background where a grid has no voxel; cells that neither has are left out."""
    return a.select(*keys, F.col("value").alias("va")).join(b.select(*keys, F.col("value").alias("vb")), keys, "full").select(
        *keys, F.coalesce("va", F.lit(background)).alias("a"), F.coalesce("vb", F.lit(background)).alias("b")
    )


def error_norms(a: DataFrame, b: DataFrame, keys: list[str], cells: int, background: float = 0.0) -> DataFrame:
    """Largest, mean and root mean square difference, and the norms of the first grid, over a box of ``cells`` cells.

    Cells that neither grid has differ by nothing, so they count only in the divisor.
    """
    e, s = F.abs(F.col("a") - F.col("b")), F.abs(F.col("a") - background)
    return joined(a, b, ["grid", *keys], background).groupBy("grid").agg(
        F.max(e).alias("linf_error"), (F.sum(e) / cells).alias("l1_error"), F.sqrt(F.sum(e * e) / cells).alias("l2_error"),
        F.max(s).alias("linf_sol"), (F.sum(s) / cells).alias("l1_sol"), F.sqrt(F.sum(s * s) / cells).alias("l2_sol"),
    )


def leaf_errors(leaves: DataFrame, cells: DataFrame, dims: int, level: int) -> DataFrame:
    """For each leaf the largest difference from the cells inside it: cells meet their leaf by coordinates."""
    keys = ["tree_id", *AXES[:dims]]
    inside = filled(leaves.select("tree_id", "path", "refs", "value"), dims, level).select(*keys, "path", "value")
    return inside.join(cells.withColumnRenamed("value", "cell"), keys).groupBy("tree_id", "path").agg(F.max(F.abs(F.col("value") - F.col("cell"))).alias("max_error"))


def tree_stats(leaves: DataFrame, dims: int) -> DataFrame:
    """Boxes, nodes, topology bits and the refinements of inner nodes as JSON, for each tree."""
    inner = leaves.filter(F.size("refs") > 0).select("tree_id", F.posexplode("refs").alias("d", "ref"), "path").select("tree_id", F.substr("path", F.lit(1), F.col("d")).alias("node"), "ref").distinct()
    kinds = inner.groupBy("tree_id", "ref").agg(F.count("*").alias("n"))
    refs = kinds.groupBy("tree_id").agg(F.sum("n").alias("inner"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("ref").cast("string"), "n"))))).alias("ref_counts"))
    boxes = leaves.groupBy("tree_id").agg(F.count("*").alias("boxes"))
    nodes = F.col("boxes") + F.coalesce("inner", F.lit(0))
    return boxes.join(refs, "tree_id", "left").select("tree_id", "boxes", nodes.alias("nodes"), (nodes * dims).alias("topo_bits"), F.coalesce("ref_counts", F.lit("{}")).alias("ref_counts"))


def ref_histogram(leaves: DataFrame) -> DataFrame:
    """How many inner nodes of all trees have each refinement. A node is counted at its first leaf, so no node is held or moved."""
    ends = F.length(F.regexp_extract("path", "0*$", 0))  # the ancestors that begin with this leaf
    inner = leaves.select(F.explode(F.slice("refs", F.length("path") - ends + 1, ends)).alias("ref"))
    return inner.groupBy("ref").agg(F.count("*").alias("n"))


def descriptors(leaves: DataFrame, dims: int) -> DataFrame:
    """The topology file of each tree: ``dims`` bits a node in pre-order, dimension 0 first, zeros for a leaf.

    The nodes are put in order by paths; bits become bytes in the JVM.
    """
    nodes = leaves.select("tree_id", F.posexplode(F.concat("refs", F.array(F.lit(0)))).alias("d", "ref"), "path").select("tree_id", F.substr("path", F.lit(1), F.col("d")).alias("node"), "ref").distinct()
    text = F.concat_ws("", *[F.shiftright("ref", d).bitwiseAND(1).cast("string") for d in range(dims)])
    bits = nodes.groupBy("tree_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", text.alias("b")))), lambda x: x["b"]), "").alias("bits"))
    padded = F.rpad("bits", (F.ceil(F.length("bits") / 8) * 8).cast("int"), F.lit("0"))
    hexed = F.array_join(F.transform(F.sequence(F.lit(0), (F.length(padded) / 4 - 1).cast("int")), lambda i: F.conv(F.substr(padded, i * 4 + 1, F.lit(4)), 2, 16)), "")
    return bits.select("tree_id", F.length("bits").alias("n_bits"), F.unhex(hexed).alias("descriptor"))


def read_descriptors(files: DataFrame, dims: int) -> DataFrame:
    """Leaves (without values) of topology files (tree_id, descriptor), which are parsed in chunks."""
    return descriptor.read(descriptor.split(files, dims), dims)


def compose(parts: DataFrame, top_levels: int, dims: int) -> DataFrame:
    """Trees stitched below a regular top grid: a part at coordinates gets the path of its cell in front."""
    top = paths.path_of([F.col(f"top_{c}") for c in AXES[:dims]], top_levels)
    refs = F.array_repeat(F.lit((1 << dims) - 1), top_levels)
    return parts.select("tree_id", F.concat(top, "path").alias("path"), F.concat(refs, "refs").alias("refs"), "value")
