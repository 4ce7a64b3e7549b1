"""Grids and trees from tables: full trees of cells, sampled shapes, sparse voxels.

Leaves are (tree_id, path, refs, value), as haargrid.functions.paths describes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haargrid.functions import paths


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def full_tree(cells: DataFrame, coords: list[str], levels: int) -> DataFrame:
    """Leaves of a full tree from cells (tree_id, coordinates, value); no shuffle."""
    refs = F.array_repeat(F.lit((1 << len(coords)) - 1), levels)
    return cells.select("tree_id", paths.path_of([F.col(c) for c in coords], levels).alias("path"), refs.alias("refs"), F.col("value").cast("double").alias("value"))


def vector_cells(vectors: DataFrame, coords: list[str], levels: int) -> DataFrame:
    """Cells of the trees whose cells are a vector's elements, dimension 0 fastest."""
    n, mask = levels, (1 << levels) - 1
    flat = vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("tree_id"), F.posexplode("embedding").alias("i", "value"))
    return flat.select("tree_id", *[F.shiftright("i", n * d).bitwiseAND(mask).alias(c) for d, c in enumerate(coords)], F.col("value").cast("double").alias("value"))


def order_raster(lineitem: DataFrame, levels: int = 2) -> DataFrame:
    """Quantity by part and order bins, a raster for each supplier."""
    side = 1 << levels
    bins = lineitem.groupBy(F.col("l_suppkey").alias("tree_id"), (F.col("l_partkey") % side).alias("x"), (F.col("l_orderkey") % side).alias("y"))
    return bins.agg(F.sum("l_quantity").alias("value"))


def event_voxels(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """Sparse voxels of the number of events: day, hour, type; a grid for each user.

    With ``partitions`` events are dealt out by grid into so many, before they are counted, and lie by grid afterwards.
    """
    kind = (F.length("event_type") % 8).cast("long")
    cells = events.select(F.col("user_id").alias("grid"), (F.dayofmonth("ts") % 8).cast("long").alias("x"), (F.hour("ts") % 8).cast("long").alias("y"), kind.alias("z"))
    if partitions is not None:
        cells = cells.repartition(partitions, "grid")
    return cells.groupBy("grid", "x", "y", "z").agg(F.count("*").cast("double").alias("value"))


def padded(voxels: DataFrame, side: int, background: float = 0.0) -> DataFrame:
    """All cells of each grid's box: stored voxels, and the background elsewhere."""
    box = voxels.select("grid").distinct().select("grid", F.explode(F.sequence(F.lit(0), F.lit(side**3 - 1))).alias("i"))
    bits = side.bit_length() - 1
    cells = box.select("grid", *[F.shiftright("i", bits * d).bitwiseAND(side - 1).cast("long").alias(c) for d, c in enumerate("xyz")])
    return cells.join(voxels, ["grid", "x", "y", "z"], "left").withColumn("value", F.coalesce("value", F.lit(background)))


def unit_cube(points: DataFrame, key: str) -> DataFrame:
    """Points of each thing moved to the origin and divided by its longest side; a thing of one point stays at the origin."""
    box = points.groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))])
    side = F.greatest(*[F.col(f"high_{c}") - F.col(f"low_{c}") for c in "xyz"])
    placed = points.join(box.withColumn("side", side), key)
    for c in "xyz":
        placed = placed.withColumn(c, F.coalesce(F.try_divide(F.col(c) - F.col(f"low_{c}"), F.col("side")), F.lit(0.0)))
    return placed.select(*points.columns)


def named_grid(voxels: DataFrame, name) -> DataFrame:
    """The voxels of one grid; a name that no voxel has is an error that lists some names."""
    found = voxels.filter(F.col("grid") == name)
    if found.isEmpty():
        names = [r[0] for r in voxels.select("grid").distinct().orderBy("grid").limit(20).collect()]
        raise ValueError(f"no grid {name!r}; there are {names}")
    return found


# shapes: predicates over points of the unit cube


def sphere(x: Column, y: Column, z: Column) -> Column:
    return F.pow(x - 0.5, 2.0) + F.pow(y - 0.5, 2.0) + F.pow(z - 0.5, 2.0) <= 0.35**2


def tetrahedron(x: Column, y: Column, z: Column) -> Column:
    return x + y + z <= 1.0


def rod(x: Column, y: Column, z: Column) -> Column:
    """Points within .08 of the segment from (.2, .2, .2) to (.8, .8, .8)."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - 0.2) + (y - 0.2) + (z - 0.2)) / 1.8))
    return F.pow(x - 0.2 - t * 0.6, 2.0) + F.pow(y - 0.2 - t * 0.6, 2.0) + F.pow(z - 0.2 - t * 0.6, 2.0) <= 0.08**2


SHAPES: dict[str, Callable[[Column, Column, Column], Column]] = {"sphere": sphere, "tetrahedron": tetrahedron, "rod": rod}


def sampled(spark: SparkSession, inside: Callable[..., Column], levels: int) -> DataFrame:
    """A predicate at the midpoints of all cells, in Morton order: (m, x, y, z, value)."""
    m = spark.range(1 << 3 * levels).withColumnRenamed("id", "m")
    cells = m.select("m", *[paths.unmorton(F.col("m"), 3, levels, d).alias(c) for d, c in enumerate("xyz")])
    middle = [(F.col(c) + 0.5) / (1 << levels) for c in "xyz"]
    return cells.withColumn("value", inside(*middle).cast("double"))


def at_corners(leaves: DataFrame, voxels: DataFrame, side_level: int, background: float = 0.0) -> DataFrame:
    """Each leaf with the voxel at its lower corner, or the background; and whether that voxel is stored."""
    marked = leaves.withColumn("steps", paths.steps(F.col("path"), F.col("refs"))).select("tree_id", "path", *[paths.marked_index(F.col("steps"), d).alias(c) for d, c in enumerate("xyz")])
    low = [(F.call_function("shiftleft", F.col(c), F.lit(side_level) - paths.marked_level(F.col(c))) - (1 << side_level)).alias(c) for c in "xyz"]
    placed = marked.select("tree_id", "path", *low)
    stored = voxels.select(F.col("grid").alias("tree_id"), "x", "y", "z", F.col("value").alias("stored"))
    return placed.join(stored, ["tree_id", "x", "y", "z"], "left").select("tree_id", "path", F.coalesce("stored", F.lit(background)).alias("value"), F.col("stored").isNotNull().alias("active"))
