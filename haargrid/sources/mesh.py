"""Triangles to voxels: which meshes are closed, and which cells of a grid lie inside.

A triangle is (mesh, ax, ay, az, bx, .., cz), in units of cells. A column of cells is a ray along z through the middles of its
cells: each triangle meets the columns over it, and a cell is inside if an odd number of hits lies below its middle. Edges that go through
a column's middle belong to one of the two triangles beside them, by their direction, so that a ray never hits a closed mesh twice there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNERS = ("a", "b", "c")


def open_meshes(triangles: DataFrame) -> DataFrame:
    """(mesh) of meshes that aren't closed: some edge, whichever way it goes, is not in exactly two triangles."""
    at = {p: F.struct(*[F.col(f"{p}{c}").alias(c) for c in "xyz"]) for p in CORNERS}
    edge = lambda p, q: F.struct(F.least(at[p], at[q]).alias("p"), F.greatest(at[p], at[q]).alias("q"))
    edges = triangles.select("mesh", F.explode(F.array(edge("a", "b"), edge("b", "c"), edge("c", "a"))).alias("edge"))
    return edges.groupBy("mesh", "edge").agg(F.count("*").alias("n")).filter("n != 2").select("mesh").distinct()


def closed(triangles: DataFrame) -> DataFrame:
    """The triangles of closed meshes."""
    return triangles.join(open_meshes(triangles), "mesh", "left_anti")


def _left_of(p: str, q: str, x: Column, y: Column, turn: Column) -> Column:
    """Whether a point is on the inner side of an edge, turned so that the triangle goes round to the left."""
    dx, dy = (F.col(f"{q}{c}") - F.col(f"{p}{c}") for c in "xy")
    side = (dx * (y - F.col(f"{p}y")) - dy * (x - F.col(f"{p}x"))) * turn
    # the same edge goes the other way in the neighbour, so one of the two has it
    own = (dy * turn > 0) | ((dy == 0) & (dx * turn < 0))
    return (side > 0) | ((side == 0) & own)


def hits(triangles: DataFrame) -> DataFrame:
    """(mesh, x, y, z): where the rays of the columns (x, y) go through triangles. A triangle along z is met by none."""
    low, high = ({c: f(*[F.col(f"{p}{c}") for p in CORNERS]) for c in "xy"} for f in (F.least, F.greatest))
    # columns whose middles lie within the triangle's bounds
    columns = lambda c: F.sequence(F.ceil(low[c] - 0.5), F.floor(high[c] - 0.5))
    some = (F.ceil(low["x"] - 0.5) <= F.floor(high["x"] - 0.5)) & (F.ceil(low["y"] - 0.5) <= F.floor(high["y"] - 0.5))
    area = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))
    over = triangles.withColumn("area", area).filter(some & (area != 0)).withColumn("x", F.explode(columns("x"))).withColumn("y", F.explode(columns("y")))
    x, y, turn = F.col("x") + 0.5, F.col("y") + 0.5, F.signum("area")
    met = over.filter(_left_of("a", "b", x, y, turn) & _left_of("b", "c", x, y, turn) & _left_of("c", "a", x, y, turn))
    weight = lambda p, q: ((F.col(f"{p}x") - x) * (F.col(f"{q}y") - y) - (F.col(f"{p}y") - y) * (F.col(f"{q}x") - x)) / F.col("area")
    return met.select("mesh", "x", "y", (weight("b", "c") * F.col("az") + weight("c", "a") * F.col("bz") + weight("a", "b") * F.col("cz")).alias("z"))


def voxels(triangles: DataFrame) -> DataFrame:
    """(grid, x, y, z, value) of the cells whose middles lie in a closed mesh; open meshes have none.

    A column's hits are put in order and taken in pairs; the cells between each pair are inside.
    """
    column = hits(closed(triangles)).groupBy("mesh", "x", "y").agg(F.array_sort(F.collect_list("z")).alias("z"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("z") / 2).cast("int") - 1), lambda k: F.struct(F.ceil(F.element_at("z", (k * 2 + 1).cast("int")) - 0.5).alias("low"), (F.ceil(F.element_at("z", (k * 2 + 2).cast("int")) - 0.5) - 1).alias("high")))
    runs = column.filter(F.size("z") > 1).select("mesh", "x", "y", F.explode(pairs).alias("run")).filter("run.low <= run.high")
    return runs.select(F.col("mesh").alias("grid"), "x", "y", F.explode(F.sequence("run.low", "run.high")).alias("z"), F.lit(1.0).alias("value"))


#: Corners of each triangle of a box (a corner's bits say on which side it is) and of a tetrahedron, going round outside.
BOX = ((0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5))
TETRAHEDRON = ((0, 2, 1), (0, 1, 4), (0, 4, 2), (1, 2, 4))


def solids(rows: DataFrame, faces: tuple, missing: Column) -> DataFrame:
    """Triangles of boxes or tetrahedra from (mesh, x, y, z, sx, sy, sz): a corner and sides; the last one is left out where ``missing``."""
    at = lambda k, d, c: F.col(c) + (F.col(f"s{c}") if k >> d & 1 else F.lit(0.0))
    each = [F.struct(*[at(k, d, c).alias(f"{p}{c}") for p, k in zip(CORNERS, face, strict=True) for d, c in enumerate("xyz")], F.lit(i).alias("face")) for i, face in enumerate(faces)]
    return rows.select("mesh", missing.alias("missing"), F.inline(F.array(*each))).filter(~(F.col("missing") & (F.col("face") == len(faces) - 1))).drop("missing", "face")
