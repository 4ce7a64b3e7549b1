"""Trees restructured part by part, so that a run that stops goes on where it was.

A part is what lies below the first steps of a tree. Parts are dealt to waves; a wave's leaves are written first, then the manifest names its parts,
so parts that a stopped run hasn't finished aren't seen. A run does the waves that the manifest hasn't got: parts are told
by an anti-join, whatever folders a stopped run left. In the end parts are put together and the seams are compressed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haargrid.functions import paths
from haargrid.functions.tables import settled
from haargrid.operators import coarsen, restructure
from haargrid.sources import files, log

KEYS = ["tree_id", "part"]
MANIFEST = "tree_id long, part string, wave int, folder string, boxes long"


def cut(leaves: DataFrame, steps: int) -> DataFrame:
    """(tree_id, part, above, path, refs, value): leaves by the first ``steps`` steps; a shorter path is a part of its own."""
    return leaves.select(
        "tree_id", F.substr("path", F.lit(1), F.lit(steps)).alias("part"), F.slice("refs", 1, steps).alias("above"),
        F.substr("path", F.lit(steps + 1), F.length("path")).alias("path"), F.slice("refs", steps + 1, 1 << 20).alias("refs"), "value",
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return log.read(spark, f"{path}/manifest", MANIFEST)


def pending(parts: DataFrame, path: str) -> DataFrame:
    """Parts (tree_id, part) of which the manifest says nothing."""
    return parts.join(manifest(parts.sparkSession, path).select(*KEYS), KEYS, "left_anti")


def compress(leaves: DataFrame, path: str, steps: int, threshold: float, waves: int = 16, wave: Column | None = None, bound: str = "flat", stop_after: int | None = None) -> int:
    """Restructures the parts that are still to do; the number of waves that were run.

    ``wave`` gives a part's wave (0 to ``waves`` - 1) from tree_id and part, by hash if not given. ``stop_after`` ends the
    run after so many waves.
    """
    spark = leaves.sparkSession
    number = F.pmod(F.xxhash64("tree_id", "part"), F.lit(waves)) if wave is None else wave
    rows = cut(leaves, steps).withColumn("wave", number.cast("int"))
    parts = settled(rows.select(*KEYS, "wave").distinct())
    todo = settled(pending(parts, path))
    left = [r.wave for r in todo.select("wave").distinct().orderBy("wave").collect()]  # numbers below ``waves``
    for done, w in enumerate(left):
        if done == stop_after:
            return done
        own = rows.filter(F.col("wave") == w).join(todo, [*KEYS, "wave"], "left_semi")
        trees = own.select(F.struct("tree_id", "part", "above").alias("tree_id"), "path", "refs", "value")
        limit = F.lit(threshold) / paths.volume(F.col("tree_id.above")) if bound == "per_volume" else F.lit(threshold)
        out = restructure.batched(trees, limit, bound)
        folder = f"wave-{w}-{uuid.uuid4().hex}"
        out.select("tree_id.*", "path", "refs", "value").write.parquet(f"{path}/{folder}")
        new = spark.read.parquet(f"{path}/{folder}").groupBy(*KEYS).agg(F.count("*").alias("boxes"))
        log.append(new.select("tree_id", "part", F.lit(w).alias("wave"), F.lit(folder).alias("folder"), "boxes"), f"{path}/manifest", KEYS, MANIFEST)
    return len(left)


def composed(spark: SparkSession, path: str) -> DataFrame:
    """Leaves of all parts in the manifest, below their trees' first steps."""
    done = manifest(spark, path)
    folders = [r.folder for r in done.select("folder").distinct().collect()]  # one for each wave
    if not folders:
        return spark.createDataFrame([], "tree_id long, path string, refs array<int>, value double")
    rows = spark.read.parquet(*[f"{path}/{f}" for f in folders]).withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -2))
    rows = rows.join(done.select(*KEYS, "folder"), [*KEYS, "folder"], "left_semi")
    return rows.select("tree_id", F.concat("part", "path").alias("path"), F.concat("above", "refs").alias("refs"), "value")


def finish(spark: SparkSession, path: str, threshold: float, bound: str = "flat", pushes: bool = True) -> DataFrame:
    """The composed trees, coarsened over the seams, and restructured if ``pushes``."""
    can = settled(coarsen.canonical(composed(spark, path), threshold, bound).select("tree_id", "path", "refs", "value"))
    return restructure.batched(can, threshold, bound) if pushes else can


def write_run(spark: SparkSession, path: str, box: DataFrame, grid_levels: list[int]) -> None:
    """The run's metadata beside its parts: box and levels, levels of the grid of parts, number of parts in the manifest."""
    n = manifest(spark, path).agg(F.count("*").cast("int").alias("n_partitions"))
    ints = lambda *c: F.array(*[F.col(x).cast("int") for x in c])
    row = box.select(ints("low_x", "low_y", "low_z").alias("bbox_min"), ints("level_x", "level_y", "level_z").alias("per_dim_levels"), F.array(*map(F.lit, grid_levels)).alias("grid_levels"), F.lit(1).alias("one"))
    files.write_metadata(row.join(n.withColumn("one", F.lit(1)), "one").drop("one"), f"{path}/metadata")
