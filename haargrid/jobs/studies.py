"""Registered queries of whole jobs: sparse grids that grow with the tables, sweeps, comparisons, stored stages, files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haargrid.functions import paths
from haargrid.functions.tables import settled, shared_folder
from haargrid.jobs import images, parts, sweeps
from haargrid.jobs.queries import query, r6, stats, vectors
from haargrid.operators import coarsen, grid, kernel, report, restructure, sparse
from haargrid.sources import files, grids, mesh, slices, tiff

THRESHOLDS = [0.0, 0.06, 0.1]
#: Voxels of a task that builds trees: it holds some dozens of nodes for each.
VOXELS = 50_000
#: Index to world: a row for each axis, then the origin.
MATRIX = [[0.5, 0.0, 0.0], [0.25, 0.5, 0.0], [0.0, 0.0, 2.0], [1.0, -2.0, 3.0]]


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/haargrid-{name}-{uuid.uuid4().hex}"


def user_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user, day and hour as sparse voxels, a grid for each type: its box grows with users and days."""
    day = F.unix_date(F.to_date("ts")).cast("long")
    return grids.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("grid"), F.col("user_id").alias("x"), day.alias("y"), F.hour("ts").cast("long").alias("z")).agg(F.count("*").cast("double").alias("value"))


def user_tree(spark, sf_dir):
    v = settled(user_grid(spark, sf_dir))
    box = settled(sparse.extent(v))
    return v, box, settled(sparse.adaptive(v, box, partitions=v.count() // VOXELS + 1))


@query
def sparse_build_events(spark, sf_dir):
    return user_tree(spark, sf_dir)[2].select("tree_id", "path", "value")


@query
def ref_histogram_partial(spark, sf_dir):
    """Refinements of the inner nodes of trees whose dimensions have different levels."""
    return grid.ref_histogram(user_tree(spark, sf_dir)[2])


@query
def grid_levels(spark, sf_dir):
    """Levels of each grid, capped ones, those of the largest image inside, and the nodes of its full tree."""
    box = sparse.extent(user_grid(spark, sf_dir))
    levels = [F.col(f"level_{c}") for c in "xyz"]
    v = user_grid(spark, sf_dir).groupBy("grid").agg(*[(F.max(c) - F.min(c) + 1).alias(f"extent_{c}") for c in "xyz"])
    base = sparse.base_levels([F.col(f"extent_{c}") for c in "xyz"], cap=4)
    return box.join(v, "grid").select("grid", *levels, *[F.least(x, F.lit(4)).alias(f"capped_{c}") for c, x in zip("xyz", levels, strict=True)], *[b.cast("int").alias(f"base_{c}") for c, b in zip("xyz", base, strict=True)], sparse.full_nodes(levels).alias("full_nodes"))


@query
def outside_active_box(spark, sf_dir):
    """Leaves and cells of each tree that lie outside the box of the stored voxels."""
    v, box, leaves = user_tree(spark, sf_dir)
    b = sparse.placed_boxes(leaves, box)
    high = v.groupBy(F.col("grid").alias("tree_id")).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))])
    out = sparse.outside(*[[F.col(p + c) for c in "xyz"] for p in ("", "size_", "low_", "high_")])
    return b.join(high, "tree_id").groupBy("tree_id").agg(F.count_if(out).alias("leaves_outside"), F.sum(F.when(out, F.col("size_x") * F.col("size_y") * F.col("size_z")).otherwise(0)).alias("cells_outside"))


@query
def sparse_max_error(spark, sf_dir):
    """Largest error of each leaf when all values are halved."""
    v, box, leaves = user_tree(spark, sf_dir)
    return sparse.voxel_errors(leaves.withColumn("value", F.col("value") / 2), v, box).withColumn("max_error", r6("max_error"))


def boolean_cells(leaves: DataFrame, box: DataFrame) -> DataFrame:
    """Cells of the leaves above one half; leaves that are false are skipped before any box is filled."""
    b = sparse.placed_boxes(leaves.withColumn("value", F.col("value") > 0.5).filter("value"), box)
    for c in "xyz":
        b = b.withColumn(c, F.explode(F.sequence(F.col(c), F.col(c) + F.col(f"size_{c}") - 1)))
    return b.select(F.col("tree_id").alias("grid"), "x", "y", "z", "value")


@query
def boolean_fill(spark, sf_dir):
    _, box, leaves = user_tree(spark, sf_dir)
    return boolean_cells(leaves, box)


@query
def leaf_midpoint_samples(spark, sf_dir):
    """Each leaf's value of a sphere, taken at the midpoint of its first cell of the finest level."""
    _, box, leaves = user_tree(spark, sf_dir)
    b = sparse.placed_boxes(leaves, box).join(box.withColumnRenamed("grid", "tree_id").drop(*"xyz"), "tree_id")
    unit = [(F.col(c) - F.col(f"low_{c}") + 0.5) / F.pow(F.lit(2.0), F.col(f"level_{c}")) for c in "xyz"]
    return b.select("tree_id", "path", grids.sphere(*unit).alias("inside"))


@query
def stage_reconstruction(spark, sf_dir):
    """Trees stored as shape, values and mask, read again, as sparse voxels with their place in the world."""
    _, box, leaves = user_tree(spark, sf_dir)
    at = place(spark, "stage")
    sweeps.save_stage(leaves, at, "adaptive", 0.0, 3)
    back = sweeps.read_stage(spark, at, "adaptive", 0.0)
    b = sparse.placed_boxes(back.filter("value != 0"), box)
    for c in "xyz":
        b = b.withColumn(c, F.explode(F.sequence(F.col(c), F.col(c) + F.col(f"size_{c}") - 1)))
    return sweeps.world(b.select(F.col("tree_id").alias("grid"), "x", "y", "z", "value"), MATRIX)


@query
def approximate_topology(spark, sf_dir):
    return sweeps.approximate_topology(user_grid(spark, sf_dir))


# sweeps over the vectors' trees


def _cubes(spark, sf_dir):
    """The vectors' cells and trees in three dimensions."""
    cells = grids.vector_cells(grids.read(spark, sf_dir, "embeddings"), list("xyz"), 2)
    return cells, grids.full_tree(cells, list("xyz"), 2)


def _voxels(cells: DataFrame) -> DataFrame:
    return cells.filter("value != 0").select(F.col("tree_id").alias("grid"), "x", "y", "z")


@query
def compare_thresholds(spark, sf_dir):
    rows = sweeps.comparison(_cubes(spark, sf_dir)[1], THRESHOLDS, 3, 2)
    return rows.withColumn("ratio_to_dense", r6("ratio_to_dense")).withColumn("max_error", r6("max_error"))


@query
def sweep_rows(spark, sf_dir):
    cells, leaves = _cubes(spark, sf_dir)
    rows = sweeps.sweep_rows(leaves, THRESHOLDS, 3, 2, _voxels(cells))
    return rows.select(*[r6(c).alias(c) if c.endswith(("error", "sol")) or c == "ratio_raw_vs_vdb" else F.col(c) for c in rows.columns])


@query
def stats_rows(spark, sf_dir):
    """Statistics of each vector at levels 1 and 2: a level's cells are means of the finer ones."""
    fine = vectors(spark, sf_dir, 3).select("tree_id", "path", "value", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("level"))
    tree = F.col("tree_id") * 8 + F.col("level")
    means = fine.groupBy(tree.alias("tree_id"), "level", F.substr("path", F.lit(1), F.col("level")).alias("path")).agg(F.avg("value").alias("value"))
    every = settled(means.select("tree_id", "path", F.array_repeat(F.lit(7), F.col("level")).alias("refs"), "value"))
    things = every.select("tree_id").distinct().select("tree_id", F.floor(F.col("tree_id") / 8).alias("thingi_id"), (F.col("tree_id") % 8).cast("int").alias("level"))
    at = [paths.index(F.col("path"), F.col("refs"), d).alias(c) for d, c in enumerate("xyz")]
    return sweeps.stats_rows(every, every.select(F.col("tree_id").alias("grid"), *at), things, 0.06, 3)


@query
def canonical_lines(spark, sf_dir):
    """Canonical one-dimensional trees, leaf by leaf."""
    return coarsen.canonical(vectors(spark, sf_dir, 1), 0.05).select("tree_id", "path", r6("value").alias("value"), r6("discarded").alias("discarded"))


def _restructured_lines(spark, sf_dir, scheduler):
    return kernel.restructure(vectors(spark, sf_dir, 1), scheduler, 0.05).select("tree_id", "path", r6("value").alias("value"))


@query
def downsplit_lines(spark, sf_dir):
    return _restructured_lines(spark, sf_dir, "batched")


@query
def decomposed_lines(spark, sf_dir):
    return _restructured_lines(spark, sf_dir, "decomposed")


@query
def partitioned_lines(spark, sf_dir):
    """Trees cut at their second step, compressed apart, composed, and coarsened over the seams."""
    parts = kernel.restructure(vectors(spark, sf_dir, 1), "batched", 0.05, prefix=2)
    return coarsen.canonical(settled(parts).drop("discarded"), 0.05).select("tree_id", "path", r6("value").alias("value"))


@query
def cascade_lines(spark, sf_dir):
    """Boxes of each tree by threshold, each starting from the result of the one before."""
    now, out = vectors(spark, sf_dir, 1), None
    for t in (0.01, 0.05, 0.2):
        now = settled(coarsen.canonical(now, t)).select("tree_id", "path", "refs", "value")
        part = now.groupBy("tree_id").agg(F.count("*").alias("boxes")).withColumn("threshold", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


def _alternating(spark, sf_dir):
    """The vectors' trees with one dimension halved at each step, y and x in turn: every inner node of x can take over y."""
    return vectors(spark, sf_dir, 1).withColumn("refs", F.array(*[F.lit(2 - k % 2) for k in range(6)]))


@query
def normalize_alternating(spark, sf_dir):
    """Trees that break the rule at every other node: steps of one dimension become steps of both."""
    return kernel.restructure(_alternating(spark, sf_dir), "normalize").select("tree_id", "path", r6("value").alias("value"), F.array_join(F.transform("refs", lambda r: r.cast("string")), "").alias("refs"))


@query
def push_and_normalize(spark, sf_dir):
    """Pushing a dimension down at the root and normalising gives the tree back."""
    return kernel.restructure(vectors(spark, sf_dir, 3), "push_and_back").select("tree_id", "path", r6("value").alias("value"))


@query
def lineage_round(spark, sf_dir):
    """Each leaf before a round of coarsening with the leaf that holds it afterwards."""
    return coarsen.lineage(vectors(spark, sf_dir, 3), 0.06, partial=False)


@query
def lineage_partial(spark, sf_dir):
    """How many leaves each leaf after a round that may give up single dimensions stands for, by tree."""
    m = coarsen.lineage(vectors(spark, sf_dir, 3), 0.06)
    n = m.groupBy("tree_id", "new_path").agg(F.count("*").alias("n"))
    return n.groupBy("tree_id", "n").agg(F.count("*").alias("leaves"))


# restructuring in three dimensions


def _canonical(spark, sf_dir, threshold=0.06):
    return settled(coarsen.canonical(vectors(spark, sf_dir, 3), threshold).select("tree_id", "path", "refs", "value"))


def _leaves(df: DataFrame, *more: str) -> DataFrame:
    return df.select("tree_id", "path", F.array_join(F.transform("refs", lambda r: r.cast("string")), "").alias("refs"), r6("value").alias("value"), *more)


@query
def push_down_round(spark, sf_dir):
    """Canonical trees with a dimension pushed down at every node that has two leaves or more."""
    return _leaves(restructure.push_down(_canonical(spark, sf_dir)), "was")


@query
def downsplit_leaves(spark, sf_dir):
    """Leaves of the restructured canonical trees, by joins over leaves."""
    return _leaves(restructure.downsplit(_canonical(spark, sf_dir), 0.06)[0])


@query
def downsplit_lineage(spark, sf_dir):
    """Each canonical leaf with the restructured leaf that holds it, and its share of that."""
    can = _canonical(spark, sf_dir)
    new, line = restructure.downsplit(can, 0.06, lineage=True)
    size = lambda df, name: df.select("tree_id", F.col("path").alias(name), paths.volume(F.col("refs")).alias(f"{name}_volume"))
    both = line.select("tree_id", "origin", F.col("path").alias("new")).join(size(can, "origin"), ["tree_id", "origin"]).join(size(new, "new"), ["tree_id", "new"])
    return both.select("tree_id", "origin", F.col("new").alias("path"), (F.col("origin_volume") / F.col("new_volume")).alias("share"))


# partitioned runs


@query
def partition_splits(spark, sf_dir):
    """Default cuts of each grid for four workers, with the number of parts and the levels left in them."""
    box = sparse.extent(user_grid(spark, sf_dir))
    levels = [F.col(f"level_{c}") for c in "xyz"]
    cuts = sweeps.default_splits(levels, 4)
    return box.select("grid", *[s.alias(f"cut_{c}") for c, s in zip("xyz", cuts, strict=True)], F.call_function("shiftleft", F.lit(1), cuts[0] + cuts[1] + cuts[2]).alias("n_parts"), *[(x - s).alias(f"left_{c}") for c, x, s in zip("xyz", levels, cuts, strict=True)])


def _stopped_run(spark, sf_dir) -> tuple[DataFrame, str]:
    """Canonical trees cut at their first step in four waves of parts, and where a run has stopped after two of them."""
    can, at = _canonical(spark, sf_dir), place(spark, "parts")
    parts.compress(can, at, 1, 0.06, 4, _wave(), stop_after=2)
    return can, at


def _wave():
    return (F.col("tree_id") + F.coalesce(F.col("part").try_cast("int"), F.lit(0))) % 4


@query
def resume_parts(spark, sf_dir):
    """Parts that are still to do after a run was stopped, by its manifest, with their leaves."""
    can, at = _stopped_run(spark, sf_dir)
    every = parts.cut(can, 1).groupBy("tree_id", "part").agg(F.count("*").alias("leaves"))
    return parts.pending(every, at)


@query
def resumed_compress(spark, sf_dir):
    """A run that was stopped, started again, put together and coarsened over the seams."""
    can, at = _stopped_run(spark, sf_dir)
    parts.compress(can, at, 1, 0.06, 4, _wave())
    out = parts.finish(spark, at, 0.06, pushes=False)
    return _leaves(out)


# files


@query
def metadata_roundtrip(spark, sf_dir):
    """Run metadata of each grid, written as JSON and read again."""
    box = sparse.extent(user_grid(spark, sf_dir))
    at = place(spark, "metadata")
    ints = lambda *c: F.array(*[F.col(x).cast("int") for x in c])
    files.write_metadata(box.select("grid", ints("low_x", "low_y", "low_z").alias("bbox_min"), ints("level_x", "level_y", "level_z").alias("per_dim_levels"), F.array(F.lit(2), F.lit(1), F.lit(1)).alias("grid_levels"), F.lit(16).alias("n_partitions")), at)
    back = files.read_metadata(spark, at)
    return back.select(*[F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("bbox_min", "per_dim_levels", "grid_levels")], "n_partitions")


@query
def csv_pivot(spark, sf_dir):
    """The pivot of sizes by level as a report: whole numbers without decimals, nan where there is none, read as text."""
    at = place(spark, "csv")
    wide = report.level_pivot(stats(spark, sf_dir), "ds_bytes", list(range(1, 8)))
    files.write_report(wide, at)
    return spark.read.option("header", True).csv(at).select([F.col(c) for c in wide.columns])


@query
def stats_append(spark, sf_dir):
    """Measurements appended under the fixed schema in four runs with the same things in several of them, and read from level 2 on."""
    at = place(spark, "stats")
    rows = stats(spark, sf_dir).select("thingi_id", "level", F.col("rows").alias("can_nodes"), F.col("can_bytes").alias("can_raw_total_bytes"), F.col("ds_bytes").alias("ds_raw_total_bytes"), F.lit("gone").alias("extra"))
    for half in (rows.filter("thingi_id % 2 = 0"), rows.filter("thingi_id % 3 != 0"), rows.filter("thingi_id % 2 = 0"), rows):
        files.append_stats(half, at)
    return files.read_stats(spark, at).select("thingi_id", "level", "can_nodes", "can_raw_total_bytes", "ds_raw_total_bytes", "vdb_file_bytes")


@query
def tool_lines(spark, sf_dir):
    """The tool's three kinds of JSON lines, written and summed up by grid."""
    v = user_grid(spark, sf_dir)
    t = files.voxel_topology(v)
    mask = F.element_at(F.array(F.lit(512), F.lit(8192), F.lit(65536)), F.col("level") + 1)
    level = t.select("grid", "level", F.lit("node").alias("type"), "nodes", mask.alias("mask_bits_per_node"), F.col("mask_bits").alias("total_bits"))
    s = sweeps.voxel_summary(v, 32)
    summary = s.select("grid", F.lit(True).alias("summary"), F.col("topo_bits").alias("total_topology_bits"), F.col("topo_bytes").alias("total_topology_bytes"))
    values = s.select("grid", F.lit(True).alias("value_summary"), (F.col("dense_value_bits") / 16384).cast("long").alias("leaf_count"), "active_leaf_voxels", F.col("inactive_leaf").alias("inactive_leaf_voxels"), "active_tiles", "total_leaf_coefficients", "total_coefficients", "dense_value_bits", "active_value_bits")
    at = place(spark, "tool")
    for part in (level, summary, values):
        part.write.mode("append").json(at)
    return files.tool_summaries(spark, at)


def _names(spark, sf_dir):
    """File names of things and levels: all have a canonical file, some push-down, downsplit or voxel files; and other names."""
    s = stats(spark, sf_dir).select(F.concat(F.lit("runs/"), F.col("thingi_id"), F.lit("_l"), F.col("level")).alias("p"), "thingi_id", "level")
    of = lambda cond, tail: F.when(cond, F.concat("p", F.lit(tail)))
    i, lv = F.col("thingi_id"), F.col("level")
    every = F.array(of(lv != 3, "_canonical_3d.bin"), of(i % 3 == 0, "_pushdown_3d.bin"), of(i % 2 == 0, "_downsplit_3d.bin"), of(i % 5 == 0, "_openvdb.vdb"), of(lv == 1, "_canonical_3d.bin.tmp"))
    return s.select(F.explode(F.filter(every, lambda x: x.isNotNull())).alias("path"))


@query
def discover_pairs(spark, sf_dir):
    return files.discover(_names(spark, sf_dir))


@query
def sweep_folder_scan(spark, sf_dir):
    """Folders of thresholds that hold topology, values and metadata."""
    f = stats(spark, sf_dir).select(F.concat(F.lit("out/thr_0."), F.lpad(F.col("thingi_id").cast("string"), 6, "0")).alias("p"), "level").distinct()
    kind = F.when(F.col("level") == 1, "final_3d.bin").when(F.col("level") == 2, "final_values.npy").when(F.col("level") == 3, "metadata.json").otherwise("log.txt")
    return files.sweep_folders(f.filter(~(F.col("p").endswith("5") & (F.col("level") == 2))).select(F.concat("p", F.lit("/"), kind).alias("path")))


@query
def named_grid_scan(spark, sf_dir):
    v = user_grid(spark, sf_dir)
    name = v.agg(F.min("grid")).first()[0]
    return grids.named_grid(v, name)


def line_ellipsoid(spark, sf_dir):
    """(inside, level) of an ellipsoid that is longer where the order lines' numbers spread more; finer for more customers."""
    spread = grids.read(spark, sf_dir, "lineitem").agg(*[(F.max(c) - F.min(c)).cast("double") for c in ("l_partkey", "l_suppkey", "l_quantity")]).first()
    level = (grids.read(spark, sf_dir, "customer").count().bit_length() - 1) // 2 + 2
    a, b, c = (0.25 + 0.25 * s / max(spread) for s in spread)

    def inside(x, y, z):
        u, v, w = (x - 0.5) / a, (y - 0.5) / b, (z - 0.5) / c
        return u * u + v * v + w * w <= 1.0

    return inside, level


@query
def slice_blocks(spark, sf_dir):
    """Blocks of the slices of an ellipsoid, by side: how many, and where they lie."""
    inside, level = line_ellipsoid(spark, sf_dir)
    return slices.read(spark, inside, level).groupBy("side").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in "xyz"])


@query
def slice_tree(spark, sf_dir):
    """The adaptive tree of that ellipsoid, from blocks."""
    inside, level = line_ellipsoid(spark, sf_dir)
    return sparse.adaptive(slices.read(spark, inside, level), slices.cube(spark, level)).select("tree_id", "path", "value")


# images


def supplier_images(spark, sf_dir) -> DataFrame:
    """An image file of 16 bits for each supplier, 7 rows high and 5 to 13 columns wide: what was ordered by line number and part."""
    lines = grids.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tree_id"), (F.col("l_linenumber") - 1).cast("long").alias("x"), (F.col("l_partkey") % (F.col("l_suppkey") % 9 + 5)).cast("long").alias("y"), "l_quantity")
    return settled(tiff.files_of(lines.groupBy("tree_id", "x", "y").agg((F.sum("l_quantity").cast("long") % 65536).cast("int").alias("level"))))


def compressed_images(spark, sf_dir):
    return images.compressed(settled(tiff.cells(supplier_images(spark, sf_dir))), 0.0005)


@query
def tiff_cells(spark, sf_dir):
    """Brightness of all cells of the files."""
    return tiff.cells(supplier_images(spark, sf_dir)).select(F.col("tree_id").cast("long").alias("tree_id"), "x", "y", F.round(F.col("value"), 9).alias("value"))


@query
def image_compress(spark, sf_dir):
    """Images to trees, compressed: sizes before and after, and what became different."""
    out = images.summary(*compressed_images(spark, sf_dir))
    return out.select(F.col("tree_id").cast("long").alias("tree_id"), "boxes_before", "boxes_after", "nodes_before", "nodes_after", F.round("max_difference", 9).alias("max_difference"), (F.round("mean_difference", 9) + 0.0).alias("mean_difference"))


@query
def image_resample(spark, sf_dir):
    """The compressed images at half their resolution."""
    box, _, after = compressed_images(spark, sf_dir)
    return images.resampled(after, box, 1).select(F.col("tree_id").cast("long").alias("tree_id"), "x", "y", F.round("value", 9).alias("value"))


# reports


@query
def level_pivots(spark, sf_dir):
    """The pivots of all methods and of the counts, one after another."""
    out = None
    for m, c in (("can", "can_bytes"), ("ds", "ds_bytes"), ("vdb", "vdb_bytes"), ("rows", "rows")):
        part = report.level_pivot(stats(spark, sf_dir), c, list(range(2, 8))).withColumn("column", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out


@query
def extremal_both_ratios(spark, sf_dir):
    s = stats(spark, sf_dir)
    out = report.extremal(s, "vdb_bytes", "ds_bytes").withColumn("kind", F.lit("bytes")).unionByName(report.extremal(s, "rows", "ds_bytes").withColumn("kind", F.lit("counts")))
    return out.withColumn("ratio", r6("ratio"))


@query
def slope_rates_by_metric(spark, sf_dir):
    """Growth of three metrics: sizes, sizes by row, and rows."""
    s, out = stats(spark, sf_dir).filter("level >= 2"), None
    for metric, f in (("bytes", lambda c: F.col(c).cast("double")), ("bytes_by_row", lambda c: F.col(c) / F.col("rows")), ("rows", lambda c: F.when(F.col(c).isNotNull(), F.col("rows").cast("double")))):
        part = report.slopes(s.select("thingi_id", "level", *[f(f"{m}_bytes").alias(f"{m}_bytes") for m in report.METHODS])).withColumn("metric", F.lit(metric))
        out = part if out is None else out.unionByName(part)
    return out.select("metric", "method", "lo", "hi", "n_lo", "n_hi", *[r6(c).alias(c) for c in ("mean_lo", "mean_hi", "median_lo", "median_hi", "rate_mean", "rate_median")])


@query
def semijoin_returned(spark, sf_dir):
    """Measurements of things of which another table has a row: suppliers and lines that something came back from."""
    back = grids.read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_suppkey").alias("thingi_id"), F.col("l_linenumber").alias("level"))
    return stats(spark, sf_dir).join(back, ["thingi_id", "level"], "left_semi").select("thingi_id", "level", "can_bytes")


@query
def equality_of_all_pairs(spark, sf_dir):
    """Cells in which each pair of three reconstructions differs."""
    v = user_grid(spark, sf_dir)
    made = {"a": v, "b": v.filter("value > 1"), "c": v.withColumn("value", F.least("value", F.lit(2.0)))}
    return report.unequal_cells(made, ["grid", "x", "y", "z"])


@query
def unit_cube(spark, sf_dir):
    """Points of each group moved and scaled into the unit cube, its longest side one."""
    p = grids.read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("thing"), "l_orderkey", "l_linenumber", F.col("l_partkey").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"), F.col("l_quantity").alias("z"))
    out = grids.unit_cube(p, "thing")
    return out.select("thing", "l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in "xyz"])


def supplier_solids(spark, sf_dir) -> DataFrame:
    """A box or a tetrahedron for each supplier, its place and sides from the supplier's numbers; one in five has a hole."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    rows = grids.read(spark, sf_dir, "supplier").select(k.alias("mesh"), (k % 4 + 0.25).alias("x"), (n % 3 + 0.0).alias("y"), (k % 3 + 0.0).alias("z"), (k % 7 + 2.0).alias("sx"), (n % 5 + 3.0).alias("sy"), (F.abs("s_acctbal").cast("long") % 6 + 2.0).alias("sz"))
    hole = F.col("mesh") % 5 == 0
    return mesh.solids(rows.filter("mesh % 2 = 0"), mesh.BOX, hole).unionByName(mesh.solids(rows.filter("mesh % 2 = 1").withColumn("x", F.floor("x") + 0.2718), mesh.TETRAHEDRON, hole))


@query
def open_meshes(spark, sf_dir):
    return mesh.open_meshes(supplier_solids(spark, sf_dir))


@query
def mesh_voxels(spark, sf_dir):
    """Cells inside the suppliers' closed solids."""
    return mesh.voxels(supplier_solids(spark, sf_dir)).select("grid", "x", "y", "z")


@query
def mesh_trees(spark, sf_dir):
    """Adaptive trees of the solids: leaves and volume, in cells, of what is inside."""
    v = settled(mesh.voxels(supplier_solids(spark, sf_dir)))
    box = settled(sparse.extent(v))
    b = sparse.placed_boxes(sparse.adaptive(v, box), box)
    return b.groupBy("tree_id").agg(F.count("*").alias("leaves"), F.sum(F.when(F.col("value") > 0, F.col("size_x") * F.col("size_y") * F.col("size_z")).otherwise(0)).alias("cells"))


@query
def mesh_filter_slice(spark, sf_dir):
    """Slice 2 of 5 of the parts that pass the filter on size, kind and price."""
    p = grids.read(spark, sf_dir, "part").filter((F.col("p_size") <= 40) & F.col("p_brand").isNotNull() & (F.col("p_retailprice") > 0))
    return report.slice_of(p.select("p_partkey"), "p_partkey", 2, 5)
