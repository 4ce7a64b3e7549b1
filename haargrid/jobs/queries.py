"""The registered queries over the given tables, each a thin call of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haargrid.functions import paths
from haargrid.functions.tables import settled
from haargrid.operators import coarsen, grid, haar, kernel, report, restructure
from haargrid.sources import files, grids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Events of a task that builds their trees: it holds several nodes for each.
EVENTS = 50_000
#: Order lines of a task that tells repeated voxels.
LINES = 250_000


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    """Rounded, and never a negative zero, so that engines that add in another order agree."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


# inputs


def vectors(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    """Trees of the 64 elements of each embedding: 6 levels, or 3 in two, or 2 in three dimensions."""
    coords = list("xyz")[:dims]
    levels = 6 // dims
    return grids.full_tree(grids.vector_cells(grids.read(spark, sf_dir, "embeddings"), coords, levels), coords, levels)


def event_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of whether each cell of the event grids has events; the number of tasks follows from the number of events."""
    events = grids.read(spark, sf_dir, "events")
    voxels = grids.event_voxels(events, events.count() // EVENTS + 1)
    return coarsen.adaptive_sparse(voxels.withColumn("value", F.lit(1.0)), list("xyz"), 3, dealt=True)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements by (thingi_id, level): supplier and line number, with sums of quantities in place of sizes."""
    q = F.col("l_quantity").cast("long")
    return grids.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("thingi_id"), F.col("l_linenumber").alias("level")).agg(
        F.sum(q).alias("can_bytes"), F.sum(F.when(F.col("l_returnflag") == "N", q)).alias("ds_bytes"), F.sum(F.when(F.col("l_linestatus") == "O", q)).alias("vdb_bytes"), F.count("*").alias("rows")
    )


# transforms


@query
def haar2d_lineitem(spark, sf_dir):
    cells = grids.order_raster(grids.read(spark, sf_dir, "lineitem"))
    return haar.forward(grids.full_tree(cells, ["x", "y"], 2)).withColumn("c", r6("c"))


@query
def haar1d_embeddings(spark, sf_dir):
    return haar.forward(vectors(spark, sf_dir, 1)).withColumn("c", r6("c"))


@query
def haar3d_embeddings(spark, sf_dir):
    return haar.forward(vectors(spark, sf_dir, 3)).withColumn("c", r6("c"))


@query
def inverse_haar_roundtrip(spark, sf_dir):
    leaves = vectors(spark, sf_dir, 3)
    return haar.inverse(leaves, haar.forward(leaves)).withColumn("value", r6("value"))


@query
def node_means(spark, sf_dir):
    return haar.node_means(vectors(spark, sf_dir, 2)).select("tree_id", "path", r6("mean").alias("mean"))


# bits and places


@query
def morton_encode(spark, sf_dir):
    li = grids.read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", paths.morton([F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")], 21).alias("m"))


@query
def morton_decode(spark, sf_dir):
    m = F.col("o_orderkey")
    return grids.read(spark, sf_dir, "orders").select("o_orderkey", *[paths.unmorton(m, 3, 21, d).alias(c) for d, c in enumerate("xyz")])


@query
def bit_index_sets(spark, sf_dir):
    """Coefficient indexes that hold each refined dimension, for the refinements that the events' trees use."""
    refs = event_tree(spark, sf_dir).select(F.explode("refs").alias("ref")).distinct().unionByName(grids.read(spark, sf_dir, "nation").select((F.col("n_nationkey") % 8).cast("int").alias("ref")).distinct()).distinct().filter("ref > 0")
    each = refs.select("ref", F.explode(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda d: F.call_function("shiftright", F.col("ref"), d).bitwiseAND(1) == 1)).alias("dim"))
    mask = F.call_function("shiftleft", F.lit(1), F.bit_count(F.col("ref").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("dim")) - 1)).cast("int"))
    n = F.call_function("shiftleft", F.lit(1), paths.bits(F.col("ref")))
    held = F.filter(F.sequence(F.lit(0), n - 1), lambda j: j.bitwiseAND(mask) != 0)
    return each.select("ref", "dim", mask.alias("own_index"), F.array_join(F.transform(held, lambda j: j.cast("string")), ",").alias("indexes"))


@query
def tree_levels(spark, sf_dir):
    t = event_tree(spark, sf_dir).withColumn("steps", paths.steps(F.col("path"), F.col("refs")))
    t = t.select("tree_id", "path", *[paths.marked_index(F.col("steps"), d).alias(f"at_{c}") for d, c in enumerate("xyz")])
    t = t.select("*", *[paths.marked_level(F.col(f"at_{c}")).alias(f"level_{c}") for c in "xyz"])
    return t.select("tree_id", "path", *[f"level_{c}" for c in "xyz"], *[(F.col(f"at_{c}") - F.call_function("shiftleft", F.lit(1).cast("long"), F.col(f"level_{c}"))).alias(f"index_{c}") for c in "xyz"])


@query
def box_volumes(spark, sf_dir):
    t = event_tree(spark, sf_dir)
    return t.groupBy("tree_id", F.length("path").alias("depth")).agg(F.count("*").alias("boxes"), r6(F.sum(paths.volume(F.col("refs")))).alias("volume"))


def _all_nodes(t: DataFrame) -> DataFrame:
    """(tree_id, path, leaf) of all nodes: an inner node comes with its first leaf, so none is made twice or grouped."""
    nodes = F.transform(F.sequence(F.lit(0), "begun"), lambda k: F.struct(F.substr("path", F.lit(1), F.length("path") - k).alias("path"), (k == 0).alias("leaf")))
    return t.select("tree_id", "path", paths.begun(F.col("path")).alias("begun")).select("tree_id", F.inline(nodes))


@query
def preorder_ordinals(spark, sf_dir):
    w = Window.partitionBy("tree_id").orderBy("path")
    box = F.when(F.col("leaf"), F.count_if("leaf").over(w) - 1)
    return _all_nodes(event_tree(spark, sf_dir)).select("tree_id", "path", (F.row_number().over(w) - 1).alias("node_no"), box.alias("box_no"))


@query
def subtree_ranges(spark, sf_dir):
    """Number of nodes of each subtree: a leaf adds itself and the nodes inside that begin with it."""
    t = event_tree(spark, sf_dir).select("tree_id", "path", paths.begun(F.col("path")).alias("begun"))
    up = F.transform(F.sequence(F.lit(0), F.length("path")), lambda k: F.struct(F.substr("path", F.lit(1), k).alias("path"), (F.least("begun", F.length("path") - k) + 1).alias("nodes")))
    return t.select("tree_id", F.inline(up)).groupBy("tree_id", "path").agg(F.sum("nodes").alias("nodes"))


@query
def ancestry(spark, sf_dir):
    """Children of each inner node, and how many of them are leaves."""
    nodes = _all_nodes(event_tree(spark, sf_dir)).filter("path != ''")
    return nodes.groupBy("tree_id", paths.parent(F.col("path")).alias("path")).agg(F.count("*").alias("children"), F.count_if("leaf").alias("leaf_children"))


@query
def adaptive_build_events(spark, sf_dir):
    return event_tree(spark, sf_dir).select("tree_id", "path", "value")


@query
def ref_histogram(spark, sf_dir):
    return grid.ref_histogram(event_tree(spark, sf_dir))


@query
def descriptor_stats(spark, sf_dir):
    return grid.tree_stats(event_tree(spark, sf_dir), 3)


@query
def descriptor_files(spark, sf_dir):
    d = grid.descriptors(event_tree(spark, sf_dir), 3)
    return d.select("tree_id", F.col("n_bits").cast("long").alias("n_bits"), F.lower(F.hex("descriptor")).alias("descriptor"))


@query
def descriptor_roundtrip(spark, sf_dir):
    return grid.read_descriptors(grid.descriptors(event_tree(spark, sf_dir), 3), 3).select("tree_id", "path")


# compression


@query
def coarsen_round_full(spark, sf_dir):
    new, _ = coarsen.coarsening_round(vectors(spark, sf_dir, 3), 0.06, partial=False)
    return new.select("tree_id", "path", r6("value").alias("value"))


@query
def coarsen_round_partial(spark, sf_dir):
    plan = coarsen.decisions(vectors(spark, sf_dir, 3), 0.06).filter("give > 0")
    return plan.select("tree_id", F.col("up").alias("path"), "give", r6("discarded").alias("discarded"))


@query
def coarsen_bounds(spark, sf_dir):
    """How many nodes each bound lets go."""
    out = None
    for bound in ("flat", "per_volume", "sum_volume"):
        part = coarsen.decisions(vectors(spark, sf_dir, 3), 0.05, bound, partial=False).filter("give > 0").groupBy().agg(F.count("*").alias("nodes")).withColumn("bound", F.lit(bound))
        out = part if out is None else out.unionByName(part)
    return out


@query
def discarded_l1(spark, sf_dir):
    plan = coarsen.decisions(vectors(spark, sf_dir, 3), 0.06)
    return plan.groupBy("tree_id").agg(r6(F.sum("discarded")).alias("discarded"))


@query
def canonical_fixpoint(spark, sf_dir):
    return coarsen.canonical(vectors(spark, sf_dir, 3), 0.06).groupBy("tree_id").agg(F.count("*").alias("boxes"), r6(F.max("discarded")).alias("discarded"))


def _restructured(spark, sf_dir, scheduler):
    """Canonical trees restructured, summed up by tree."""
    out = kernel.restructure(coarsen.canonical(vectors(spark, sf_dir, 3), 0.06), scheduler, 0.06)
    return out.groupBy("tree_id").agg(F.count("*").alias("boxes"), r6(F.sum("discarded")).alias("discarded"), r6(F.sum(F.col("value") * paths.volume(F.col("refs")))).alias("mean"))


@query
def downsplit_compress(spark, sf_dir):
    return _restructured(spark, sf_dir, "batched")


@query
def decomposed_compress(spark, sf_dir):
    return _restructured(spark, sf_dir, "decomposed")


@query
def normalize(spark, sf_dir):
    """Canonical trees after a push everywhere, normalised: the boxes are the same, the shape isn't."""
    pushed = restructure.push_down(settled(coarsen.canonical(vectors(spark, sf_dir, 3), 0.06)))
    out = restructure.normalized(pushed)
    return out.select("tree_id", "path", F.array_join(F.transform("refs", lambda r: r.cast("string")), "").alias("refs"), r6("value").alias("value"))


@query
def partitioned_compress(spark, sf_dir):
    """Canonical trees cut by their first step, compressed apart, composed, and coarsened over the seams."""
    parts = kernel.restructure(coarsen.canonical(vectors(spark, sf_dir, 3), 0.06), "batched", 0.06, prefix=1)
    return coarsen.canonical(settled(parts).drop("discarded"), 0.06).groupBy("tree_id").agg(F.count("*").alias("boxes"))


@query
def whatif_thresholds(spark, sf_dir):
    return coarsen.what_if(vectors(spark, sf_dir, 3), [0.0, 0.01, 0.05, 1.0, 4.0])


@query
def threshold_cascade(spark, sf_dir):
    """Boxes by threshold, each threshold starting from the result of the one before."""
    now, out = vectors(spark, sf_dir, 3), None
    for t in (0.01, 0.05, 0.2):
        now = settled(coarsen.canonical(now, t)).select("tree_id", "path", "refs", "value")
        part = now.groupBy("tree_id").agg(F.count("*").alias("boxes")).withColumn("threshold", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


# grids


@query
def rasterize(spark, sf_dir):
    return grid.rasterise(event_tree(spark, sf_dir), 3, 3)


@query
def sparse_fill(spark, sf_dir):
    return grid.fill(event_tree(spark, sf_dir), 3, 3)


@query
def occupancy_threshold(spark, sf_dir):
    """Cells of the orders' raster that count as occupied, from one half on or only above it, in Morton order."""
    cells = grids.order_raster(grids.read(spark, sf_dir, "lineitem"))
    half = F.col("value") / 2000.0
    return cells.select("tree_id", paths.morton([F.col("x"), F.col("y")], 2).alias("m"), (half >= 0.5).alias("at_least"), (half > 0.5).alias("above"))


@query
def analytic_shapes(spark, sf_dir):
    """Order lines whose bins' midpoints lie in a sphere, a tetrahedron or a rod."""
    p = [(F.col(c) % 16 + 0.5) / 16 for c in ("l_partkey", "l_suppkey", "l_orderkey")]
    li = grids.read(spark, sf_dir, "lineitem").select("l_returnflag", *[f(*p).alias(n) for n, f in grids.SHAPES.items()])
    return li.groupBy("l_returnflag").agg(*[F.count_if(n).alias(n) for n in grids.SHAPES])


def _two_grids(spark, sf_dir):
    """Event grids, and what they are when the lightest voxels are left out."""
    v = grids.event_voxels(grids.read(spark, sf_dir, "events"))
    return v, v.filter("value > 2").withColumn("value", F.col("value") - 0.5)


@query
def error_norms(spark, sf_dir):
    a, b = _two_grids(spark, sf_dir)
    n = grid.error_norms(a, b, list("xyz"), 512)
    return n.select("grid", *[r6(c).alias(c) for c in n.columns[1:]])


@query
def max_error(spark, sf_dir):
    cells = grids.vector_cells(grids.read(spark, sf_dir, "embeddings"), list("xyz"), 2)
    new, _ = coarsen.coarsening_round(grids.full_tree(cells, list("xyz"), 2), 0.06, partial=False)
    return grid.leaf_errors(new, cells, 3, 2).withColumn("max_error", r6("max_error"))


@query
def grid_compare_outer(spark, sf_dir):
    a, b = _two_grids(spark, sf_dir)
    j = grid.joined(a, b, ["grid", "x", "y", "z"])
    return j.filter("a != b").groupBy("grid").agg(F.count("*").alias("different"), r6(F.sum(F.col("a") - F.col("b"))).alias("missing"))


@query
def corner_sample(spark, sf_dir):
    voxels = grids.event_voxels(grids.read(spark, sf_dir, "events"))
    return grids.at_corners(event_tree(spark, sf_dir), voxels, 3)


@query
def grid_extent(spark, sf_dir):
    """Bounding box of the stored voxels, and the levels that hold it."""
    v = grids.event_voxels(grids.read(spark, sf_dir, "events"))
    box = v.groupBy("grid").agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    level = lambda c: F.ceil(F.log2(F.greatest(F.col(f"max_{c}") + 1 - F.col(f"min_{c}"), F.lit(1)))).cast("int")
    return box.select("*", *[level(c).alias(f"level_{c}") for c in "xyz"])


@query
def voxel_topology(spark, sf_dir):
    """Sparse-tree nodes of the order lines' part, supplier and line numbers as voxels, a grid for each flag."""
    lines = grids.read(spark, sf_dir, "lineitem")
    v = lines.select(F.col("l_returnflag").alias("grid"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_linenumber").alias("z"))
    return files.voxel_topology(v, lines.count() // LINES + 1)


@query
def masked_layout(spark, sf_dir):
    """Event trees from their shape and the values that differ from the background."""
    t = event_tree(spark, sf_dir)
    return files.with_background(t, files.masked_values(t)).select("tree_id", "path", "value")


# statistics


@query
def level_pivot_first(spark, sf_dir):
    return report.level_pivot(stats(spark, sf_dir), "ds_bytes", list(range(1, 8)))


@query
def level_aggregate(spark, sf_dir):
    a = report.level_aggregate(stats(spark, sf_dir))
    return a.withColumn("mean", r6("mean")).withColumn("median", r6("median"))


@query
def extremal_topk(spark, sf_dir):
    return report.extremal(stats(spark, sf_dir), "can_bytes", "vdb_bytes").withColumn("ratio", r6("ratio"))


@query
def slope_rates(spark, sf_dir):
    s = report.slopes(stats(spark, sf_dir).filter("level >= 2"))
    return s.select("method", "lo", "hi", "n_lo", "n_hi", *[r6(c).alias(c) for c in ("mean_lo", "mean_hi", "median_lo", "median_hi", "rate_mean", "rate_median")])


@query
def count_distinct_things(spark, sf_dir):
    return stats(spark, sf_dir).filter("level >= 2").groupBy("level").agg(F.countDistinct("thingi_id").alias("things"))


@query
def size_ratios(spark, sf_dir):
    ratio = F.try_divide(F.col("can_bytes").cast("double"), F.col("vdb_bytes"))
    return stats(spark, sf_dir).select("thingi_id", "level", r6(ratio).alias("ratio"), (F.col("can_bytes") * 32 + F.col("rows") * 3).alias("total_bits"))


@query
def sweep_sorted(spark, sf_dir):
    """Results by threshold, the largest first, in the fixed order of columns."""
    s = stats(spark, sf_dir).groupBy((F.col("level") / 10.0).alias("threshold")).agg(F.sum("can_bytes").alias("can"), F.sum("ds_bytes").alias("ds"))
    both = s.select("threshold", F.lit("can").alias("variant"), F.col("can").alias("total_bytes")).unionByName(s.select("threshold", F.lit("ds").alias("variant"), F.col("ds").alias("total_bytes")))
    return both.orderBy(F.desc("threshold"), "variant")


# bookkeeping


@query
def antijoin_incremental(spark, sf_dir):
    done = stats(spark, sf_dir).filter("level < 4 or thingi_id % 3 = 0")
    return report.new_rows(stats(spark, sf_dir), done, ["thingi_id", "level"]).select("thingi_id", "level", "can_bytes")


@query
def semijoin_siblings(spark, sf_dir):
    s = stats(spark, sf_dir)
    full = s.filter(F.col("ds_bytes").isNotNull() & F.col("vdb_bytes").isNotNull())
    return s.join(full.select("thingi_id", "level"), ["thingi_id", "level"], "left_semi").select("thingi_id", "level")


@query
def left_coalesce_files(spark, sf_dir):
    """The restructured size if there is one, else the canonical one."""
    s = stats(spark, sf_dir)
    return s.select("thingi_id", "level", "can_bytes").join(s.filter("ds_bytes > 200").select("thingi_id", "level", "ds_bytes"), ["thingi_id", "level"], "left").select("thingi_id", "level", F.coalesce("ds_bytes", "can_bytes").alias("bytes"))


@query
def pairwise_equality(spark, sf_dir):
    """Cells of one reconstruction that the other one hasn't got, both ways."""
    a, b = (g.select("grid", "x", "y", "z", "value") for g in _two_grids(spark, sf_dir))
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second"))).groupBy("side").agg(F.count("*").alias("cells"))


@query
def outermost_prefixes(spark, sf_dir):
    """Nodes with two or more leaf children that lie in no other such node: in pre-order none before them reaches so far."""
    t = event_tree(spark, sf_dir).filter("path != ''")
    c = t.groupBy("tree_id", paths.parent(F.col("path")).alias("path")).agg(F.count("*").alias("leaves")).filter("leaves >= 2")
    earlier = Window.partitionBy("tree_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    end = F.max(F.concat("path", F.lit("8"))).over(earlier)  # no slot is above 7: beyond all nodes inside
    return c.withColumn("end", end).filter("end is null or path > end").select("tree_id", "path", "leaves")


@query
def zorder_concat(spark, sf_dir):
    """The event trees of sixteen users each as parts of one, below a regular top grid."""
    t = event_tree(spark, sf_dir)
    parts = t.withColumn("top_x", F.col("tree_id") % 4).withColumn("top_y", F.floor(F.col("tree_id") / 4) % 4).withColumn("top_z", F.lit(0)).withColumn("tree_id", F.floor(F.col("tree_id") / 16))
    return grid.compose(parts, 2, 3).select("tree_id", "path", "value")


@query
def slice_i_of_n(spark, sf_dir):
    return report.slice_of(grids.read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 3, 7)


@query
def partition_layout(spark, sf_dir):
    """Voxels by part of a grid that is cut twice in x and once in y and z, with the part's origin."""
    v = grids.event_voxels(grids.read(spark, sf_dir, "events"))
    part = v.select("grid", F.shiftright("x", 1).alias("px"), F.shiftright("y", 2).alias("py"), F.shiftright("z", 2).alias("pz"), "value")
    return part.groupBy("grid", "px", "py", "pz").agg((F.col("px") * 2).alias("ox"), (F.col("py") * 4).alias("oy"), (F.col("pz") * 4).alias("oz"), F.count("*").alias("voxels"), F.sum("value").alias("total"))


@query
def jsonlines_parse(spark, sf_dir):
    """Events' JSON properties as columns, counted."""
    e = grids.read(spark, sf_dir, "events")
    return e.select("event_type", F.get_json_object("props", "$.k").alias("k"), "value").groupBy("event_type", "k").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query
def regexp_discover(spark, sf_dir):
    """Pages by host and the first number in their address."""
    p = grids.read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"([0-9]+)", 1).alias("number"))
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.countDistinct("number").alias("numbers"))
