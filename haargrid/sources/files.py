"""Tables and grids in files: measurements, tool output, run folders, images, compressed sizes."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haargrid.sources import log

# The columns of the statistics and of the threshold sweep, in their order.
_METHOD = ("nodes long", "boxes long", "topo_bits long", "ref_counts string", "raw_total_bytes long", "blosc2_total_bytes double", "desc_raw_bytes long", "desc_blosc2_bytes double", "coeffs_raw_bytes long", "coeffs_blosc2_bytes double")
_VDB = ("topo_bits", "topo_bytes", "active_leaf_voxels", "dense_value_bits", "active_value_bits", "active_leaf", "inactive_leaf", "active_tiles", "total_leaf_coefficients", "total_coefficients", "file_bytes")
STATS = ", ".join(["thingi_id long", "level int", *(f"{p}_{c}" for p in ("can", "ds") for c in _METHOD), *(f"vdb_{c} long" for c in _VDB)])
SWEEP = (
    "threshold double, variant string, nodes long, boxes long, topo_bits long, n_leaves long, n_nonbg_leaves long, Linf_error double, L1_error double, L2_error double, Linf_sol double, L1_sol double, L2_sol double, "
    "desc_raw_bytes long, values_raw_bytes long, raw_total_bytes long, desc_blosc2_bytes double, values_blosc2_bytes double, blosc2_total_bytes double, "
    "vdb_orig_file_bytes long, vdb_orig_topo_bits long, vdb_orig_active_voxels long, vdb_orig_total_coefficients long, vdb_recon_file_bytes long, ratio_raw_vs_vdb double, ratio_blosc2_vs_vdb double"
)
TOOL = (
    "grid string, level int, type string, nodes long, mask_bits_per_node long, total_bits long, summary boolean, total_topology_bits long, total_topology_bytes long, value_summary boolean, bits_per_value long, "
    "leaf_count long, active_leaf_voxels long, inactive_leaf_voxels long, active_tiles long, total_leaf_coefficients long, total_coefficients long, dense_value_bits long, active_value_bits long"
)


def read_stats(spark: SparkSession, path: str, schema: str = STATS, least_level: int = 2) -> DataFrame:
    """Measurements from CSV with a header, of levels from ``least_level`` on; nan is missing. Of appended ones, those that count."""
    rows = log.read(spark, path, schema, "csv") if log.commits(spark, path) else spark.read.schema(schema).option("header", True).option("nullValue", "nan").csv(path)
    return rows.filter(F.col("level") >= least_level)


def conform(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema in its order: missing ones are null, others go."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def append_stats(rows: DataFrame, path: str, schema: str = STATS, keys: tuple[str, ...] = ("thingi_id", "level")) -> int:
    """Adds the rows whose keys aren't there as CSV, as ``log.append`` does: repeated and concurrent runs leave each key once."""
    return log.append(conform(rows, schema), path, list(keys), schema, "csv")


def tool_summaries(spark: SparkSession, path: str) -> DataFrame:
    """A row for each grid from a tool's JSON lines: level rows summed, with what the two kinds of summaries say."""
    lines = spark.read.schema(TOOL).json(path)
    of = lambda flag, c: F.max(F.when(F.col(flag), F.col(c))).alias(c)
    values = ("leaf_count", "active_leaf_voxels", "inactive_leaf_voxels", "active_tiles", "total_leaf_coefficients", "total_coefficients", "dense_value_bits", "active_value_bits")
    return lines.groupBy("grid").agg(
        F.count("level").alias("levels"), F.sum(F.when(F.col("level").isNotNull(), F.col("nodes"))).alias("nodes"), F.sum(F.when(F.col("level").isNotNull(), F.col("total_bits"))).alias("level_bits"),
        of("summary", "total_topology_bits"), of("summary", "total_topology_bytes"), *[of("value_summary", c) for c in values],
    )


def discover(files: DataFrame, path: str = "path") -> DataFrame:
    """Things and levels that have a canonical topology file, with their other files; push-down before downsplit."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    part = lambda i: F.regexp_extract(name, r"^(\d+)_l(\d+)_(canonical|pushdown|downsplit)_3d\.bin$|^(\d+)_l(\d+)_(openvdb)\.vdb$", i)
    either = lambda a, b: F.when(part(a) != "", part(a)).otherwise(part(b))
    found = files.select(F.col(path).alias("file"), either(1, 4).alias("id"), either(2, 5).alias("l"), either(3, 6).alias("kind")).filter("id != ''")
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("file")))
    wide = found.groupBy(F.col("id").cast("long").alias("thingi_id"), F.col("l").cast("int").alias("level")).agg(at("canonical").alias("canonical"), F.coalesce(at("pushdown"), at("downsplit")).alias("restructured"), at("openvdb").alias("vdb"))
    return wide.filter("canonical is not null")


def sweep_folders(files: DataFrame, path: str = "path") -> DataFrame:
    """Folders thr_* that have topology, values and metadata, in the order of their names."""
    p = F.regexp_extract(path, r"^(.*/)?(thr_[^/]*)/([^/]+)$", 2)
    name = F.element_at(F.split(F.col(path), "/"), -1)
    kinds = F.when(name.rlike(r"_3d\.bin$"), 1).when(name.rlike(r"_values\.npy$"), 2).when(name == "metadata.json", 4)
    return files.select(p.alias("folder"), kinds.alias("kind")).filter("folder != '' and kind is not null").groupBy("folder").agg(F.count_distinct("kind").alias("n")).filter("n = 3").select("folder", F.regexp_extract("folder", "^thr_(.*)$", 1).try_cast("double").alias("threshold")).orderBy("folder")


def write_metadata(runs: DataFrame, path: str) -> None:
    """Run metadata as JSON, an object for each run: bounding box, levels, levels of the partition grid, partitions."""
    runs.write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report that replaces an earlier one: numbers without decimals, nan where there is none."""
    numbers = {f.name for f in rows.schema if f.dataType.typeName() in ("double", "float")}
    rows.select(*[F.when(F.isnan(c), None).otherwise(F.format_string("%.0f", F.col(c))).alias(c) if c in numbers else F.col(c) for c in rows.columns]).select(
        *[F.coalesce(F.when(F.col(c) != "null", F.col(c)), F.lit("nan")).alias(c) if c in numbers else F.col(c) for c in rows.columns]
    ).write.mode("overwrite").option("header", True).option("nullValue", "nan").csv(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Run metadata: bounding box, levels of a dimension, levels of the partition grid, partitions."""
    return spark.read.schema("bbox_min array<int>, per_dim_levels array<int>, grid_levels array<int>, n_partitions int").json(path)


def read_gray(spark: SparkSession, path: str) -> DataFrame:
    """Cells (tree_id, x: row, y: column, value) of images: luminosity from 0 to 1."""
    images = spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        import numpy as np

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).astype(float)
                # stored blue, green, red; fixed weights of a colour's brightness
                v = (a[:, :, 2] * 0.2989 + a[:, :, 1] * 0.5870 + a[:, :, 0] * 0.1140 if r.nChannels >= 3 else a[:, :, 0]) / 255
                x, y = np.divmod(np.arange(v.size), r.width)
                yield pd.DataFrame({"tree_id": r.origin, "x": x, "y": y, "value": v.ravel()})

    return images.mapInPandas(run, "tree_id string, x long, y long, value double")


def compressed_bytes(column: Column, codec: str = "zstd") -> Column:
    """Size of each binary value when it is compressed (a stand-in for sizes of another library)."""

    @F.pandas_udf("long")
    def size(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else len(pa.compress(bytes(v), codec=codec, asbytes=True)))

    return size(column)


def masked_values(leaves: DataFrame, background: float = 0.0) -> DataFrame:
    """Leaves that differ from the background; ``with_background`` puts the others back."""
    return leaves.filter(F.col("value") != background).select("tree_id", "path", "value")


def with_background(shape: DataFrame, values: DataFrame, background: float = 0.0) -> DataFrame:
    return shape.select("tree_id", "path", "refs").join(values, ["tree_id", "path"], "left").withColumn("value", F.coalesce("value", F.lit(background)))


def voxel_topology(voxels: DataFrame, partitions: int | None = None) -> DataFrame:
    """Nodes and mask bits of each level of the usual sparse tree (8, 16 and 32 cells a side), and active voxels.

    Fixed values: a leaf has 512 mask bits, inner nodes 8,192 and 65,536. Each level is counted from the nodes of the one below. With
    ``partitions`` voxels are dealt out by nodes of the middle level into so many before anything is held, and repeated ones count once.
    """
    shifts = (3, 7, 12)
    key = [[F.call_function("shiftright", F.col(c).cast("long"), F.lit(s)).alias(f"n{i}{c}") for c in "xyz"] for i, s in enumerate(shifts)]
    names = [[f"n{i}{c}" for c in "xyz"] for i in range(3)]
    placed = voxels.select("grid", *key[1], "x", "y", "z")
    if partitions is not None:
        placed = placed.repartition(partitions, "grid", *names[1]).distinct()
    leaf = placed.groupBy("grid", *names[1], *key[0]).agg(F.count("*").alias("voxels"))
    middle = leaf.groupBy("grid", *names[1]).agg(F.count("*").alias("leaves"), F.sum("voxels").alias("voxels"))
    up = [F.call_function("shiftright", F.col(n), F.lit(shifts[2] - shifts[1])).alias(t) for n, t in zip(names[1], names[2], strict=True)]
    top = middle.groupBy("grid", *up).agg(F.sum("leaves").alias("leaves"), F.count("*").alias("middles"), F.sum("voxels").alias("voxels"))
    whole = top.groupBy("grid").agg(F.sum("leaves").alias("leaves"), F.sum("middles").alias("middles"), F.count("*").alias("tops"), F.sum("voxels").alias("voxels"))
    levels = [F.struct(F.lit(i).alias("level"), F.col(n).alias("nodes"), (F.col(n) * bits).cast("long").alias("mask_bits"), "voxels") for i, (n, bits) in enumerate((("leaves", 512), ("middles", 8192), ("tops", 65536)))]
    return whole.select("grid", F.inline(F.array(*levels)))
