import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from haargrid.sources import files


def test_stats_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 3, None)], "thingi_id long, level int, can_blosc2_total_bytes double").withColumn("unknown", F.lit(1))
    files.append_stats(rows, str(tmp_path / "s"))
    files.append_stats(rows.filter("thingi_id = 2"), str(tmp_path / "s"))
    got = files.read_stats(spark, str(tmp_path / "s"))
    assert len(got.columns) == 33 and len(files.SWEEP.split(",")) == 26
    assert sorted((r.thingi_id, r.level, r.can_blosc2_total_bytes) for r in got.collect()) == [(1, 2, 6.0), (2, 3, None)]


def test_tool_lines(spark, tmp_path):
    lines = [{"grid": "g", "level": k, "type": "leaf", "nodes": 2, "mask_bits_per_node": 512, "total_bits": 1024} for k in range(2)]
    lines += [{"grid": "g", "summary": True, "total_topology_bits": 2048, "total_topology_bytes": 256}, {"grid": "g", "value_summary": True, "active_leaf_voxels": 7, "dense_value_bits": 9}]
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, lines)))
    (r,) = files.tool_summaries(spark, str(tmp_path / "t.json")).collect()
    assert (r.levels, r.nodes, r.level_bits, r.total_topology_bits, r.active_leaf_voxels) == (2, 4, 2048, 2048, 7)


def test_discovery(spark):
    names = ["d/1_l2_canonical_3d.bin", "d/1_l2_downsplit_3d.bin", "d/1_l2_pushdown_3d.bin", "d/1_l3_canonical_3d.bin", "d/1_l3_openvdb.vdb", "d/2_l2_downsplit_3d.bin", "d/readme"]
    got = {(r.thingi_id, r.level): (r.restructured, r.vdb) for r in files.discover(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got == {(1, 2): ("d/1_l2_pushdown_3d.bin", None), (1, 3): (None, "d/1_l3_openvdb.vdb")}
    sweep = [f"w/{d}/{f}" for d in ("thr_1e-2", "thr_1e-10", "thr_0") for f in ("a_3d.bin", "a_values.npy", "metadata.json")][:-1]
    assert [r.folder for r in files.sweep_folders(spark.createDataFrame([(n,) for n in sweep], "path string")).collect()] == ["thr_1e-10", "thr_1e-2"]


def test_metadata(spark, tmp_path):
    (tmp_path / "metadata.json").write_text(json.dumps({"bbox_min": [0, 1, 2], "per_dim_levels": [3, 3, 4], "grid_levels": [1, 1, 1], "n_partitions": 8}))
    (r,) = files.read_metadata(spark, str(tmp_path / "metadata.json")).collect()
    assert (list(r.per_dim_levels), r.n_partitions) == ([3, 3, 4], 8)


def png(rows):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "i.png").write_bytes(png([[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (255, 255, 255)]]))
    got = {(r.x, r.y): r.value for r in files.read_gray(spark, str(tmp_path / "i.png")).collect()}
    assert [got[k] for k in sorted(got)] == pytest.approx([0.2989, 0.5870, 0.1140, 0.9999])


def test_compressed_sizes(spark):
    rows = spark.createDataFrame([(b"a" * 1000,), (None,)], "v binary").select(files.compressed_bytes(F.col("v")).alias("n")).collect()
    assert 0 < rows[0].n < 100 and rows[1].n is None


def test_voxel_topology_deals_voxels_by_rows_and_counts_repeated_ones_once(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(9000), rng.randrange(300), rng.randrange(5)) for g in "ab" for _ in range(800)]
    v = spark.createDataFrame(rows + rows[:50], "grid string, x long, y long, z int")
    want = {(g, i, len({tuple(k >> s for k in r[1:]) for r in own}), len(own)) for g in "ab" for own in [{r for r in rows if r[0] == g}] for i, s in enumerate((3, 7, 12))}
    found = files.voxel_topology(v, 7)
    assert {(r.grid, r.level, r.nodes, r.voxels) for r in found.collect()} == want
    assert {(r.grid, r.level, r.nodes, r.voxels) for r in files.voxel_topology(v.distinct()).collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # three levels from one another, not three rows a voxel
