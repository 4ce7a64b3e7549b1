"""Appends of several writers, packed masks, runs of parts that stop."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from haargrid.jobs import parts, sweeps
from haargrid.operators import order
from haargrid.sources import log, masks
from tests.test_restructure import rows
from tests.test_trees import canonical, leaves_of, random_full


def test_concurrent_appends_leave_each_key_once(spark, tmp_path):
    at, schema, failed = str(tmp_path / "t"), "k long, v long", []
    made = [spark.range(a, b).select(F.col("id").alias("k"), F.lit(i).cast("long").alias("v")).coalesce(1) for i, (a, b) in enumerate(((0, 60), (30, 90), (0, 90), (50, 100)))]

    def write(df):
        try:
            log.append(df, at, ["k"], schema)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(df,)) for df in made]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = log.read(spark, at, schema)
    assert log.one_by_key(got, ["k"]) and sorted(r.k for r in got.collect()) == list(range(100))
    n = len(log.commits(spark, at))
    assert log.append(made[0], at, ["k"], schema) == -1 and len(log.commits(spark, at)) == n
    # what a stopped writer has left isn't read
    made[0].write.parquet(f"{at}/part-left")
    assert log.read(spark, at, schema).count() == 100


def test_rank_and_select(spark):
    rng = random.Random(1)
    marks = {t: [rng.random() < p for _ in range(n)] for t, (n, p) in enumerate(((1, 1.0), (63, 0.5), (64, 1.0), (65, 0.0), (9000, 0.3)))}
    data = spark.createDataFrame([(t, i, b) for t, bits in marks.items() for i, b in enumerate(bits)], "tree_id long, ordinal long, stored boolean")
    blocks = masks.pack(data)
    assert blocks.filter(F.size("words") > masks.WORDS).count() == 0
    for r in masks.ranked(data.select("tree_id", "ordinal"), blocks).collect():
        assert r.stored == marks[r.tree_id][r.ordinal] and r["rank"] == sum(marks[r.tree_id][: r.ordinal])
    assert sorted((r.tree_id, r["rank"], r.ordinal) for r in masks.selected(blocks).collect()) == [(t, k, i) for t, bits in marks.items() for k, i in enumerate(i for i, b in enumerate(bits) if b)]


def test_numbers_of_rows_in_order(spark):
    data = spark.createDataFrame([(k, (v * 37) % 101) for k in "ab" for v in range(101 if k == "a" else 3)], "key string, v long").repartition(4)
    got = order.numbered(data, "key", [F.col("v")]).collect()
    for k in "ab":
        own = sorted((r.v, r.ordinal) for r in got if r.key == k)
        assert [o for _, o in own] == list(range(len(own)))


def test_stages_come_back(spark, tmp_path):
    rng = random.Random(2)
    trees = [random_full(rng, [2, 2, 1]), 0.0, 1.5, (1, [0.0, 0.0])]
    leaves = leaves_of(spark, trees).withColumn("value", F.when(F.length("path") % 3 == 1, 0.0).otherwise(F.col("value")))
    sweeps.save_stage(leaves, str(tmp_path), "can", 0.1, 3)
    assert rows(sweeps.read_stage(spark, str(tmp_path), "can", 0.1)) == rows(leaves)
    values = f"{tmp_path}/stage=can/threshold=0.1/values"
    spark.read.parquet(values).limit(3).write.parquet(f"{tmp_path}/less")
    spark.read.parquet(f"{tmp_path}/less").write.mode("overwrite").parquet(values)
    with pytest.raises(ValueError):
        sweeps.read_stage(spark, str(tmp_path), "can", 0.1)


def test_stopped_run_goes_on(spark, tmp_path):
    rng = random.Random(3)
    trees = [canonical(random_full(rng, [2, 2, 2]), 0.4) for _ in range(3)] + [1.0]
    leaves = leaves_of(spark, trees)
    whole, stopped = str(tmp_path / "whole"), str(tmp_path / "stopped")
    # waves by hash, of which some may have no part
    wave = F.length("part") * 3 % 4 + F.coalesce(F.col("part").try_cast("int"), F.lit(0)) % 2
    assert parts.compress(leaves, whole, 1, 0.4, 4, wave) >= 2
    assert parts.compress(leaves, stopped, 1, 0.4, 4, wave, stop_after=1) == 1
    first = {(r.tree_id, r.part): r.folder for r in parts.manifest(spark, stopped).collect()}
    # a stopped wave leaves a folder that no manifest names
    leaves.limit(2).write.parquet(f"{stopped}/wave-9-left")
    assert parts.compress(leaves, stopped, 1, 0.4, 4, wave) >= 1
    after = {(r.tree_id, r.part): r.folder for r in parts.manifest(spark, stopped).collect()}
    assert first and all(after[k] == f for k, f in first.items()) and len(after) > len(first)
    assert rows(parts.composed(spark, stopped)) == rows(parts.composed(spark, whole))
    assert parts.compress(leaves, stopped, 1, 0.4, 4, wave) == 0
    assert parts.composed(spark, stopped).count() <= leaves.count()


def test_solids_on_the_cells_middles(spark):
    """Diagonals of faces that go through the middles of cells count once; a mesh with a hole or a doubled face isn't closed."""
    from haargrid.sources import mesh

    rows = spark.createDataFrame([(k, float(k % 3), float(k), 0.0, 4.0, 4.0, 3.0) for k in range(4)], "mesh long, x double, y double, z double, sx double, sy double, sz double")
    triangles = mesh.solids(rows, mesh.BOX, F.col("mesh") == 3)
    triangles = triangles.unionByName(triangles.filter("mesh = 2").limit(1))
    assert sorted(r.mesh for r in mesh.open_meshes(triangles).collect()) == [2, 3]
    got = sorted((r.grid, r.x, r.y, r.z) for r in mesh.voxels(triangles).collect())
    assert got == sorted((k, k % 3 + x, k + y, z) for k in range(2) for x in range(4) for y in range(4) for z in range(3))
