"""Shapes sampled by slabs, in batches and as a stream, against all cells at once."""

import numpy as np
import pytest

from haargrid.operators import sparse
from haargrid.sources import slices


# by value to the tasks, which don't import tests
ball = lambda x, y, z: (x - 0.4) ** 2 + (y - 0.5) ** 2 + (z - 0.55) ** 2 <= 0.3**2


def cells(blocks):
    out = []
    for r in blocks:
        out += [(r.x + i, r.y + j, r.z + k) for i in range(r.side) for j in range(r.side) for k in range(r.side)]
    return sorted(out)


def plain(inside, level):
    m = (np.arange(1 << level) + 0.5) / (1 << level)
    got = np.broadcast_to(inside(m[:, None, None], m[None, :, None], m[None, None, :]), (len(m),) * 3)
    return [tuple(map(int, c)) for c in np.argwhere(got)]


@pytest.mark.parametrize("level", [0, 1, 2, 4, 5])
def test_blocks_are_the_cells(spark, level):
    df = slices.read(spark, ball, level)
    assert df.rdd.getNumPartitions() == max(1, (1 << level) // slices.SLAB)
    got = df.collect()
    assert cells(got) == plain(ball, level)
    assert all(r.x % r.side == r.y % r.side == r.z % r.side == 0 for r in got)


def test_tiles_meet(spark, monkeypatch):
    monkeypatch.setattr(slices, "TILE", 16)
    for number in range(4):
        rows = [r for b in slices.slab(ball, 5, number, "g") for r in b.to_pylist()]
        got = sorted((r["x"] + i, r["y"] + j, r["z"] + k) for r in rows for i in range(r["side"]) for j in range(r["side"]) for k in range(r["side"]))
        assert got == [c for c in plain(ball, 5) if c[2] // 8 == number]


def test_nothing_and_everything(spark):
    none, every = (lambda x, y, z: False & (x < 0)), (lambda x, y, z: x >= 0)
    assert slices.read(spark, none, 4).count() == 0
    assert {(r.side, r.value) for r in slices.read(spark, every, 4).collect()} == {(8, 1.0)}
    tree = sparse.adaptive(slices.read(spark, every, 4), slices.cube(spark, 4)).collect()
    assert [(r.path, r.value) for r in tree] == [("", 1.0)]
    with pytest.raises(Exception, match="level 22"):
        slices.read(spark, every, 22).count()


def test_tree_of_blocks_is_that_of_cells(spark):
    blocks = slices.read(spark, ball, 5)
    single = spark.createDataFrame([("shape", *c, 1.0) for c in plain(ball, 5)], "grid string, x long, y long, z long, value double")
    box = slices.cube(spark, 5)
    key = lambda df: sorted((r.path, tuple(r.refs), r.value) for r in df.collect())
    assert key(sparse.adaptive(blocks, box)) == key(sparse.adaptive(single, box))


def test_stream_reads_each_slab_once(spark, tmp_path):
    spark.dataSource.register(slices.source(ball, "ball_slices"))

    def run():
        s = spark.readStream.format("ball_slices").option("level", 5).load()
        s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)

    run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert cells(got) == plain(ball, 5)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)
