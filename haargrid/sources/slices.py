"""Implicit shapes sampled slice by slice, as a data source for batches and streams.

A partition is a slab of SLAB slices. A task samples it tile by tile, so that it holds some
megabytes at any level, and sends the largest blocks of a power of two that are inside as a
whole; what is outside leaves no row. The blocks feed ``sparse.adaptive`` as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Slices of a partition, and cells along a tile's other sides: powers of two.
SLAB, TILE = 8, 256
SCHEMA = "grid string, x long, y long, z long, side long, value double"

Inside = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def whole_blocks(inside: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(side, corners) of the largest cubes of a power of two that lie in the cells, at multiples of their side."""
    full = [inside]
    while min(full[-1].shape) > 1:
        a, b, c = (n // 2 for n in full[-1].shape)
        full.append(full[-1].reshape(a, 2, b, 2, c, 2).all(axis=(1, 3, 5)))
    for k in reversed(range(len(full))):
        own = full[k]
        if k + 1 < len(full):
            own = own & ~full[k + 1].repeat(2, 0).repeat(2, 1).repeat(2, 2)
        yield 1 << k, np.argwhere(own) << k


def slab(inside: Inside, level: int, number: int, grid: str) -> Iterator[pa.RecordBatch]:
    """The blocks of a slab, sampled at the cells' midpoints in the unit cube."""
    cells = 1 << level
    thick, tile = min(SLAB, cells), min(TILE, cells)
    middle = (np.arange(cells) + 0.5) / cells
    z = number * thick
    for x in range(0, cells, tile):
        for y in range(0, cells, tile):
            got = inside(middle[x : x + tile, None, None], middle[None, y : y + tile, None], middle[None, None, z : z + thick])
            for side, at in whole_blocks(np.broadcast_to(np.asarray(got, bool), (tile, tile, thick))):
                if len(at):
                    corner = [pa.array(at[:, d] + low) for d, low in enumerate((x, y, z))]
                    yield pa.RecordBatch.from_arrays([pa.repeat(grid, len(at)), *corner, pa.array(np.full(len(at), side)), pa.array(np.ones(len(at)))], names=["grid", "x", "y", "z", "side", "value"])


class _Slabs:
    def __init__(self, inside: Inside, options):
        self.inside, self.level, self.grid = inside, int(options["level"]), options.get("grid", "shape")
        if not 0 <= self.level <= 21:
            raise ValueError(f"level {self.level} isn't from 0 to 21")

    def count(self) -> int:
        return max(1, (1 << self.level) // SLAB)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from slab(self.inside, self.level, partition.value, self.grid)


class _Reader(_Slabs, DataSourceReader):
    def partitions(self):
        return [InputPartition(i) for i in range(self.count())]


class _StreamReader(_Slabs, DataSourceStreamReader):
    """The offset is the number of slabs read. It follows from the options alone, so a query that starts again goes on right."""

    def initialOffset(self) -> dict:
        return {"slabs": 0}

    def latestOffset(self) -> dict:
        return {"slabs": self.count()}

    def partitions(self, start: dict, end: dict):
        return [InputPartition(i) for i in range(start["slabs"], end["slabs"])]


def source(inside: Inside, format_name: str) -> type[DataSource]:
    """A data source of the shape, to be registered: ``level`` is its option, 2 ** level cells a side, and ``grid`` its name.

    ``inside`` takes three arrays of coordinates that are broadcast together, and goes to the tasks with the class.
    """

    class Slices(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema):
            return _Reader(inside, self.options)

        def streamReader(self, schema):
            return _StreamReader(inside, self.options)

    return Slices


def read(spark: SparkSession, inside: Inside, level: int, grid: str = "shape", format_name: str = "dyadic_slices") -> DataFrame:
    """Blocks (grid, x, y, z, side, value) of a shape: each has ``side`` cells along each dimension."""
    spark.dataSource.register(source(inside, format_name))
    return spark.read.format(format_name).option("level", level).option("grid", grid).load()


def cube(spark: SparkSession, level: int, grid: str = "shape") -> DataFrame:
    """The box of a sampled cube, as ``sparse.adaptive`` takes it; also where nothing is inside."""
    return spark.range(1).select(F.lit(grid).alias("grid"), *[F.lit(0).cast("long").alias(f"low_{c}") for c in "xyz"], *[F.lit(level).alias(f"level_{c}") for c in "xyz"])
