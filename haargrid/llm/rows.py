"""Helpers shared by the corpus operators: batch mapping, materialising, scratch tables."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of an Arrow batch between the JVM and Python, and of texts that are Python strings together.
BATCH, TOGETHER = 4 << 20, 1 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; batches for Python are bounded by bytes, whatever the length of the rows (one row may be longer)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, after which a task gives back the memory that it has freed: workers live on between stages."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trim()(0)

    return tidied


def slices(column: pa.Array, size: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes of text, at least one row each."""
    at = 0
    ends = np.cumsum(np.array(pa.compute.fill_null(pa.compute.binary_length(column), 0)))
    while at < len(column):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + size)))
        yield at, stop
        at = stop


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_text(
    docs: DataFrame,
    per_texts: Callable[[], Callable[[list[str]], list[tuple]]],
    out: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One output row for each document: the id, then what ``per_texts()`` gives for its text.

    ``per_texts`` runs once in each task and gives the function for a list of texts; a null
    text is passed on as the empty string. Only the two named columns are read, so the names of
    other columns don't matter. No shuffle. ``out`` is a DDL list of the computed columns.
    """
    ids = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, ids), *T._parse_datatype_string(out).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = per_texts()
        for b in batches:
            texts = b.column(1)
            # a piece at a time, so that Python strings of few texts are alive together
            for at, stop in slices(texts):
                rows = f([x or "" for x in texts.slice(at, stop - at).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, stop - at).cast(arrow.field(0).type)]
                    + [pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True)],
                    schema=arrow,
                )

    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), schema)


def each(f: Callable[[str], tuple]) -> Callable[[list[str]], list[tuple]]:
    return lambda texts: [f(x) for x in texts]


def scratch(spark: SparkSession) -> str | None:
    """A new folder below the shared checkpoint folder that the session names.

    Where ``spark.checkpoint.dir`` is unset (a local test session), a temporary folder of
    this machine serves; a cluster always names one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        # one machine only: the driver is the executor
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/haargrid-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and a lost executor costs nothing of it."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
