"""Measurements that arrive as files: new keys are appended once, however often files come again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from haargrid.operators.report import new_rows


def append_new(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Reads what is there of ``source`` (Parquet) and ends; a key that ``target`` has is left out, and so are repeats.

    A batch that is run again after a failure finds its keys in the target and appends nothing.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.dropDuplicates(keys)
        try:
            existing = spark.read.schema(schema).parquet(target)
            rows = new_rows(rows, existing, keys)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
