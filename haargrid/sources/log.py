"""Tables to which several writers append at once: each row's key is there once, whoever comes first.

Rows are written to a folder of their own, which counts only when a numbered file of the log names it. A number
is made by the one writer that finds it absent; the others see its keys, leave those out and try the next one. A run
that stops before its number leaves a folder that nobody reads, and a repeated run finds its keys there.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "_log"
#: How rows are stored: tables, or text with a header in which nan is missing.
FORMS: dict[str, dict] = {"parquet": {}, "csv": {"header": True, "nullValue": "nan"}}


def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def commits(spark: SparkSession, path: str) -> list[str]:
    """Folders that count, in the order of their numbers: one small file for each append."""
    fs, at = _folder(spark, f"{path}/{LOG}")
    if not fs.exists(at):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().endswith(".json"))
    if not names:
        return []
    found = {r.number: r.folder for r in spark.read.schema("number long, folder string").json([f"{path}/{LOG}/{n}" for n in names]).collect()}
    return [found[n] for n in sorted(found)]


def _claim(spark: SparkSession, path: str, number: int, folder: str) -> bool:
    """Makes the log's file of a number, unless there is one."""
    fs, at = _folder(spark, f"{path}/{LOG}/{number:012}.json")
    line = json.dumps({"number": number, "folder": folder})
    if fs.getScheme() == "file":  # Hadoop's local files are looked for before they are made, not at once
        name = at.toUri().getPath()
        os.makedirs(os.path.dirname(name), exist_ok=True)
        draft = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            f.write(line + "\n")
        try:
            os.link(draft, name)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    if fs.exists(at):
        return False
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "Exist" in str(e):
            return False
        raise
    out.writeBytes(line + "\n")
    out.close()
    return True


def _reader(spark: SparkSession, schema: str, form: str):
    return spark.read.schema(schema).format(form).options(**FORMS[form])


def read(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """The rows of all folders that count."""
    folders = [f"{path}/{f}" for f in commits(spark, path)]
    return _reader(spark, schema, form).load(folders) if folders else spark.createDataFrame([], schema)


def append(rows: DataFrame, path: str, keys: list[str], schema: str, form: str = "parquet") -> int:
    """Adds the rows whose keys aren't there, of equal keys one; the number of the commit, or -1 if nothing was new.

    Rows are in the columns and order of ``schema``. Null keys are never equal to others, so such rows are always added.
    """
    spark = rows.sparkSession
    rows = rows.dropDuplicates(keys)
    while True:
        # the log is read before the rows: what another adds meanwhile takes this number
        number = len(commits(spark, path))
        there = read(spark, path, schema, form).select(*keys)
        folder = f"part-{uuid.uuid4().hex}"
        rows.join(there, keys, "left_anti").select(rows.columns).write.format(form).options(**FORMS[form]).save(f"{path}/{folder}")
        if _reader(spark, schema, form).load(f"{path}/{folder}").isEmpty():
            return -1
        if _claim(spark, path, number, folder):
            return number


def one_by_key(df: DataFrame, keys: list[str]) -> bool:
    """Whether no key is there twice."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
