"""Helpers that every operator of the subpackage uses."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()
#: Rows and bytes that a Python worker gets at a time, unless the session says otherwise: texts may be long.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once for each application, so that their Python finds it wherever it is installed, and bounds what a worker holds.

    The bounds are session settings; they stay set, as results of operators are computed later, and only where the session has Spark's own defaults.
    """
    sc = spark.sparkContext
    for name, bound, default in (("maxRecordsPerBatch", BATCH_ROWS, 10_000), ("maxBytesPerBatch", BATCH_BYTES, 2**31 - 1)):
        if int(spark.conf.get(f"spark.sql.execution.arrow.{name}", str(default))) >= default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", bound)
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = Path(__file__).parents[2]
        with tempfile.TemporaryDirectory() as d:
            shutil.copytree(root / "millrace", f"{d}/all/millrace", ignore=shutil.ignore_patterns("__pycache__"))
            made = tempfile.mkdtemp()
            sc.addPyFile(shutil.make_archive(f"{made}/millrace", "zip", f"{d}/all"))
            atexit.register(shutil.rmtree, made, True)  # executors that come later fetch it from the driver


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that further columns can't clash with an operator's own; a null text is empty."""
    ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def split_join(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of rows with an aggregate over the same keys. A further key, their hash, makes Spark deal both sides anew, and adaptive execution can then split the rows of a hot key; it can't where the aggregate's own exchange is used."""
    again = F.xxhash64(*keys)
    return rows.withColumn("_again", again).join(groups.withColumn("_again", again), [*keys, "_again"], how).drop("_again")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; only a local session without the setting gets one of its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str, compression: str = "snappy", tidy: bool = True) -> DataFrame:
    """df written once to the shared folder and read from there: cuts lineage, and no executor's loss makes it run again. tidy: frees shuffle files at once, which steps of little data needn't do."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    del df
    if tidy:
        gc.collect()  # Spark deletes shuffle files once nothing refers to the plan that made them
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


#: Bytes of Parquet files up to which a stored table is sent to every executor.
SMALL_BYTES = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """What stored() gave (or some columns and rows of it), to be broadcast if its files are small; as it is otherwise."""
    spark, size = df.sparkSession, 0
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        size += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return F.broadcast(df) if size <= SMALL_BYTES else df


def release(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
