"""Helpers that the operators of this subpackage share: tables in and out of shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the operators call a word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes that go to a Python worker at once while a table is written, unless the session has its own settings: a
#: batch of whole texts or sets at Spark's 64 MB stands several times in the memory of the executor and of the worker, which keep it.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

_fallback: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new local one where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="thermion-")
    return _fallback[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/thermion/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application's operators have written; results that still read it are gone with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/thermion/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """BATCH holds meanwhile, where the session has nothing else."""
    own = spark.conf.getAll
    put = {k: v for k, v in BATCH.items() if k not in own}
    for k, v in put.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in put:
            spark.conf.unset(k)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to shared storage and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]
