"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module_name: str) -> None:
    """Send this module's functions to the executors by value, so that they need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def once(key: str, make):
    """What ``make()`` gave when this process first asked for ``key``: worker processes serve many tasks."""
    kept = sys.modules.setdefault("_focalgrid_once", types.ModuleType("_focalgrid_once")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def frugal(f):
    """A function of Arrow batches that gives its task's freed memory back to the system at the end: workers are used again."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data set in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``; where that is unset on a local master, as in tests, a new temporary
    folder becomes the setting.  On any other master that is an error: a folder of the driver's own machine won't do.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later plans start there, whatever executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of the largest table that goes to every executor.
MAX_BROADCAST = 1_000_000


def small(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """``df`` marked to be broadcast if it was counted and has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have in any case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"{name}_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing reads any more."""
    for folder in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        remove(df.sparkSession, folder)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """The bytes of all texts: the figure by which shards are sized."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col)).cast("long")), F.lit(0)).alias("n")).first()[0])


ship(__name__)
