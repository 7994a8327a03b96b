"""Session helpers: table access and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one the session names in ``spark.checkpoint.dir``; only where that
    is unset and all executors are threads of this machine, as in tests, a folder of our own is made and registered.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        own = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared folder and read it back.

    The result depends on files only, so no later stage has to recompute what led
    to it when an executor is lost. The files go with ``drop_cut``, or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` returned and nothing reads any more."""
    spark = df.sparkSession
    base = shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        name = folder.rsplit("/", 1)[-1]
        if name.startswith("weftline-"):
            jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
