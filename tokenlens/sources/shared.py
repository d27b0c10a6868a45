"""The folder that all machines share, for checkpoints and tables in between."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share. Where it is unset: an error, but for local mode (one machine)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not sc.master.startswith(("local[", "local*")) and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not path:
            path = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, path, True)
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like checkpointed(), as compressed Parquet files in the same folder: for what is large, read by columns, or joined by its size."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Delete the files of stored() tables that nothing reads any more, here or where an executor is lost; others are left alone."""
    for df in tables:
        spark = df.sparkSession
        for name in df.inputFiles():
            folder = name.rpartition("/")[0]
            if folder.rpartition("/")[2].startswith("stored-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
                break
