"""Cutting lineage so that lost executors cost little and plans stay small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What the names of this process's tables begin with.
_NAME = f"cut-{uuid.uuid4().hex[:8]}-"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where none is set and the master is local (tests) a folder of its own is made; on a
    cluster without the setting this raises, because a folder of one machine would not
    survive a lost executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="raqim-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as written to and read from the shared folder.

    A parquet table takes far less disk than a checkpoint of rows, and later scans of it
    read only the columns they need. It stays until ``drop_cuts`` is called.
    """
    path = f"{shared_folder(df.sparkSession)}/{_NAME}{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> int:
    """Remove the tables that ``cut`` wrote in this process, when nothing made of them is to be read again; how many there were."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(shared_folder(spark)).getFileSystem(spark._jsc.hadoopConfiguration())
    written = [s.getPath() for s in fs.listStatus(path(shared_folder(spark))) if s.getPath().getName().startswith(_NAME)]
    for p in written:
        fs.delete(p, True)
    return len(written)
