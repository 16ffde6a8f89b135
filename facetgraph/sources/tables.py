"""Tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, removed when the driver ends. Where that is unset, a temporary
    folder of this machine, if it is the only one."""
    context = spark.sparkContext
    if context.applicationId not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            base = "file://" + tempfile.mkdtemp(prefix="facetgraph-")
            context.setCheckpointDir(base)
        root = f"{base.rstrip('/')}/facetgraph-{context.applicationId}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ROOTS[context.applicationId] = root
    return _ROOTS[context.applicationId]


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder that every machine can read and write."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once and read again: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
