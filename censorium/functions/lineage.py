"""Cutting the lineage of iterations: a table in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that ``cut`` wrote in this process.
_WRITTEN: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete everything that ``cut`` wrote; results that weren't stored elsewhere can't be read afterwards."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    while _WRITTEN:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        folder.getFileSystem(conf).delete(folder, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write to ``spark.checkpoint.dir`` as Parquet and read again; only a local session without that setting uses a temporary folder."""
    session = df.sparkSession
    folder = session.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not session.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        session.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return session.read.schema(df.schema).parquet(path)
