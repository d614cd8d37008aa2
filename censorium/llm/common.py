"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (any file system Spark knows).

    Arrow batches are bounded in bytes too, so that many long texts don't meet in one.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a single-machine session without that setting gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Folders behind the frames that ``saved`` gave.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def saved(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read again."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[found] = path
    return found


def discard(*frames: DataFrame | None) -> None:
    """Delete the folders of frames that ``saved`` gave; only when no plan that is still to run reads them."""
    for df in frames:
        path = _FOLDERS.pop(df, None) if df is not None else None
        if path:
            session = df.sparkSession
            folder = session._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def rows_are_few(df: DataFrame, most: int) -> bool:
    """Whether df has at most ``most`` rows: the size check before a broadcast."""
    return df.limit(most + 1).count() <= most
