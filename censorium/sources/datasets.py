"""Loaders of the classic teaching data sets from a folder of CSV files, and writers of results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the data sets (fixed values); a folder holds ``<name>.csv`` with a header.
NAMES = (
    "aml bladder cgd cgd0 colon diabetic flchain gbsg heart hoel kidney logan lung mgus mgus2 myeloid myeloma nafld nwtco ovarian pbc pbcseq rats rats2 retinopathy rhdnase rotterdam solder stanford2 tobin transplant udca veteran"
).split()
#: File names that differ from the name (fixed values).
FILES = {"rhdnase": "rhDNase"}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One data set: types are inferred, NA, NaN and empty numbers are null, a column of row names is left out, dots in names become underscores."""
    if name not in NAMES:
        raise ValueError(f"{name} is not one of {', '.join(NAMES)}")
    df = spark.read.option("header", True).option("inferSchema", True).option("nullValue", "NA").option("nanValue", "NaN").csv(f"{folder.rstrip('/')}/{FILES.get(name, name)}.csv")
    kept = [c for c in df.columns if c not in ("rownames", "", "_c0")]
    numeric = {c for c, t in df.dtypes if t in ("double", "float")}
    clean = [F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) if c in numeric else F.col(f"`{c}`") for c in kept]
    return df.select(*(c.alias(re.sub(r"\W+", "_", n).strip("_")) for c, n in zip(clean, kept, strict=True)))


def load_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every data set whose file is in the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    there = {s.getPath().getName() for s in system.listStatus(path)}
    return {n: load(spark, folder, n) for n in NAMES if f"{FILES.get(n, n)}.csv" in there}


def write_curves(curves: DataFrame, path: str, *, keys: list[str] | None = None) -> None:
    """Curves as Parquet, sorted by group and time inside files, one folder a value of the first key."""
    order = [*(keys or []), "time"]
    out = curves.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
    (out.partitionBy(keys[0]) if keys else out).parquet(path)
