"""Layers of a run: named tables in one folder, which later steps require."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_layer(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")


def available(spark: SparkSession, root: str) -> list[str]:
    """Names of the layers that are whole: an interrupted write leaves none."""
    at, files = _folder(spark, root)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
    return sorted(n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{n}/_SUCCESS")))


def require(spark: SparkSession, root: str, *names: str) -> list[DataFrame]:
    """The layers, or an error that names those that are missing."""
    there = available(spark, root)
    if missing := [n for n in names if n not in there]:
        raise FileNotFoundError(f"missing layers: {', '.join(missing)}")
    return [spark.read.parquet(f"{root.rstrip('/')}/{n}") for n in names]


def llms_present(status: Column, text: Column) -> Column:
    """Whether a site serves a file of hints for models: a good status and a heading near its beginning."""
    return F.coalesce(status.between(200, 299) & F.contains(F.substring(text, 1, 2000), F.lit("#")), F.lit(False))
