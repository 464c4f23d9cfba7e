"""What every operator needs of the session: tables, shipped code and scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent
#: Bytes up to which a source is worth a shuffle only to spread it, and up to which a side is broadcast.
SPREAD_BYTES, BROADCAST_BYTES = 1 << 30, 8 << 20


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each context; clusters need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_siltstone_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="siltstone-")) / "siltstone.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, os.path.join(PACKAGE.name, p.relative_to(PACKAGE)))
    sc.addPyFile(str(path))
    sc._siltstone_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The frame over all cores, where a source of at most SPREAD_BYTES is read in fewer parts than there
    are cores; larger sources are never shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > SPREAD_BYTES:
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The frame with a broadcast hint if it has at most so many rows and BROADCAST_BYTES; else as it is,
    for Spark to choose. Rows beyond the bound are not read for this."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    n, size = df.limit(most + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(row))).first()
    return F.broadcast(df) if n <= most and (size or 0) <= BROADCAST_BYTES else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir or the context's checkpoint
    folder. Only where neither is set and the master is local, as in tests, a local one is made."""
    sc = spark.sparkContext
    if base := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return base.rstrip("/")
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
    base = "file://" + tempfile.mkdtemp(prefix="siltstone-checkpoint-")
    sc.setCheckpointDir(base)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the shared folder, which is deleted when the driver's Python ends."""
    path = f"{shared_folder(spark)}/siltstone-{uuid.uuid4().hex}"
    _scratch(spark).add(path)
    return path


def _scratch(spark: SparkSession) -> set[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_siltstone_scratch"):
        sc._siltstone_scratch = set()
        sc._siltstone_tables = []
        atexit.register(_clean_at_exit, spark)
    return sc._siltstone_scratch


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Deletes the session's scratch tables; frames that still read them can no longer be computed."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    for name in getattr(sc, "_siltstone_tables", []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in list(getattr(sc, "_siltstone_scratch", ())):
        _delete(spark, path)
        sc._siltstone_scratch.discard(path)


def _clean_at_exit(spark: SparkSession) -> None:
    # the JVM may be gone already
    with contextlib.suppress(Exception):
        clean(spark)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The frame as a written table: its lineage is cut, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_siltstone_path", None):
            _delete(df.sparkSession, path)
            _scratch(df.sparkSession).discard(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The frame as a written table in buckets of the key: joins by the key do not move it again."""
    spark = df.sparkSession
    path, parts = scratch_dir(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"siltstone_{uuid.uuid4().hex}"
    # where the frame comes from a join by the key, this is no further shuffle
    df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(name)
    spark.sparkContext._siltstone_tables.append(name)
    return spark.table(name)
