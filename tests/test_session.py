import os

import pytest
from pyspark.sql import functions as F

from siltstone import session


def test_small_is_bounded_by_rows_and_bytes(spark):
    hinted = lambda df, **k: "broadcast" in session.small(df, **k)._jdf.queryExecution().logical().toString().lower()
    assert hinted(spark.range(10)) and not hinted(spark.range(11), most=10)
    assert not hinted(spark.range(100).select(F.repeat(F.lit("x"), 200_000).alias("x"))) and hinted(spark.range(0))


def test_scratch_tables_are_deleted(spark):
    df = session.written(spark.range(5))
    path = df._siltstone_path.removeprefix("file:")
    assert os.path.exists(path) and df.count() == 5
    session.discard(df)
    assert not os.path.exists(path)
    b = session.bucketed(spark.range(100).withColumn("v", F.lit(1)), "id")
    other = spark.range(50).repartition(3).withColumn("w", F.lit(2)).hint("merge")
    plan = b.join(other, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == 1 and b.join(other, "id").count() == 50


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Nothing:
        def isDefined(self):  # noqa: N802
            return False

    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "spark://m:7077"
        getConf = staticmethod(lambda: Conf)
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: Nothing())}))})

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(type("Spark", (), {"sparkContext": Context, "conf": Conf}))


def test_spread_leaves_large_sources_alone(spark, monkeypatch):
    df = spark.range(10).coalesce(1)
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "SPREAD_BYTES", 1)
    assert session.spread(df).rdd.getNumPartitions() == 1
