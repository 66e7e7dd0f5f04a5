"""Session settings, and where intermediate tables may be written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set the run-time options that the results or the plans depend on.

    All of them are SQL options that can be changed on a running session; sizes of executors,
    and the number of shuffle partitions, stay the cluster's business.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local session; on a cluster it would not be shared, so that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if named and named not in (current or ""):
        context.setCheckpointDir(named)
    elif not current:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="flowmetrics-checkpoint-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from there.

    For tables that several later steps read: they are computed once, the files survive lost executors,
    readers take only the columns they need, and the planner knows the size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/flowmetrics-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_and_measure(df: DataFrame, measure: Column) -> tuple[DataFrame, object]:
    """:func:`settle`, and the value of an aggregate over the rows as they were written, without a job of its own."""
    seen = Observation()
    settled = settle(df.observe(seen, measure.alias("value")))
    return settled, seen.get["value"]
