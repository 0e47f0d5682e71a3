"""Session settings the library relies on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app_name: str = "outpulse", master: str | None = None, **settings: str) -> SparkSession:
    """A session with AQE on and a fixed UTC session zone.

    Partition counts stay with AQE: ``spark.sql.shuffle.partitions`` is only the starting point that it coalesces
    from, so on a cluster set it high (several times the core count) and let small stages shrink.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, fallback: Callable[[], str] | None = None) -> str:
    """The shared folder for stored tables: the cluster's checkpoint folder, else the caller's fallback.

    A machine-local folder is only for sessions whose executors run in this process.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured
    if fallback is None or not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_SETTING} is not set; name a folder there that every executor can reach")
    return fallback()


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once, for plans that use it several times.

    With a checkpoint folder, as on a cluster, the rows are written there and the lineage ends. Without one they are
    cached and keep their lineage, so a lost executor only costs a recomputation.
    """
    if df.sparkSession.conf.get(CHECKPOINT_SETTING, None):
        return df.checkpoint()
    return df.persist()
