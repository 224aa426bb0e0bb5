"""A session with the settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # by default the JVM leaves methods above 8,000 bytes uncompiled; stages that would need one
    # go through the ordinary operators instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", memory: str = "16g", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodestone")
    options = {
        **SETTINGS,
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **extra,
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
