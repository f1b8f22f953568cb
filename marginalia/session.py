"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def share_code(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the driver's own path, wherever they run.

    Where it is installed on the executors already, this changes nothing.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session in one process, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("marginalia")
    conf = {
        "spark.sql.shuffle.partitions": shuffle_partitions, "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true",
    }
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return share_code(spark)
