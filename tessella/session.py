"""A local session with the settings that tests and the bench use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": str(cpus), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("TESSELLA_DRIVER_MEMORY", "8g"), "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tessella")
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
