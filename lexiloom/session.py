"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "lexiloom", **conf: str) -> SparkSession:
    """The active session, or a local one; on a cluster the submitter's settings win."""
    b = SparkSession.builder.appName(name)
    if "spark.master" not in conf and not os.environ.get("MASTER"):
        b = b.master(f"local[{os.environ.get('BENCH_CPUS', '*')}]")
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    return b.config(map=defaults | conf).getOrCreate()
