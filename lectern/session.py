"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(name: str = "lectern", **conf: str) -> SparkSession:
    """A session with adaptive plans and UTC; on a cluster the master and sizes come from spark-submit."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    return SparkSession.builder.appName(name).config(map=base).getOrCreate()


def setting(name: str, default: str = "") -> str:
    """A value from the environment; blank counts as unset."""
    return os.environ.get(name, "").strip() or default
