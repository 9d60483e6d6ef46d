"""Spark sessions for the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results or plans rely on; sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(name: str = "vellum", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; ``settings`` add to them or replace them."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
