"""Sessions: what the library expects of one, and a local one for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Time is reckoned in UTC throughout; AQE coalesces partitions and splits skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(name: str = "terraquarry", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine; on a cluster, make one with SETTINGS and the cluster's own sizes."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory}).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
