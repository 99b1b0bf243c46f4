"""Session settings for running the library on a cluster.

Everything in the library is plain DataFrame code; these settings let
Catalyst/AQE pick good physical plans at scale. They are suggestions for
the job's own session (the library never changes a running session)."""

from __future__ import annotations

CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",                      # runtime re-planning
    "spark.sql.adaptive.coalescePartitions.enabled": "true",   # merge small shuffle partitions
    "spark.sql.adaptive.skewJoin.enabled": "true",             # split hot join partitions
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "static",      # the bucketed upsert switches per write
}


def builder(app_name: str = "lossledger", shuffle_partitions: int | None = None, **extra):
    """A SparkSession builder with the recommended settings (master and
    resources come from spark-submit / the cluster manager)."""
    from pyspark.sql import SparkSession
    b = SparkSession.builder.appName(app_name)
    for k, v in {**CLUSTER_CONF, **extra}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b
