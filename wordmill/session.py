"""Session settings and loading of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXT_TABLES = {"documents", "conversations", "benchmark", "pages"}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and skew handling on; anything else is left to the cluster."""
    builder = SparkSession.builder.appName("wordmill")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table; text tables that arrive in fewer splits than there are cores are spread out."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Repartition a small scan over all cores; a scan with enough splits is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
