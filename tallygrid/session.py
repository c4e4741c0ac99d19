"""Session builder for local runs, tests and the benchmark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "tallygrid", partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """A local session; ``shared`` is its folder for stored tables, if the settings name none."""
    shuffle = partitions if partitions is not None else (8 if cpus == "*" else int(cpus))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder the cluster shares between executors.

    The cluster names that folder in ``spark.checkpoint.dir``; where that is unset, the warehouse folder serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write a table that many jobs read to the shared folder and read it back.

    This also ends its lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = shared_path(df.sparkSession, label)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path).select(*df.columns)
