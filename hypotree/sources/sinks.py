"""Tables written on the way: checkpoints and states in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode, where one machine does all."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="hypotree-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a written table: short lineage, safe when executors are lost."""
    path = new_folder(df.sparkSession, "checkpoint")
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def counting(df: DataFrame, counts: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """checkpointed(df), and aggregates over its rows that are worked out while it is written."""
    seen = Observation()
    found = checkpointed(df.observe(seen, *[c.alias(k) for k, c in counts.items()]))
    return found, seen.get


def _at(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system for a path, so that any kind of shared folder works, and the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _at(spark, path)
    return files.exists(target)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of checkpointed() that nothing reads any more."""
    for one in tables:
        if path := one.__dict__.get("_written"):
            files, target = _at(one.sparkSession, path)
            files.delete(target, True)


def write_events(events: DataFrame, path: str) -> None:
    """Appends events to a table partitioned by day, so that readers of new evidence skip old days."""
    from pyspark.sql import functions as F

    events.withColumn("day", F.to_date("observed_at")).write.mode("append").partitionBy("day").parquet(path)
