"""Shared helpers: intermediate tables in the cluster's shared folder, global row order, memory-bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: monotonically_increasing_id() puts the partition above this many bits and the row's place below.
ROW_BITS = 33
#: Bytes of text that a task of small models or sets works on at a time; workers keep what memory they once took.
SLICE = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only in local mode, where one machine does all."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="hypotree-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back: cuts lineage, computes df once, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def drop_tables(*tables: DataFrame | None) -> None:
    """Deletes tables of write_table() that nothing reads any more."""
    for one in tables:
        if one is not None and (path := one.__dict__.get("_written")):
            drop_path(one.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table, through Hadoop's file systems, so that any kind of shared folder works."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows that are kept out of learning: crc32 of the id as text leaves 1 when divided by 3 (null ids: False)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def ordered_rows(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """df, range-partitioned and sorted by `order`, as a table with the extra columns _part and _place (from 0 within _part).

    _part ascends with the order, so (_part, _place) is the global order without a single-task sort. Give `order` columns
    that break ties, else equal keys meet in one part.
    """
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    rows = rows.select(*df.columns, F.shiftright("_at", ROW_BITS).alias("_part"), F.col("_at").bitwiseAND((1 << ROW_BITS) - 1).alias("_place"))
    return write_table(rows, label)


def with_running_total(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows before each, for the output of ordered_rows().

    Only one row for each part (as many as the shuffle has partitions) meets in the window over part totals.
    """
    totals = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = totals.select("_part", (F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "_part", "left").withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("long")).drop("_before")


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema), sent in batches of about SLICE bytes: 10,000 rows of text at a time, as by default, take up to 64 MB on both sides.

    The setting is the session's, is read when the job is planned, and changes no result.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE))
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most about max_bytes of `column` (one longer value makes a slice of its own)."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        begin, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)


def field(schema: T.StructType, name: str) -> str:
    """name, with underscores added until it clashes with no column of schema."""
    while name in schema.fieldNames():
        name += "_"
    return name
