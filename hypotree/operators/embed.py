"""Feature-hash embedding of texts, and any embedder plugged in over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embed_cells(rows: DataFrame, text: Column, dim: int = 64) -> DataFrame:
    """(id, bucket, value): signed counts of hashed tokens, scaled to length 1; only cells that aren't 0."""
    tokens = rows.select("id", F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    counted = tokens.groupBy("id", "token").agg(F.count("*").alias("n")).withColumn("h", F.md5("token"))
    bucket = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    sign = F.when(F.substring("h", 9, 1) < "8", 1).otherwise(-1)
    cells = counted.groupBy("id", bucket.alias("bucket")).agg(F.sum(sign * F.col("n")).alias("total")).where("total <> 0")
    length = cells.groupBy("id").agg(F.sqrt(F.sum(F.col("total") * F.col("total"))).alias("length"))
    return cells.join(length, "id").select("id", "bucket", (F.col("total") / F.col("length")).alias("value"))


def embed(rows: DataFrame, text: Column, dim: int = 64) -> DataFrame:
    """(id, embedding): embed_cells() as arrays; texts without tokens have no row."""
    cells = embed_cells(rows, text, dim).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))  # at most dim cells
    return cells.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def embed_with(rows: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """(id, embedding) by a function from batches with id and embedding (or other columns that it needs) to batches."""
    return rows.mapInPandas(fn, "id long, embedding array<double>")


def unit_length(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The embedder of the tests: given vectors scaled to length 1."""
    import numpy as np

    for batch in batches:
        x = np.array(batch["embedding"].tolist(), float).reshape(len(batch), -1)
        yield pd.DataFrame({"id": batch["id"], "embedding": list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))})
