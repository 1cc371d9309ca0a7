"""Exact top-k search by inner product: tiles of queries and corpus shards, partial selection, tree merging.

Corpus rows are dealt to shards and queries to blocks by the hash of their id; every pair of a block and a shard is a
tile, one task's group of bounded size. A tile's scores are a matrix product, of which each query keeps its k best; the
lists of a query are merged a few at a time, level by level, so no group holds more than `fan_in` lists.

Components are quantised to floor(scale * x). Products run in floats while sums stay exact, else in whole numbers.

Defined results: vectors that are null or hold nulls, NaNs or infinities take no part, nor do rows without an id; vectors of
different lengths are compared as if zeros followed the shorter; rows that repeat an id are candidates and queries of their own, but
no candidates of a query with their id; ties go to the smaller id; scores beyond a long are cut to its range; no queries give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTS = "query_id long, uid long, shard long, top array<struct<less: long, vec_id: long>>"
LONG = np.iinfo(np.int64)


def finite(vector: Column) -> Column:
    """True for vectors without nulls, NaNs and infinities."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _matrix(table: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and the quantised vectors, as floats of whole numbers."""
    ids = table["id"].to_numpy()
    column = table["v"].combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(column))
    out = np.zeros((len(ids), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(scale * np.asarray(column.flatten(), np.float64))
    order = np.argsort(ids, kind="stable")
    return ids[order], out[order]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    return np.array([[min(max(int(x), LONG.min + 1), LONG.max) for x in row] for row in exact], np.int64).reshape(exact.shape)


def _best(scores: np.ndarray, first: np.ndarray, end: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the places of its k highest scores, ties to the smaller place, without the places first to end."""
    out = []
    for row, a, b in zip(scores, first.tolist(), end.tolist()):
        row[a:b] = LONG.min
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            at = np.flatnonzero(row > least)
            at = np.concatenate([at, np.flatnonzero(row == least)[:k]])
        else:
            at = np.arange(len(row))
        at = at[row[at] != LONG.min]
        out.append(at[np.lexsort([at, -row[at]])][:k])
    return out


def _tile(queries: pa.Table, rows: pa.Table, shard: int, scale: float, k: int) -> pa.Table:
    queries = queries.sort_by("id")
    query_ids, a = _matrix(queries, scale)
    ids, b = _matrix(rows, scale)
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    found, step = [], max(1, (1 << 22) // max(1, len(ids)))
    for at in range(0, len(query_ids), step):
        part = query_ids[at : at + step]
        scores = _products(a[at : at + step], b)
        own = np.searchsorted(ids, part), np.searchsorted(ids, part, "right")
        found += [[{"less": -int(row[i]), "vec_id": int(ids[i])} for i in best] for row, best in zip(scores, _best(scores, *own, k))]
    kind = pa.list_(pa.struct([("less", pa.int64()), ("vec_id", pa.int64())]))
    return pa.table({"query_id": pa.array(query_ids, pa.int64()), "uid": queries["uid"], "shard": pa.array([shard] * len(query_ids), pa.int64()), "top": pa.array(found, kind)})


def search(corpus: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0, shard_rows: tuple[int, int] = (1024, 65_536), block_rows: tuple[int, int] = (512, 8192), fan_in: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of corpus with is_query, the k best other rows.

    shard_rows and block_rows: smallest and largest number of rows of a shard and of a block; they grow with the table.
    """
    rows = corpus.where(finite(F.col(vector)) & F.col(key).isNotNull())
    counts = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards = -(-counts[0] // min(shard_rows[1], max(shard_rows[0], counts[0] // 64))) or 1
    blocks = -(-counts[1] // min(block_rows[1], max(block_rows[0], counts[1] // 16))) or 1
    named = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("is_query"), F.monotonically_increasing_id().alias("uid"))
    hashed = F.xxhash64("uid")  # rows of one id are dealt to many tiles
    right = named.select(F.col("vec_id").alias("id"), F.col("vector").alias("v"), F.pmod(hashed, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    left = named.where("is_query").select(F.col("vec_id").alias("id"), "uid", F.col("vector").alias("v"), F.pmod(F.shiftright(hashed, 20), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def tile(at: tuple, queries: pa.Table, found: pa.Table) -> pa.Table:
        if not queries.num_rows or not found.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "uid": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "top": pa.array([], pa.list_(pa.struct([("less", pa.int64()), ("vec_id", pa.int64())])))})
        return _tile(queries, found, at[0].as_py(), scale, k)

    lists = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(tile, LISTS)
    while True:  # merges fan_in lists of a query at a time
        lists = lists.groupBy("query_id", "uid", F.floor(F.col("shard") / fan_in).alias("shard")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if shards <= fan_in:
            break
        shards = -(-shards // fan_in)
    ranked = lists.select("query_id", F.posexplode("top").alias("at", "one"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.less")).alias("score"))
