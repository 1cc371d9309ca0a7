"""Sharding along a Hilbert curve, with DataFrame functions only.

Each metadata column is quantised to a cell number that keeps its order, cells holding about equally many rows, the cells of a row give its place on the Hilbert curve, rows are
ordered by that place (ties: by the given columns) and the order is cut into runs. Near rows share most metadata ranges,
so a shard's minimum and maximum of every column prune files in several dimensions at once.

Defined results: nulls fall into cell 0; equal rows keep any order among themselves; fewer rows than shards leave some
shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, ordered_rows, with_running_total


def name_bounds(rows: DataFrame, columns: list[str], bits: int) -> list[list[str]]:
    """For each column the smallest name of each cell: names in order, cut where the rows so far pass another part of all.

    Names are counted before they are ordered; at most 1 << bits names of a column come to the driver.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.col(c).alias("name")) for k, c in enumerate(columns)]))
    counted = rows.select(pairs.alias("_pair")).select("_pair.*").where("name is not null").groupBy("column", "name").agg(F.count("*").alias("rows"))
    ordered = ordered_rows(counted, ["column", "name"], "hilbert-names")
    running = with_running_total(ordered, F.col("rows"), "at")
    whole = {r["column"]: r for r in running.groupBy("column").agg(F.min("at").alias("first"), F.sum("rows").alias("rows")).collect()}
    out: list[list[str]] = []
    for k in range(len(columns)):
        if k in whole:
            cell = F.floor((F.col("at") - whole[k]["first"]) * (1 << bits) / whole[k]["rows"]).alias("cell")
            found = running.where(F.col("column") == k).groupBy(cell).agg(F.min("name").alias("name")).collect()
            out.append(sorted((r["name"] for r in found), key=lambda x: x.encode()))
        else:
            out.append([])
    drop_tables(ordered)
    return out


def number_bounds(rows: DataFrame, columns: list[str], bits: int) -> list[list[int]]:
    """For each numeric column the (approximate) quantiles that part its rows into 1 << bits cells, in one pass over all."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return [sorted(set(found[k] or [])) for k in range(len(columns))]


def cell(value: Column, bounds: list, bits: int) -> Column:
    """The number of bounds at or below the value, spread over 1 << bits cells: it keeps the values' order. Nulls get 0."""
    if not bounds:
        return F.lit(0)
    below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= value))
    return F.when(value.isNull(), 0).otherwise(F.floor(below * (1 << bits) / (len(bounds) + 1))).cast("int")


def place_on_curve(df: DataFrame, cells: list[Column], bits: int, to: str) -> DataFrame:
    """df with the place of its cells on the Hilbert curve in column `to`.

    The point's axes are turned, bit by bit from the highest, into the curve's own frame; a Gray code over the axes then
    gives the digits, read from the highest bit over all axes.
    """
    n = len(cells)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("axis")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, step: Column) -> Column:
        low = step["q"] - 1
        own = F.get(x, step["axis"])
        swap = F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(low)
        flipped = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
        swapped = F.transform(x, lambda v, j: F.when((j == 0) | (j == step["axis"]), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(own.bitwiseAND(step["q"]) != 0, flipped).otherwise(swapped)

    axes = F.aggregate(steps, F.array(*[c.cast("int") for c in cells]), turn)
    turned = df.withColumn("_axes", axes)
    gray = [reduce(lambda a, b: a.bitwiseXOR(b), [F.get("_axes", F.lit(k)) for k in range(i + 1)]) for i in range(n)]
    fix = reduce(lambda a, b: a.bitwiseXOR(b), [F.when(gray[-1].bitwiseAND(1 << b) != 0, (1 << b) - 1).otherwise(0) for b in range(1, bits)], F.lit(0))
    digits = [F.shiftright(g.bitwiseXOR(fix), b).bitwiseAND(1).cast("long") * (1 << (b * n + n - 1 - i)) for b in range(bits) for i, g in enumerate(gray)]
    return turned.withColumn(to, reduce(lambda a, b: a + b, digits)).drop("_axes")


def shards(rows: DataFrame, cells: list[Column], *, n_shards: int, ties: list[str], bits: int = 5) -> DataFrame:
    """rows with _curve, shard and slot: runs of the curve's order whose row counts differ by one at most.

    Give narrow rows (ids and metadata, no texts). The order is a range partitioning with ties broken by `ties`, so one
    common metadata value spreads over many tasks; only one number for each partition meets in one place.
    """
    placed = place_on_curve(rows, cells, bits, "_curve")
    ordered = ordered_rows(placed, ["_curve", *ties], "hilbert")
    ranked = with_running_total(ordered, F.lit(1), "_rank")
    total = ordered.count()
    shard = F.expr(f"(_rank * {n_shards}) div {max(1, total)}")
    begin = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_rank") - begin).cast("long")).drop("_rank", "_part", "_place")


def file_ranges(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Per shard the minimum and maximum of each column: what a reader prunes files by."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])


def shard_documents(docs: DataFrame, *, n_shards: int = 40, bits: int = 5) -> DataFrame:
    """Documents (doc_id, text, lang, source) in shards along the curve of source, language, size and id.

    Columns: doc_id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32, lang, source, _curve, shard, slot.
    Equal texts are rows like any other: those of one source, language and range of ids stand side by side.
    """
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "lang", "source")
    names, numbers = ["source", "lang"], ["size", "doc_id"]
    bounds = name_bounds(rows, names, bits) + number_bounds(rows, numbers, bits)
    cells = [cell(F.col(c), b, bits) for c, b in zip(names + numbers, bounds)]
    return shards(rows, cells, n_shards=n_shards, ties=["text_crc32", "doc_id"], bits=bits)
