"""Vector similarity: distances of given pairs, exact theta joins and top-k by tiles, and an approximate join.

Exact joins compare blocks: rows of either side are dealt to blocks of bounded size, and each pair of blocks is a tile, one
task's group. There are few tiles, so that a vector travels equally often whatever the size of the tables; a tile compares
piece by piece, each one matrix product, and hands on what counts before the next piece. Neither side is broadcast.

Vectors that are null, empty or hold nulls, NaN or infinite values take no part; vectors of different lengths are in no pair.
A vector of zeros has a cosine of 0 with every other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hypotree import defaults as D
from hypotree.functions.expressions import cosine, dot
from hypotree.sources.sinks import checkpointed

PAIRS = "a long, b long, cos double"


def with_distances(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with cos, ip and l2 of the vector columns a and b."""
    x, y = F.col(a), F.col(b)
    square = F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return pairs.withColumns({"cos": cosine(x, y), "ip": dot(x, y), "l2": F.sqrt(square)})


def _units(table: pa.Table) -> np.ndarray:
    flat = table["v"].combine_chunks().flatten()
    x = np.asarray(flat, np.float64).reshape(table.num_rows, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Lists(NamedTuple):
    """An index of unit vectors: their centroids' lists, and how many lists each vector looks into."""

    centroids: np.ndarray
    probes: int

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row, the nearest first, ties to the lower number."""
        return np.argsort(-np.round(x @ self.centroids.T, 9), axis=1, kind="stable")[:, :n]


def _centroids(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from evenly chosen rows; a centroid that loses all its rows stays where it was."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), c)
    return c


def fit_lists(nodes: DataFrame, tau: float, *, recall: float = 0.97, list_size: int = 128, max_lists: int = 2048, sample: int = 20_000, asked: int = 512) -> Lists:
    """Lists for pairs with cos >= tau, fit on a sample of at most `sample` vectors, the first by a hash of their ids.

    As many lists as hold about list_size vectors each, at most max_lists; for vectors of the most frequent length. Probes: the least number with which, of the true pairs between
    `asked` of the sample and the sample, a share of `recall` is found. Vectors without clusters need nearly all lists; then nothing is saved.
    """
    rows = _vectors(nodes)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return Lists(np.zeros((1, 1)), 1)
    n, rows = lengths[0].n, rows.where(F.size("v") == lengths[0].d)
    taken = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = _units(taken)
    lists = int(np.clip(n // list_size, 1, min(max_lists, len(x))))
    index = Lists(_centroids(x, lists), lists)
    if not asked:
        return index
    own = index.nearest(x, 1)[:, 0]
    some = np.linspace(0, len(x) - 1, min(asked, len(x))).astype(int)
    true = np.argwhere(x[some] @ x.T >= tau)
    true = true[some[true[:, 0]] != true[:, 1]]
    if not len(true):
        return index._replace(probes=1)
    a, b = some[true[:, 0]], true[:, 1]
    near = x @ index.centroids.T
    place = lambda i, j: (near[i] > near[i, own[j]][:, None]).sum(1)
    needed = np.concatenate([np.minimum(place(a[k : k + 65_536], b[k : k + 65_536]), place(b[k : k + 65_536], a[k : k + 65_536])) for k in range(0, len(a), 65_536)])
    return index._replace(probes=int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1)


def _vectors(df: DataFrame, group: str | None = None, *more: str) -> DataFrame:
    """(id, g, v, *more) of the vectors that take part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usual = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~odd
    return df.where(usual).select("id", (F.col(group) if group else F.lit(0)).cast("long").alias("g"), F.col("embedding").cast("array<double>").alias("v"), *more)


def blocks(n: int, m: int, tiles: int = 64, most: int = 1 << 16) -> tuple[int, int]:
    """Into how many blocks n and m rows go: at most `tiles` tiles, fewer for few pairs, and more only where a block would hold over `most` rows."""
    wanted = min(tiles, max(1, n * m >> 22))
    p = min(wanted, max(1, round((wanted * n / max(1, m)) ** 0.5)))
    q = -(-wanted // p)
    return max(p, -(-n // most)), max(q, -(-m // most))


def _none(kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array([], v) for k, v in kinds.items()})


def _compared(a: pa.Table, b: pa.Table, keep: Callable[..., np.ndarray], carry: Sequence[str]) -> pa.Table:
    """The pairs of two blocks that keep() marks."""
    if not a.num_rows or not b.num_rows:
        return _none({"a": pa.int64(), "b": pa.int64(), "cos": pa.float64()} | {c: b.schema.field(c).type for c in carry})
    cos = np.round(_units(a) @ _units(b).T, 9)
    x, y = np.nonzero(keep(cos, *(t["g"].to_numpy() for t in (a, b)), *(t["id"].to_numpy() for t in (a, b))))
    other = pa.array(y)
    return pa.table({"a": a["id"].to_numpy()[x], "b": b["id"].to_numpy()[y], "cos": cos[x, y]} | {c: b[c].combine_chunks().take(other) for c in carry})


Reach = Callable[[np.ndarray, np.ndarray], np.ndarray]


def list_tiles(index: Lists, left: dict[int, float], right: dict[int, float], reach: Reach) -> np.ndarray:
    """Which lists of the left side (rows) may hold a pair that counts with which of the right: by bounds of the lowest and highest cos of a pair.

    left, right: for each list that has vectors the largest angle of one to its centroid. Two vectors are at least as far apart as the
    centroids, less both angles, and at most as far as with both added.
    """
    n = len(index.centroids)
    apart = np.arccos(np.clip(index.centroids @ index.centroids.T, -1, 1))
    wide = [np.array([side.get(k, 0.0) for k in range(n)]) for side in (left, right)]
    both = wide[0][:, None] + wide[1][None, :]
    low, high = np.cos(np.minimum(apart + both, np.pi)), np.cos(np.maximum(apart - both, 0.0))
    there = [np.isin(np.arange(n), list(side)) for side in (left, right)]
    return reach(low - 1e-8, high + 1e-8) & there[0][:, None] & there[1][None, :]


def _in_lists(rows: DataFrame, index: Lists) -> DataFrame:
    """rows with their nearest list and the angle to its centroid; -1 for vectors of another length than the index's."""
    shared = rows.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType([*rows.schema, T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value.centroids
        for batch in batches:
            own = np.asarray(pa.compute.list_value_length(batch.column("v"))) == c.shape[1]
            lists, angles = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            if own.any():
                near = _units(pa.Table.from_batches([batch]).filter(pa.array(own))) @ c.T
                lists[own] = near.argmax(1)
                angles[own] = np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists), pa.array(angles)], schema.fieldNames())

    return checkpointed(rows.mapInArrow(place, schema))


def _floors(left: DataFrame, right: DataFrame, lists: int, best: Callable[..., np.ndarray], k: int, block: int) -> np.ndarray:
    """For each list of left the least, over its rows, of the k-th best cos that a row has among some of its own list on the right: each row has k as good or better ones."""
    sizes = right.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("m"))  # a row for each list
    few = right.join(F.broadcast(sizes), "list").where(F.pmod(F.xxhash64("id"), F.col("m")) == 0)  # about a block of each list
    salted = left.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int"))
    copies = few.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(15))))
    deal = lambda df: df.select(*[F.col(c).alias(c) for c in ("list", "s", "id", "g", "v")], F.size("v").alias("d"))

    def kth(a: pa.Table, b: pa.Table) -> pa.Table:
        least = pa.array([], pa.float64())
        if a.num_rows:
            found = np.full(a.num_rows, -2.0)
            if b.num_rows:
                cos = np.round(_units(a) @ _units(b).T, 9)
                mask = best(cos, *(t["g"].to_numpy() for t in (a, b)), *(t["id"].to_numpy() for t in (a, b)))
                found = np.where(mask.sum(1) >= k, np.where(mask, cos, 2.0).min(1), -2.0)
            least = pa.array([found.min()])
        return pa.table({"list": a["list"][: len(least)] if a.num_rows else pa.array([], pa.int32()), "least": least})

    found = deal(salted).groupBy("list", "s", "d").cogroup(deal(copies).groupBy("list", "s", "d")).applyInArrow(kth, "list int, least double")
    out = np.full(lists, -2.0)
    for r in found.groupBy("list").agg(F.min("least").alias("least")).collect():  # a row for each list
        if r.list >= 0:
            out[r.list] = r.least
    return out


def _homes(sizes: dict[int, int], parts: int) -> dict[int, range]:
    """The blocks of each list: lists in their order fill about so many blocks, a list of more rows than a block's share goes to several."""
    room, seen, out = max(1, -(-sum(sizes.values()) // parts)), 0, {}
    for k, n in sorted(sizes.items()):
        out[k] = range(seen // room, seen // room + max(1, -(-n // room)))
        seen += n
    return out


def _by_lists(left: DataFrame, right: DataFrame, index: Lists, reach: Reach | None, block: int, parts: tuple[int, int], best: tuple[Callable[..., np.ndarray], int] | None = None) -> tuple[DataFrame, DataFrame, np.ndarray] | None:
    """Both sides dealt to tiles (i, j) by lists, a row only to blocks with lists near enough to its own, and which lists (left, right) are; None if that
    leaves most of all pairs. parts: about how many blocks either side has. best: in place of reach, the mask of a row's k best, and k."""
    sides = [_in_lists(x, index) for x in (left, right)]
    if best is not None:
        least = _floors(*sides, len(index.centroids), *best, block)
        reach = lambda low, high: high >= least[:, None]
    told = [x.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect() for x in sides]  # a row for each list
    size, angle = ([{r.list: r[c] for r in t} for t in told] for c in ("n", "angle"))
    allowed = list_tiles(index, *angle, reach)
    full = [np.array([s.get(k, 0) for k in range(len(allowed))], float) for s in size]
    if full[0] @ allowed @ full[1] > 0.5 * full[0].sum() * full[1].sum():
        return None
    homes = [_homes(s, n) for s, n in zip(size, parts)]
    spark, out = left.sparkSession, []
    for x, own, other, near, (mine, theirs) in zip(sides, homes, reversed(homes), (allowed, allowed.T), (("i", "j"), ("j", "i"))):
        meets = {k: [int(m) for m in np.flatnonzero(near[k])] if k >= 0 else [-1] for k in own}
        rows = [(k, blocks_.start, len(blocks_), sorted({t for m in meets[k] if m in other for t in other[m]})) for k, blocks_ in own.items()]
        plan = spark.createDataFrame(rows, "list int, first int, parts int, tiles array<int>")  # a row for each list
        place = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
        out.append(x.join(F.broadcast(plan), "list").select(*[F.col(c).alias(c) for c in x.columns if c != "angle"], place.alias(mine), F.explode("tiles").alias(theirs)))
    return out[0], out[1], allowed


def _pieces(a: pa.Table, b: pa.Table, block: int, allowed: np.ndarray | None) -> Iterator[tuple[pa.Table, pa.Table]]:
    """What of two blocks is compared at a time, at most `block` rows of either: all with all, or of lists that are near enough."""
    cut = lambda t: (t.slice(k, block) for k in range(0, t.num_rows, block))
    meet = [(a, b)]
    if allowed is not None:
        mine, theirs = (t["list"].to_numpy() for t in (a, b))
        near = lambda k: np.where(theirs >= 0, allowed[k][theirs], False) if k >= 0 else theirs < 0
        meet = ((a.filter(pa.array(mine == k)), b.filter(pa.array(near(k)))) for k in np.unique(mine))
    return ((x, y) for rows, columns in meet for x in cut(rows) for y in cut(columns))


def _by_pieces(a: pa.Table, b: pa.Table, tile: Callable[[pa.Table, pa.Table], pa.Table], block: int, allowed: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """What tile() finds in each piece, handed on before the next is compared."""
    for x, y in _pieces(a, b, block, allowed):
        yield from (found for found in tile(x, y).to_batches(max_chunksize=1 << 14) if found.num_rows)


def _tiles(left: DataFrame, right: DataFrame, tile: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int, *, reach: Reach | None = None, best: tuple[Callable[..., np.ndarray], int] | None = None, tau: float = 0.0, tiles: int = 64, most: int = 1 << 16) -> DataFrame:
    """What tile() makes of each pair of pieces of at most `block` rows of left and right, which are (id, g, v) and further columns.

    The sides are dealt to at most `tiles` tiles, more only where a block would hold over `most` rows, or 2^24 numbers; a tile's pieces are compared one by one.
    reach(lowest, highest cos): whether lists can have pairs that count; with it large sides are dealt to blocks by nearness, and lists that
    can't are left out, if that saves half of all pairs or more. best: the same for a row's k best, as by a first look into its own list.
    """
    told = [x.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first() for x in (left, right)]
    sizes, wide = [r.n for r in told], max(r.d or 1 for r in told)
    parts = blocks(*sizes, tiles, max(1, min(most, (1 << 24) // wide)))
    dealt = None
    if (reach is not None or best is not None) and max(sizes) > 2 * block:
        dealt = _by_lists(left, right, fit_lists(right.withColumn("embedding", F.col("v")), tau, list_size=max(32, block // 8), max_lists=512, asked=0), reach, block, parts, best)
    if dealt is None:
        deal = lambda df, own, other, n, m: df.select("*", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
        dealt = deal(left, "i", "j", *parts), deal(right, "j", "i", parts[1], parts[0]), None
    rows, columns, allowed = dealt
    both = rows.withColumn("own", F.lit(True)).unionByName(columns.withColumn("own", F.lit(False)), allowMissingColumns=True).withColumn("d", F.size("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches).combine_chunks()
        return _by_pieces(whole.filter(whole["own"]), whole.filter(pa.compute.invert(whole["own"])), tile, block, allowed)

    # so many partitions: a tile's work grows with its pairs, not with the bytes by which partitions would be put together
    return both.repartition(parts[0] * parts[1], "i", "j", "d").groupBy("i", "j", "d").applyInArrow(run, schema)


def _pair_tiles(left: DataFrame, right: DataFrame, keep: Callable[..., np.ndarray], block: int, *, carry: Sequence[str] = (), **kw: object) -> DataFrame:
    """(a, b, cos, *carry) of the pairs that keep(cos, left groups, right groups, left ids, right ids) marks; carry: columns of right."""
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in right.schema if f.name in carry)
    return _tiles(left, right, lambda a, b: _compared(a, b, keep, carry), PAIRS + kinds, block, **kw)


LINKS = "theory_a long, theory_b long, max_cos double, n_pairs long"


def _linked(g: np.ndarray, h: np.ndarray, cos: np.ndarray) -> dict[str, np.ndarray]:
    """Pairs of different theories, the smaller first, with the highest cos and the number of their pairs of nodes."""
    apart = g != h
    pair = np.stack([np.minimum(g, h), np.maximum(g, h)], 1)[apart]
    told, where, count = np.unique(pair, axis=0, return_inverse=True, return_counts=True)
    top = np.full(len(told), -2.0)
    np.maximum.at(top, where.ravel(), cos[apart])
    return {"theory_a": told[:, 0], "theory_b": told[:, 1], "max_cos": top, "n_pairs": count}


def _row_best(cos: np.ndarray, k: int, ids: np.ndarray) -> np.ndarray:
    """The mask of the k highest values of each row, ties to the smaller id."""
    if cos.shape[1] <= k:
        return np.ones(cos.shape, bool)
    least = np.partition(cos, cos.shape[1] - k, axis=1)[:, [cos.shape[1] - k]]
    out, tied = cos > least, cos == least
    order = np.argsort(ids, kind="stable")
    room = k - out.sum(1, keepdims=True)
    out[:, order] |= tied[:, order] & (np.cumsum(tied[:, order], axis=1) <= room)
    return out


def link_evidence(nodes: DataFrame, events: DataFrame, tau: float = D.TAU, block: int = 2048, *, since: str | None = None) -> DataFrame:
    """(node_id, event_id, cos, stance, observed_at, source) for |cos| >= tau; cos has nine digits. since: a column of nodes, a time; only links of
    later events leave a tile, all of a node without that time."""
    either = lambda low, high: (high >= tau) | (low <= -tau)
    keep = lambda c, *_: np.abs(c) >= tau
    if since is not None:
        keep = lambda c, g, h, *_: (np.abs(c) >= tau) & (h[None, :] > g[:, None])
        micros = lambda c, otherwise: F.coalesce(F.unix_micros(c), F.lit(otherwise)).alias("_at")
        nodes, events = nodes.select("id", "embedding", micros(since, -(1 << 63))), events.select("*", micros("observed_at", -(1 << 62)))
    at = "_at" if since is not None else None
    pairs = _pair_tiles(_vectors(nodes, at), _vectors(events, at, "observed_at", "source"), keep, block, reach=either, carry=("observed_at", "source"), tau=tau)
    return pairs.select(F.col("a").alias("node_id"), F.col("b").alias("event_id"), "cos", F.when(F.col("cos") > 0, 1).otherwise(-1).alias("stance"), "observed_at", "source")


def nearest(queries: DataFrame, corpus: DataFrame, k: int = D.K, *, other_group: str | None = None, block: int = 2048) -> DataFrame:
    """(a, rank, b, cos): for each query the k corpus rows of highest cos, ties to the smaller id; other_group: only rows of another group."""

    def keep(cos: np.ndarray, g: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if other_group is None:
            return _row_best(cos, k, b)
        open_ = g[:, None] != h[None, :]
        return open_ & _row_best(np.where(open_, cos, -2.0), k, b)

    pairs = _pair_tiles(_vectors(queries, other_group), _vectors(corpus, other_group), keep, block, best=(keep, k))
    best = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("a", "rank", "b", "cos")


def similar_nodes(nodes: DataFrame, tau: float, *, block: int = 2048) -> DataFrame:
    """(a, b, cos): pairs of nodes of two theories, a's before b's, with cos >= tau."""
    v = _vectors(nodes, "theory_id")
    return _pair_tiles(v, v, lambda c, g, h, *_: (c >= tau) & (g[:, None] < h[None, :]), block, reach=lambda low, high: high >= tau, tau=tau)


def closest_earlier(nodes: DataFrame, *, block: int = 2048) -> DataFrame:
    """(a, cos): the highest cos, above 0, of each node to the nodes of its theory with smaller ids.

    Only nodes of one theory meet: a large theory is dealt to tiles of its own, small ones share buckets of about `block` nodes.
    A tile gives one value a row.
    """

    def keep(cos: np.ndarray, g: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        open_ = np.where((g[:, None] == h[None, :]) & (b[None, :] < a[:, None]) & (cos > 0), cos, -2.0)
        out = np.zeros(cos.shape, bool)
        best = open_.argmax(1)
        out[np.arange(len(a)), best] = open_[np.arange(len(a)), best] > 0
        return out

    v = _vectors(nodes.where("theory_id is not null"), "theory_id")
    sizes = v.groupBy("g").agg(F.count("*").alias("n"))
    buckets = max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // block)
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    own = v.join(sizes.withColumnRenamed("g", "_g"), F.col("g") == F.col("_g")).withColumn("parts", parts).withColumn("large", F.col("parts") > 1)
    own = own.withColumn("of", F.when(F.col("large"), F.col("g")).otherwise(F.pmod(F.xxhash64("g"), F.lit(buckets)))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    deal = lambda mine, other: own.select(*[F.col(c).alias(c) for c in ("id", "g", "v", "large", "of")], F.size("v").alias("d"), F.col("own").alias(mine), every.alias(other))
    key = ("large", "of", "i", "j", "d")
    found = deal("i", "j").groupBy(*key).cogroup(deal("j", "i").groupBy(*key)).applyInArrow(lambda a, b: _compared(a, b, keep, ()), PAIRS)
    return found.groupBy("a").agg(F.max("cos").alias("cos"))


def best_in_groups(rows: DataFrame, nodes: DataFrame, group: str, tau: float, *, block: int = 2048) -> DataFrame:
    """(a, b, cos): for each row a and each group of nodes the node b of the highest cos, at least tau, ties to the smaller id.

    A tile gives one node for each of its rows and groups; what the tiles give of a row and group is compared by Spark.
    """

    def keep(cos: np.ndarray, g: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        order = np.lexsort((b, h))
        first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        out, every = np.zeros(cos.shape, bool), np.arange(len(a))
        for one in np.split(order, first[1:]):
            best = one[cos[:, one].argmax(1)]
            out[every, best] = cos[every, best] >= tau
        return out

    found = _pair_tiles(_vectors(rows), _vectors(nodes, group), keep, block)
    named = found.join(nodes.select(F.col("id").alias("b"), F.col(group).alias("_group")), "b")
    return named.groupBy("a", "_group").agg(F.max(F.struct("cos", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b"), "m.cos")


def link_theories(nodes: DataFrame, tau: float = D.TAU_LINK, *, block: int = 2048) -> DataFrame:
    """(theory_a, theory_b, max_cos, n_pairs) over node pairs of two theories with cos >= tau. A tile gives a row for each pair of theories."""
    v = _vectors(nodes.where("theory_id is not null"), "theory_id")

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _none({"theory_a": pa.int64(), "theory_b": pa.int64(), "max_cos": pa.float64(), "n_pairs": pa.int64()})
        cos = np.round(_units(a) @ _units(b).T, 9)
        g, h = (t["g"].to_numpy() for t in (a, b))
        x, y = np.nonzero((cos >= tau) & (g[:, None] < h[None, :]))
        return pa.table(_linked(g[x], h[y], cos[x, y]))

    return _together(_tiles(v, v, tile, LINKS, block, reach=lambda low, high: high >= tau, tau=tau))


def _together(links: DataFrame) -> DataFrame:
    return links.groupBy("theory_a", "theory_b").agg(F.max("max_cos").alias("max_cos"), F.sum("n_pairs").alias("n_pairs"))


def _list_links(vectors: DataFrame, index: Lists, tau: float, block: int) -> DataFrame:
    """(theory_a, theory_b, max_cos, n_pairs, compared) over vectors (id, g, v) of the index's length: a tile's links by pairs of theories, and, in one row of each tile, its comparisons.

    A vector is a member of its nearest list and asks in the lists that it probes; a list's members and askers are dealt to blocks of bounded
    size, so that a list which holds a third of all vectors is many tiles. A pair that meets in two lists counts in the lower one.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = shared.value.nearest(_units(pa.Table.from_batches([batch])), shared.value.probes).astype(np.int32)
                width = np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(width), pa.array(near.ravel()))], ["id", "g", "v", "lists"])

    rows = vectors.mapInArrow(place, "id long, g long, v array<double>, lists array<int>")
    rows = checkpointed(rows)
    asked = rows.select(F.posexplode("lists").alias("k", "list")).groupBy("list").agg(F.count_if(F.col("k") == 0).alias("members"), F.count("*").alias("askers"))
    parts = lambda column: F.greatest(F.lit(1), F.ceil(F.col(column) / block)).cast("int")
    sizes = F.broadcast(asked.select("list", parts("members").alias("n"), parts("askers").alias("m")))  # a row for each list
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    new = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  # columns of their own, as both sides come from the same rows
    members = rows.withColumn("list", F.col("lists")[0]).join(sizes, "list").select(*new("list"), dealt("n").alias("i"), each("m").alias("j"), *new("id", "g", "v", "lists"))
    askers = rows.withColumn("list", F.explode("lists")).join(sizes, "list").select(*new("list"), dealt("m").alias("j"), each("n").alias("i"), *new("id", "g", "v"), F.col("lists")[0].alias("own"))

    def tile(b: pa.Table, a: pa.Table) -> pa.Table:
        found: dict[str, np.ndarray] = {"theory_a": np.zeros(0, np.int64), "theory_b": np.zeros(0, np.int64), "max_cos": np.zeros(0), "n_pairs": np.zeros(0, np.int64)}
        if a.num_rows and b.num_rows:
            cos = np.round(_units(a) @ _units(b).T, 9)
            x, y = np.nonzero(cos >= tau)
            at, own = b["list"][0].as_py(), a["own"].to_numpy()[x]
            ids, others = a["id"].to_numpy()[x], b["id"].to_numpy()[y]
            probes = np.asarray(b["lists"].combine_chunks().flatten()).reshape(b.num_rows, -1)[y]
            again = (probes == own[:, None]).any(1)  # the pair meets in the list `own` too
            good = np.where(again, (own > at) | ((own == at) & (ids < others)), True)
            found = _linked(a["g"].to_numpy()[x][good], b["g"].to_numpy()[y][good], cos[x, y][good])
        columns = [pa.concat_arrays([pa.array(v), pa.nulls(1, pa.array(v).type)]) for v in found.values()]
        compared = np.zeros(len(columns[0]), np.int64)
        compared[-1] = a.num_rows * b.num_rows
        return pa.table([*columns, pa.array(compared)], [*found, "compared"])

    return members.groupBy("list", "i", "j").cogroup(askers.groupBy("list", "i", "j")).applyInArrow(tile, LINKS + ", compared long")


def link_lsh(nodes: DataFrame, tau: float = D.TAU_LINK, *, index: Lists | None = None, block: int = 2048) -> DataFrame:
    """link_theories() by an index of lists, in which each vector is compared with those in the lists near it only. Null theories are in no pair.

    Every row is indexed; which pairs are missed depends on the lists alone, and fit_lists() chooses how many are looked into by the recall on its sample.
    """
    index = index or fit_lists(nodes, tau)
    rows, here = _vectors(nodes.where("theory_id is not null"), "theory_id"), F.size("v") == index.centroids.shape[1]
    found = _list_links(rows.where(here), index, tau, block).where("theory_a is not null").drop("compared")
    rest = rows.where(~here)
    if not rest.isEmpty():  # vectors of other lengths than the index's, each compared with all of its length
        found = found.unionByName(link_theories(rest.select("id", F.col("g").alias("theory_id"), F.col("v").alias("embedding")), tau, block=block))
    return _together(found)


def comparisons(nodes: DataFrame, tau: float, index: Lists, *, block: int = 2048) -> int:
    """How many pairs link_lsh() with that index compares."""
    rows = _vectors(nodes.where("theory_id is not null"), "theory_id").where(F.size("v") == index.centroids.shape[1])
    return _list_links(rows, index, tau, block).agg(F.sum("compared")).first()[0] or 0
