"""What scores and requests need of evidence, by tiles and without a row for each link: sums by node and a key of the event, newest links, best links.

Evidence has a row for each close pair of a node and an event, so it grows with nodes times events. Here a tile compares its pairs
strip by strip and gives a row for each node and key. The number of tiles is fixed as long as blocks stay under `most` rows, so a
vector travels equally often whatever the size of the tables, and events lie in ranges of their key, so a node and key come from few tiles.

A link is as in similarity.link_evidence(): |cos| of nine digits at least tau. Sums of cos are whole billionths, which any order adds up alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypotree import defaults as D
from hypotree.operators.similarity import _units, _vectors, blocks
from hypotree.sources.sinks import checkpointed, counting

#: Rows and columns that a tile compares at a time.
STRIP, WIDE = 256, 4096
SCALE = 1e9


def _least(tau: float) -> int:
    """The fewest billionths that are at least tau."""
    found = int(np.ceil(tau * SCALE))
    return found - 1 if (found - 1) / SCALE >= tau else found


def _dealt(nodes: DataFrame, events: DataFrame, by: str, more: tuple[str, ...], tiles: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides' vectors by tile (i, j, d); events in ranges of `by`. Nodes (id, parent_id) come with the vectors of their parents as rows that are not own."""
    left, n = counting(_vectors(nodes, None, "parent_id").drop("g"), {"n": F.count("*")})
    right, m = counting(_vectors(events, None, by, *more).drop("g"), {"n": F.count("*")})
    p, q = blocks(n["n"], m["n"], tiles, most)
    right = checkpointed(right.repartitionByRange(q, by, "id").withColumn("j", F.spark_partition_id()))
    last = right.agg(F.max("j")).first()[0] or 0
    own = left.select("id", "parent_id", "v", F.lit(True).alias("own"), F.pmod(F.xxhash64("id"), F.lit(p)).cast("int").alias("i"))
    homes = own.where("parent_id is not null").select(F.col("parent_id").alias("home"), "i").distinct()
    parents = homes.join(left.select("id", "v"), F.col("home") == F.col("id")).select("id", F.lit(None).cast("long").alias("parent_id"), "v", F.lit(False).alias("own"), "i")
    each = lambda name, k: F.explode(F.sequence(F.lit(0), F.lit(k))).alias(name)
    rows = own.unionByName(parents).select("*", F.size("v").alias("d"), each("j", last))
    return rows, right.select("*", F.size("v").alias("d"), each("i", p - 1))


def _told(rows: list[dict[str, np.ndarray | pa.Array]], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.table([pa.array(r[f.name]).cast(f.type) if f.name in r else pa.nulls(len(r["node_id"]), f.type) for f in schema], schema=schema) for r in rows)])


def _billionths(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The cosines of unit vectors in whole billionths."""
    out = x @ e.T
    out *= SCALE
    return np.rint(out, out=out)


def _strips(a: pa.Table) -> Iterator[slice]:
    return (slice(k, min(k + STRIP, a.num_rows)) for k in range(0, a.num_rows, STRIP))


def link_sums(nodes: DataFrame, events: DataFrame, by: str, tau: float = D.TAU, *, tiles: int = 64, most: int = 1 << 16) -> DataFrame:
    """Per tile, node and value of `by`: (node_id, by, n, n_support, s, c, planted): links, supporting ones, billionths of cos of support, of
    contradiction (positive), of support by planted events. Per tile and node besides, with n null: (node_id, both, against): supporting events
    that bear on the parent too, and those of them that contradict the parent. To be summed over the tiles.

    nodes: id, parent_id, embedding. events: id, embedding, `by`; planted and alone, if there are such columns: marks, and which count in both and
    against (all, if not given); weight, if there is such a column: cos counts so many times, and s and c are numbers with fractions.
    """
    least, kind = _least(tau), events.schema[by].dataType
    more = tuple(c for c in ("planted", "alone", "weight") if c in events.columns)
    total = pa.float64() if "weight" in more else pa.int64()
    from pyspark.sql.pandas.types import to_arrow_type

    out = {"node_id": pa.int64(), by: to_arrow_type(kind), "n": pa.int64(), "n_support": pa.int64(), "s": total, "c": total, "planted": total, "both": pa.int64(), "against": pa.int64()}
    schema = pa.schema(list(out.items()))
    spoken = f"node_id long, {by} {kind.simpleString()}, n long, n_support long, " + ", ".join(f"{c} {'double' if 'weight' in more else 'long'}" for c in ("s", "c", "planted")) + ", both long, against long"

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        nodes_, parents = a.filter(a["own"]).sort_by([("parent_id", "ascending"), ("id", "ascending")]), a.filter(pa.compute.invert(a["own"])).sort_by("id")
        if not nodes_.num_rows or not b.num_rows:
            return schema.empty_table()
        code = b[by].combine_chunks().dictionary_encode(null_encoding="encode")
        values, code = code.dictionary, code.indices.to_numpy().astype(np.int64) * 2
        if "planted" in more:
            code = code + b["planted"].to_numpy()
        order = np.argsort(code, kind="stable")
        code, b = code[order], b.take(pa.array(order))
        alone = b["alone"].to_numpy() if "alone" in more else np.ones(b.num_rows, bool)
        weight = b["weight"].to_numpy() if "weight" in more else None
        x, above, e = _units(nodes_), _units(parents) if parents.num_rows else None, _units(b)
        ids, known = nodes_["id"].to_numpy(), parents["id"].to_numpy()
        home = np.asarray(nodes_["parent_id"].fill_null(0).to_numpy(), np.int64)
        child = np.asarray(nodes_["parent_id"].is_valid())
        first, end = np.searchsorted(known, home, "left"), np.searchsorted(known, home, "right")
        first, end = np.where(child, first, 0), np.where(child, end, 0)
        repeats = int((end - first).max(initial=0))
        found = []
        for rows in _strips(nodes_):
            size = rows.stop - rows.start
            sums = np.zeros((4, size, 2 * len(values)))
            lap = np.zeros((2, size), np.int64)
            some = end[rows] > first[rows]
            lo, hi = (int(first[rows][some].min()), int(end[rows][some].max())) if some.any() else (0, 0)
            for at in range(0, b.num_rows, WIDE):
                cols = slice(at, min(at + WIDE, b.num_rows))
                k = _billionths(x[rows], e[cols])
                begin = np.flatnonzero(np.concatenate([[True], code[cols][1:] != code[cols][:-1]]))
                up, down = k >= least, k <= -least
                if hi > lo:
                    near = _billionths(above[lo:hi], e[cols])
                    against = near <= -least
                    bears = (np.abs(near) >= least) & alone[cols]
                    against &= alone[cols]
                    for r in range(repeats):  # one round, unless parents' ids repeat
                        have = first[rows] + r < end[rows]
                        place = first[rows][have] + r - lo
                        lap[0][have] += np.count_nonzero(up[have] & bears[place], axis=1)
                        lap[1][have] += np.count_nonzero(up[have] & against[place], axis=1)
                if weight is not None:
                    k *= weight[cols]
                parts = (up | down, up, np.where(up, k, 0.0), np.where(down, -k, 0.0))
                for one, part in zip(sums, parts):
                    one[:, code[cols][begin]] += np.add.reduceat(part, begin, axis=1, dtype=np.float64 if part.dtype == np.float64 else np.int32)
            both = sums[:, :, 0::2] + sums[:, :, 1::2]
            i, j = np.nonzero(both[0])
            n, t, s, c = (z[i, j] for z in both)
            found.append({"node_id": ids[rows][i], by: values.take(pa.array(j)), "n": n.astype(np.int64), "n_support": t.astype(np.int64)} | {w: z if weight is not None else z.astype(np.int64) for w, z in (("s", s), ("c", c), ("planted", sums[2][i, 2 * j + 1]))})
            with_both = np.flatnonzero(lap[0])
            found.append({"node_id": ids[rows][with_both], "both": lap[0][with_both], "against": lap[1][with_both]})
        return _told(found, schema)

    rows, columns = _dealt(nodes, events, by, more, tiles, most)
    return rows.groupBy("i", "j", "d").cogroup(columns.groupBy("i", "j", "d")).applyInArrow(tile, spoken)


def newest_links(nodes: DataFrame, events: DataFrame, tau: float = D.TAU, *, tiles: int = 64, most: int = 1 << 16) -> DataFrame:
    """(node_id, newest, newest_support, supported) of nodes with links: observed_at of the newest link and of the newest supporting one (null if no time is known), and whether there is support.

    Events are compared from the newest on, until every row of a strip has both.
    """
    least = _least(tau)
    schema = pa.schema([("node_id", pa.int64()), ("newest", pa.int64()), ("newest_support", pa.int64()), ("supported", pa.bool_())])

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        b = b.sort_by([("at", "descending")])  # nulls come last
        at, ids, x, e, found = b["at"].combine_chunks(), a["id"].to_numpy(), _units(a), _units(b), []
        for rows in _strips(a):
            hit = np.full((2, rows.stop - rows.start), -1, np.int64)
            for col in range(0, b.num_rows, STRIP):
                k = _billionths(x[rows], e[col : col + STRIP])
                for one, mask in zip(hit, (np.abs(k) >= least, k >= least)):
                    new = (one < 0) & mask.any(1)
                    one[new] = col + mask[new].argmax(1)
                if (hit >= 0).all():
                    break
            linked = hit[0] >= 0
            times = [at.take(pa.array(h[linked], pa.int64(), mask=h[linked] < 0)) for h in hit]
            found.append({"node_id": ids[rows][linked], "newest": times[0], "newest_support": times[1], "supported": hit[1][linked] >= 0})
        return _told(found, schema)

    timed = events.select("id", "embedding", F.unix_micros("observed_at").alias("at"))
    rows, columns = _dealt(nodes.withColumn("parent_id", F.lit(None).cast("long")), timed, "at", (), tiles, most)
    found = rows.groupBy("i", "j", "d").cogroup(columns.groupBy("i", "j", "d")).applyInArrow(tile, "node_id long, newest long, newest_support long, supported boolean")
    latest = lambda c: F.timestamp_micros(F.max(c)).alias(c)
    return found.groupBy("node_id").agg(latest("newest"), latest("newest_support"), F.bool_or("supported").alias("supported"))


def best_links(nodes: DataFrame, events: DataFrame, k: int, tau: float = D.TAU, *, tiles: int = 64, most: int = 1 << 16) -> DataFrame:
    """(node_id, event_id, cos, stance) of supporting links, with the k best of each node by (cos desc, event_id) among them: a tile gives a row of its nodes at most k.

    Events are compared in the order of their ids, so that of equal ones the first stay.
    """
    least = _least(max(tau, 1 / SCALE))  # a cos of 0 supports nothing
    schema = pa.schema([("node_id", pa.int64()), ("event_id", pa.int64()), ("cos", pa.float64())])

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows or k < 1:
            return schema.empty_table()
        b = b.sort_by("id")
        ids, others, x, e, found = a["id"].to_numpy(), b["id"].to_numpy(), _units(a), _units(b), []
        for rows in _strips(a):
            size = rows.stop - rows.start
            floor = np.full(size, least - 1.0)  # billionths that a link must exceed
            best = np.zeros((3, 0))  # rows, billionths and places of those found so far
            for at in range(0, b.num_rows, WIDE):
                cos = x[rows] @ e[at : at + WIDE].T
                row, col = np.nonzero(cos > (floor[:, None] + 0.25) / SCALE)
                near = np.rint(cos[row, col] * SCALE)
                better = near > floor[row]
                if not better.any():
                    continue
                best = np.concatenate([best, np.stack([row[better], near[better], col[better] + at])], axis=1)
                best = best[:, np.lexsort((best[2], -best[1], best[0]))]
                place = np.arange(best.shape[1]) - np.searchsorted(best[0], best[0])
                last = best[:, place == k - 1]
                floor[last[0].astype(np.int64)] = last[1]
                best = best[:, place < k]
            found.append({"node_id": ids[rows][best[0].astype(np.int64)], "event_id": others[best[2].astype(np.int64)], "cos": best[1] / SCALE})
        return _told(found, schema)

    placed = events.select("id", "embedding", F.col("id").alias("place"))
    rows, columns = _dealt(nodes.withColumn("parent_id", F.lit(None).cast("long")), placed, "place", (), tiles, most)
    found = rows.groupBy("i", "j", "d").cogroup(columns.groupBy("i", "j", "d")).applyInArrow(tile, "node_id long, event_id long, cos double")
    return found.withColumn("stance", F.lit(1))
