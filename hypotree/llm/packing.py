"""Bound-certified best-fit packing of token pieces into fixed-length sequences.

Documents longer than a sequence are cut into full pieces, with the odd piece first; the rest stays whole. Pieces are
dealt to packing partitions of bounded size by hash. Each partition packs by best-fit decreasing and gets lower bounds
from dual-feasible functions; where the bound equals its bin count, the partition is certified and done. Partitions with
a gap give the pieces of their emptiest bins away; these are dealt anew to fewer partitions and packed again, as long as
that saves bins.

Defined results: null text is empty (one piece with the end token only); repeated rows are packed each on its own; a null
doc_id is packed like any other; an empty table gives an empty result; ties go to the smaller piece number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, map_texts, slices, write_table
from .tokens import shared_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "uid long, length long, bin int, offset long, settled boolean, bins int, bound int"


def cut_points(n: int, capacity: int) -> list[int]:
    """Where the pieces of a document of n tokens begin, and n."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n + 1, capacity)]


def pieces(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, and with_ids also the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer, max_entries=200_000, max_chars=4_000_000)
        for batch in slices(batches, "text", SLICE):
            ids, sizes = encoder.encode([x or "" for x in batch.column("text").to_pylist()])
            ends = np.cumsum(sizes)
            raw = memoryview(np.insert(ids, ends, end_id).astype("<u4").tobytes())
            rows: list[tuple] = []
            at = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), (sizes + 1).tolist()):
                cuts = cut_points(n, capacity)
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = raw[4 * (at + a) : 4 * (at + b)]
                    rows.append((doc, k, a, b - a, zlib.crc32(part), *([bytes(part)] if with_ids else [])))
                at += n
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(rows[0])])

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(chosen, run, PIECES + (", ids binary" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: per length its bin and offset, and per bin its free room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int64)
    room: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                rooms ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - n
        if r > n:
            open_bins[r - n].append(b)
            rooms |= 1 << (r - n)
    return bins, offsets, np.array(room, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the bounds by dual-feasible functions: the sum, halves by threshold, and multiples of 1 / (k + 1)."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int(count @ size) // capacity)
    for t in range(1, capacity // 2 + 1):  # above capacity - t counts as a full bin, below t as nothing
        value = np.where(size > capacity - t, capacity, np.where(size < t, 0, size))
        best = max(best, -(-int(count @ value) // capacity))
    for k in range(1, 21):  # x stays if (k + 1) x is whole, else floor((k + 1) x) / k
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)
        best = max(best, -(-int(count @ value) // (k * capacity)))
    return best


def _pack(table: pa.Table, capacity: int, release: float) -> pa.Table:
    table = table.sort_by([("length", "descending"), ("uid", "ascending")])
    lengths = table["length"].to_numpy()
    bins, offsets, room = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    gap = len(room) - bound
    given = np.zeros(len(room), bool)
    if gap > 0:
        given = room > release * capacity
        given[np.argsort(-room, kind="stable")[: 2 * gap]] = True
    n = len(lengths)
    return pa.table({"uid": table["uid"], "length": table["length"], "bin": bins, "offset": offsets, "settled": ~given[bins], "bins": np.full(n, len(room), np.int32), "bound": np.full(n, bound, np.int32)})


def pack(lengths: DataFrame, *, capacity: int = 1024, per_partition: int = 4096, release: float = 0.125, rounds: int = 4) -> DataFrame:
    """(uid, sequence_id, offset) for rows (uid, length), with length at most capacity; the rows of a round are written once.

    Rows settled in a round keep their bins. Rows given away are packed again, and the new packing of a round is taken
    only if it has fewer bins than the bins they came from. sequence_id: round, partition and bin in one number; full
    pieces have a sequence each, below zero.
    """
    full = lengths.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = lengths.where(F.col("length") < capacity).select("uid", "length")
    done, before = [full], None
    for k in range(rounds + 1):
        n = left.count()
        if not n:
            break
        parts = -(-n // per_partition)
        dealt = left.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(parts)))
        packed = write_table(dealt.groupBy("part").applyInArrow(lambda t: _pack(t, capacity, release).append_column("part", t["part"]), PACKED + ", part long"), f"packing{k}")
        named = packed.select("uid", "length", "settled", F.col("offset"), (F.lit(k).cast("long") * (1 << 54) + F.col("part") * (1 << 24) + F.col("bin")).alias("sequence_id"))
        if before is not None:
            was = before.agg(F.count_distinct("sequence_id")).first()[0]
            now = named.agg(F.count_distinct("sequence_id")).first()[0]
            if now >= was:
                done.append(before.select("uid", "sequence_id", "offset"))
                break
        last = k == rounds or parts == 1
        done.append(named.where(F.lit(last) | F.col("settled")).select("uid", "sequence_id", "offset"))
        if last:
            break
        before = named.where(~F.col("settled"))
        left = before.select("uid", "length")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, **kw: float) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = pieces(docs, tokenizer, key=key, text=text, capacity=capacity, end_id=end_id).withColumn("uid", F.monotonically_increasing_id())
    rows = write_table(found, "packing-pieces")
    placed = write_table(pack(rows.select("uid", "length"), capacity=capacity, **kw), "packing-placed")
    return rows.join(placed, "uid").drop("uid")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves; ids: little-endian 32-bit integers. For tables with unique doc_id."""
    whole = pieces(docs, tokenizer, capacity=capacity, end_id=end_id, with_ids=True).select("doc_id", "piece", "ids")
    parts = packed.select("doc_id", "piece", "sequence_id", "offset").join(whole, ["doc_id", "piece"])
    ordered = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # at most `capacity` parts
    return ordered.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
