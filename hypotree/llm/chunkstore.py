"""Content-addressed store of token ids: chunks by rolling hash, each kept once, recipes and a Merkle manifest.

A document's ids are cut where a rolling hash of the last `window` ids has its low bits zero, so equal passages give
equal chunks wherever they stand. The store is four tables in the shared folder:

own: a row for each document: its recipe (digests of its chunks: SHA-256 of the ids as little-endian 32-bit integers, 16
bytes), root, n_tokens, and the payloads (the ids, packed) of the chunks that no other document has.
shared: digest, payload: the chunks of several documents, each once. uid in own.touches has the digests of them it uses.
order: uid, at and start: the place of each document in ascending doc_id order, and the ids before it.
manifest: Merkle tree over the recipes' roots: level, at, hash; a node hashes up to `fan_in` nodes below.

Most payloads never leave the row that was made with them: repeated digests are found by an aggregation over digests
alone, and only chunks of several documents are moved. Reading hashes every chunk again, rebuilds each document from its
recipe, and compares lengths, the recipe's root and the manifest; a mismatch raises.

Defined results: null text is empty (one end id); rows that repeat a doc_id are separate documents in the order of their
row number; a null doc_id comes first; an empty table gives an empty store and an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, drop_tables, map_texts, ordered_rows, slices, with_running_total, write_table
from .tokens import shared_encoder

#: Width of a chunk's digest in bytes.
DIGEST = 16
CHUNKS = "array<struct<digest: binary, payload: binary>>"
MADE = f"uid long, doc_id long, n_tokens long, root binary, digests array<binary>, own {CHUNKS}"


def gear(seed: int = 5) -> np.ndarray:
    """A random 64-bit number for each id modulo 2^16."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cut_points(ids: np.ndarray, bounds: np.ndarray, numbers: np.ndarray, *, window: int = 16, bits: int = 9, least: int = 64, most: int = 4096) -> list[list[int]]:
    """For each document, ids[bounds[i]:bounds[i + 1]], where its chunks end, counted from the start of the document.

    A chunk ends after an id whose hash over the last `window` ids of the document has `bits` zero bits, if the chunk
    has `least` ids by then, or at `most` ids, or with the document. window: a power of two.
    """
    own = numbers[ids & 0xFFFF]
    hashed, span = own.copy(), 1
    while span < window:  # the polynomial over 2 * span ids from two over span ids
        hashed[span:] = hashed[span:] + hashed[:-span] * np.uint64(pow(0x9E3779B97F4A7C15, span, 1 << 64))
        span *= 2
    hits = np.flatnonzero(hashed >> np.uint64(64 - bits) == 0)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        ends, last = [], a
        for hit in (hits[np.searchsorted(hits, a + window - 1) : np.searchsorted(hits, b)] + 1).tolist():
            while hit - last > most:
                last += most
                ends.append(last - a)
            if hit - last >= least and hit < b:
                ends.append(hit - a)
                last = hit
        while b - last > most:
            last += most
            ends.append(last - a)
        out.append([*ends, b - a])
    return out


@lru_cache
def _zstd() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack_ids(raw: bytes) -> bytes:
    """32-bit ids as 16-bit ones where they fit (first byte 2), else as they are (first byte 4), compressed."""
    ids = np.frombuffer(raw, "<u4")
    small = len(ids) == 0 or ids.max() < 1 << 16
    return (b"\2" if small else b"\4") + _zstd()[0].compress(ids.astype("<u2").tobytes() if small else raw)


def unpack_ids(packed: bytes) -> bytes:
    raw = _zstd()[1].decompress(packed[1:])
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if packed[0] == 2 else raw


def _lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), values)


def _made(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """A row for each document: its recipe, and the payloads of its chunks that were not seen before in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, numbers, seen, sha = shared_encoder(tokenizer, max_entries=1_000_000, max_chars=20_000_000), gear(), set(), hashlib.sha256
        for batch in slices(batches, "text", SLICE):
            ids, sizes = encoder.encode([x or "" for x in batch.column("text").to_pylist()])
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
            raw = memoryview(ids.astype("<u4")).cast("B")
            half = memoryview(ids.astype("<u2")).cast("B") if ids.max() < 1 << 16 else None
            roots, digests, per_recipe, own, payloads, per_own = [], [], [], [], [], []
            for a, ends in zip(bounds.tolist(), cut_points(ids, bounds, numbers)):
                if len(seen) >= 1 << 20:  # forgetting costs surplus copies, which are left out later
                    seen.clear()
                had, begin = len(digests), a
                new = len(own)
                for end in ends:
                    end += a
                    digests.append(digest := sha(raw[4 * begin : 4 * end]).digest()[:DIGEST])
                    if digest not in seen:
                        seen.add(digest)
                        own.append(digest)
                        payloads.append(b"\2" + _zstd()[0].compress(half[2 * begin : 2 * end]) if half is not None else pack_ids(bytes(raw[4 * begin : 4 * end])))
                    begin = end
                roots.append(sha(b"".join(digests[had:])).digest())
                per_recipe.append(len(digests) - had)
                per_own.append(len(own) - new)
            chunks = pa.StructArray.from_arrays([pa.array(own, pa.binary()), pa.array(payloads, pa.binary())], ["digest", "payload"])
            columns = [batch.column("uid"), batch.column("doc_id"), pa.array(sizes + 1, pa.int64()), pa.array(roots, pa.binary()), _lists(per_recipe, pa.array(digests, pa.binary())), _lists(per_own, chunks)]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "n_tokens", "root", "digests", "own"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(rows, run, MADE)


@dataclass
class Store:
    own: DataFrame
    shared: DataFrame
    order: DataFrame
    manifest: DataFrame

    @property
    def chunks(self) -> DataFrame:
        """(digest, payload): every chunk of the store."""
        return self.own.select(F.inline("own")).union(self.shared.select("digest", "payload"))


def _merkle(leaves: DataFrame, fan_in: int) -> DataFrame:
    """(level, at, hash): leaves (at, hash) are level 0; a node hashes its children's hashes in order; up to one root."""
    level, below = 0, leaves.select("at", "hash")
    levels = [below.select(F.lit(0).alias("level"), "at", "hash")]
    n = below.count()
    while n > 1:
        level, n = level + 1, -(-n // fan_in)
        nodes = below.groupBy(F.expr(f"at div {fan_in}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("kids"))
        below = nodes.select(F.col("up").alias("at"), F.unhex(F.sha2(F.array_join(F.transform("kids", lambda k: F.hex(k["hash"])), "").cast("binary"), 256)).alias("hash"))
        below = write_table(below, "chunkstore-level")
        levels.append(below.select(F.lit(level).alias("level"), "at", "hash"))
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out


def write(docs: DataFrame, tokenizer: str, *, end_id: int = 2, fan_in: int = 256, small_table: int = 2_000_000) -> Store:
    """Writes docs (doc_id, text) into a new store. The lists of shared digests are broadcast only up to small_table rows."""
    made = write_table(_made(docs, tokenizer, end_id), "chunkstore-made")
    few = lambda rows, n: F.broadcast(rows) if n <= small_table else rows.hint("merge")
    # of a digest that several documents use, the first that made it is the home
    makers = made.select(F.explode("own.digest").alias("digest"), F.col("uid").alias("maker"), F.lit(0).alias("uses"))
    users = made.select(F.explode(F.array_distinct("digests")).alias("digest"), "uid")
    counted = makers.union(users.select("digest", F.lit(None).cast("long"), F.lit(1)))
    repeated = counted.groupBy("digest").agg(F.min("maker").alias("home"), F.sum("uses").alias("uses")).where("uses > 1").select("digest", "home")
    repeated = write_table(repeated, "chunkstore-repeated")
    n = repeated.count()
    touches = write_table(users.join(few(repeated.select("digest"), n), "digest").groupBy("uid").agg(F.collect_list("digest").alias("touches")), "chunkstore-touches")
    alone = F.when(F.col("touches").isNull(), F.col("own")).otherwise(F.filter("own", lambda x: ~F.array_contains("touches", x["digest"])))
    own = made.join(few(touches, touches.count()), "uid", "left").select("uid", "doc_id", "n_tokens", "root", "digests", alone.alias("own"), "touches")
    own = write_table(own, "chunkstore-own")
    copies = made.select("uid", F.inline("own")).join(few(repeated, n), "digest").where("uid = home").select("digest", "payload")
    shared = write_table(copies, "chunkstore-shared")
    ordered = with_running_total(ordered_rows(own.select("uid", "doc_id", "n_tokens", "root"), ["doc_id", "uid"], "chunkstore-order"), F.col("n_tokens"), "start")
    order = write_table(with_running_total(ordered, F.lit(1), "at").select("uid", "at", "start", "root"), "chunkstore-order")
    drop_tables(made, repeated, touches)
    manifest = write_table(_merkle(order.select("at", F.col("root").alias("hash")), fan_in), "chunkstore-manifest")
    return Store(own, shared, order, manifest)


def _rebuilt(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    """From rows with a recipe, the document's own chunks, and those of others that it uses: each document, verified."""
    names = ["uid", "doc_id", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = ["uid", "doc_id", "n_tokens", "root", "digests", "own", "others"]

    def parts_of(column: pa.ListArray) -> Iterator[list[tuple[bytes, bytes]]]:
        flat, ends = column.values, column.offsets.to_pylist()
        both = list(zip(flat.field("digest").to_pylist(), flat.field("payload").to_pylist()))
        for a, b, some in zip(ends, ends[1:], column.is_valid().to_pylist()):
            yield both[a:b] if some else []

    for batch in batches:
        rows = []
        plain = [batch.column(c).to_pylist() for c in columns[:5]]
        for uid, doc_id, n_tokens, root, digests, own, others in zip(*plain, *(parts_of(batch.column(c)) for c in columns[5:])):
            parts = {}
            for digest, payload in own + others:
                raw = unpack_ids(payload)
                if hashlib.sha256(raw).digest()[:DIGEST] != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                parts[digest] = raw
            if any(d not in parts for d in digests) or hashlib.sha256(b"".join(digests)).digest() != root:
                raise ValueError(f"document {doc_id}: chunks are missing or the recipe is wrong")
            whole = b"".join([parts[d] for d in digests])
            if len(whole) != 4 * n_tokens:
                raise ValueError(f"document {doc_id} has {len(whole) // 4} ids, not {n_tokens}")
            rows.append((uid, doc_id, n_tokens, zlib.crc32(whole), *([whole] if with_ids else [])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read(store: Store, *, with_ids: bool = False) -> DataFrame:
    """One verified row for each document: at, doc_id, start, n_tokens, ids_crc32, and with_ids also the ids (32-bit).

    Documents whose chunks are all their own are rebuilt where they lie. Chunks of several documents travel to those by
    a join on digests, which Spark splits where one is very frequent.
    """
    columns = ["uid", "doc_id", "n_tokens", "root", "digests", "own"]
    needs = store.own.where("touches is not null").select("uid", F.explode("touches").alias("digest")).join(store.shared, "digest")
    needs = needs.groupBy("uid").agg(F.collect_list(F.struct("digest", "payload")).alias("others"))  # no more than the document has
    apart = store.own.where("touches is null").select(*columns, F.lit(None).cast(CHUNKS).alias("others"))
    joined = store.own.where("touches is not null").select(*columns).join(needs, "uid", "left").select(*columns, "others")
    schema = "uid long, doc_id long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    found = map_texts(apart.union(joined), lambda it: _rebuilt(it, with_ids), schema)
    return found.join(store.order.select("uid", "at", "start"), "uid").select("at", "doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def verify_manifest(store: Store, fan_in: int = 256) -> DataFrame:
    """The nodes of the manifest that differ from a tree built anew over the roots of the documents as stored; empty if all is well."""
    leaves = store.own.select("uid", F.unhex(F.sha2(F.unhex(F.array_join(F.transform("digests", lambda d: F.hex(d)), "")), 256)).alias("hash"))
    anew = _merkle(leaves.join(store.order.select("uid", "at"), "uid"), fan_in)
    return store.manifest.exceptAll(anew).union(anew.exceptAll(store.manifest))
