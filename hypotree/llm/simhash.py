"""SimHash near-duplicates by covering locality-sensitive hashing, then connected components.

Fingerprint: 64 bits, each set if it is set in more than half of the XXH64 hashes (seed 42) of the word shingles.
Candidates: every bit position carries a non-zero code of radius + 1 bits, and there is a table for each non-zero vector
v of as many bits, which keeps the positions whose code has an odd product with v. At most `radius` differing positions
have codes that some v is orthogonal to, so every pair within the radius agrees in at least one table: none is missed.
A bucket of more than `most` fingerprints is split by the same construction over another assignment of codes, again and
again; each round keeps more positions, so buckets become small without losing a pair and without all pairs of a group.

Defined results: null and empty texts and texts of white space only have fingerprint zero; fewer words than a shingle
make one shingle of all words; equal fingerprints always link; a component's id is the smallest non-null doc_id in it
(null if it has none); repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, field, map_texts, slices, write_table

BITS = 64


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each run of so many words of text: A-Z lower-cased, words by ASCII white space, joined by single spaces."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [xxh64_intdigest(line, 42)]
    ends = np.cumsum([len(x) + 1 for x in parts])
    begins = (ends - [len(x) + 1 for x in parts])[: len(parts) - words + 1]
    return [xxh64_intdigest(line[a:b], 42) for a, b in zip(begins.tolist(), (ends[words - 1 :] - 1).tolist())]


def fingerprint(hashes: list[int]) -> int:
    counts, step = np.zeros(BITS, np.int64), 1 << 16
    for at in range(0, len(hashes), step):
        part = np.array(hashes[at : at + step], ">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): one row for each row of docs, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(shingle_hashes(x or b"", words)) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return map_texts(texts, run, "doc_id long, fp long")


def covering_masks(radius: int, level: int = 0, bits: int = BITS) -> list[int]:
    """The tables' masks; level picks the assignment of codes to positions."""
    order = list(range(bits))
    random.Random(level).shuffle(order)
    vectors = range(1, 1 << (radius + 1))
    code = {p: 1 + i % len(vectors) for i, p in enumerate(order)}
    return [sum(1 << p for p in range(bits) if (code[p] & v).bit_count() % 2) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """For each list of distinct fingerprints, edges (a > b) that join those within the radius, no more than the list is long."""
    for batch in batches:
        out: list[tuple[int, int]] = []
        for values in batch.column("fps").to_pylist():
            fps = np.sort(np.array(values, np.int64))
            near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= radius
            label = np.arange(len(fps))
            while True:  # the smallest label spreads over the links
                lower = np.where(near, label[None, :], len(fps)).min(1)
                lower = lower[lower]
                if (lower == label).all():
                    break
                label = lower
            moved = np.flatnonzero(label != np.arange(len(fps)))
            out += zip(fps[moved].tolist(), fps[label[moved]].tolist())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def links(fps: DataFrame, *, radius: int = 2, most: int = 128, levels: int = 5) -> DataFrame:
    """Edges (a > b) over distinct fingerprints (column fp) whose components are those of all links within the radius.

    After `levels` assignments so few positions are free that a bucket can't hold more than `most` fingerprints.
    """
    found, left = [], fps.select("fp", F.lit(0).cast("long").alias("bucket"))
    for level in range(levels):
        masks = F.array(*[F.struct(F.lit(i).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("kept")) for i, m in enumerate(covering_masks(radius, level))])
        keyed = left.select("fp", F.explode(F.transform(masks, lambda x: F.xxhash64(F.lit(level), F.col("bucket"), x["v"], x["kept"]))).alias("bucket"))
        keyed = keyed.distinct() if level else keyed
        sizes = write_table(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), f"simhash-sizes{level}")
        shared = write_table(keyed.join(sizes, "bucket"), f"simhash-shared{level}")
        small = shared.where(F.col("n") <= most).groupBy("bucket").agg(F.collect_set("fp").alias("fps")).select("fps")
        found.append(small.mapInArrow(lambda it: _forest(it, radius), "a long, b long"))
        left = shared.where(F.col("n") > most).select("fp", "bucket")
        if left.isEmpty():
            break
    else:
        raise AssertionError("positions stay free after all levels")
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges.distinct()


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, root): for every node of edges (a, b), the smallest node that it reaches, by alternating large-star and small-star steps.

    Each step hangs neighbours under the smallest one seen; the steps' tables are written, so lineage stays short. The
    table of minima is written before the join, so that a node with very many neighbours is split like any skewed join key.
    """
    pair = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges, before = write_table(pair, "cc"), None
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = write_table(both.groupBy("a").agg(F.min("b").alias("m")), "cc-least").select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = write_table(large, "cc-large")
        least = write_table(large.groupBy("a").agg(F.min("b").alias("m")), "cc-least").select(F.col("a").alias("k"), "m")
        small = large.join(least, large["a"] == least["k"]).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        drop_tables(edges)
        edges = write_table(small, "cc")
        drop_tables(large)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise AssertionError(f"components have not settled after {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of docs."""
    rows = write_table(fingerprints(docs, key=key, text=text, words=words), "simhash-fp")
    nodes = write_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = write_table(components(links(nodes, radius=radius)), "simhash-roots")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = write_table(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id, with the columns of docs.

    Rows with a null key stay, as there is no name to drop them by; of rows that repeat a key all stay or all go.
    """
    found = near_duplicates(docs, key=key, text=text, words=words, radius=radius)
    name = field(docs.schema, "_gone")
    gone = write_table(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "simhash-gone")
    return docs.join(gone, docs[key].cast("long") == gone[name], "left_anti")
