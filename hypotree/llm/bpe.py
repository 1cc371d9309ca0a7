"""Byte-level BPE encoding and decoding with length-bucketed padded matrices.

Words (matches of the public split pattern) that no cache knows become rows of byte ids, padded within buckets of similar
length. In each round every row merges its leftmost pair of the smallest rank; ranks come from a hash table of pairs, are
kept in a second matrix and are looked up anew only beside the merge. Rows without a pair to merge leave the matrix.
A word beyond the buckets is a row of its own, which makes in one round all merges that would follow each other anyway:
those of the same rank from left to right, up to the first that gives rise to a pair of no higher rank.

Defined results: null text is empty and has no ids; repeated rows each get their own row; an empty table gives an empty
result; ids outside the vocabulary can't be decoded and raise. A long word takes about as many rounds as it has different ranks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .tokens import StretchEncoder, joined

NONE = np.int32(1 << 30)
#: Widest row of each bucket; longer words are merged alone.
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, 256)


class PairTable:
    """Open addressing: pair of ids to the rank of the joined bytes, NONE for pairs that don't join."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(10, int(4 * len(rank)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            at = slot[waiting]
            free = self.keys[at] == -1
            first = np.zeros(len(waiting), bool)  # of several that want a free slot one gets it
            first[np.unique(np.where(free, at, -1), return_index=True)[1]] = True
            won = waiting[first & free]
            self.keys[slot[won]], self.ranks[slot[won]] = keys[won], rank[won]
            waiting = waiting[~(first & free)]
            slot[waiting] = (slot[waiting] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        shape, keys = keys.shape, keys.ravel()
        out = np.full(len(keys), NONE, np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            found = self.keys[slot]
            hit = found == keys[rest]
            out[rest[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found != -1)
            rest, slot = rest[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class Vocabulary:
    """Ranks of byte strings. encode_words: for StretchEncoder. decode: the bytes of each run of ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        parts = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(parts, np.int64).reshape(-1, 3).T)
        self.bytes_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        size = np.zeros(max(ranks.values(), default=-1) + 2, np.int64)
        for t, r in ranks.items():
            size[r] = len(t)
        self.size, self.end = size, np.cumsum(size)
        self.flat = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def _merge(self, words: list[bytes], width: int) -> list[list[int]]:
        """BPE of words of at most width bytes."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < n[:, None]] = self.bytes_id[raw]
        ranks = np.full((len(words), width), NONE, np.int32)
        some = np.arange(width - 1) < (n - 1)[:, None]
        ranks[:, :-1][some] = self.pairs.get(ids[:, :-1][some], ids[:, 1:][some])
        out: list[list[int]] = [[]] * len(words)
        rows = np.arange(len(words))
        while len(rows):
            at = ranks.argmin(1)  # the leftmost of the smallest
            line = np.arange(len(rows))
            best = ranks[line, at]
            ended = best == NONE
            if ended.any():
                for i, one, k in zip(rows[ended].tolist(), ids[ended].tolist(), n[ended].tolist()):
                    out[i] = one[:k]
                on = ~ended
                rows, ids, ranks, n, at, best = rows[on], ids[on], ranks[on], n[on], at[on], best[on]
                if not len(rows):
                    break
                wide = int(n.max())  # columns that no row uses any more go
                ids, ranks, line = ids[:, :wide], ranks[:, :wide], np.arange(len(rows))
            ids[line, at] = best
            cols = np.arange(ids.shape[1])
            take = np.minimum(cols + (cols > at[:, None]), ids.shape[1] - 1)
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, np.minimum(cols + (cols >= at[:, None]), ids.shape[1] - 1), 1)
            n = n - 1
            beyond = cols >= n[:, None]
            ids[beyond] = -1
            ranks[cols >= n[:, None] - 1] = NONE
            for near in (at - 1, at):
                ok = np.flatnonzero((near >= 0) & (near < n - 1))
                ranks[ok, near[ok]] = self.pairs.get(ids[ok, near[ok]], ids[ok, near[ok] + 1])
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        """BPE of one word, many merges a round."""
        ids = self.bytes_id[np.frombuffer(word, np.uint8)]
        ranks = self.pairs.get(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            # of a run of places next to each other every second one, from its start: the others share a token with it
            start = np.concatenate([[True], at[1:] != at[:-1] + 1])
            begin = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            # the pairs that each merge makes when all before it are done and none after it
            after = np.concatenate([[False], at[1:] == at[:-1] + 2])
            left = np.where(after, least, ids[np.maximum(at - 1, 0)])
            right = ids[np.minimum(at + 2, len(ids) - 1)]
            merged = np.full(len(at), least, np.int32)
            low = (at > 0) & (self.pairs.get(left, merged) <= least) | (at + 2 < len(ids)) & (self.pairs.get(merged, right) <= least)
            if low.any():
                at = at[: int(np.argmax(low)) + 1]
            ids[at] = least
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ranks = np.append(ranks, NONE)[kept][:-1]
            ids = ids[kept]
            at = at - np.arange(len(at))  # where the merged ids are now
            near = np.unique(np.concatenate([at - 1, at]))
            near = near[(near >= 0) & (near < len(ids) - 1)]
            ranks[near] = self.pairs.get(ids[near], ids[near + 1])
        return ids.tolist()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        out: list[list[int]] = [[r] if (r := self.ranks.get(w)) is not None else [] for w in raw]
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            if not out[i] and w:
                width = next((x for x in WIDTHS if len(w) <= x), 0)
                if not width:
                    out[i] = self._merge_long(w)
                    continue
                buckets.setdefault(width, []).append(i)
        for width, members in sorted(buckets.items()):
            step = max(1, (1 << 18) // width)  # matrices that fit the processor's cache
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._merge([raw[i] for i in part], width)):
                    out[i] = ids
        return joined(out)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.size) and self.size[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        size = self.size[ids]
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.end[ids] - np.cumsum(size), size)].tobytes()


_LOADED: dict[str, tuple[Vocabulary, StretchEncoder]] = {}


def loaded(path: str) -> tuple[Vocabulary, StretchEncoder]:
    """The Python worker's tables and cache for a rank file."""
    if path not in _LOADED:
        found = Vocabulary.load(path)
        _LOADED[path] = found, StretchEncoder(found.encode_words, max_entries=300_000)
    return _LOADED[path]


def encode(docs: DataFrame, ranks: str, *, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with the ids of each text in place of the text: little-endian unsigned 32-bit integers in a binary column."""
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(to, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = loaded(ranks)
        for batch in slices(batches, text):
            ids, sizes = encoder.encode([x or "" for x in batch.column(text).to_pylist()])
            raw, ends = memoryview(ids.astype("<u4").tobytes()), (4 * np.cumsum(sizes)).tolist()
            column = pa.array([raw[a:b] for a, b in zip([0, *ends], ends)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], [*kept, to])

    return docs.select(*kept, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str, *, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with the bytes that the ids stand for in a binary column. Null ids count as none."""
    schema = T.StructType([*encoded.schema.fields, T.StructField(to, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = loaded(ranks)
        for batch in slices(batches, ids):
            decoded = [vocabulary.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, to])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks: str, *, text: str = "text") -> DataFrame:
    """docs with ids and decoded in place of the text: encode() and decode() in one pass, so that a task needs one Python worker."""
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, encoder = loaded(ranks)
        for batch in slices(batches, text):
            ids, sizes = encoder.encode([x or "" for x in batch.column(text).to_pylist()])
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes).tolist()
            column = pa.array([raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)], pa.binary())
            decoded = [vocabulary.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column, pa.array(decoded, pa.binary())], [*kept, "ids", "decoded"])

    return docs.select(*kept, text).mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """Per document (doc_id, text): the number of ids, and SHA-256 of the ids and of the bytes decoded from them."""
    found = round_trip(docs.select("doc_id", "text"), ranks)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
