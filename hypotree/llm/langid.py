"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: a cell holds a mask with a bit for each language, an n-gram's cells
are the same for all, and the bitwise and of its cells gives every language that (probably) has the n-gram at once.
Per language, the number of a text's n-grams that it holds, corrected for that language's false positives, decides. A
second filter of the same form holds the n-grams that are common in a language: a hit there weighs 1, one in the first
filter alone `RARE`.

Fitting reads a bounded sample (`per_lang` texts of each language in expectation, of at most `max_bytes`, and `budget`
bytes over all). There is a layer of masks for every 64 languages. Prediction reads every whole text.

Defined results: null text and text without a letter give `und` and score 0; ties go to the first language by name;
repeated rows each get their own (equal) row; an empty table gives an empty result; without learned languages all is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, field, held_out, map_texts, slices
from .tokens import sums

UNKNOWN = "und"
#: The weight of an n-gram that a language holds, if it isn't common in it.
RARE = 0.02
#: Odd multipliers, one for each cell of an n-gram.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Bytes other than letters become spaces; bytes of other scripts and of accents stay.
LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All four-byte windows of the lower-cased texts, runs of non-letters as one space, and each text's number of them."""
    coded = [f" {x.lower()} ".encode("utf-8", "replace") for x in texts]
    sizes = np.fromiter((len(x) + 1 for x in coded), np.int64, len(coded))
    raw = np.frombuffer(b"\0".join([*coded, b""]), np.uint8)
    ends = np.cumsum(sizes) - 1
    text = LETTERS[raw]
    text[ends] = 0
    space = text == 32
    keep = ~(space & np.roll(space, 1))
    doc = np.repeat(np.arange(len(texts)), sizes)[keep]
    text = text[keep]
    if len(text) < 4:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    wide = text.astype(np.uint32)
    window = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    full = text != 0
    full = full[:-3] & full[1:-2] & full[2:-1] & full[3:]
    return window[full], np.bincount(doc[:-3][full], minlength=len(texts))


def cells(window: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((window.astype(np.uint64) + np.uint64(1)) * np.uint64(m)) >> np.uint64(64 - bits) for m in MULTIPLIERS]


@dataclass
class Filters:
    """langs: the names; bit i % 64 of layer i // 64 is langs[i]. Of each pair, first all n-grams of a language, then its common ones.

    masks: layers of cells. false_rate: per language, its fill to the power of the cells read.
    """

    langs: list[str]
    masks: tuple[np.ndarray, np.ndarray]
    false_rate: tuple[np.ndarray, np.ndarray]

    def holding(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each n-gram the masks of the languages that hold it, and of those in which it is common: (layers, n-grams)."""
        at = cells(window, self.masks[0].shape[1].bit_length() - 1)
        return tuple(np.stack([layer[at[0]] & layer[at[1]] & layer[at[2]] for layer in masks]) for masks in self.masks)

    def shares(self, window: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Per language and text, the weighted share of the text's n-grams that it holds, false positives taken off."""
        total = 0.0
        for held, wrong, weight in zip(self.holding(window), self.false_rate, (RARE, 1 - RARE)):
            hits = np.stack([sums((held[i // 64] >> (i % 64) & 1).astype(np.int64), n) for i in range(len(self.langs))])
            total += weight * np.clip((hits / np.maximum(n, 1) - wrong[:, None]) / (1 - wrong[:, None]), 0, 1)
        return total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Per text the language, its share of all languages' hit rates, and its own hit rate, which doesn't depend on how many others there are."""
        out, scores, rates = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
        if not some or not self.langs:
            return out, scores, rates
        window, n = grams([texts[i] for i in some])
        share = self.shares(window, n)
        best = share.argmax(0)
        total = share.sum(0)
        sure = np.where(total > 0, share.max(0) / np.maximum(total, 1e-12), 1 / len(self.langs))
        for k, i in enumerate(some):
            out[i], scores[i], rates[i] = self.langs[best[k]], sure[k], share[best[k], k]
        return out, scores, rates


def build(texts: list[str], langs: list[str], *, bits: int = 20, min_count: int = 2, rival: float = 0.05) -> Filters:
    """An n-gram is common in a language that has it min_count times and at least `rival` as often, for its size, as the language that has it most."""
    names = sorted(set(langs))
    kind = np.uint8 if len(names) <= 8 else np.uint64
    masks = tuple(np.zeros((-(-len(names) // 64), 1 << bits), kind) for _ in range(2))
    counted = []
    for name in names:
        window, _ = grams([t for t, own in zip(texts, langs) if own == name])
        counted.append(np.unique(window, return_counts=True))
    if not names:
        return Filters([], masks, (np.zeros(0), np.zeros(0)))
    every, at = np.unique(np.concatenate([w for w, _ in counted]), return_inverse=True)
    rate = np.concatenate([np.where(times >= min_count, times / max(1, times.sum()), 0) for _, times in counted])
    most = np.zeros(len(every))
    np.maximum.at(most, at, rate)
    is_common = np.split((rate > 0) & (rate >= rival * most[at]), np.cumsum([len(w) for w, _ in counted])[:-1])
    false_rate = []
    for layers, held in zip(masks, ([w for w, _ in counted], [w[own] for (w, _), own in zip(counted, is_common)])):
        for i, window in enumerate(held):
            for at in cells(window, bits):
                layers[i // 64, at] |= kind(1 << i % 64)
        fill = np.array([np.count_nonzero(layers[i // 64] >> (i % 64) & 1) for i in range(len(names))]) / (1 << bits)
        false_rate.append(fill ** len(MULTIPLIERS))
    return Filters(names, masks, tuple(false_rate))


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 1200, max_bytes: int = 32_768, budget: int = 64 << 20, **kw: float) -> Filters:
    """Learns from rows with a language that held_out() leaves, per_lang of each in expectation, and no more than an even share of budget bytes, by the hash of their id and text."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key)) & (F.octet_length(text) <= max_bytes))
    counts = {r["l"]: r for r in rows.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("b")).collect()}
    if not counts:
        return build([], [])
    share = F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text), F.lit(1)), 11) / float(1 << 53)
    wanted = F.create_map(*[F.lit(x) for l, r in sorted(counts.items()) for x in (l, min(1.0, per_lang / r["n"], budget / len(counts) / max(1, r["b"])))])
    sample = rows.where(share < wanted[F.col(lang)]).select(F.col(text).alias("t"), F.col(lang).alias("l")).toArrow()
    return build(sample["t"].to_pylist(), sample["l"].to_pylist(), **kw)


def identify(docs: DataFrame, filters: Filters, *, text: str = "text", to: str = "lang_pred", score: str = "score", rate: str = "hit_rate") -> DataFrame:
    """docs with the predicted language, its share of the languages' corrected hit rates, and its own rate, in place of columns of those names. The filters are of fixed size."""
    sent, docs = docs.sparkSession.sparkContext.broadcast(filters), docs.drop(to, score, rate)
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(rate, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            found, sure, own = sent.value.predict([x or "" for x in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(sure), pa.array(own)], [*batch.schema.names, to, score, rate])

    return map_texts(docs, run, schema)


def keep_known(docs: DataFrame, filters: Filters, *, text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows in one of the learned languages with a hit rate of at least `least`, with the columns of docs."""
    to, score, rate = (field(docs.schema, name) for name in ("_lang", "_sure", "_rate"))
    return identify(docs, filters, text=text, to=to, score=score, rate=rate).where((F.col(to) != UNKNOWN) & (F.col(rate) >= least)).drop(to, score, rate)
