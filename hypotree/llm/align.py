"""Cross-tokenizer alignment: tokens of two tokenizers over the same bytes, linked by products of sparse incidence matrices.

Two matrices, of tokens and the bytes that they cover, lie in CSR form (indptr, indices), built by hand. The product of one
with the other's transpose, made row by row after Gustavson, has an entry for every two tokens that share bytes; its value
is the number of these bytes. Offsets at which tokens of both kinds end cut a text into groups; matrices of tokens and
groups give the tokens that share a group, of which only the number is worked out, as a group's pairs may be many.

A text is aligned if it isn't empty and the tokens of either kind, joined, are the bytes of a space and the text. Texts that
are null, empty or changed by a tokenizer have no tokens: zeros, and an empty string of groups. Repeated rows are rows of
their own and count as documents of their own; null ids are kept; extra columns take no part; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, map_texts, slices, write_table
from .tokens import CUT, StretchEncoder, byte_letters, sums, tokenizer_encoder

#: Pairs of ids that are looked up in a broadcast table: the most frequent ones, never more than this.
HOT_PAIRS = 300_000


class Csr(NamedTuple):
    """A matrix of ones: row r has them in the columns indices[indptr[r]:indptr[r + 1]]."""

    indptr: np.ndarray
    indices: np.ndarray
    n_columns: int


def covers(ends: np.ndarray) -> Csr:
    """Tokens (rows) and the bytes (columns) that they cover; ends: the byte at which each token ends, ascending."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]), np.arange(n), n)


def belongs(groups: np.ndarray, n_groups: int) -> Csr:
    """Tokens (rows) and the one group (column) of each."""
    return Csr(np.arange(len(groups) + 1), groups, n_groups)


def transposed(m: Csr) -> Csr:
    count = np.bincount(m.indices, minlength=m.n_columns)
    rows = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    return Csr(np.concatenate([[0], np.cumsum(count)]), rows[np.argsort(m.indices, kind="stable")], len(m.indptr) - 1)


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """For each row of a the entries that its product with b adds up: the sizes of b's rows that it names. Gustavson's first pass."""
    return sums(np.diff(b.indptr)[a.indices], np.diff(a.indptr))


def row_products(a: Csr, b: Csr, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The product a b as (row, column, value) in order of rows and columns, some rows at a time: about `block` entries are added up at once."""
    total = np.concatenate([[0], np.cumsum(product_sizes(a, b))])
    n, first = len(a.indptr) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(total, total[first] + block, "right")) - 1)
        named = a.indices[a.indptr[first] : a.indptr[last]]
        rows = np.repeat(np.arange(first, last), np.diff(a.indptr[first : last + 1]))
        size = np.diff(b.indptr)[named]
        places = np.arange(int(size.sum())) + np.repeat(b.indptr[named] - (np.cumsum(size) - size), size)
        at = np.repeat(rows, size) * b.n_columns + b.indices[places]
        if np.any(at[1:] < at[:-1]):
            at = np.sort(at)
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        yield at[new] // b.n_columns, at[new] % b.n_columns, np.diff(np.append(new, len(at)))
        first = last


class _Pair:
    """The two tokenizers of a Python worker, the bytes of every token, and what is known of stretches of text."""

    def __init__(self, tokenizer: str, model: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        octet = {letter: b for b, letter in byte_letters().items()}
        vocabulary = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(octet[c] for c in token) if all(c in octet for c in token) else token.encode()
        self.encoder: StretchEncoder = tokenizer_encoder(tokenizer, max_entries=150_000, max_chars=3_000_000)
        self.encoder.added = {}  # their strings are plain text here
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        #: Neither tokenizer joins a character that isn't white space with a space after it, so texts may be cut there.
        self.may_cut = not any(INNER.search(x) for x in pieces) and len(sp.encode("a")) == 1
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        #: What is written for a token in a list of groups: a's id and what comes after it, then b's.
        self.written = [f"{i}{mark}" for n, marks in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for mark in marks for i in range(n)]
        self.known = Stretches(self)

    def cut(self, spaced: str) -> list[str]:
        if not self.may_cut:
            return [spaced]
        return CUT.split(spaced) if AFTER_SPACE.search(spaced) or "\0" in spaced else spaced.replace(" ", "\0 ").split("\0")[1:]

    def tokens_b(self, spaced: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.sp.encode([s[1:] for s in spaced], num_threads=1)
        lists = [x or self.sp.encode("a ")[1:] for x in lists]  # a space alone, which the model doesn't add to nothing
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


#: A piece that goes on after a space, white space before a space.
INNER, AFTER_SPACE = re.compile("[^▁]▁"), re.compile(r"\s ")

_PAIRS: dict[tuple[str, str], _Pair] = {}


def _pair(tokenizer: str, model: str) -> _Pair:
    if (tokenizer, model) not in _PAIRS:
        _PAIRS[tokenizer, model] = _Pair(tokenizer, model)
    return _PAIRS[tokenizer, model]


def _sound(texts: list[bytes], ids: np.ndarray, sizes: np.ndarray, token_bytes: list[bytes]) -> np.ndarray:
    """For each text whether its tokens, joined, are its bytes."""
    names, ends = list(map(token_bytes.__getitem__, ids.tolist())), np.cumsum(sizes).tolist()
    return np.array([b"".join(names[e - n : e]) == t for t, e, n in zip(texts, ends, sizes.tolist())], bool)


class Aligned:
    """Some texts aligned together, each a space and what comes after it; texts that a tokenizer changes are left out, `kept` has the places of the others.

    ids_a, ids_b: token ids of all kept texts; first_a, first_b: where each text's begin (and the last end); group_a, group_b: each token's
    group, of n_groups, numbered over all texts.
    """

    def __init__(self, spaced: list[str], pair: _Pair) -> None:
        self.pair = pair
        raw = [t.encode() for t in spaced]
        (a, na), (b, nb) = pair.encoder.encode(spaced), pair.tokens_b(spaced)
        good = _sound(raw, a, na, pair.bytes_a) & _sound(raw, b, nb, pair.bytes_b)
        self.kept = np.flatnonzero(good)
        if not good.all():
            a, b, na, nb = a[np.repeat(good, na)], b[np.repeat(good, nb)], na[good], nb[good]
        self.ids_a, self.ids_b = a.astype(np.int64), b.astype(np.int64)
        self.first_a, self.first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (na, nb))
        self.ends_a, self.ends_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
        ends = np.zeros(int(self.ends_a[-1]) + 1 if len(a) else 1, np.uint8)
        ends[self.ends_a] = 1
        ends[self.ends_b] += 2
        last_a, last_b = (ends[x] == 3 for x in (self.ends_a, self.ends_b))  # tokens that end a group
        self.last_a, self.last_b, self.n_groups = last_a, last_b, int(last_a.sum())
        self.group_a, self.group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of a, token of b, bytes that they share) in blocks."""
        return row_products(covers(self.ends_a), transposed(covers(self.ends_b)))

    def shared_groups(self) -> np.ndarray:
        """For each token of a the number of b's tokens in its group: entries of the group matrices' product."""
        return product_sizes(belongs(self.group_a, self.n_groups), transposed(belongs(self.group_b, self.n_groups)))

    def group_texts(self) -> Iterator[str]:
        """Each text's groups, as `a1,a2|b1;a3|b2,b3`."""
        size_a, size_b = (np.bincount(g, minlength=self.n_groups) for g in (self.group_a, self.group_b))
        before_a, before_b = np.cumsum(size_a), np.cumsum(size_b) - size_b
        n, m = len(self.pair.bytes_a), len(self.pair.bytes_b)
        codes = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        codes[np.arange(len(self.ids_a)) + before_b[self.group_a]] = self.ids_a + n * self.last_a
        codes[np.arange(len(self.ids_b)) + before_a[self.group_b]] = 2 * n + self.ids_b + m * self.last_b
        names, first = list(map(self.pair.written.__getitem__, codes.tolist())), (self.first_a + self.first_b).tolist()
        for k in range(len(self.kept)):
            yield "".join(names[first[k] : first[k + 1]])[:-1]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


def _roomy(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n entries in its last axis at least."""
    while x.shape[-1] < n:
        x = np.concatenate([x, np.zeros_like(x)], axis=-1)
    return x


class Stretches(dict):
    """Numbers stretches of text in the order they come; for each number its counts, groups and linked pairs. Emptied beyond a bound, which changes only the speed."""

    def __init__(self, pair: _Pair, most: int = 400_000, chars: int = 8_000_000) -> None:
        super().__init__()
        self.pair, self.most, self.chars = pair, most, chars
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.pending: list[str] = []
        self.groups: list[str] = []
        self.held = self.used = 0
        self.counts, self.good = np.zeros((len(_COUNTS), 1 << 14), np.int64), np.zeros(1 << 14, bool)
        self.pairs, self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def __missing__(self, stretch: str) -> int:
        self[stretch] = code = len(self)
        self.pending.append(stretch)
        self.held += len(stretch)
        return code

    def learn(self) -> None:
        """Aligns the stretches that came since the last time."""
        new, self.pending = self.pending, []
        if not new:
            return
        n, known = len(self), len(self) - len(new)
        found, size_b = Aligned(new, self.pair), len(self.pair.bytes_b)
        at = known + found.kept
        texts = [""] * len(new)
        for k, text in zip(found.kept.tolist(), found.group_texts()):
            texts[k] = text
        self.groups += texts
        self.counts, self.good, self.begin, self.size = (_roomy(x, n) for x in (self.counts, self.good, self.begin, self.size))
        a, b = np.diff(found.first_a), np.diff(found.first_b)
        of = np.repeat(np.arange(len(at)), a)  # the stretch of each token of a
        links = np.zeros(len(at), np.int64)
        for x, y, _ in found.links():
            links += np.bincount(of[x], minlength=len(at))
            self.pairs = _roomy(self.pairs, self.used + len(x))
            self.pairs[self.used : self.used + len(x)] = found.ids_a[x] * size_b + found.ids_b[y]
            self.used += len(x)
        self.good[at] = True
        self.size[at] = links
        self.begin[at] = self.used - int(links.sum()) + np.cumsum(links) - links
        self.counts[:, at] = [a, b, sums(found.last_a.astype(np.int64), a), links, sums(found.shared_groups(), a)]

    def linked(self, codes: np.ndarray) -> np.ndarray:
        """The linked pairs of all codes, joined."""
        size = self.size[codes]
        return self.pairs[np.arange(int(size.sum())) + np.repeat(self.begin[codes] - (np.cumsum(size) - size), size)]


def _summaries(texts: list[str | None], pair: _Pair, digest: bool) -> list[pa.Array]:
    """Columns for texts: the counts, groups, and the different id pairs with how often each is linked.

    Stretches end where tokens of both kinds end, so a text's links and groups are those of its stretches, which are worked out once each.
    """
    known, n = pair.known, len(texts)
    if len(known) > known.most or known.held > known.chars:
        known.reset()
    codes = [np.fromiter(map(known.__getitem__, pair.cut(" " + t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    known.learn()
    sizes = np.fromiter(map(len, codes), np.int64, n)
    every = np.concatenate([np.zeros(0, np.int64), *codes])
    good = sums((~known.good[every]).astype(np.int64), sizes) == 0
    every, sizes = every[np.repeat(good, sizes)], np.where(good, sizes, 0)
    values = [sums(c[every], sizes) for c in known.counts]
    told = [""] * n
    for k in np.flatnonzero(sizes).tolist():
        text = ";".join(map(known.groups.__getitem__, codes[k].tolist()))
        told[k] = hashlib.sha256(text.encode()).hexdigest() if digest else text
    span = len(pair.bytes_a) * len(pair.bytes_b)
    key, count = np.unique(np.repeat(np.arange(n), values[3]) * span + known.linked(every), return_counts=True)
    offsets = pa.array(np.searchsorted(key, np.arange(n + 1) * span).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (key % span, count.astype(np.int32))]
    return [*map(pa.array, values), pa.array(told, pa.string()), *lists]


def aligned(docs: DataFrame, tokenizer: str, model: str, *, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """For each row: its key, n_a, n_b, n_groups, n_links, n_shared (pairs of tokens of one group), groups, pairs and times.

    tokenizer: a byte-level BPE of the tokenizers library (a), model: one of sentencepiece (b), which adds the space itself. groups: as by
    Aligned.group_texts, or with digest the SHA-256 of that; pairs: a's id times b's number of ids plus b's id, once each; times: how often.
    """
    kind = [docs.schema[key], *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("groups", T.StringType())]
    schema = T.StructType([*kind, T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(tokenizer, model)
        for part in slices(batches, text, SLICE):
            yield pa.RecordBatch.from_arrays([part.column(key), *_summaries(part.column(text).to_pylist(), pair, digest)], schema.fieldNames())

    return map_texts(docs.select(key, text), run, schema)


def token_links(docs: DataFrame, tokenizer: str, model: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each link: the document's key, place_a, place_b (from 0), id_a, id_b, shared_bytes."""
    names = ("place_a", "place_b", "id_a", "id_b", "shared_bytes")
    schema = T.StructType([docs.schema[key], *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(tokenizer, model)
        for part in slices(batches, text, SLICE):
            texts = part.column(text).to_pylist()
            some = np.flatnonzero([bool(t) for t in texts])
            found = Aligned([" " + texts[k] for k in some.tolist()], pair)
            for x, y, n in found.links():
                doc = np.searchsorted(found.first_a, x, "right") - 1
                columns = (x - found.first_a[doc], y - found.first_b[doc], found.ids_a[x], found.ids_b[y], n)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(some[found.kept[doc]])), *map(pa.array, columns)], schema.fieldNames())

    return map_texts(docs.select(key, text), run, schema)


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): in how many rows of aligned() each pair is linked, and whether no other pair of its a id is in more."""
    counted = write_table(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "align-counts")
    a = F.expr(f"pair div {n_b}")
    top = counted.groupBy(a.alias("a")).agg(F.max("n").alias("top"))  # as many rows as a has ids
    return counted.join(F.broadcast(top), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _most_frequent(counts: DataFrame, limit: int) -> int:
    """The least n such that at most `limit` pairs have that n or more: by counts in steps of a sixteenth of a power of two."""
    step = F.floor(F.log2("n") * 16)
    held = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect(), reverse=True)  # at most 16 x 63 rows
    least, total = 1 << 62, 0
    for x in held:
        total += x.pairs
        if total > limit:
            break
        least = x.least
    return least


def scored(rows: DataFrame, n_b: int, hot: int = HOT_PAIRS) -> DataFrame:
    """rows of aligned(), without pairs and times, with n_best (links whose pair's count is the highest of its a id) and count_sum (over links).

    A count is the number of rows that hold the pair linked. The `hot` most frequent pairs are broadcast, a table of bounded size; all others
    are in few rows each and are joined by a shuffle.
    """
    made = write_table(rows.withColumn("_row", F.monotonically_increasing_id()), "align-rows")
    counts = write_table(pair_counts(made, n_b), "align-best")
    least = _most_frequent(counts, hot)
    few = F.broadcast(counts.where(F.col("n") >= least))
    links = made.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", "x.pairs", "x.times").withColumnRenamed("pairs", "pair")
    found = links.join(few, "pair")
    rest = counts.where(F.col("n") < least)
    if not rest.isEmpty():
        found = found.unionByName(links.join(few.select("pair"), "pair", "left_anti").join(rest, "pair"))
    totals = found.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return made.drop("pairs", "times").join(totals, "_row", "left").fillna(0, ["n_best", "count_sum"]).drop("_row")


def vocabulary_size(model: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()


def align(docs: DataFrame, tokenizer: str, model: str, *, key: str = "doc_id", text: str = "text", digest: bool = False, hot: int = HOT_PAIRS) -> DataFrame:
    """aligned() with n_best and count_sum over all rows of docs, in place of pairs and times."""
    return scored(aligned(docs, tokenizer, model, key=key, text=text, digest=digest), vocabulary_size(model), hot)
