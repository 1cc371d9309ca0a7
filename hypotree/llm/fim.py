"""Fill-in-middle transformation: cuts in code points are made in UTF-8 bytes through a sparse index of multibyte characters.

A text is cut into prefix, middle and suffix at two code points drawn from its id, and written with sentinels in the order
prefix, suffix, middle (psm) or suffix, prefix, middle (spm), or left as it is (plain). Only characters of several bytes are
recorded: their places and the bytes they have beyond one. A search among them turns a place in code points into one in
bytes, or back; between them it is arithmetic, and a text of ASCII needs no index at all.

Nulls: a null text is the empty text, a null id counts as the id of no digits. The empty text, and a text that contains a
sentinel, stay plain. Every row is treated alone, so ties and repeated rows give equal results and an empty table an empty
one; new columns whose names clash with those at hand get underscores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SLICE, field, map_texts, slices

#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")


class ExceptionIndex:
    """Of a UTF-8 text: `at`, the places in code points of its multibyte characters, and `excess`, their bytes beyond one summed up to and with each."""

    def __init__(self, data: bytes) -> None:
        if data.isascii():
            self.at = self.excess = np.zeros(0, np.int64)
        else:
            octets = np.frombuffer(data, np.uint8)
            lead = np.flatnonzero(octets >= 0xC0)
            first = octets[lead]
            beyond = 1 + (first >= 0xE0) + (first >= 0xF0).astype(np.int64)
            self.excess = np.cumsum(beyond)
            self.at = lead - (self.excess - beyond)
        self.n_chars = len(data) - (int(self.excess[-1]) if len(self.excess) else 0)

    def to_bytes(self, chars: int) -> int:
        """The byte at which the code point of that number begins (the end of the text for n_chars)."""
        k = int(np.searchsorted(self.at, chars, "left"))
        return chars + (int(self.excess[k - 1]) if k else 0)

    def to_chars(self, octets: int) -> int:
        """The number of code points that begin before that byte, for a byte at which one begins or the text ends."""
        k = int(np.searchsorted(self.at + self.excess, octets, "left"))  # a character's last byte is before any later beginning
        return octets - (int(self.excess[k - 1]) if k else 0)


def drawn(key: int | None, seed: int) -> tuple[int, ...]:
    """Four 32-bit numbers: the first groups of eight hexadecimal digits of sha256 over 'seed:key'."""
    told = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(told[4 * i : 4 * i + 4], "big") for i in range(4))


def arranged(data: bytes, h: tuple[int, ...], rate: int, spm_rate: int, sentinels: tuple[bytes, bytes, bytes]) -> tuple[bytes, str, int, int | None, int | None]:
    """(output, form, code points of the text, of the prefix, of the middle) of a text and its four numbers."""
    index = ExceptionIndex(data)
    n = index.n_chars
    if not data or h[2] % 100 >= rate or any(s in data for s in sentinels):
        return data, "plain", n, None, None
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = index.to_bytes(first), index.to_bytes(second)
    prefix, suffix = sentinels[0] + data[:a], sentinels[1] + data[b:]
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    return (suffix + prefix if form == "spm" else prefix + suffix) + sentinels[2] + data[a:b], form, n, first, second - first


def rebuilt(output: bytes, form: str, sentinels: tuple[bytes, bytes, bytes]) -> bytes:
    """The text that `arranged` made output of. No sentinel can begin within another or reach into it, so the first ones found are the ones written."""
    if form == "plain":
        return output
    lead, then = (sentinels[1], sentinels[0]) if form == "spm" else (sentinels[0], sentinels[1])
    one, _, rest = output[len(lead) :].partition(then)
    two, _, middle = rest.partition(sentinels[2])
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


def _checked(sentinels: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """Sentinels as bytes; each must begin with a byte that stands nowhere else in any, else texts could not always be rebuilt."""
    made = tuple(s.encode() for s in sentinels)
    if len(set(made)) != 3 or not all(s and all(s[:1] not in t[1:] for t in made) for s in made):
        raise ValueError("sentinels must differ, and begin with a byte that none has further on")
    return made


def transform(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rate: int = 90, spm_rate: int = 20, seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs with output, form, n_code_points, prefix_chars and middle_chars (null if plain): rate of 100 texts are cut, spm_rate of 100 of these in spm order.

    One pass without a shuffle; texts go through in slices of bounded bytes.
    """
    marks = _checked(sentinels)
    schema = T.StructType(list(docs.schema))
    for name, kind in (("output", T.StringType()), ("form", T.StringType()), ("n_code_points", T.LongType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())):
        schema = schema.add(field(schema, name), kind)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE):
            texts = part.column(text).cast(pa.binary()).to_pylist()
            made = [arranged(t or b"", drawn(k, seed), rate, spm_rate, marks) for k, t in zip(part.column(key).to_pylist(), texts)]
            outputs, forms, *counts = zip(*made)
            columns = [pa.array(outputs, pa.binary()).cast(pa.string()), pa.array(forms, pa.string()), *(pa.array(c, pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names)

    return map_texts(docs, run, schema)


def restore(made: DataFrame, *, output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """made with restored: the text, rebuilt from output and form alone."""
    marks = _checked(sentinels)
    schema = T.StructType(list(made.schema))
    schema = schema.add(field(schema, "restored"), T.StringType())
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, output, SLICE):
            found = [rebuilt(o or b"", f, marks) for o, f in zip(part.column(output).cast(pa.binary()).to_pylist(), part.column(form).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary()).cast(pa.string())], names)

    return map_texts(made, run, schema)
