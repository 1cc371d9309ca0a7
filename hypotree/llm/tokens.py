"""Token ids of many texts by a byte-level BPE, with a cache of the stretches that texts are cut into.

A byte-level BPE with the public split pattern never joins a character that isn't white space with white space after it,
nor a letter or digit with a comma or full stop after it. So a text may be cut at those places, each stretch encoded
alone, and the ids joined: the result is that of encoding the whole text. Most stretches are words, and most are looked
up; one not seen yet is split by the pattern and goes to the model.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

#: The cut for texts in which white space stands before a space, or no letter or digit before a comma or full stop.
CUT = re.compile(r"(?<=\S)(?= )")
#: Code points below this end: 1 for letters and digits, 2 for white space; all white space is below.
KINDS = np.array([1 if chr(c).isalpha() or chr(c).isdigit() else 2 if chr(c).isspace() else 0 for c in range(0x3001)], np.uint8)
#: A stretch that holds no white space but a leading space; these are split many at a time.
PLAIN = re.compile(r" ?\S+\Z")


class _Store(dict):
    """Numbers its keys in the order they come; holds the ids of each number in one growing array."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[str] = []
        self.held = self.used = 0
        self.flat, self.begin, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        self.pending.append(key)
        self.held += len(key)
        return code

    def put(self, codes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[codes] = self.used + np.cumsum(sizes) - sizes
        self.size[codes] = sizes
        self.used += len(ids)

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all codes, joined, and the number of ids of each."""
        size = self.size[codes]
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.begin[codes] - (np.cumsum(size) - size), size)], size


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values; counts: the runs' lengths, 0 allowed."""
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - counts]


class StretchEncoder:
    """encode(texts): the ids of all texts in one array, and each text's number of ids.

    encode_words: from a list of words, the joined ids and the number of ids of each word. The cache is emptied beyond
    max_entries stretches or max_chars characters; that changes only the speed. added: strings that are one id wherever
    they stand (leftmost first, the longest of those at a place); what lies between them is encoded as a text of its own.
    """

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], max_entries: int = 600_000, max_chars: int = 12_000_000, added: dict[str, int] | None = None) -> None:
        import public_tokenizers
        import regex

        self.words_of = regex.compile(public_tokenizers.PATTERN).findall
        self.encode_words, self.max_entries, self.max_chars = encode_words, max_entries, max_chars
        self.known = _Store()
        self.added = added or {}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _learn(self) -> None:
        new, self.known.pending = self.known.pending, []
        if not new:
            return
        plain = np.array([PLAIN.match(x) is not None for x in new])
        own: dict[str, int] = {}
        line_end = own.setdefault("\n", 0)
        many = [x for x, is_plain in zip(new, plain.tolist()) if is_plain]
        codes = np.array([own.setdefault(w, len(own)) for w in self.words_of("\n".join(many))], np.int64)
        counts = np.zeros(len(new), np.int64)
        if many:
            counts[plain] = np.diff(np.append(np.flatnonzero(codes == line_end), len(codes)), prepend=-1) - 1
        odd_codes: list[int] = []
        for i in np.flatnonzero(~plain).tolist():
            found = [own.setdefault(w, len(own)) for w in self.words_of(new[i])]
            counts[i] = len(found)
            odd_codes += found
        words = _Store()
        words.update(own)
        words.put(np.arange(len(own)), *self.encode_words(list(own)))
        at = len(self.known) - len(new) + np.arange(len(new))
        for chosen, its in ((plain, codes[codes != line_end]), (~plain, np.array(odd_codes, np.int64))):
            if chosen.any():
                ids, sizes = words.gather(its)
                self.known.put(at[chosen], ids, sums(sizes, counts[chosen]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not any(a in t for a in self.added for t in texts):
            return self._encode(texts)
        parts = [self.at_added.split(t) for t in texts]  # every second part is an added string
        ids, sizes = self._encode([x if k % 2 == 0 else "" for part in parts for k, x in enumerate(part)])
        single = np.array([k % 2 == 1 for part in parts for k in range(len(part))])
        own = np.array([self.added[x] for part in parts for x in part[1::2]], ids.dtype)
        return np.insert(ids, np.cumsum(sizes)[single], own), sums(sizes + single, np.fromiter(map(len, parts), np.int64, len(parts)))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.max_entries or self.known.held > self.max_chars:
            self.known = _Store()
        get, codes = self.known.__getitem__, []
        for text, is_odd in zip(texts, odd(texts)):
            parts = CUT.split(text) if is_odd else text.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").split("\0")
            codes.append(np.fromiter(map(get, parts), np.int64, len(parts)))
        self._learn()
        ids, size = self.known.gather(np.concatenate([np.zeros(0, np.int64), *codes]))
        return ids, sums(size, np.fromiter(map(len, codes), np.int64, len(codes)))


def odd(texts: list[str]) -> list[bool]:
    """For each text whether it must be cut by CUT."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = KINDS[np.minimum(points, len(KINDS) - 1)]
    kinds[points >= len(KINDS)] = 0
    now, before = points[1:], kinds[:-1]
    wrong = (now == 32) & (before == 2) | ((now == 44) | (now == 46)) & (before != 1)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(ends, np.flatnonzero(wrong) + 1, "right")] = True
    return [o or "\0" in t for o, t in zip(out.tolist(), texts)]


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for one in lists for x in one), np.int32, int(sizes.sum())), sizes


def byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE files write for bytes: printable ones stand for themselves, the others follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def tokenizer_encoder(path: str, **kw: int) -> StretchEncoder:
    """An encoder by the tokenizers library and the file at path (a byte-level BPE); the file's added tokens are one id each."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters, found = tokenizer.model, byte_letters(), tokenizer.get_added_tokens_decoder()
    assert not any(x.lstrip or x.rstrip or x.single_word for x in found.values()), "added tokens that depend on what is beside them"

    def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return joined([[x.id for x in model.tokenize(w.encode().decode("latin-1").translate(letters))] for w in words])

    return StretchEncoder(encode_words, added={x.content: i for i, x in found.items()}, **kw)


_ENCODERS: dict[str, StretchEncoder] = {}


def shared_encoder(path: str, **kw: int) -> StretchEncoder:
    """The Python worker's encoder for path: its cache lives as long as the worker, over many tasks. kw: sizes for a new one."""
    if path not in _ENCODERS:
        _ENCODERS[path] = tokenizer_encoder(path, **kw)
    return _ENCODERS[path]
