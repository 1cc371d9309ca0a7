"""Cross-tokenizer alignment against a plain version with the libraries themselves and dense products."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hypotree.llm import align, queries
from hypotree.llm.tokens import byte_letters

DIR = "/root/testdata/sf0.001"
JSON, MODEL = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]
ODD = [
    (1, "The cat sat on the mat."), (1, "The cat sat on the mat."), (2, None), (3, ""), (4, " "), (5, "über été . a,b  c  d　e 漢字 🎉 1.5"), (6, "a<|endoftext|>b <s> </s> <unk> <0x41>"),
    (7, "a ▁ block"), (8, "nul \0 and \r\n\ttabs"), (9, "ﬁ é é"), (10, "漢字" * 3000), (11, "x" * 5000), (None, "no id here"), (12, "internationalisation, antidisestablishmentarianism " * 40), (2**62, "  two  spaces"),
]


def _tokens(rows):
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    octet = {letter: b for b, letter in byte_letters().items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for _, text in rows:
        if not text:
            yield [], []
            continue
        one = [(i, bytes(octet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
        whole = (" " + text).encode()
        yield (one, two) if all(b"".join(x[1] for x in t) == whole for t in (one, two)) else ([], [])


def _spans(tokens):
    ends = np.cumsum([len(x[1]) for x in tokens]).tolist()
    return [(i, e - len(b), e) for (i, b), e in zip(tokens, ends)]


def _brute(rows):
    """Links by comparing spans, counts by dictionaries."""
    links, groups, sizes = [], [], []
    for one, two in _tokens(rows):
        a, b = _spans(one), _spans(two)
        found, j = [], 0
        for i, x, y in a:
            while j and b[j][1] > x:
                j -= 1
            while j < len(b) and b[j][2] <= x:
                j += 1
            k = j
            while k < len(b) and b[k][1] < y:
                found.append((i, b[k][0]))
                k += 1
        links.append(found)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        told = [([i for i, _, e in a if p < e <= q], [i for i, _, e in b if p < e <= q]) for p, q in zip([0, *ends], ends)] if len(a) < 3000 else _by_walk(a, b, ends)
        groups.append(told)
        sizes.append((len(a), len(b)))
    count = collections.Counter(p for found in links for p in set(found))
    top = collections.defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    out = []
    for (key, _), found, told, (n, m) in zip(rows, links, groups, sizes):
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in told)
        out.append((key, n, m, len(told), len(found), sum(count[p] == top[p[0]] for p in found), sum(count[p] for p in found), hashlib.sha256(text.encode()).hexdigest() if n else "", sum(len(x) * len(y) for x, y in told)))
    return out


def _by_walk(a, b, ends):
    out, i, j = [], 0, 0
    for q in ends:
        one, two = [], []
        while i < len(a) and a[i][2] <= q:
            one.append(a[i][0])
            i += 1
        while j < len(b) and b[j][2] <= q:
            two.append(b[j][0])
            j += 1
        out.append((one, two))
    return out


@pytest.mark.parametrize("hot", [align.HOT_PAIRS, 40, 0])
def test_odd_texts(spark, hot):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"n": F.lit(1), "pair": F.lit("x"), "groups": F.lit(2)}).repartition(3)
    found = align.align(docs, JSON, MODEL, digest=True, hot=hot).withColumnRenamed("groups", "groups_sha256").select(COLUMNS)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(_brute(ODD), key=repr)


def test_query(spark):
    df = queries.queries()["op11_align"](spark, DIR)
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert df.columns == COLUMNS
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(_brute(rows), key=repr)


def test_products_are_those_of_dense_matrices():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n, m, k = rng.integers(1, 30, 3)
        x, y = rng.random((n, k)) < 0.3, rng.random((m, k)) < 0.3
        csr = lambda d: align.Csr(np.concatenate([[0], np.cumsum(d.sum(1))]), np.nonzero(d)[1], d.shape[1])
        for block in (1, 7, 1 << 20):
            out = np.zeros((n, m), int)
            for r, c, v in align.row_products(csr(x), align.transposed(csr(y)), block):
                out[r, c] += v
            assert np.array_equal(out, x.astype(int) @ y.T.astype(int))


def test_real_groups_and_links(spark):
    docs = spark.createDataFrame([(1, "The internationalisation of cats")], "doc_id long, text string")
    groups = align.align(docs, JSON, MODEL).first().groups
    links = align.token_links(docs, JSON, MODEL).collect()
    (one, two), = _tokens([(1, "The internationalisation of cats")])
    assert ";".join("|".join(",".join(map(str, s)) for s in g) for g in _by_walk(_spans(one), _spans(two), sorted({e for *_, e in _spans(one)} & {e for *_, e in _spans(two)}))) == groups
    dense = [(p, q, i, j, min(y, z) - max(x, w)) for p, (i, x, y) in enumerate(_spans(one)) for q, (j, w, z) in enumerate(_spans(two)) if min(y, z) > max(x, w)]
    assert sorted(tuple(r)[1:] for r in links) == sorted(dense)


def test_nothing(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), JSON, MODEL).collect() == []
