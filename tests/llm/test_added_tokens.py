"""Token ids against the tokenizers library with its default settings: the file's added tokens are one id each."""

from __future__ import annotations

import numpy as np
import public_tokenizers as public
from tokenizers import Tokenizer

from hypotree.llm import packing, tokens

JSON = public.path("byte_bpe_50k.json")
TEXTS = [
    "one <|endoftext|> two", "<|endoftext|>", "", "plain, text.", "<|endoftext|><|endoftext|>", "a\n<|endoftext|>\n b  <|endoftext|>", "x<|endoftext|>y <|endoftext|",
    "<|<|endoftext|>|>", " <|endoftext|>  lead", "<|ENDOFTEXT|>", "é,z<|endoftext|>.a", "Z\x00a <|endoftext|>", "<|end\x00oftext|>",
]


def test_added_tokens_are_one_id():
    library = Tokenizer.from_file(JSON)
    want = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert want[0] == [505, 220, 50256, 734]
    for clear in (10**9, 5):
        encoder = tokens.tokenizer_encoder(JSON, max_entries=clear)
        for texts, its in ((TEXTS, want), (TEXTS[::-1], want[::-1]), (TEXTS[3:4], want[3:4])):
            ids, sizes = encoder.encode(texts)
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == its


def test_packing_counts_added_tokens_once(spark):
    library = Tokenizer.from_file(JSON)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = packing.pieces(docs, JSON, with_ids=True).select("doc_id", "ids").collect()
    want = {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(TEXTS)}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() if isinstance(r.ids, (bytes, bytearray)) else list(r.ids) for r in found} == want
