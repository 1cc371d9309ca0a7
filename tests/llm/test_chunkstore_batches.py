"""The chunk store's rows go to Python in batches of bounded size, and give the same documents."""

from __future__ import annotations

import zlib

import public_tokenizers
from hypotree.llm import chunkstore
from hypotree.llm.common import SLICE

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_when_written_and_read(spark):
    text = "Some words of a long text, with number {}. "
    docs = spark.createDataFrame([(i, "".join(text.format(i * k) for k in range(2000))) for i in range(40)], "doc_id long, text string").coalesce(1)
    spark.conf.unset(KEY)
    store = chunkstore.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert spark.conf.get(KEY) == str(SLICE)
    spark.conf.unset(KEY)
    rows = chunkstore.read(store, with_ids=True).collect()
    assert spark.conf.get(KEY) == str(SLICE)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.at)] == list(range(40))
    assert all(len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
