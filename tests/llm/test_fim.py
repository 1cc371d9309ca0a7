"""The fill-in-middle transformation against SQL and a plain version over Python strings."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from hypotree.llm import fim, queries

DIR = "/root/testdata/sf0.001"
TEXTS = ["", "a", "é", "漢字🎉x", "plain words only", "über été . a,b  漢字 🎉 1.5", "has <S> inside", "ends with <", "<P", "S><M", "🎉" * 500, "a" * 300_000 + "é" + "b" * 9]


def _plain(key, text, rate=90, spm=20, seed=1):
    """By characters of the decoded string."""
    text = text or ""
    s = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(s[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return text, "plain", n, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < spm:
        return f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}", "spm", n, a, b - a
    return f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "psm", n, a, b - a


@pytest.mark.parametrize("text", TEXTS[:-1])
def test_index_converts_every_cut(text):
    index = fim.ExceptionIndex(text.encode())
    assert index.n_chars == len(text)
    assert len(index.at) == sum(len(c.encode()) > 1 for c in text)
    for k in range(len(text) + 1):
        at = len(text[:k].encode())
        assert index.to_bytes(k) == at and index.to_chars(at) == k


@pytest.mark.parametrize("rate, spm, seed", [(90, 20, 1), (100, 50, 7), (0, 20, 1)])
def test_as_by_strings(spark, rate, spm, seed):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(3, "漢字🎉x"), (3, "漢字🎉x"), (None, "no id é"), (2**62, None), (-5, "minus ü")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"form": F.lit(1), "output": F.lit("x")}).repartition(3)
    made = fim.restore(fim.transform(docs, rate=rate, spm_rate=spm, seed=seed), output="output_", form="form_")
    assert made.columns == ["doc_id", "text", "form", "output", "output_", "form_", "n_code_points", "prefix_chars", "middle_chars", "restored"]
    found = [tuple(r) for r in made.select("doc_id", "output_", "form_", "n_code_points", "prefix_chars", "middle_chars", "restored").collect()]
    told = [(k, *_plain(k, t, rate, spm, seed), t or "") for k, t in rows]
    assert sorted(found, key=repr) == sorted(told, key=repr)
    assert {x[2] for x in found} == ({"plain"} if rate == 0 else {"plain", "psm", "spm"})


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{DIR}/documents.parquet')")
    df, sql = queries.queries()["op13_fim"](spark, DIR), con.sql(queries.oracle_sql()["op13_fim"])
    assert df.columns == sql.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(sql.fetchall(), key=repr)


def test_nothing(spark):
    assert fim.restore(fim.transform(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_sentinels_that_could_mislead_are_refused(spark):
    with pytest.raises(ValueError, match="sentinels"):
        fim.transform(spark.createDataFrame([], "doc_id long, text string"), sentinels=("ab", "ba", "c"))
