"""The pipeline's stages on small tables."""

from __future__ import annotations

import corpus_pipeline
from hypotree.llm import simhash

DIR = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(name)
        if k < 3:
            assert docs.columns == columns
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            assert kept <= {r.doc_id for r in before.select("doc_id").collect()}
        if k == 0:
            good = [d for d, q in labels.items() if q == 1]
            assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d, q in labels.items() if q == 0) <= 0.1 * len(labels)
        if k == 2:  # against brute force in test_nearcopies
            assert kept <= {r.component_id for r in simhash.near_duplicates(before).select("component_id").collect()}
    assert docs.select("doc_id").distinct().count() == len(kept)


def test_stages_on_odd_rows(spark):
    """Each stage alone: no row that it should keep goes, and none is kept that has no language or is a later copy."""
    long = "A long text of many different words, number {}. "
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words of a text", "en", "a", 20), (3, "!!!", None, "a", 3), (4, "".join(long.format(i) for i in range(4000)), "en", "a", 0)]
    rows += [(5, rows[-1][1], "en", "b", 0), (6, rows[-1][1] + "An end.", "en", "c", 0), (6, "other words in a row that repeats its id", "en", "c", 0)]
    kept = {"simhash_near_dedup": [None, 1, 3, 4], "best_fit_packing": [None, 1, 2, 3, 4, 5, 6, 6]}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as _gone", "2 as _score", "3 as _lang")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, DIR)
        ids = [r.doc_id for r in found.where("piece = 0" if "piece" in found.columns else "true").select("doc_id").collect()]
        if name in kept:
            assert sorted(ids, key=lambda x: x or 0) == kept[name]
        else:
            assert set(ids) <= {r[0] for r in rows} and (name != "language_id" or not {1, 2, 3} & set(ids))
        assert stage(spark, docs.limit(0), DIR).count() == 0
