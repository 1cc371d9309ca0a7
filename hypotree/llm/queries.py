"""The registered queries of this folder: each applies one operator to its whole table; SQL where it can be said in SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chunkstore, fim, hilbert, langid, ordermh, packing, pii, quality, simhash, topk, warc
from .common import held_out, table

JSON_VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    sharded = hilbert.shard_documents(docs, n_shards=40)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_chunkstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = chunkstore.write(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(JSON_VOCABULARY))
    if not chunkstore.verify_manifest(store).isEmpty():
        raise ValueError("the manifest doesn't match the recipes")
    return chunkstore.read(store).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path(JSON_VOCABULARY))


def op9_ordermh(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ordermh.edited_fingerprints(docs, keep=lambda edited: F.sha2(edited.cast("binary"), 256))
    return found.select(
        "doc_id", "n_chars", F.col("edited").alias("edited_sha256"), ordermh.as_text(F.col("fingerprint")).alias("fingerprint"), ordermh.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        ordermh.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), ordermh.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align.align(docs, public_tokenizers.path(JSON_VOCABULARY), public_tokenizers.path(PIECES), digest=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"), "n_shared")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]  # noqa: B023
    base, spans = pii.written(F.col("base")), pii.written(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), F.size("added").alias("n_added"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.restore(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(
        "doc_id", F.col("n_code_points").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_hilbert, op3_topk, op4_warc, op5_chunkstore, op6_langid, op7_simhash, op8_packing, op9_ordermh, op10_bpe, op11_align, op12_pii, op13_fim)}


#: Vectors that take no part are left out; the rest as whole numbers.
_TOP_K = """
WITH whole AS (
    SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, q.uid, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20"""

_WARC = """
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS payload FROM pages),
told AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS first FROM payloads)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM told"""


_FIM = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
drawn AS (
    SELECT *, CAST('0x' || s[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || s[9:16] AS BIGINT) % (n + 1) AS c2,
        CAST('0x' || s[17:24] AS BIGINT) % 100 AS d3, CAST('0x' || s[25:32] AS BIGINT) % 100 AS d4 FROM texts),
told AS (
    SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d3 >= 90 THEN 'plain' WHEN d4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS z FROM told)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || z || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || z || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM parts"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against brute force."""
    return {"op3_topk": _TOP_K, "op4_warc": _WARC, "op13_fim": _FIM}
