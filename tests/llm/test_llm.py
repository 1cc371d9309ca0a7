"""The operators of hypotree/llm against brute force, with nulls, empty and long texts, ties, repeated rows, extra columns and empty tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

from hypotree.llm import bpe, chunkstore, hilbert, langid, ordermh, packing, quality, queries, simhash, tokens, topk, warc
from hypotree.llm.common import held_out, ordered_rows, with_running_total

DIR, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
JSON, RANKS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string"
ODD = [
    (5, "The cat sat on the mat, and the dog sat on the rug.", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "en", "b"), (4, "word", "de", "a"), (5, "The cat sat on the mat, and the dog sat on the rug.", "en", "a"),
    (None, "no id here", "en", "a"), (6, "über été . a,b  c  d　e 漢字 🎉 1.5", "fr", "c"), (7, "long tail " * 9000, "en", "a"), (8, "###&&&!!!", None, "b"), (9, "x" * 5000, "en", None), (2**40, "Z\x00a <|endoftext|>", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, DOCS)
    return rows.select("*", F.lit(1).alias("score"), F.lit("x").alias("shard"), F.lit(2.0).alias("n_chars")).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(JSON)
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def _held(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def _u32(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


# shared helpers


def test_held_out(spark):
    rows = spark.createDataFrame([(i,) for i in [None, *range(-20, 50)]], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == _held(r.doc_id) for r in rows)


def test_running_total(spark):
    rows = spark.range(1000).select(F.xxhash64("id").alias("k"), "id").repartition(5)
    found = with_running_total(ordered_rows(rows, ["k", "id"], "t"), F.col("id"), "before").orderBy("k").collect()
    assert [r.before for r in found] == [0, *np.cumsum([r.id for r in found])[:-1].tolist()]


@pytest.mark.parametrize("clear", [10**9, 20])
def test_encoder_is_the_tokenizer(tokenizer, docs, clear):
    texts = [t or "" for _, t, *_ in ODD] + [", a", ".a", "a ,b", "x_,y", "é,z", "don't,'s.", "a\nb c\n d", " lead", "  x", "½,a"] + [r.text for r in docs.select("text").limit(60).collect()]
    encoder = tokens.tokenizer_encoder(JSON, max_entries=clear)
    for part in (texts, texts[::-1]):
        ids, sizes = encoder.encode(part)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [tokenizer(t) for t in part]


# 1


def test_quality(spark, odd, none):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    found = {r.doc_id: r for r in queries.op1_quality(spark, MIDDLE).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d in truth if found[d].held_out]
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    assert all(r.held_out == _held(d) for d, r in found.items())
    assert sum(found[d].predicted == truth[d] for d in held) >= 0.95 * len(held)
    model = quality.fit(docs, labels)
    scored = quality.score(odd, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id == 5}) == 1
    assert quality.score(none, model).isEmpty()
    assert quality.keep_good(odd, model, least=0.0).columns == odd.columns
    empty = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs.limit(5), empty).collect()} == {0.5}


def test_pool_is_the_same_in_parts():
    model = quality.word_vectors(["a b c, a b", "d e f a"], 16, 4, 100, 1, 2)
    texts = ["a b c " * 30_000, "", "a, b", "zzz " * 7]
    together = model.pool(texts)
    assert np.allclose(together, np.concatenate([model.pool([t]) for t in texts]), atol=1e-5)
    for text, pooled in zip(texts, together):
        own = model.vectors[[model.words.get(w) or model.words.get(quality.shape(w), 0) for w in quality.TOKEN.findall(text)]].astype(np.float64)
        n = max(1, len(own))
        told = np.concatenate([own.sum(0) / n, *((own[lag:] * own[:-lag]).sum(0) / n for lag in quality.LAGS)])
        assert np.allclose(pooled, told, atol=1e-4)


def test_quality_network_and_temperature(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = [r for r in docs.join(labels, "doc_id").where("text is not null").collect()]
    pooled = model.pool([r.text for r in rows])
    w1, b1, w2, b2 = model.layers
    for x, found in list(zip(pooled, model.scores(pooled)))[:50]:
        hidden = [math.tanh(v) for v in ((x - model.centre) / model.spread) @ w1 + b1]
        logit = sum(h * w for h, w in zip(hidden, w2[:, 0])) + b2[0]
        assert abs(found - 1 / (1 + math.exp(-max(-40, min(40, logit / model.temperature))))) < 1e-5
    held = [i for i, r in enumerate(rows) if _held(r.doc_id) and r.quality in (0, 1)]
    truth, logit = np.array([rows[i].quality for i in held]), model.logits(pooled[held])
    loss = lambda t: np.logaddexp(0, np.where(truth == 1, -logit, logit) / t).mean()
    assert loss(model.temperature) < 0.15
    noisy = quality.Model({}, np.zeros((1, 4), np.float32))
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4)).astype(np.float32)
    p = 1 / (1 + np.exp(-x[:, 0]))
    y = (rng.random(2000) < p).astype(int)
    quality.train(noisy, x[:1000], y[:1000], 48, 200, 7)
    found = noisy.scores(x[1000:])
    assert all(abs(found[cut].mean() - y[1000:][cut].mean()) < 0.12 for lo in (0.0, 0.25, 0.5, 0.75) if (cut := (found >= lo) & (found < lo + 0.25)).sum() > 100)


# 2


def test_hilbert_curve_is_a_curve(spark):
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=n)), ", ".join(f"c{i} int" for i in range(n)))
        found = hilbert.place_on_curve(cells, [F.col(f"c{i}") for i in range(n)], bits, "at").orderBy("at").collect()
        assert [r.at for r in found] == list(range(1 << n * bits))
        assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(found, found[1:]))


def test_hilbert_shards(spark, odd, none):
    for rows, shards in ((odd, 5), (odd, 40), (none, 4), (spark.read.parquet(f"{MIDDLE}/documents.parquet"), 40)):
        found = hilbert.shard_documents(rows, n_shards=shards).collect()
        assert len(found) == rows.count()
        sizes = collections.Counter(r.shard for r in found)
        assert all(0 <= s < shards for s in sizes)
        if found:
            assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
        for s in sizes:
            assert sorted(r.slot for r in found if r.shard == s) == list(range(sizes[s]))
    texts = {d: t for d, t, *_ in ODD}
    for r in hilbert.shard_documents(odd, n_shards=5).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


def test_hilbert_cells_keep_order_and_prune(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = docs.select("source", "lang").collect()
    for k, bounds in enumerate(hilbert.name_bounds(docs, ["source", "lang"], 5)):
        names = sorted(r[k].encode() for r in rows if r[k] is not None)
        first = {n: i for i, n in reversed(list(enumerate(names)))}
        cells = {}
        for n, i in first.items():
            cells.setdefault(i * 32 // len(names), []).append(n)
        assert [b.encode() for b in bounds] == sorted(min(c) for c in cells.values())
    low = hilbert.number_bounds(docs.select(F.octet_length("text").alias("size")), ["size"], 5)[0]
    assert low == sorted(low) and len(low) <= 31
    one = spark.createDataFrame([(None,), ("a",), ("b",), ("bb",), ("z",)], "x string").select("x", hilbert.cell(F.col("x"), ["b", "c"], 5).alias("c"))
    assert [r.c for r in one.collect()] == [0, 0, 10, 10, 21]
    sharded = hilbert.shard_documents(docs, n_shards=40).cache()
    ranges = {r.shard: r for r in hilbert.file_ranges(sharded, ["source", "size", "doc_id"]).collect()}
    found = collections.defaultdict(list)
    for r in sharded.collect():
        found[r.shard].append(r)
    for s, own in found.items():
        names = [r.source for r in own if r.source is not None]
        assert (ranges[s].rows, ranges[s].min_source, ranges[s].max_source) == (len(own), min(names), max(names))
        assert (ranges[s].min_size, ranges[s].max_size) == (min(r["size"] for r in own), max(r["size"] for r in own))
    sources = {r.source for own in found.values() for r in own if r.source is not None}
    opened = sum(r.min_source <= x <= r.max_source for x in sources for r in ranges.values())
    assert opened <= 0.6 * len(sources) * len(ranges)


# 3


@pytest.mark.parametrize("dim", [4, 64])
def test_topk(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, rng.integers(-3, 4, dim).astype(float).tolist()) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * dim), (303, [float("inf")] * dim), (304, [1.0]), (305, []), (20, [2.0] * dim), (7, rows[7][1]), (7, [3.0] * dim), (None, rows[0][1]), (360, [1e18] * dim)]
    found = collections.defaultdict(list)
    for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 20 == 0, shard_rows=(32, 32), block_rows=(5, 5), fan_in=2).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = [(i, [int(np.floor(64 * x)) for x in v] + [0] * (dim - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = collections.defaultdict(list)
    for q, a in whole:
        if q % 20 == 0:
            best = sorted((-min(max(sum(x * y for x, y in zip(a, b)), -(2**63) + 1), 2**63 - 1), i) for i, b in whole if i != q)[:20]
            want[q] += [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {q: sorted(x) for q, x in found.items()} == {q: sorted(x) for q, x in want.items()}


def test_topk_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(empty, F.col("vec_id") % 20 == 0).isEmpty()


# 4


def test_warc(spark):
    copied, long = "é" * 600, "y" * 200_000
    rows = [(1, "http://a/1", copied), (2, None, copied), (3, "http://a/\r\nX: y", copied), (3, "http://a/3", copied), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", long), (9, "u", long), (None, "u", copied), (None, "u", "z")]
    rows += [(100 + i, "u", f"page {i} " * 150) for i in range(60)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type int").repartition(3)
    folder = warc.new_path(spark, "t")
    for table in (100_000, 0):  # the broadcast and the shuffle join
        typed = warc.with_types(pages, small_table=table)
        manifest = warc.write_table(warc.write_archives(typed, folder, max_bytes=3000, sample_bytes=20_000).withColumn("base", F.lit(folder)), "m")
        found = warc.read_archives(manifest).collect()
        want = []
        for i, _, html in rows:
            raw = (html or "").encode()
            top = max((j for j, _, h in rows if j is not None and h == html), default=None) if len(raw) >= 1000 else i
            revisit = len(raw) >= 1000 and i != top
            want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None, b"" if revisit else raw))
        assert sorted(map(repr, want)) == sorted(repr((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload))) for r in found)
        assert manifest.count() > 3
    assert warc.round_trip(pages.limit(0)).isEmpty()


def test_warc_damage(tmp_path):
    import io

    record = warc.record_bytes(1, "u", b"payload" * 50, hashlib.sha1(b"payload" * 50).hexdigest(), None, False, "d")
    sink = io.BytesIO()
    writer = warc.ArchiveWriter(sink, [record] * 40)
    writer.add(record)
    writer.add(record)
    raw = sink.getvalue()
    assert list(warc.read_frames(io.BytesIO(raw), step=7)) == [record] * 2
    for broken in (raw[:-3], b"????" + raw[4:], raw[:9]):
        with pytest.raises(Exception):
            list(warc.read_frames(io.BytesIO(broken)))
    for bad in (record.replace(b"payloadpay", b"Payloadpay"), record[:-1], record.replace(b"WARC-Date", b"WARC-Xate"), record.replace(b"WARC/1.1", b"WARC/9.9")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


# 5


def test_chunk_store(spark, docs, odd, none, tokenizer):
    copies = docs.select("doc_id", "text").union(docs.select(F.col("doc_id") + 10_000, "text").limit(30))
    for rows in (copies.repartition(4), odd.select("doc_id", "text"), none.select("doc_id", "text")):
        store = chunkstore.write(rows, JSON)
        want = sorted(([r.doc_id, r.text] for r in rows.collect()), key=lambda x: (x[0] is not None, x[0]))
        found = chunkstore.read(store, with_ids=True).orderBy("at").collect()
        assert [r.doc_id for r in found] == [d for d, _ in want]
        ids = [tokenizer(t) + [2] for _, t in want]
        assert [r.n_tokens for r in found] == [len(x) for x in ids]
        if [d for d, _ in want].count(5) < 2 or rows is odd:
            assert sorted((bytes(r.ids), r.ids_crc32) for r in found) == sorted((_u32(x), zlib.crc32(_u32(x))) for x in ids)
        assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()][: len(found)]
        assert store.chunks.groupBy("digest").count().where("count > 1").isEmpty()
        assert chunkstore.verify_manifest(store).isEmpty()
        few = chunkstore.write(rows, JSON, small_table=-1)  # the shuffle in place of the broadcast
        assert few.chunks.select("digest").exceptAll(store.chunks.select("digest")).isEmpty() and few.chunks.count() == store.chunks.count()


def test_chunks_find_equal_passages():
    rng, numbers = np.random.default_rng(0), chunkstore.gear()
    shared = rng.integers(0, 50_000, 20_000)
    parts = [np.concatenate([rng.integers(0, 50_000, n), shared]) for n in (100, 777)]
    ids, bounds = np.concatenate(parts), np.array([0, len(parts[0]), len(parts[0]) + len(parts[1])])
    cuts = chunkstore.cut_points(ids, bounds, numbers)
    seen = [{p[a:b].tobytes() for a, b in zip([0, *c], c)} for p, c in zip(parts, cuts)]
    assert len(seen[0] & seen[1]) >= 0.8 * min(map(len, seen))
    for p, c in zip(parts, cuts):
        assert c[-1] == len(p) and all(0 < b - a <= 4096 for a, b in zip([0, *c], c))
        own = numbers[p & 0xFFFF]  # the hash, term by term
        for end in c[:-1]:
            total = sum(int(own[end - 1 - k]) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(16)) % (1 << 64)
            assert total >> (64 - 9) == 0 or (end - max([0, *[x for x in c if x < end]])) == 4096


def test_damaged_chunk_raises(spark):
    store = chunkstore.write(spark.createDataFrame([(1, "some text " * 50)], "doc_id long, text string"), JSON)
    good = store.own
    store.own = good.withColumn("own", F.transform("own", lambda x: x.withField("payload", F.lit(chunkstore.pack_ids(_u32([1, 2, 3]))))))
    with pytest.raises(Exception, match="damaged"):
        chunkstore.read(store).collect()
    store.own = good.withColumn("own", F.slice("own", 1, 0))
    with pytest.raises(Exception, match="missing"):
        chunkstore.read(store).collect()
    store.own = good.withColumn("digests", F.array_repeat(F.get("digests", F.lit(0)), 2))
    assert not chunkstore.verify_manifest(store).isEmpty()


# 6


def test_langid(spark, odd, none):
    found = queries.op6_langid(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in found)
    filters = langid.build(["the cat and the dog"] * 3 + ["der hund und die katze"] * 3, ["en"] * 3 + ["de"] * 3)
    got = langid.identify(odd, filters).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    assert langid.identify(none, filters).isEmpty()
    assert langid.keep_known(odd, filters).columns == odd.columns
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(none)).collect()} == {"und"}


def test_more_languages_than_a_mask_has_bits():
    rng = np.random.default_rng(4)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(30)] for _ in range(150)]
    told = [(" ".join(rng.choice(own, 40)), f"l{i:03}") for i, own in enumerate(words) for _ in range(4)]
    filters = langid.build([t for t, _ in told], [x for _, x in told])
    assert filters.masks[0].shape[0] == 3
    found, *_ = filters.predict([" ".join(rng.choice(own, 40)) for own in words])
    assert found == [f"l{i:03}" for i in range(150)]


def test_related_languages_keep_clear_texts():
    """Forty languages that share most words: the share among rivals falls, the hit rate by which the stage decides doesn't."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(4, 8)))
    common = [word() for _ in range(150)]
    own = {f"l{i:02d}": common + [word() for _ in range(60)] for i in range(40)}
    rows = [(" ".join(rng.choice(words, 60)), name) for name, words in own.items() for _ in range(30)]
    filters = langid.build(*map(list, zip(*rows)))
    asked = [(" ".join(rng.choice(words, 60)), name) for name, words in own.items()]
    found, scores, rates = filters.predict([t for t, _ in asked])
    assert [n for _, n in asked] == found
    assert scores.max() < 0.3 and rates.min() > 0.5
    _, _, strange = filters.predict([" ".join(word() for _ in range(60))])
    assert strange[0] < 0.3


def test_filters_hold_all_their_ngrams():
    texts, langs = ["alpha beta gamma", "alpha beta gamma", "alpha once", "delta epsilon", "delta epsilon"], ["a", "a", "a", "b", "b"]
    filters = langid.build(texts, langs)
    for text, lang in zip(texts, langs):
        window, n = langid.grams([text])
        held, common = filters.holding(window)
        assert n[0] == len(window) and (held[0] >> filters.langs.index(lang) & 1).all()
        assert (common[0] & ~held[0] == 0).all()
    raw = " alpha beta gamma ".encode()
    assert sorted(langid.grams(["Alpha -- beta, GAMMA"])[0].tolist()) == sorted(int.from_bytes(raw[i : i + 4], "little") for i in range(len(raw) - 3))


def test_langid_is_as_by_sets(spark):
    """Predictions and scores against plain sets of n-grams, which have no false positives."""
    rows = [r for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").where("text is not null and lang is not null").select("doc_id", "text", "lang").collect() if len(r.text) < 20_000]
    told, asked = [r for r in rows if not _held(r.doc_id)], [r for r in rows if _held(r.doc_id)][:150]
    filters = langid.build([r.text for r in told], [r.lang for r in told])
    counts = {lang: collections.Counter() for lang in filters.langs}
    for r in told:
        counts[r.lang].update(langid.grams([r.text])[0].tolist())
    rate = {lang: {g: n / c.total() for g, n in c.items() if n >= 2} for lang, c in counts.items()}
    most = collections.defaultdict(float)
    for own in rate.values():
        for g, x in own.items():
            most[g] = max(most[g], x)
    found, scores, _ = filters.predict([r.text for r in asked])
    for r, lang, score in zip(asked, found, scores):
        window = langid.grams([r.text])[0].tolist()
        share = [sum((g in counts[x]) * langid.RARE + (rate[x].get(g, 0) >= 0.05 * most[g] > 0) * (1 - langid.RARE) for g in window) / max(1, len(window)) for x in filters.langs]
        if not any(map(str.isalpha, r.text)):
            assert (lang, score) == ("und", 0)
        elif sum(share):
            assert abs(score - max(share) / sum(share)) < 2e-3
            assert share[filters.langs.index(lang)] >= max(share) - 1e-3


# 7


def _fingerprint(text: str | None) -> int:
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(fps: dict) -> dict:
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in fps}


def test_simhash(spark, docs, odd, none):
    rows = docs.select("doc_id", "text").union(odd.where("doc_id is not null").select(F.col("doc_id") + 5000, "text"))
    found = simhash.near_duplicates(rows.repartition(4)).collect()
    assert len(found) == rows.count()
    fps = {r.doc_id: _fingerprint(r.text) for r in rows.collect()}
    assert {r.doc_id: r.fp % 2**64 for r in found} == fps
    assert {r.doc_id: r.component_id for r in found} == _groups(fps)
    assert simhash.near_duplicates(none).isEmpty()
    left = simhash.keep_first(odd)
    assert left.columns == odd.columns and left.where("doc_id is null").count() == 1


def test_masks_cover_all_pairs():
    for level in range(3):
        masks = simhash.covering_masks(2, level)
        assert len(masks) == 7
        for a, b in itertools.combinations(range(64), 2):
            assert any(m & (1 << a | 1 << b) == 0 for m in masks)
    free = [2**64 - 1]
    for level in range(5):
        free = [f & ~m for f in free for m in simhash.covering_masks(2, level)]
    assert max(f.bit_count() for f in free) <= 7  # so a bucket of the last level has at most 128 fingerprints


def test_dense_groups_are_split_not_lost(spark):
    """One huge bucket: all fingerprints of 12 free bits, a chain beside them, and single ones."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**62))
    cloud = [centre ^ int(x) << 20 for x in rng.choice(4096, 900, replace=False)]
    chain = [int("1" * k, 2) << 1 for k in range(2, 60, 2)]
    single = [int(x) for x in rng.integers(-(2**62), 2**62, 100)]
    fps = {i: v for i, v in enumerate(dict.fromkeys(cloud + chain + single))}
    frame = spark.createDataFrame([(v,) for v in fps.values()], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, most=16, levels=12)).collect()}
    want = _groups({v: v % 2**64 for v in fps.values()})
    groups = lambda g: sorted(sorted(k for k in g if g[k] == r) for r in set(g.values()))
    assert groups({v: roots.get(v, v) for v in fps.values()}) == groups(want)


# 8


def test_packing(spark, docs, odd, none, tokenizer):
    for rows in (docs.select("doc_id", "text"), odd.where("doc_id <> 5 or doc_id is null"), none):
        found = packing.pack_documents(rows, JSON, per_partition=60).collect()
        by = collections.defaultdict(list)
        for r in found:
            by[r.sequence_id].append(r)
        for parts in by.values():
            parts.sort(key=lambda r: r.offset)
            assert [r.offset for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1].tolist()]
            assert sum(r.length for r in parts) <= 1024
        own = collections.defaultdict(list)
        for r in found:
            own[r.doc_id].append(r)
        assert len(own) == rows.count()
        for r in rows.collect():
            ids, at = tokenizer(r.text) + [2], 0
            for k, p in enumerate(sorted(own[r.doc_id], key=lambda p: p.piece)):
                assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(_u32(ids[at : at + p.length])))
                assert p.length == 1024 or k == 0
                at += p.length
            assert at == len(ids)
        if len(found) > 200:
            lengths = np.array([r.length for r in found])
            assert len(by) <= len(packing.best_fit(lengths, 1024)[2]) * 1.03 + 1
    twice = packing.pack_documents(odd, JSON)
    assert twice.where("doc_id = 5").count() == 2


def test_packed_sequences(spark, docs, tokenizer):
    few = docs.select("doc_id", "text").limit(20)
    rows = {r.doc_id: tokenizer(r.text) + [2] for r in few.collect()}
    packed = packing.pack_documents(few, JSON)
    found = packing.sequences(few, packed, JSON).collect()
    assert sorted(np.concatenate([np.frombuffer(r.ids, "<u4") for r in found]).tolist()) == sorted(x for ids in rows.values() for x in ids)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, cap = int(rng.integers(1, 9)), 30
        lengths = rng.integers(1, cap + 1, n)
        bins, offsets, room = packing.best_fit(lengths, cap)
        assert [cap - lengths[bins == b].sum() for b in range(len(room))] == room.tolist()

        def fewest(rest, rooms):
            if not rest:
                return len(rooms)
            tries = {r for r in rooms if r >= rest[0]}
            best = [fewest(rest[1:], sorted([*rooms[: rooms.index(r)], *rooms[rooms.index(r) + 1 :], r - rest[0]])) for r in tries]
            return min([*best, fewest(rest[1:], sorted([*rooms, cap - rest[0]]))])

        least = fewest(sorted(lengths.tolist(), reverse=True), [])
        assert packing.lower_bound(lengths, cap) <= least <= len(room)


# 9


def _order_minhash(text: str, k: int = 12) -> dict[int, int]:
    import xxhash

    raw, items, cells = text.encode(), [], collections.defaultdict(list)
    if not raw:
        return {}
    seen: collections.Counter = collections.Counter()
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    for at in range(max(1, len(raw) - k + 1)):
        h = (xxhash.xxh64_intdigest(raw[at : at + k], seed=42) & (2**63 - 1)) >> 31
        if seen[h]:  # xxhash64(long, int): the first value's hash seeds the second's
            first = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=42)
            g = xxhash.xxh64_intdigest(seen[h].to_bytes(4, "little"), seed=signed(first) % 2**64) >> 32
        else:
            g = h
        seen[h] += 1
        items.append((g, at + 1))
    for g, at in sorted(items)[:384]:
        cells[g & 63].append((g >> 6, at))
    out = {}
    for cell, its in cells.items():
        ranks = [r for r, _ in sorted(sorted(its)[:2], key=lambda x: (x[1], x[0]))]
        seed = 42
        for r in ranks:
            seed = xxhash.xxh64_intdigest(r.to_bytes(8, "little"), seed=seed)
        out[cell] = seed >> 39
    return out


def test_order_minhash_fingerprint(spark, docs, odd):
    rows = docs.select("doc_id", "text").limit(60).union(odd.select("doc_id", "text")).union(spark.createDataFrame([(-1, "ab " * 3000), (-2, "abcdefghijk"), (-3, "abcdefghijklm")], "doc_id long, text string"))
    for r in ordermh.with_fingerprint(rows, F.col("text"), "fp").collect():
        assert {x >> 25: x & (1 << 25) - 1 for x in r.fp} == _order_minhash(r.text or ""), r.doc_id


def _likeness(a: dict, b: dict) -> float:
    return sum(a[c] == b[c] for c in a.keys() & b.keys()) / len(a.keys() | b.keys()) if a or b else 1.0


def test_order_minhash_query(spark, docs, odd, none, tmp_path):
    """All columns of the query against brute force, repeated rows and null ids included."""
    few = docs.select("doc_id", "text").limit(60)
    again = few.limit(9).union(few.limit(4)).union(spark.createDataFrame([(None, "no id"), (None, "no id"), (None, None), (0, "zero"), (70_000, "short"), (70_001, "\u00e9" * 9)], "doc_id long, text string"))
    one = spark.createDataFrame([(3, "only one text here")], "doc_id long, text string")
    for number, rows in enumerate((few, odd.select("doc_id", "text"), again, none.select("doc_id", "text"), one)):
        rows.write.parquet(str(tmp_path / str(number) / "documents.parquet"))
        found = queries.op9_ordermh(spark, str(tmp_path / str(number))).collect()
        source = [(r.doc_id, r.text or "") for r in ordermh.next_in_order(rows.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text")), ["doc_id", "h", "text"]).orderBy(F.asc_nulls_first("doc_id"), "h").collect()]
        want = []
        for (doc, text), (_, after) in zip(source, source[1:] + source[:1]):
            cut = len(text) // 4
            edited = text[: len(text) - cut] + after[:cut]
            a, b, c = map(_order_minhash, (text, edited, after))
            told = ["".join(f"{cell << 25 | x[cell]:08x}" for cell in sorted(x)) for x in (a, b)]
            want.append((str(doc), len(text), hashlib.sha256(edited.encode()).hexdigest(), *told, round(_likeness(a, b), 9), round(_likeness(a, c), 9)))
        assert sorted(want) == sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found), number


def test_order_minhash_edits(spark):
    near = queries.op9_ordermh(spark, DIR).where("n_chars > 100").agg(F.avg("near_edited"), F.avg("near_next"), F.min("near_next"), F.max("near_edited")).first()
    assert near[0] > near[1] + 0.2 and near[2] >= 0 and near[3] <= 1


# 10


def test_bpe(spark, docs, odd, none):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = sorted(repr((r.doc_id, len(x := encoding.encode_ordinary(r.text or "")), hashlib.sha256(_u32(x)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())) for r in rows.collect())
    assert sorted(repr(tuple(r)) for r in bpe.digests(rows, RANKS).collect()) == want
    apart = bpe.decode(bpe.encode(odd, RANKS), RANKS)
    assert sorted(bytes(r.decoded) for r in apart.collect()) == sorted((t or "").encode() for _, t, *_ in ODD)
    assert bpe.digests(none, RANKS).isEmpty()


def test_bpe_merges_leftmost_lowest():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aab": 258, b"bc": 259, b"abc": 260, b"aaaa": 261}
    vocabulary = bpe.Vocabulary(ranks)

    def slow(word: bytes) -> list[int]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if found is None:
                return [ranks[p] for p in parts]
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]

    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcd"), int(n))) for n in rng.integers(2, 140, 300)]
    ids, sizes = vocabulary.encode_words(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[ranks[w.encode()]] if w.encode() in ranks else slow(w.encode()) for w in words]
    long = ["".join(rng.choice(list("abcd"), 600)), "a" * 700, "ab" * 333, "aab" * 250 + "c", "".join(rng.choice(list("ab"), 500, p=[0.9, 0.1]))]
    assert [vocabulary._merge_long(w.encode()) for w in long + words] == [slow(w.encode()) for w in long + words]
    for _ in range(40):  # vocabularies in which merging makes pairs of lower rank
        parts = {bytes(rng.choice(list(b"abc"), int(n)).tolist()) for n in rng.integers(2, 6, 25)}
        mixed = {bytes([b]): 1000 + b for b in range(256)} | {p: int(k) for p, k in zip(sorted(parts), rng.permutation(len(parts)))}
        ranks, odd_words = mixed, ["".join(rng.choice(list("abc"), 60)) for _ in range(20)]
        vocabulary = bpe.Vocabulary(mixed)
        assert [vocabulary._merge_long(w.encode()) for w in odd_words] == [slow(w.encode()) for w in odd_words]
    with pytest.raises(ValueError):
        vocabulary.decode(np.array([99_999]))


def test_bpe_of_a_very_long_match():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    word = "".join(np.random.default_rng(2).choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 200_000))
    ids, sizes = bpe.loaded(RANKS)[0].encode_words([word])
    assert ids.tolist() == tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(word) and sizes.tolist() == [len(ids)]
