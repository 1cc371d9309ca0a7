"""The near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
import pytest
from hypotree.llm import nearcopies, simhash

MIDDLE = "/root/testdata/sf0.01"


def _set(text, words=5):
    parts = (text or "").lower().split()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def _pairs(texts):
    sets = {i: _set(t) for i, t in texts.items()}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if 4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
            yield a, b


def _groups(texts, pairs):
    root = {i: i for i in texts}
    for a, b in pairs:
        one, two = root[a], root[b]
        if one != two:
            root = {i: min(one, two) if r in (one, two) else r for i, r in root.items()}
    return root


def _want(spark, docs):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    near = list(_pairs(texts))
    links = near + [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    return near, _groups(texts, links)


def test_stage_leaves_no_near_copy(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    near, want = _want(spark, docs)
    kept = {r.doc_id for r in corpus_pipeline.first_of_near_duplicates(spark, docs, MIDDLE).select("doc_id").collect()}
    assert near and kept == set(want.values())
    assert not any(a in kept and b in kept for a, b in near)


@pytest.mark.parametrize("most, sample", [(128, 20_000), (4, 0)])
def test_groups_with_hot_shingles(spark, most, sample):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    licence = [rng.choice(words) for _ in range(60)]
    texts = []
    for k in range(40):
        own = [rng.choice(words) for _ in range(rng.choice([0, 3, 40, 200]))]
        texts.append(own + licence)
        for _ in range(2):
            copy = list(own + licence)
            for _ in range(rng.randint(0, 1 + len(copy) // 50)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    texts += [["one", "two"], ["one", "two"], [], ["one"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    _, want = _want(spark, docs)
    assert {r.doc_id: r.component_id for r in nearcopies.groups(docs, most=most, sample=sample).collect()} == want


def test_prefix_size():
    for n in range(1, 200):
        least = min(k for k in range(n + 1) if 5 * k >= 4 * n)
        assert nearcopies.prefix_size(n) == n - least + 1
    assert nearcopies.prefix_size(0) == 0


def _chains(rng, clusters, size, changed):
    """Clusters of texts that share most words and all lists, where no two of different families are similar enough."""
    words = [f"w{i}" for i in range(4000)]
    for _ in range(clusters):
        base = [rng.choice(words) for _ in range(120)]
        for k in range(size):
            own = list(base)
            for at in rng.sample(range(120), changed):
                own[at] = rng.choice(words)
            yield own
            if k % 3 == 0:
                yield [*own, rng.choice(words)]


def _made(lists):
    return [(i, " ".join(t)) for i, t in enumerate(lists)]


@pytest.mark.parametrize("most", [128, 3])
def test_forests_keep_every_link_and_make_no_row_for_each_pair(spark, monkeypatch, most):
    """Groups of near misses: links are those of brute force; candidates have fewer rows than the lists have members."""
    texts = _made(_chains(random.Random(3), 3, 24, 3))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    seen, old = [], nearcopies.candidate_forest

    def counted(members, *args):
        found = old(members, *args)
        seen.append((found.count(), members.count(), members.select("sig").distinct().count()))
        return found

    monkeypatch.setattr(nearcopies, "candidate_forest", counted)
    _, want = _want(spark, docs)
    assert {r.doc_id: r.component_id for r in nearcopies.groups(docs, most=most).collect()} == want
    rows, members, sets = seen[0]
    assert sets > 20 and rows < members and (most == 3 or rows < 3 * sets)


def test_similar_forest_against_brute_force():
    """All pairs of a cell, with groups known before, of long and short sets; and cells in which only parts meet."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(t) for t in _chains(rng, 4, 12, 2)]
    words = [f"w{i}" for i in range(30_000)]
    for n in (2046, 2100, 2600, 5000):
        base = [rng.choice(words) for _ in range(n)]
        texts += [" ".join(base), " ".join(base[: n - n // 9]), " ".join(base[n // 3 :])]
    sets = [_set(t) for t in texts]
    near = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    for cross in (False, True):
        root = [i if i > 2 else 0 for i in range(len(texts))]
        own = [i % 2 for i in range(len(texts))]
        cell = pa.table({"x": [0] * len(texts), "y": [int(cross)] * len(texts), "sig": range(len(texts)), "root": root, "own": own, "text": [t.encode() for t in texts]})
        found = [(r["a"], r["b"]) for r in nearcopies.similar_forest(cell, 5, nearcopies.LEAST).to_pylist()]
        allowed = {(a, b) for a, b in near if not cross or own[a] != own[b]}
        nodes = {i: None for i in range(len(texts))}
        known = [(0, 1), (0, 2)]
        assert set(found) <= near and 0 < len(found) < len(texts)
        assert _groups(nodes, [*known, *found]) == _groups(nodes, [*known, *allowed])
    maps = nearcopies._Bitmaps([nearcopies.bitmap(nearcopies.shingle_set(t.encode(), 5, nearcopies._WordHashes())) for t in texts], np.array([len(x) for x in sets]), nearcopies.LEAST)
    for a, b in near:
        assert b in maps.near(a, np.arange(a + 1, len(texts)))
    assert sum(len(maps.near(i, np.arange(i + 1, len(texts)))) for i in range(len(texts))) < len(texts) ** 2 / 4
