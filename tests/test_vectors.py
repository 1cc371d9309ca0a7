"""The index of lists, and vectors that are odd."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hypotree.operators import similarity

NODES = "id long, theory_id long, embedding array<double>"


def _clustered(spark, n=20_000, clusters=200, dim=64, hot=0.0, noise=0.05):
    """Vectors about random centres; a share of `hot` about one of them."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    own = np.where(rng.random(n) < hot, 0, rng.integers(0, clusters, n))
    x = centres[own] + noise * rng.normal(size=(n, dim))
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "theory_id": rng.integers(0, 9, n), "embedding": x.tolist()}), NODES).repartition(4)


def _pairs(df):
    return {(r.theory_a, r.theory_b): (r.n_pairs, r.max_cos) for r in df.collect()}


def test_index_prunes_and_recalls(spark):
    nodes = _clustered(spark)
    nodes = nodes.cache()
    nodes.count()
    began = time.time()
    exact = _pairs(similarity.link_theories(nodes, 0.6))
    middle = time.time()
    index = similarity.fit_lists(nodes, 0.6)
    found = _pairs(similarity.link_lsh(nodes, 0.6, index=index))
    ended = time.time()
    every = sum(n for n, _ in exact.values())
    assert sum(n for n, _ in found.values()) >= 0.9 * every and all(n <= exact[k][0] for k, (n, _) in found.items())
    assert similarity.comparisons(nodes, 0.6, index) <= 0.1 * 20_000 * 20_000 / 2
    assert ended - middle < middle - began
    nodes.unpersist()


def test_all_probes_are_exact_and_hot_lists_are_split(spark):
    nodes = _clustered(spark, 1500, 12, 16, hot=0.4, noise=0.2)
    exact = _pairs(similarity.link_theories(nodes, 0.5))
    index = similarity.fit_lists(nodes, 0.5, list_size=100)
    whole = index._replace(probes=len(index.centroids))
    assert _pairs(similarity.link_lsh(nodes, 0.5, index=whole)) == exact
    assert _pairs(similarity.link_lsh(nodes, 0.5, index=whole, block=64)) == exact  # many tiles a list
    few = _pairs(similarity.link_lsh(nodes, 0.5, index=index, block=64))
    assert few == _pairs(similarity.link_lsh(nodes, 0.5, index=index)) and all(n <= exact[k][0] for k, (n, _) in few.items())


def test_index_of_few_equal_or_no_vectors(spark):
    assert similarity.link_lsh(spark.createDataFrame([], NODES)).collect() == []
    same = spark.createDataFrame([(i, i % 2, [1.0, 2.0]) for i in range(300)] + [(300, 0, None)], NODES)
    found = similarity.link_lsh(same, index=similarity.fit_lists(same, 0.25, list_size=10)).collect()
    assert [(r.theory_a, r.theory_b, r.n_pairs, r.max_cos) for r in found] == [(0, 1, 150 * 150, 1.0)]


ODD = [(1, 0, [1.0, 0.0]), (2, 1, [0.9, 0.1]), (3, 0, [float("nan"), 1.0]), (4, 1, [float("inf"), 1.0]), (5, 0, [1.0, 0.0, 0.0]), (6, 1, None), (7, 0, []), (8, 1, [None, 1.0]), (9, 1, [0.8, 0.1, 0.2]), (10, 0, [0.0, 0.0])]


def test_odd_vectors(spark):
    """Vectors that hold nulls, NaN or infinite values take no part; those of other lengths are in no pair with one another."""
    nodes = spark.createDataFrame(ODD, NODES)
    found = {(r.a, r["rank"], r.b) for r in similarity.nearest(nodes, nodes, 2).collect()}
    assert {a for a, *_ in found} == {1, 2, 5, 9, 10} and {(a, b) for a, _, b in found if a != b} == {(1, 2), (2, 1), (5, 9), (9, 5), (10, 1), (10, 2)}
    linked = [(r.theory_a, r.theory_b, r.n_pairs) for r in similarity.link_theories(nodes, 0.5).collect()]
    assert linked == [(0, 1, 2)]
    assert [(r.theory_a, r.theory_b, r.n_pairs) for r in similarity.link_lsh(nodes, 0.5).collect()] == linked
    assert {(r.a, r.b) for r in similarity.similar_nodes(nodes, 0.5).collect()} == {(1, 2), (5, 9)}
    events = nodes.select("id", "embedding", F.lit("s").alias("source"), F.lit(None).cast("timestamp").alias("observed_at"))
    assert {(r.node_id, r.event_id) for r in similarity.link_evidence(nodes.where("id < 5"), events).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    pairs = nodes.alias("x").join(nodes.alias("y"), F.expr("x.id + 1 = y.id")).select(F.col("x.id").alias("a"), F.col("x.embedding").alias("va"), F.col("y.embedding").alias("vb"))
    told = {r.a: r.cos for r in similarity.with_distances(pairs, "va", "vb").collect()}
    assert told[1] == pytest.approx(0.9 / np.hypot(0.9, 0.1)) and all(told[a] is None or np.isnan(told[a]) for a in (2, 3, 4, 5, 6, 7, 8, 9))


def test_tiles_out_of_reach_are_left_out(spark, monkeypatch):
    """Exact, with the pairs compared counted: by nearness far fewer than all."""
    nodes = _clustered(spark, 6000, 40, 32, hot=0.3, noise=0.02)
    compared = []
    allowed = similarity.list_tiles
    monkeypatch.setattr(similarity, "list_tiles", lambda *a: (out := allowed(*a), compared.append(out.mean()))[0])
    pruned = _pairs(similarity.link_theories(nodes, 0.8, block=256))
    assert compared and compared[0] < 0.3  # the share of tiles that remain
    assert pruned == _pairs(similarity.link_theories(nodes, 0.8, block=8192))
    events = nodes.select("id", "embedding", F.lit("s").alias("source"), F.lit(None).cast("timestamp").alias("observed_at"))
    some = nodes.where("id % 50 = 0")
    one, many = (similarity.link_evidence(some, events, 0.8, block=b) for b in (8192, 256))
    assert one.count() == many.count() > 0 and one.exceptAll(many).isEmpty()


def test_ties_are_bounded_in_a_tile():
    cos = np.array([[1.0, 1.0, 1.0, 0.5], [0.1, 0.9, 0.1, 0.1]])
    ids = np.array([9, 3, 5, 1])
    assert similarity._row_best(cos, 2, ids).tolist() == [[False, True, True, False], [False, True, False, True]]


@pytest.mark.parametrize("block", [2048, 16])
def test_closest_earlier_within_theories(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, 0 if i % 3 == 0 else i % 40, rng.normal(size=4).tolist()) for i in range(240)]
    found = {r.a: r.cos for r in similarity.closest_earlier(spark.createDataFrame(rows, NODES), block=block).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    want = {i: max((float(unit[i] @ unit[j]) for j, s, _ in rows if s == t and j < i), default=-1.0) for i, t, _ in rows}
    assert found == pytest.approx({i: c for i, c in want.items() if c > 0}, abs=2e-9)


def test_nearest_leaves_tiles_out_and_stays_exact(spark, monkeypatch):
    nodes = _clustered(spark, 5000, 40, 16, hot=0.3, noise=0.02)
    compared = []
    allowed = similarity.list_tiles
    monkeypatch.setattr(similarity, "list_tiles", lambda *a: (out := allowed(*a), compared.append(out.mean()))[0])
    some = nodes.where("id % 25 = 0")
    for other in (None, "theory_id"):
        one, many = (similarity.nearest(some, nodes, 4, other_group=other, block=b) for b in (8192, 200))
        assert many.count() == 4 * 200 and one.exceptAll(many).isEmpty()
    assert len(compared) == 2 and max(compared) < 0.4


@pytest.mark.parametrize("noise, block", [(0.03, 50), (1.0, 50), (0.03, 2048)])
def test_vectors_travel_to_few_tiles(spark, monkeypatch, noise, block):
    """However small the pieces, with lists (little noise) and without; vectors of other lengths stay apart."""
    nodes = _clustered(spark, 3000, 30, 8, noise=noise).union(spark.createDataFrame([(9000 + i, 0, [1.0, float(i)]) for i in range(5)], NODES))
    events = nodes.select("id", "embedding", F.lit("s").alias("source"), F.lit(None).cast("timestamp").alias("observed_at"))
    dealt, compared, came = similarity.blocks, similarity._by_pieces, spark.sparkContext.accumulator(0)

    def counted(a, b, *rest):
        came.add(a.num_rows + b.num_rows)
        return compared(a, b, *rest)

    monkeypatch.setattr(similarity, "_by_pieces", counted)
    monkeypatch.setattr(similarity, "blocks", lambda n, m, tiles, most: dealt(n, m, tiles, 800))
    found = {(r.node_id, r.event_id) for r in similarity.link_evidence(nodes, events, 0.9, block=block).collect()}
    assert 2 * 3005 <= came.value <= 2 * 5 * 3005  # four blocks of a side, or five where lists fill them unevenly
    rows = nodes.collect()
    want = set()
    for own in ([r for r in rows if r.id < 9000], [r for r in rows if r.id >= 9000]):
        x, ids = np.array([r.embedding for r in own]), [r.id for r in own]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want |= {(ids[i], ids[j]) for i, j in np.argwhere(np.abs(np.round(x @ x.T, 9)) >= 0.9)}
    assert found == want


def test_links_leave_a_tile_piece_by_piece():
    """A task holds the links of one piece, not of its tile."""
    rows, calls = pa.table({"id": range(10), "list": [0, 0, 1, 1, 1, 1, 2, 2, -1, -1]}), []

    def tile(a, b):
        calls.append((a["id"].to_pylist(), b["id"].to_pylist()))
        return pa.table({"n": [len(calls)]})

    found = similarity._by_pieces(rows, rows, tile, 6, None)
    assert next(found)["n"].to_pylist() == [1] and len(calls) == 1
    assert sum(1 for _ in found) == 3 and [(len(a), len(b)) for a, b in calls] == [(6, 6), (6, 4), (4, 6), (4, 4)]
    calls.clear()
    near = np.array([[True, False, True], [False, False, False], [False, True, False]])
    assert sum(1 for _ in similarity._by_pieces(rows, rows, tile, 3, near)) == len(calls) == 5
    assert sorted(calls) == [([0, 1], [0, 1, 6]), ([0, 1], [7]), ([6, 7], [2, 3, 4]), ([6, 7], [5]), ([8, 9], [8, 9])]
