"""Walks over trees: sound and unsound keys, deep chains, large trees, against walks in plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hypotree.operators import tree

NODES = "id long, theory_id long, parent_id long, score double"


def _plain(rows):
    """id -> (depth, size, best, mean, kept) of the nodes that a root reaches, by following parents one at a time."""
    one = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1], r[3] is not None, r[3] or 0)):
        one.setdefault(r[0], r)
    up = {}
    for i in one:
        chain, at = [], i
        while at in one and at not in chain:
            chain.append(at)
            at = one[at][2]
        if at is None:
            up[i] = chain
    below = {i: [] for i in up}
    for i, chain in up.items():
        for a in chain:
            below[a].append(one[i][3])
    out = {}
    for i, chain in up.items():
        scores = [s for s in below[i] if s is not None]
        kept = all(one[a][2] is None or (one[a][3] or 0) >= 0.2 for a in chain)
        out[i] = (len(chain) - 1, len(below[i]), max(scores, default=None), sum(scores) / len(scores) if scores else None, kept)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_walks_on_random_tables(spark, seed):
    """Parents at random, with cycles, missing parents, repeated ids and null scores."""
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        parent = None if rng.random() < 0.08 else rng.choice([rng.randrange(max(i, 1)), rng.randrange(130), i])
        rows.append((i, rng.randrange(3), parent, rng.choice([None, rng.random()])))
    rows += [(i, 0, rng.randrange(120), 0.5) for i in rng.sample(range(120), 9)] + [(7, 0, None, 0.1)] * 2
    told = _plain(rows)
    nodes = spark.createDataFrame(rows, NODES).repartition(3)
    assert {r.id: r.depth for r in tree.tree_depth(nodes).collect()} == {i: x[0] for i, x in told.items()}
    rolled = {r.id: (r["size"], r.max_score, r.mean_score) for r in tree.subtree_rollup(nodes).collect()}
    assert rolled.keys() == told.keys() and all(rolled[i] == (x[1], pytest.approx(x[2]), pytest.approx(x[3])) for i, x in told.items())
    assert {r.id for r in tree.prune(nodes).collect()} == {i for i, x in told.items() if x[4]}
    paths = {r.id: [int(x) for x in r.path.split("/")] for r in tree.tree_paths(nodes).collect()}
    assert {i: len(p) - 1 for i, p in paths.items()} == {i: x[0] for i, x in told.items()} and all(p[-1] == i for i, p in paths.items())
    audit = {(r.kind, r.node_id) for r in tree.budget_audit(nodes, 3, 200).collect()}
    ids = {r[0] for r in rows}
    assert audit == {("unreachable", i) for i in ids - told.keys()} | {("too_deep", i) for i, x in told.items() if x[0] > 3}


def test_repeated_id_in_a_cycle_ends_and_is_reported(spark):
    nodes = spark.createDataFrame([(1, 0, None, 0.5), (1, 0, 2, 0.5), (2, 0, 1, 0.5)], NODES)
    limits = {k: spark.conf.get(f"spark.sql.cteRecursion{k}Limit") for k in ("Level", "Row")}
    assert tree.budget_audit(nodes).collect() == []
    assert [tuple(r) for r in tree.key_audit(nodes).collect()] == [("repeated", 1)]
    assert {k: spark.conf.get(f"spark.sql.cteRecursion{k}Limit") for k in limits} == limits


def test_key_audit(spark):
    rows = [(1, 0, None, 1.0), (2, 0, 4, 1.0), (3, 0, 2, 1.0), (4, 0, 3, 1.0), (5, 0, 4, 1.0), (6, 0, 6, 1.0), (7, 0, 99, 1.0), (8, 1, 1, 1.0), (9, 0, 1, 1.0), (9, 0, 1, 1.0), (None, 0, 1, 1.0)]
    found = sorted((r.kind, r.node_id) for r in tree.key_audit(spark.createDataFrame(rows, NODES)).collect())
    assert found == sorted([("cycle", 2), ("cycle", 3), ("cycle", 4), ("cycle", 6), ("no_parent", 7), ("other_theory", 8), ("repeated", 9), ("no_id", None)], key=lambda x: x[0])


def test_a_long_chain_takes_a_row_for_each_node(spark, monkeypatch):
    from hypotree.sources import sinks

    n, written = 100_000, []
    counted = sinks.counting
    monkeypatch.setattr(sinks, "counting", lambda df, counts: (out := counted(df, counts), written.append(out[1]["all"]))[0])
    nodes = spark.range(n).select("id", F.lit(0).cast("long").alias("theory_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(0.5).alias("score"))
    rolled = tree.subtree_rollup(nodes)
    assert rolled.where(f"size <> {n} - id or max_score <> 0.5 or mean_score <> 0.5").isEmpty() and rolled.count() == n
    assert written == [n] * 18  # once, and for each of the 17 doublings


def test_a_million_nodes_over_150_levels(spark):
    per = 7000
    level = F.expr(f"id div {per}")
    nodes = spark.range(150 * per).select("id", F.lit(0).cast("long").alias("theory_id"), F.when(level > 0, (level - 1) * per + F.expr(f"(id * 7919) % {per}") % 1 + F.expr("id % 3")).cast("long").alias("parent_id"), F.lit(1.0).alias("score"))
    found = tree.walk(nodes)
    assert found.where("reached").groupBy("depth").count().where(f"count <> {per}").isEmpty() and found.where("reached").count() == 150 * per


def test_nothing_and_only_roots(spark):
    none = spark.createDataFrame([], NODES)
    assert tree.tree_depth(none).collect() == [] and tree.subtree_rollup(none).collect() == [] and tree.key_audit(none).collect() == []
    roots = spark.createDataFrame([(1, 0, None, None), (2, 0, None, 0.1)], NODES)
    assert sorted((r.id, r["size"], r.max_score, r.mean_score) for r in tree.subtree_rollup(roots).collect()) == [(1, 1, None, None), (2, 1, 0.1, 0.1)]
