"""Hand-sized cases and properties of the engine's operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hypotree import defaults as D
from hypotree.operators import board, embed, lenses, refine, requests, scoring, similarity, tree
from hypotree.plans import queries
from hypotree.sources import tables as S
from hypotree.sources.sinks import write_events
from hypotree.sources.tables import World
from hypotree.streaming import streams

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def world(spark):
    return World(spark, SMALL)


@pytest.fixture(scope="module")
def middle(spark):
    return World(spark, MIDDLE)


def _evidence(spark, rows):
    full = [(n, e, c, 1 if c > 0 else -1, dt.datetime(2024, 1, 1, 0, e), s) for n, e, c, s in rows]
    return spark.createDataFrame(full, "node_id long, event_id long, cos double, stance int, observed_at timestamp, source string")


def _nodes(spark, rows):
    return spark.createDataFrame(rows, "id long, theory_id long, parent_id long, score double")


def _map(df, *cols):
    return {r[0]: tuple(r[1:]) if len(cols) > 2 else r[1] for r in df.select(*cols).collect()}


def test_lenses_by_hand(spark):
    evidence = _evidence(spark, [(1, 1, 0.2, "a"), (1, 2, 0.6, "b"), (1, 3, -0.4, "a"), (2, 1, -0.3, "a"), (3, 2, 0.5, "b")])
    quality = spark.createDataFrame([("a", 0.5), ("b", 0.75)], "source string, r double")
    assert _map(lenses.source_reliability(evidence, quality), "node_id", "severity") == pytest.approx({1: 1 - (0.1 + 0.45) / 0.8, 3: 0.25})
    assert _map(lenses.confirmation_bias(evidence), "node_id", "severity") == pytest.approx({1: 1 / 3, 2: 0, 3: 1})
    assert _map(lenses.incentive_analysis(evidence), "node_id", "severity") == pytest.approx({1: 0, 3: 1})
    nodes = _nodes(spark, [(1, 0, None, 0.5), (2, 0, 1, 0.5), (3, 0, 1, 0.5)])
    assert _map(lenses.competing_hypotheses(nodes, evidence), "node_id", "severity") == {3: 0.0, 2: 1.0}
    child = _evidence(spark, [(1, 1, -0.4, "a"), (1, 2, 0.4, "a"), (2, 1, 0.3, "a"), (2, 2, 0.3, "a"), (2, 3, 0.9, "a")])
    assert _map(lenses.logical_coherence(nodes, child), "node_id", "severity") == {2: 0.5}
    events = spark.createDataFrame([(1, "a", "Same  text"), (2, "b", "same text "), (3, "b", "other")], "id long, source string, body string")
    planted = _evidence(spark, [(1, 1, 0.3, "a"), (1, 3, 0.1, "b")])
    assert _map(lenses.denial_deception(planted, events), "node_id", "severity") == pytest.approx({1: 0.75})
    rated = spark.createDataFrame([(1, "en", 0.9), (2, "xx", 0.5)], "id long, lang string, score double")
    priors = spark.createDataFrame([("en", 0.8)], "lang string, p double")
    assert _map(lenses.base_rate(rated, priors), "node_id", "severity") == pytest.approx({1: 0.125, 2: 0.0})


def test_no_evidence_is_insufficient(spark, world):
    registry = world.registry
    found = spark.createDataFrame([], "node_id long, lens string, severity double")
    verdicts = board.judge(board.dispatch(world.nodes.limit(1), registry), found, registry)
    assert [r.verdict for r in verdicts.collect()] == ["insufficient"] * 7
    assert board.board_summary(verdicts, registry).first().resilience is None
    assert board.worst_lens(verdicts).count() == 0


def test_seven_verdicts_in_range(world):
    verdicts = board.run_board(world)
    assert verdicts.groupBy("node_id").count().where("count <> 7").isEmpty()
    assert verdicts.where("severity < 0 or severity > 1").isEmpty()
    scores = scoring.score_nodes(world.nodes, world.evidence, world.source_quality, verdicts, world.registry)
    assert scores.where("confidence < 0 or confidence > 1 or plausibility < 0 or plausibility > 1 or novelty < 0 or novelty > 1").isEmpty()


def test_depths_of_the_fixture(spark):
    counts = {r.depth: r["count"] for r in tree.tree_depth(World(spark, MIDDLE).nodes).groupBy("depth").count().collect()}
    assert counts == {0: 5, 1: 15, 2: 45, 3: 35}


def test_prune_is_closed_and_idempotent(spark):
    nodes = _nodes(spark, [(1, 0, None, 0.0), (2, 0, 1, 0.1), (3, 0, 2, 0.9), (4, 0, 1, 0.2), (5, 0, 4, None)])
    once = tree.prune(nodes)
    assert {r.id for r in once.collect()} == {1, 4}
    assert {r.id for r in tree.prune(once).collect()} == {1, 4}


def test_audit_finds_cycles_and_orphans(spark):
    nodes = _nodes(spark, [(1, 0, None, 0.5), (2, 0, 3, 0.5), (3, 0, 2, 0.5), (4, 0, 99, 0.5)])
    assert {(r.kind, r.node_id) for r in tree.budget_audit(nodes).collect()} == {("unreachable", 2), ("unreachable", 3), ("unreachable", 4)}


def test_expansion_keeps_the_budgets(world):
    grown = tree.expand_to_budget(world.nodes.where("parent_id is null"), world.events)
    as_nodes = grown.select(F.col("node_id").alias("id"), "theory_id", "parent_id")
    assert tree.budget_audit(as_nodes).isEmpty()
    assert grown.where("event_id is not null").groupBy("theory_id", "event_id").count().where("count > 1").isEmpty()
    assert grown.where(f"depth > {D.DEPTH}").isEmpty() and grown.count() > 5


def test_deep_trees_and_long_ids(spark):
    base = 10_000_000_000_000
    chain = [(base + i, 0, base + i - 1 if i else None, 0.5 if i != 120 else 0.1) for i in range(150)]
    nodes = _nodes(spark, chain + [(1, 1, None, 0.9), (2, 1, 1, 0.9)])
    assert tree.tree_depth(nodes).agg(F.max("depth")).first()[0] == 149
    sizes = {r.id: r["size"] for r in tree.subtree_rollup(nodes).collect()}
    assert sizes == {base + i: 150 - i for i in range(150)} | {1: 2, 2: 1}
    assert {r.id for r in tree.prune(nodes).collect()} == {base + i for i in range(120)} | {1, 2}
    assert {(r.id, r.position) for r in tree.preorder(nodes).collect()} == {(base + i, i + 1) for i in range(150)} | {(1, 1), (2, 2)}


def test_rollup_of_grown_trees(world):
    grown = tree.expand_to_budget(world.nodes.where("parent_id is null"), world.events)
    nodes = grown.select(F.col("node_id").alias("id"), "theory_id", "parent_id", F.coalesce("cos", F.lit(1.0)).alias("score"))
    rows = {r.id: r.parent_id for r in nodes.collect()}
    sizes = {i: 0 for i in rows}
    for i in rows:
        while i is not None:
            sizes[i] += 1
            i = rows[i]
    assert {r.id: r["size"] for r in tree.subtree_rollup(nodes).collect()} == sizes


def test_a_batch_that_runs_again(spark):
    state = streams.Parts(spark, "again", "k long, n long")
    for batch in (0, 1, 1, 2, 2):  # as after failures
        before = state.read(batch)
        state.write(spark.createDataFrame([(batch, before.count())], "k long, n long"), batch)
    assert sorted(map(tuple, state.read().collect())) == [(0, 0), (1, 1), (2, 2)]


def test_ingest_keeps_late_rows(spark, tmp_path):
    rows = spark.read.parquet(f"{SMALL}/events.parquet")
    order = rows.select("event_id").collect()
    for k in range(6):  # more files than a batch takes, the newest first, with rows that repeat
        part = rows.where(F.col("event_id") >= order[-1].event_id * (5 - k) // 6)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    found = streams.ingest_stream(spark, str(tmp_path))
    assert found.count() == found.select("id").distinct().count() == rows.count()


def test_lsh_recall(spark):
    nodes = World(spark, MIDDLE).nodes
    exact = {(r.theory_a, r.theory_b): r.n_pairs for r in similarity.link_theories(nodes).collect()}
    near = {(r.theory_a, r.theory_b): r.n_pairs for r in similarity.link_lsh(nodes).collect()}
    assert near.keys() <= exact.keys() and all(n <= exact[k] for k, n in near.items())
    assert sum(near.values()) >= 0.9 * sum(exact.values())


def test_nearest_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0]), (4, [0.0, 1.0]), (5, None)], "id long, embedding array<double>")
    found = similarity.nearest(rows.where("id = 2"), rows, 2).orderBy("rank").collect()
    assert [(r.b, r.cos) for r in found] == [(2, 1.0), (3, 1.0)]


def test_blocks_do_not_matter(world):
    one = similarity.link_evidence(world.nodes, world.events, block=4096)
    many = similarity.link_evidence(world.nodes, world.events, block=16)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_ingest_twice_is_ingest_once(world):
    rows = world.events.select("id", "source", "observed_at")
    once = S.ingest(rows.where("id % 3 <> 0"), rows, "2024-02-01")
    assert S.ingest(once, rows, "2024-02-02").exceptAll(once).isEmpty()
    assert once.count() == rows.count()


def test_events_by_day(spark, world, tmp_path):
    write_events(world.events, str(tmp_path / "events"))
    back = spark.read.parquet(str(tmp_path / "events"))
    assert back.count() == world.events.count() and "day" in back.columns


def test_partial_rescore_is_a_full_one(world):
    verdicts = board.run_board(world)
    full = scoring.score_nodes(world.nodes, world.evidence, world.source_quality, verdicts, world.registry).select("node_id", "confidence")
    old = full.select("node_id", F.lit(-1.0).alias("confidence"), F.lit(1).cast("long").alias("scored_at"))
    merged = refine.rescore_merge(old, world, world.theories, 2)
    assert merged.select("node_id", "confidence").exceptAll(full).isEmpty() and merged.count() == full.count()


def test_bursts_and_late_events_by_hand(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    events = spark.createDataFrame([(1, "a", t(0)), (2, "a", t(1, 29)), (3, "a", t(3)), (4, "b", t(1))], "id long, source string, observed_at timestamp")
    assert sorted((r.source, r.n) for r in refine.event_bursts(events).collect()) == [("a", 1), ("a", 2), ("b", 1)]
    arrivals = spark.createDataFrame([(1, t(0), 1), (2, t(1), 2), (3, t(0, 50), 3), (4, t(0, 49), 4)], "id long, observed_at timestamp, arrival_seq long")
    assert [r.id for r in refine.late_events(arrivals).collect()] == [4]


def test_bad_responses(spark, world):
    rows = [(1, "base_rate", '{"verdict": "pass", "severity": 0.1, "rationale": "r"}'), (2, "base_rate", "{"), (3, "zodiac", '{"verdict": "pass", "severity": 0.1}'), (4, "base_rate", '{"verdict": "hm", "severity": 0.1}'),
            (5, "base_rate", '{"verdict": "pass", "severity": 2}'), (6, "base_rate", '{"verdict": "insufficient"}'), (7, "base_rate", None)]
    found = _map(requests.parse_verdicts(spark.createDataFrame(rows, "request_id long, lens string, body string"), world.registry), "request_id", "reason")
    assert found == {1: None, 2: "bad_json", 3: "unknown_lens", 4: "unknown_verdict", 5: "bad_severity", 6: None, 7: "bad_json"}


def test_embedding_has_length_one(world):
    found = embed.embed(world.events, F.col("body")).select(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x).alias("n"), F.size("embedding").alias("d"))
    assert found.where("abs(n - 1) > 1e-9 or d <> 64").isEmpty()


def test_plans(world):
    plan = lambda df: df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    listed = plan(S.list_events(world.events, 5))
    assert "TakeOrderedAndProject" in listed and "BroadcastNestedLoopJoin" not in listed
    assert "WindowGroupLimit" in plan(tree.expand_level(tree.frontier(world.nodes), world.evidence))
    assert "CartesianProduct" not in plan(queries.flagship(world.spark, SMALL))


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.count() == 40 and "confidence" in found.columns
