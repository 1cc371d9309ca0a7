"""Sums of links by tiles against those over the rows of evidence."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hypotree.operators import linked, statistics
from hypotree.operators.similarity import link_evidence
from hypotree.plans import queries
from hypotree.sources.tables import World

SMALL = "/root/testdata/sf0.001"


def _by(df, *keys):
    return {tuple(r[k] for k in keys): pytest.approx(tuple(r[c] for c in sorted(df.columns) if c not in keys), abs=1e-9) for r in df.collect()}


def _same(one, other):
    for keys, x, y in ((("node_id", "source"), one.sums, other.sums), (("node_id",), one.overlap, other.overlap)):
        assert _by(x, *keys) == {k: v.expected for k, v in _by(y, *keys).items()} != {}


def _repeated(w):
    """Events with a second row under another source, nodes with a second row, parents missing or of their own, times unknown."""
    events = w.events.withColumn("source", F.when(F.col("id") % 9 != 0, F.col("source")))
    again = events.where("id % 7 = 1").withColumn("source", F.lit("other")).withColumn("embedding", F.transform("embedding", lambda x: -x))
    moved = F.when(F.col("id") % 35 == 0, F.col("id")).when(F.col("id") % 45 == 0, -1).otherwise(F.col("parent_id"))
    nodes = w.nodes.withColumn("parent_id", moved)
    return nodes.unionByName(nodes.where("id % 20 = 0")), events.unionByName(again)


@pytest.mark.parametrize("tiles, most", [(64, 1 << 16), (1, 37)])
def test_sums_of_tiles(spark, monkeypatch, tiles, most):
    w = World(spark, SMALL)
    sums = linked.link_sums
    monkeypatch.setattr(statistics, "link_sums", lambda *a: sums(*a, tiles=tiles, most=most))
    monkeypatch.setattr(linked, "STRIP", 16)
    for nodes, events in ((w.nodes, w.events), _repeated(w)):
        _same(statistics.of_links(nodes, events, w.planted), statistics.of_evidence(link_evidence(nodes, events), nodes, w.planted))


def test_blocks_grow_with_their_tables():
    for n, m in ((400, 1600), (20_000, 80_000), (120_000, 480_000), (0, 5), (5, 0)):
        p, q = linked.blocks(n, m)
        assert p * q <= 100 and n <= p << 16 and m <= q << 16
    p, q = linked.blocks(1 << 20, 1 << 20)
    assert p == q == 16


@pytest.mark.parametrize("name", ["query_theories", "schema_audit", "scan_theory_tables", "worst_lens", "board_run", "board_summary", "board_queue", "theory_detail", "lens_profile", "board_panel", "confidence", "calibration_scores", "theory_confidence", "calibration_bins", "rank_hypotheses"])
def test_no_rows_of_evidence(spark, monkeypatch, name):
    monkeypatch.setattr(World, "evidence", property(lambda self: pytest.fail("reads a row for each link")))
    assert queries.queries()[name](spark, SMALL).count()


def test_history_of_links(spark, monkeypatch):
    from hypotree.operators import scoring

    w = World(spark, SMALL)
    want = scoring.confidence_history(w.evidence, w.source_quality)
    monkeypatch.setattr(linked, "STRIP", 16)
    sums = linked.link_sums
    for tiles, most in ((64, 1 << 16), (1, 37)):
        monkeypatch.setattr(scoring, "link_sums", lambda *a: sums(*a, tiles=tiles, most=most))
        assert _by(scoring.history_of_links(w.nodes, w.events, w.source_quality).fillna(-9.0), "node_id", "hour") == {k: v.expected for k, v in _by(want.fillna(-9.0), "node_id", "hour").items()} != {}


def test_history_writes_no_rows_of_evidence(spark, monkeypatch):
    monkeypatch.setattr(World, "evidence", property(lambda self: pytest.fail("reads a row for each link")))
    assert queries.queries()["confidence_history"](spark, SMALL).count()


def _best(df, k):
    """The k best of each node, by (cos, event id)."""
    found = {}
    for r in df.where("stance = 1").collect():
        found.setdefault(r.node_id, []).append((-r.cos, r.event_id))
    return {n: sorted(x)[:k] for n, x in found.items()}


@pytest.mark.parametrize("tiles, most", [(64, 1 << 16), (64, 37), (1, 1 << 16)])
def test_best_links(spark, monkeypatch, tiles, most):
    """Against the rows of evidence, with ties, repeated rows and vectors of zeros; a tile gives a node k rows at most."""
    monkeypatch.setattr(linked, "STRIP", 16)
    monkeypatch.setattr(linked, "WIDE", 8)
    w = World(spark, SMALL)
    twins = w.events.withColumn("id", -F.col("id"))
    zero = w.events.limit(3).withColumn("id", F.col("id") + 10_000).withColumn("embedding", F.transform("embedding", lambda x: F.lit(0.0)))
    for nodes, events in ((w.nodes, w.events), (_repeated(w)[0], w.events.unionByName(twins).unionByName(zero))):
        for k, tau in ((1, 0.15), (3, 0.15), (4, 0.0), (1000, 0.3)):
            found = linked.best_links(nodes, events, k, tau, tiles=tiles, most=most).collect()
            want = _best(link_evidence(nodes, events, tau), k)
            told = spark.createDataFrame(found, "node_id long, event_id long, cos double, stance int")
            assert _best(told, k) == want != {}
            if most > 37:  # one tile
                assert len(found) <= k * nodes.count()


def test_no_best_links_of_nothing(spark):
    w = World(spark, SMALL)
    for nodes, events in ((w.nodes.limit(0), w.events), (w.nodes, w.events.limit(0))):
        assert linked.best_links(nodes, events, 3).collect() == []


@pytest.mark.parametrize("name", ["expand_level", "render_theory_requests", "render_lens_requests", "new_evidence"])
def test_best_links_write_no_rows_of_evidence(spark, monkeypatch, name):
    monkeypatch.setattr(World, "evidence", property(lambda self: pytest.fail("reads a row for each link")))
    assert queries.queries()[name](spark, SMALL).count()


def test_new_links(spark):
    """As new_evidence() of all evidence, with nodes scored at different times or never, and events without a time."""
    from hypotree.operators import refine

    w = World(spark, SMALL)
    events = w.events.withColumn("observed_at", F.when(F.col("id") % 6 != 0, F.col("observed_at")))
    hours = F.expr("timestamp'2024-01-01 06:00:00' + make_interval(0, 0, 0, 0, cast(id % 40 as int))")
    scored = w.node_rows.where("id % 15 <> 0").select(F.col("id").alias("node_id"), F.when(F.col("id") % 25 != 0, hours).alias("scored_at"))
    evidence = link_evidence(w.nodes, events)
    want = refine.new_evidence(evidence, scored)
    found = refine.new_links(w.nodes, events, scored)
    assert 0 < want.count() == found.count() < evidence.count()
    assert found.where("observed_at is null").count() and found.exceptAll(want.select(found.columns)).isEmpty()
