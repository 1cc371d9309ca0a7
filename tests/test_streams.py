"""Streams over many batches, with files in any order, rows that repeat, and batches that run again, against the same in one go."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hypotree.operators import board, refine, scoring
from hypotree.plans import queries
from hypotree.sources.tables import World
from hypotree.streaming import streams

SMALL = "/root/testdata/sf0.001"


def _shuffled(spark, folder, files=12, repeat=False, seed=1):
    """The tables of SMALL; its events by time in so many files, in an order that has nothing to do with time."""
    for name in ("documents", "embeddings", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    ids = sorted(r.event_id for r in events.select("event_id").collect())
    order = list(range(files))
    random.Random(seed).shuffle(order)
    for k in order:
        low, high = ids[len(ids) * k // files], ids[min(len(ids) * (k + 1) // files, len(ids) - 1)]
        part = events.where((F.col("event_id") >= low) & ((F.col("event_id") < high) | F.lit(k == files - 1)))
        part = part.unionByName(events.where(F.col("event_id") % 50 == k)) if repeat else part
        part.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return str(folder)


def _rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("slide", [None, "15 minutes"])
def test_feed_counts_every_row_in_any_order(spark, tmp_path, slide):
    path = _shuffled(spark, tmp_path)
    found = streams.feed(spark, path, "1 hour", slide)
    once = queries.queries()["feed_stream_sliding" if slide else "feed_stream_windows"](spark, SMALL)
    assert _rows(found.windows.withColumn("start", F.unix_micros("start"))) == _rows(once)
    changes = found.changes.collect()
    assert max(r.batch for r in changes) >= 2 and any(r.correction for r in changes)
    told = {}
    for r in sorted(changes, key=lambda r: r.batch):
        assert r.correction or (r.start, r.event_type) not in told  # a window that had no such rows when it closed may first be told by a correction
        told[r.start, r.event_type] = r.n
    assert told == {(r.start, r.event_type): r.n for r in found.windows.collect()}


def test_refine_stream_over_many_batches_is_the_board(spark, tmp_path):
    path = _shuffled(spark, tmp_path, repeat=True)
    w, whole = World(spark, SMALL), World(spark, SMALL)
    for name in ("events", "nodes", "labels", "theories"):
        getattr(w, name)
    w.path = path  # of the stream's files; the tables are the same
    verdicts = board.run_board(whole)
    full = scoring.score_nodes(whole.nodes, whole.evidence, whole.source_quality, verdicts, whole.registry)
    assert _rows(streams.refine_stream(w)) == _rows(full)


def test_evidence_state_over_many_batches(spark, tmp_path):
    path = _shuffled(spark, tmp_path)
    assert _rows(streams.evidence_state(World(spark, path))) == _rows(queries.queries()["evidence_state_stream"](spark, SMALL))


def test_ingest_reads_only_ranges_it_touches(spark, tmp_path, monkeypatch):
    """Forty files in order of id, so ten batches; each reads earlier ids of its own ranges only."""
    for k in range(40):
        rows = spark.range(k * 1000, k * 1000 + 1100).select(F.col("id").alias("event_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), F.lit("x").alias("event_type"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    read, before = [], streams.SeenIds.earlier
    monkeypatch.setattr(streams.SeenIds, "earlier", lambda self, buckets, batch: (out := before(self, buckets, batch), read.append(out.count()))[0])
    found = streams.ingest_stream(spark, str(tmp_path), span=1024)
    assert found.count() == found.select("id").distinct().count() == 40_100
    assert len(read) == 10 and max(read) <= 3 * 1024


def test_parts_are_folded_and_replaced(spark):
    state = streams.Parts(spark, "again", "k long, n long", streams.summed("k"))
    for batch in [*range(70), 69, 69, 63]:  # the last ones again, as after failures
        state.write(spark.createDataFrame([(batch % 3, 1), (batch % 3, 1)], "k long, n long"), batch)
        if batch in (0, 7, 8, 64):
            assert sum(r.n for r in state.read(batch + 1).collect()) == 2 * (batch + 1)
            assert len(state._folders(0, batch + 1)) == {0: 1, 7: 1, 8: 2, 64: 2}[batch]
    assert sorted(map(tuple, state.read().collect())) == [(0, 48), (1, 46), (2, 46)]
    assert sum(r.n for r in state.read(5).collect()) == 10


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    """Bytes of the parts of the statistics don't grow with the batches before."""
    import os

    w = World(spark, SMALL)
    sizes = []
    original = streams.Parts.write

    def write(self, df, batch):
        original(self, df, batch)
        if "evidence-state" in self.path:
            folder = f"{self.path}/0/{batch}".removeprefix("file://")
            sizes.append(spark.read.parquet(folder).count())
            assert os.path.isdir(folder)

    streams.Parts.write = write
    try:
        path = _shuffled(spark, tmp_path)
        streams.evidence_state(World(spark, path))
    finally:
        streams.Parts.write = original
    assert len(sizes) >= 3 and max(sizes) <= w.nodes.count()


def test_rescoring_reads_no_evidence(spark):
    """Statistics kept, one theory touched: the same scores as in full, and the old evidence isn't read."""
    from hypotree.operators import statistics

    w = World(spark, SMALL)
    full = scoring.score_nodes(w.nodes, w.evidence, w.source_quality, board.run_board(w), w.registry).select("node_id", "confidence")
    late = w.evidence.where("event_id % 3 = 0").join(w.node_rows.where("theory_id = 2").select(F.col("id").alias("node_id")), "node_id", "left_semi")
    kept = statistics.Statistics(*[spark.createDataFrame(x.collect(), x.schema) for x in statistics.of_evidence(w.evidence.join(late.select("node_id", "event_id"), ["node_id", "event_id"], "left_anti"), w.node_rows, w.planted)])
    fresh = statistics.of_evidence(late, w.node_rows, w.planted)
    other = World(spark, SMALL)
    other.__dict__["evidence"] = None  # reading it would fail
    old = full.select("node_id", F.lit(-1.0).alias("confidence"), F.lit(1).cast("long").alias("scored_at"))
    touched = refine.affected_theories(w.theories, w.node_rows, late)
    assert [r.id for r in touched.collect()] == [2]
    merged = refine.rescore_merge(old, other, touched, 2, statistics.added(kept, fresh))
    theory = {r.id: r.theory_id for r in w.node_rows.collect()}
    want = {r.node_id: r.confidence for r in full.collect()}
    for r in merged.collect():
        assert r.confidence == (pytest.approx(want[r.node_id], abs=1e-6) if theory[r.node_id] == 2 else -1.0)


def test_board_from_statistics_is_the_lenses(spark):
    w = World(spark, "/root/testdata/sf0.01")
    from hypotree.operators.lenses import BUILT_IN

    told = {(r.node_id, r.lens): (r.verdict, r.severity) for r in board.run_board(w).collect()}
    for name in BUILT_IN:
        for r in board.one_lens(w, name).collect():
            verdict, severity = told[r.node_id, name]
            assert severity == (pytest.approx(r.severity, abs=2e-6) if r.severity is not None else None) and verdict == r.verdict
    plausible = {r.node_id: r.plausibility for r in scoring.plausibility(w.nodes, w.evidence, w.source_quality).collect()}
    assert {r.node_id: r.plausibility for r in w.facts.collect()} == pytest.approx(plausible)
