"""Ranks and bursts over ranges, against windows over whole groups."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hypotree.operators import refine, scoring


@pytest.mark.parametrize("values", [3, 400])
def test_ranks_of_a_large_theory_with_ties(spark, values):
    rng = random.Random(values)
    rows = [(i, 0 if i % 3 else i % 5, rng.randrange(values) / values) for i in range(3000)]
    nodes = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, theory_id long")
    scores = spark.createDataFrame([(i, c) for i, _, c in rows], "node_id long, confidence double")
    joined = nodes.withColumnRenamed("id", "node_id").join(scores, "node_id")
    by, then = (Window.partitionBy("theory_id").orderBy(*o) for o in ([F.desc("confidence")], [F.desc("confidence"), "node_id"]))
    want = joined.select("theory_id", "node_id", "confidence", F.rank().over(by).alias("rank"), F.dense_rank().over(by).alias("dense_rank"), F.round(F.col("confidence") - F.lead("confidence").over(then), 6).alias("margin"))
    found = scoring.rank_hypotheses(nodes, scores)
    assert found.columns == want.columns and sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_no_window_over_a_whole_theory(spark):
    nodes = spark.range(10).select("id", F.lit(1).cast("long").alias("theory_id"))
    plan = scoring.rank_hypotheses(nodes, nodes.select(F.col("id").alias("node_id"), (F.col("id") / 10).alias("confidence")))
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert "windowspecdefinition(theory_id" in text and all("part" in x.split("RowFrame")[0] for x in text.split("windowspecdefinition(theory_id")[1:])


@pytest.mark.parametrize("gap", ["90 minutes", "10 minutes"])
def test_bursts_are_session_windows(spark, gap):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("aaaaab"), start + dt.timedelta(minutes=rng.randrange(40_000) if rng.random() < 0.3 else rng.randrange(900))) for _ in range(2500)]
    rows += [("c", start), ("c", start), ("d", start), ("d", start + dt.timedelta(minutes=90)), ("d", start + dt.timedelta(minutes=269)), (None, start), ("a", None)]
    events = spark.createDataFrame(rows, "source string, observed_at timestamp").repartition(4)
    grouped = events.groupBy(F.session_window("observed_at", gap).alias("w"), "source").agg(F.count("*").alias("n"), F.max("observed_at").alias("end"))
    want = grouped.where("w is not null").select("source", F.col("w.start").alias("start"), "end", "n")
    found = refine.event_bursts(events, gap)
    assert sorted(map(tuple, found.select("source", "start", "end", "n").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
