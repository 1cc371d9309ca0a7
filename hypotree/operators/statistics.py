"""Sums of evidence that verdicts and scores are made of: a row for each node and source, to which new evidence is added.

All that the lenses and the plausibility need of evidence is in these sums, so evidence is read once for all of them, and when
more arrives only that is read: its own sums are worked out and added.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hypotree import defaults as D
from hypotree.operators.linked import SCALE, link_sums
from hypotree.operators.similarity import link_evidence
from hypotree.sources.sinks import checkpointed

SUMS = ("n", "n_support", "s", "c", "planted")


class Statistics(NamedTuple):
    """sums: (node_id, source, n, n_support, s, c, planted): links, supporting ones, cos of support, of contradiction (as positive numbers), of
    support in texts that several sources share. overlap: (node_id, both, against): support that bears on the parent too, and how much of it contradicts the parent.
    """

    sums: DataFrame
    overlap: DataFrame


def planted_events(events: DataFrame) -> DataFrame:
    """(event_id) of events (id, source, hash) whose text, normalised, two or more sources share."""
    shared = events.groupBy("hash").agg(F.count_distinct("source").alias("sources")).where("sources >= 2").select("hash")
    return events.join(shared, "hash", "left_semi").select(F.col("id").alias("event_id"))


def of_evidence(evidence: DataFrame, nodes: DataFrame, planted: DataFrame) -> Statistics:
    """The statistics of evidence. Those of parts add up to those of the whole if all links of an event are in one part."""
    told = evidence.join(planted.select("event_id", F.lit(True).alias("is_planted")), "event_id", "left")
    cos, support = F.col("cos"), F.col("stance") == 1
    total = lambda when, x: F.sum(F.when(when, x).otherwise(0.0))
    sums = told.groupBy("node_id", "source").agg(
        F.count("*").alias("n"), F.count_if(support).alias("n_support"), total(support, cos).alias("s"), total(~support, -cos).alias("c"), total(support & F.col("is_planted"), cos).alias("planted")
    )
    child = evidence.where(support).select("node_id", "event_id").join(nodes.where("parent_id is not null").select(F.col("id").alias("node_id"), "parent_id"), "node_id")
    parent = evidence.select(F.col("node_id").alias("parent_id"), "event_id", "stance")
    overlap = child.join(parent, ["parent_id", "event_id"]).groupBy("node_id").agg(F.count("*").alias("both"), F.count_if(F.col("stance") == -1).alias("against"))
    return Statistics(sums, overlap)


def of_links(nodes: DataFrame, events: DataFrame, planted: DataFrame, tau: float = D.TAU) -> Statistics:
    """The statistics of the evidence between nodes and events, without its rows: of_evidence(link_evidence(nodes, events)) by tiles.

    Rows that repeat an id meet each other in `overlap`; so nodes and events with repeated ids, and only they, go by rows there.
    """
    alone = lambda df: df.groupBy("id").agg((F.count("*") == 1).alias("alone"))
    marks = planted.select(F.col("event_id").alias("id"), F.lit(True).alias("planted")).distinct()
    told = events.select("id", "source", "embedding").join(marks, "id", "left").join(alone(events), "id", "left")
    told = checkpointed(told.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("planted", "alone")}))
    own = checkpointed(nodes.select("id", "parent_id", "embedding").join(alone(nodes), "id", "left").withColumn("alone", F.coalesce("alone", F.lit(False))))
    found = checkpointed(link_sums(own.withColumn("parent_id", F.when(F.col("alone"), F.col("parent_id"))), told, "source", tau))
    cos = [(F.sum(c) / SCALE).alias(c) for c in ("s", "c", "planted")]
    sums = found.where("n is not null").groupBy("node_id", "source").agg(F.sum("n").alias("n"), F.sum("n_support").alias("n_support"), *cos)
    overlap = found.where("both is not null").select("node_id", "both", "against")
    timed = told.withColumn("observed_at", F.lit(None).cast("timestamp"))
    events_again, nodes_again = timed.where("not alone"), own.where("not alone")
    if not events_again.isEmpty():
        rows = checkpointed(link_evidence(own, events_again, tau))
        overlap = overlap.unionByName(of_evidence(rows, own.where("alone"), planted).overlap)
    if not nodes_again.isEmpty():
        family = nodes_again.select("id").union(nodes_again.select("parent_id")).distinct()
        rows = checkpointed(link_evidence(own.join(family, "id", "left_semi"), timed, tau))
        overlap = overlap.unionByName(of_evidence(rows, nodes_again, planted).overlap)
    return Statistics(sums, overlap.groupBy("node_id").agg(F.sum("both").alias("both"), F.sum("against").alias("against")))


def added(*parts: Statistics) -> Statistics:
    sums = reduce(DataFrame.unionByName, [p.sums for p in parts]).groupBy("node_id", "source").agg(*[F.sum(c).alias(c) for c in SUMS])
    overlap = reduce(DataFrame.unionByName, [p.overlap for p in parts]).groupBy("node_id").agg(F.sum("both").alias("both"), F.sum("against").alias("against"))
    return Statistics(sums, overlap)


def of_nodes(stats: Statistics, nodes: DataFrame) -> Statistics:
    """The statistics of the given nodes (id) alone."""
    own = nodes.select(F.col("id").alias("node_id"))
    return Statistics(*[x.join(own, "node_id", "left_semi") for x in stats])


def node_facts(nodes: DataFrame, stats: Statistics, source_quality: DataFrame, priors: DataFrame) -> DataFrame:
    """(node_id, plausibility, and a column of severity for each built-in lens) of all nodes, which are whole families of siblings.

    The same values as by lenses.py and scoring.plausibility() over the evidence itself.
    """
    r, many = F.col("r"), F.col("n_support")
    per = stats.sums.join(source_quality, "source", "left").groupBy("node_id").agg(
        F.sum("n").alias("n"), F.sum("n_support").alias("t"), F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("planted").alias("planted"), F.sum(F.when(r.isNotNull(), F.col("s"))).alias("rated"),
        F.coalesce(F.sum(F.col("s") * r), F.lit(0.0)).alias("sr"), F.coalesce(F.sum(F.col("c") * r), F.lit(0.0)).alias("cr"), F.sum(many * many).alias("q"), F.count_if(many > 0).alias("k"),
    )
    rows = nodes.select(F.col("id").alias("node_id"), "theory_id", "parent_id", "lang", "score").join(per, "node_id", "left").join(stats.overlap, "node_id", "left").join(priors, "lang", "left")
    rows = rows.withColumns({"x": F.round(F.coalesce("c", F.lit(0.0)), 6), "p": F.coalesce("p", F.lit(0.5))})
    family = Window.partitionBy("theory_id", "parent_id")
    concentration = (F.col("q") / (F.col("t") * F.col("t")) - 1 / F.col("k")) / (1 - 1 / F.greatest("k", F.lit(2)))
    severity = {
        "source_reliability": 1 - F.try_divide("sr", "rated"),
        "confirmation_bias": F.greatest(2 * F.col("t") - F.col("n"), F.lit(0)) / F.col("n"),
        "denial_deception": F.try_divide("planted", "s"),
        "competing_hypotheses": F.when(F.count("*").over(family) > 1, F.percent_rank().over(family.orderBy("x"))),
        "incentive_analysis": F.when(F.col("k") == 1, 1.0).when(F.col("k") > 1, concentration),
        "logical_coherence": F.try_divide("against", "both"),
        "base_rate": F.abs(F.col("score") - F.col("p")) / F.greatest(F.col("p"), 1 - F.col("p")),
    }
    support, against = (F.coalesce(c, F.lit(0.0)) for c in ("sr", "cr"))
    return rows.select("node_id", ((support + 1) / (support + against + 2)).alias("plausibility"), *[v.cast("double").alias(k) for k, v in severity.items()])
