"""The seven lenses: (node_id, severity) aggregations over evidence. No denominator: severity null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hypotree.functions.expressions import text_hash
from hypotree.sources.tables import World, copied_texts

Lens = Callable[[World], DataFrame]


def source_reliability(evidence: DataFrame, source_quality: DataFrame) -> DataFrame:
    """1 - the mean quality of the supporting sources, weighted by cos."""
    weighed = evidence.where("stance = 1").join(source_quality, "source")
    return weighed.groupBy("node_id").agg((1 - F.sum(F.col("cos") * F.col("r")) / F.sum("cos")).alias("severity"))


def confirmation_bias(evidence: DataFrame) -> DataFrame:
    """How far support outnumbers contradiction."""
    return evidence.groupBy("node_id").agg((F.greatest(F.sum("stance"), F.lit(0)) / F.count("*")).alias("severity"))


def denial_deception(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """The share of support, by cos, that lies in texts which several sources share."""
    hashes = events.select(F.col("id").alias("event_id"), text_hash(F.col("body")).alias("hash"))
    planted = hashes.join(copied_texts(events), "hash", "left_semi").select("event_id", F.lit(1).alias("planted"))
    weighed = evidence.where("stance = 1").join(planted, "event_id", "left")
    return weighed.groupBy("node_id").agg((F.sum(F.col("cos") * F.coalesce("planted", F.lit(0))) / F.sum("cos")).alias("severity"))


def competing_hypotheses(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """The share of siblings that less evidence contradicts (percent rank of the contradiction); null without siblings."""
    against = evidence.where("stance = -1").groupBy("node_id").agg(F.sum(-F.col("cos")).alias("x"))
    rivals = nodes.select(F.col("id").alias("node_id"), "theory_id", "parent_id").join(against, "node_id", "left").withColumn("x", F.round(F.coalesce("x", F.lit(0.0)), 6))
    family = Window.partitionBy("theory_id", "parent_id")
    ranked = rivals.select("node_id", F.percent_rank().over(family.orderBy("x")).alias("p"), F.count("*").over(family).alias("n"))
    return ranked.where("n > 1").select("node_id", F.col("p").alias("severity"))


def incentive_analysis(evidence: DataFrame) -> DataFrame:
    """Concentration of support among sources: normalised Herfindahl index."""
    per = evidence.where("stance = 1").groupBy("node_id", "source").agg(F.count("*").alias("c"))
    total = per.groupBy("node_id").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("s"), F.count("*").alias("n"))
    share = F.col("s") / (F.col("t") * F.col("t"))
    return total.select("node_id", F.when(F.col("n") == 1, 1.0).otherwise((share - 1 / F.col("n")) / (1 - 1 / F.greatest("n", F.lit(2)))).alias("severity"))


def logical_coherence(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Of a node's support that bears on its parent too, the share that contradicts the parent."""
    support = evidence.where("stance = 1").select("node_id", "event_id")
    child = support.join(nodes.where("parent_id is not null").select(F.col("id").alias("node_id"), "parent_id"), "node_id")
    parent = evidence.select(F.col("node_id").alias("parent_id"), "event_id", "stance")
    return child.join(parent, ["parent_id", "event_id"]).groupBy("node_id").agg(F.avg((F.col("stance") == -1).cast("double")).alias("severity"))


def base_rate(nodes: DataFrame, priors: DataFrame) -> DataFrame:
    """How far a node's score lies from the rate of its reference class."""
    rated = nodes.select(F.col("id").alias("node_id"), "lang", "score").join(priors, "lang", "left").withColumn("p", F.coalesce("p", F.lit(0.5)))
    return rated.select("node_id", (F.abs(F.col("score") - F.col("p")) / F.greatest(F.col("p"), 1 - F.col("p"))).alias("severity"))


def support_staleness(newest: DataFrame, hours: float = 72.0) -> DataFrame:
    """An example of a lens of one's own: the age of the newest support against the newest evidence of all; newest as by linked.newest_links()."""
    now = newest.agg(F.max("newest").alias("now"))
    last = newest.where("supported").select("node_id", F.col("newest_support").alias("last"))
    age = (F.unix_micros("now") - F.unix_micros("last")) / 3.6e9
    return last.crossJoin(F.broadcast(now)).select("node_id", F.least(F.lit(1.0), age / hours).alias("severity"))  # now is one row


BUILT_IN: dict[str, Lens] = {
    "source_reliability": lambda w: source_reliability(w.evidence, w.source_quality),
    "confirmation_bias": lambda w: confirmation_bias(w.evidence),
    "denial_deception": lambda w: denial_deception(w.evidence, w.events),
    "competing_hypotheses": lambda w: competing_hypotheses(w.nodes, w.evidence),
    "incentive_analysis": lambda w: incentive_analysis(w.evidence),
    "logical_coherence": lambda w: logical_coherence(w.nodes, w.evidence),
    "base_rate": lambda w: base_rate(w.nodes, w.class_priors),
}
