"""Plausibility, novelty, confidence, ranking, history and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hypotree import defaults as D
from hypotree.operators.board import board_summary
from hypotree.operators.linked import SCALE, link_sums
from hypotree.operators.ranges import in_ranges, with_earlier, within
from hypotree.operators.similarity import closest_earlier
from hypotree.operators.tree import prune


def _support(weight: Column) -> Column:
    return F.sum(F.when(F.col("stance") == 1, weight).otherwise(0.0))


def _against(weight: Column) -> Column:
    return F.sum(F.when(F.col("stance") == -1, weight).otherwise(0.0))


def plausibility(nodes: DataFrame, evidence: DataFrame, source_quality: DataFrame) -> DataFrame:
    """(S + 1) / (S + C + 2), S and C: |cos| times source quality of support and of contradiction."""
    weight = F.abs("cos") * F.col("r")
    sums = evidence.join(source_quality, "source").groupBy("node_id").agg(_support(weight).alias("s"), _against(weight).alias("c"))
    joined = nodes.select(F.col("id").alias("node_id")).join(sums, "node_id", "left").fillna(0.0, ["s", "c"])
    return joined.select("node_id", ((F.col("s") + 1) / (F.col("s") + F.col("c") + 2)).alias("plausibility"))


def novelty(nodes: DataFrame) -> DataFrame:
    """1 - the highest cos, at least 0, to an earlier node of the theory; 1 for the first."""
    closest = closest_earlier(nodes).select(F.col("a").alias("node_id"), F.col("cos").alias("m"))
    return nodes.select(F.col("id").alias("node_id")).join(closest, "node_id", "left").select("node_id", (1 - F.coalesce("m", F.lit(0.0))).alias("novelty"))


def confidence(summary: DataFrame, plausible: DataFrame, novel: DataFrame, weights: tuple[float, float, float] = D.WEIGHTS) -> DataFrame:
    """Weighted sum of resilience (0.5 where nothing was measured), plausibility and novelty."""
    joined = plausible.join(novel, "node_id").join(summary.select("node_id", "resilience"), "node_id", "left")
    total = weights[0] * F.coalesce("resilience", F.lit(0.5)) + weights[1] * F.col("plausibility") + weights[2] * F.col("novelty")
    return joined.select("node_id", "resilience", "plausibility", "novelty", F.round(total, 6).alias("confidence"))


def score_nodes(nodes: DataFrame, evidence: DataFrame, source_quality: DataFrame, verdicts: DataFrame, registry: DataFrame) -> DataFrame:
    return confidence(board_summary(verdicts, registry), plausibility(nodes, evidence, source_quality), novelty(nodes))


def theory_confidence(nodes: DataFrame, scores: DataFrame, floor: float = D.PRUNE_FLOOR) -> DataFrame:
    """(theory_id, confidence, node_id): the best node after pruning."""
    best = Window.partitionBy("theory_id").orderBy(F.desc("confidence"), "node_id")
    left = prune(nodes, floor).select(F.col("id").alias("node_id"), "theory_id").join(scores.select("node_id", "confidence"), "node_id")
    return left.withColumn("n", F.row_number().over(best)).where("n = 1").select("theory_id", "confidence", "node_id")


def rank_hypotheses(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Per theory: rank, dense rank and the margin to the next node, by confidence and then id.

    Equal confidences are counted first, then placed in ranges, so neither a large theory nor a frequent confidence meets in one task.
    """
    joined = nodes.select(F.col("id").alias("node_id"), "theory_id").join(scores.select("node_id", "confidence"), "node_id")
    levels = joined.groupBy("theory_id", "confidence").agg(F.count("*").alias("n"), F.max("node_id").alias("last_id"))
    best = F.desc_nulls_last("confidence")
    rows = with_earlier(in_ranges(levels, "theory_id", best), "theory_id", before=(F.sum("n"), "sum"), levels=(F.count("*"), "sum"))
    inside = within("theory_id").orderBy(best)
    ahead = F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.coalesce("before", F.lit(0))
    tops = rows.groupBy("theory_id", "part").agg(F.max("confidence").alias("top"))  # a row for each range of a theory
    following = tops.select("theory_id", "part", F.lead("top").over(Window.partitionBy("theory_id").orderBy("part")).alias("top"))
    placed = rows.join(following, ["theory_id", "part"]).select(
        "theory_id", "confidence", "last_id", (ahead + 1).cast("int").alias("rank"), (F.row_number().over(inside) + F.coalesce("levels", F.lit(0))).cast("int").alias("dense_rank"),
        F.coalesce(F.lead("confidence").over(inside), "top").alias("next"),
    )
    same = (F.col("theory_id") == F.col("t")) & F.col("confidence").eqNullSafe(F.col("c"))
    told = joined.join(placed.withColumnsRenamed({"theory_id": "t", "confidence": "c"}), same)
    margin = F.round(F.col("confidence") - F.when(F.col("node_id") == F.col("last_id"), F.col("next")).otherwise(F.col("confidence")), 6)
    return told.select("theory_id", "node_id", "confidence", "rank", "dense_rank", margin.alias("margin"))


def confidence_history(evidence: DataFrame, source_quality: DataFrame, step: str = "hour") -> DataFrame:
    """(node_id, hour, plausibility, change): plausibility by the evidence up to each hour that brought some."""
    weight = F.abs("cos") * F.col("r")
    return _history(evidence.join(source_quality, "source").groupBy("node_id", F.date_trunc(step, "observed_at").alias("hour")).agg(_support(weight).alias("s"), _against(weight).alias("c")))


def history_of_links(nodes: DataFrame, events: DataFrame, source_quality: DataFrame, step: str = "hour") -> DataFrame:
    """confidence_history() of the evidence between nodes and events, without its rows: sums by node and hour come from tiles."""
    timed = events.join(source_quality, "source").select("id", "embedding", F.date_trunc(step, "observed_at").alias("hour"), F.col("r").alias("weight"))
    found = link_sums(nodes.withColumn("parent_id", F.lit(None).cast("long")), timed, "hour")
    return _history(found.groupBy("node_id", "hour").agg(*[(F.sum(c) / SCALE).alias(c) for c in ("s", "c")]))


def _history(per: DataFrame) -> DataFrame:
    by = Window.partitionBy("node_id").orderBy("hour")
    run = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = per.select("node_id", "hour", ((F.sum("s").over(run) + 1) / (F.sum("s").over(run) + F.sum("c").over(run) + 2)).alias("plausibility"))
    return seen.select("node_id", "hour", "plausibility", (F.col("plausibility") - F.lag("plausibility").over(by)).alias("change"))


def calibration_bins(scores: DataFrame, outcomes: DataFrame, bins: int = 10) -> DataFrame:
    joined = scores.select("node_id", "confidence").join(outcomes, "node_id").withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)).cast("int"))
    return joined.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("outcome").alias("observed"), (F.avg("confidence") - F.avg("outcome")).alias("gap"))


def calibration_scores(scores: DataFrame, outcomes: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score, expected calibration error, and skill against the base rate (null if all outcomes are equal)."""
    per = calibration_bins(scores, outcomes, bins).agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))
    error = F.col("confidence") - F.col("outcome")
    total = scores.select("node_id", "confidence").join(outcomes, "node_id").agg(F.count("*").alias("n"), F.avg(error * error).alias("brier"), F.avg("outcome").alias("y"))
    skill = 1 - F.try_divide(F.col("brier"), F.col("y") * (1 - F.col("y")))
    return total.crossJoin(per).select("n", "brier", "ece", skill.alias("skill"))  # one row each
