"""The board: dispatch of nodes to lenses, verdicts, aggregation, queue and profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hypotree.functions.expressions import verdict
from hypotree.operators.lenses import BUILT_IN, Lens
from hypotree.sources.tables import World


def dispatch(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """(node_id, lens_no, lens): every node with every lens; the registry has a row for each lens."""
    return nodes.select(F.col("id").alias("node_id")).crossJoin(F.broadcast(registry.select("lens_no", "lens")))


def _judged(rows: DataFrame) -> DataFrame:
    """rows (node_id, lens_no, lens, severity, concern_at, fail_at) as verdicts: severity of six digits, verdict, rationale."""
    rows = rows.withColumn("severity", F.round("severity", 6))
    told = verdict(F.col("severity"), F.col("concern_at"), F.col("fail_at"))
    why = F.when(F.col("severity").isNull(), "no evidence to measure").otherwise(F.format_string("severity %.3f, concern at %.2f, fail at %.2f", "severity", "concern_at", "fail_at"))
    return rows.select("node_id", "lens_no", "lens", told.alias("verdict"), "severity", why.alias("rationale"))


def judge(items: DataFrame, found: DataFrame, registry: DataFrame) -> DataFrame:
    """items (node_id, lens_no, lens) with verdict, severity (six digits) and rationale, from found (node_id, lens, severity)."""
    rules = F.broadcast(registry.select("lens_no", "concern_at", "fail_at"))
    return _judged(items.join(found, ["node_id", "lens"], "left").join(rules, "lens_no"))


def judge_facts(facts: DataFrame, registry: DataFrame, names: list[str]) -> DataFrame:
    """Verdicts of the named lenses from statistics.node_facts(): a node's row becomes one for each lens, without a shuffle."""
    found = facts.select("node_id", F.inline(F.array(*[F.struct(F.lit(n).alias("lens"), F.col(n).alias("severity")) for n in names])))
    return _judged(found.join(F.broadcast(registry.select("lens_no", "lens", "concern_at", "fail_at")), "lens"))


def one_lens(world: World, name: str, lens: Lens | None = None, registry: DataFrame | None = None) -> DataFrame:
    registry = world.registry if registry is None else registry
    found = (lens or BUILT_IN[name])(world).select("node_id", F.lit(name).alias("lens"), "severity")
    own = registry.where(F.col("lens") == name)
    return judge(dispatch(world.nodes, own), found, own)


def run_board(world: World, lenses: dict[str, Lens] | None = None, registry: DataFrame | None = None) -> DataFrame:
    """A verdict of every registered lens on every node. lenses: by name, the seven if not given; register own ones in both.

    The built-in lenses come from one row of statistics a node; others are run each by itself.
    """
    registry, lenses = world.registry if registry is None else registry, BUILT_IN if lenses is None else lenses
    built_in = [name for name, f in lenses.items() if BUILT_IN.get(name) is f]
    told = judge_facts(world.facts, registry, built_in) if built_in else None
    if built_in == list(BUILT_IN) == list(lenses) and registry is world.registry:
        return told
    rest = registry.where(~F.col("lens").isin(built_in))
    found = [f(world).select("node_id", F.lit(name).alias("lens"), "severity") for name, f in lenses.items() if name not in built_in]
    none = world.facts.select("node_id", F.lit("").alias("lens"), F.lit(None).cast("double").alias("severity")).limit(0)
    others = judge(dispatch(world.node_rows, rest), reduce(DataFrame.unionByName, found, none), rest)
    return others if told is None else told.unionByName(others)


def register_lens(lenses: dict[str, Lens], registry: DataFrame, name: str, fn: Lens, concern_at: float, fail_at: float, weight: float = 1.0) -> tuple[dict[str, Lens], DataFrame]:
    """lenses and registry with one more lens."""
    number = (registry.agg(F.max("lens_no")).first()[0] or 0) + 1
    row = registry.sparkSession.createDataFrame([(number, name, concern_at, fail_at, weight)], registry.schema)
    return lenses | {name: fn}, registry.unionByName(row)


def board_panel(verdicts: DataFrame, names: list[str]) -> DataFrame:
    """One row for each node, a column of severity for each lens."""
    return verdicts.groupBy("node_id").pivot("lens", names).agg(F.max("severity"))


def board_summary(verdicts: DataFrame, registry: DataFrame) -> DataFrame:
    """Per node: verdict counts, weighted mean and largest severity, resilience (1 - the mean; null if nothing was measured)."""
    weighed = verdicts.join(F.broadcast(registry.select("lens_no", "weight")), "lens_no")
    known = F.when(F.col("severity").isNotNull(), F.col("weight"))
    mean = F.sum(F.col("weight") * F.col("severity")) / F.sum(known)
    counts = [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("pass", "concern", "fail", "insufficient")]
    return weighed.groupBy("node_id").agg(*counts, mean.alias("mean_severity"), F.max("severity").alias("max_severity"), (1 - mean).alias("resilience"))


def worst_lens(verdicts: DataFrame) -> DataFrame:
    worst = Window.partitionBy("node_id").orderBy(F.desc("severity"), "lens_no")
    return verdicts.where("severity is not null").withColumn("n", F.row_number().over(worst)).where("n = 1").select("node_id", "lens", "severity")


def board_queue(nodes: DataFrame, registry: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(node_id, lens_no, lens) pairs without a verdict."""
    return dispatch(nodes, registry).join(verdicts.select("node_id", "lens_no"), ["node_id", "lens_no"], "left_anti").select("node_id", "lens_no", "lens")


def lens_profile(verdicts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verdict counts and severity quartiles by theory and lens, with subtotals by theory and over all; level: 0, 1, 3."""
    joined = verdicts.join(nodes.select(F.col("id").alias("node_id"), "theory_id"), "node_id")
    counts = [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("pass", "concern", "fail", "insufficient")]
    quartiles = [F.percentile("severity", q).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return joined.rollup("theory_id", "lens").agg(F.grouping_id().alias("level"), *counts, *quartiles)
