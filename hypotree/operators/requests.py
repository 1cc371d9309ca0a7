"""Request and response tables around an outside model: prompts, parsed verdicts, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hypotree import defaults as D

QUESTIONS = {
    "source_reliability": "How reliable are the sources?",
    "confirmation_bias": "Was contrary evidence sought?",
    "denial_deception": "Could the evidence be planted?",
    "competing_hypotheses": "Does a rival explain more?",
    "incentive_analysis": "Who benefits?",
    "logical_coherence": "Is it consistent in itself?",
    "base_rate": "How often is this so?",
}


def _top_titles(evidence: DataFrame, events: DataFrame, k: int) -> DataFrame:
    """(node_id, titles): the titles of the k best supporting events, best first."""
    best = Window.partitionBy("node_id").orderBy(F.desc("cos"), "event_id")
    top = evidence.where("stance = 1").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    named = top.join(events.select(F.col("id").alias("event_id"), "title"), "event_id")
    sorted_ = F.array_sort(F.collect_list(F.struct("n", "title")))  # at most k
    return named.groupBy("node_id").agg(F.array_join(F.transform(sorted_, lambda x: x["title"]), " | ").alias("titles"))


def render_lens_requests(queue: DataFrame, nodes: DataFrame, evidence: DataFrame, events: DataFrame, k: int = D.K) -> DataFrame:
    """(node_id, lens, prompt) for each queued pair."""
    asked = F.create_map(*[F.lit(x) for kv in QUESTIONS.items() for x in kv])
    joined = queue.join(nodes.select(F.col("id").alias("node_id"), "hypothesis"), "node_id").join(_top_titles(evidence, events, k), "node_id", "left")
    prompt = F.format_string("Hypothesis: %s\nQuestion: %s\nEvidence: %s", "hypothesis", F.coalesce(asked[F.col("lens")], F.col("lens")), F.coalesce("titles", F.lit("none")))
    return joined.select("node_id", "lens", prompt.alias("prompt"))


def render_theory_requests(frontier: DataFrame, nodes: DataFrame, evidence: DataFrame, events: DataFrame, k: int = D.K) -> DataFrame:
    """(node_id, prompt) for each frontier node."""
    joined = frontier.join(nodes.select(F.col("id").alias("node_id"), "hypothesis"), "node_id").join(_top_titles(evidence, events, k), "node_id", "left")
    prompt = F.format_string("Hypothesis: %s\nPropose %d refinements.\nEvidence: %s", "hypothesis", "slots", F.coalesce("titles", F.lit("none")))
    return joined.select("node_id", prompt.alias("prompt"))


def render_refinement_requests(affected: DataFrame, nodes: DataFrame, evidence: DataFrame, events: DataFrame, k: int = D.K) -> DataFrame:
    """(node_id, prompt) for the root node of each affected theory (id, summary)."""
    roots = nodes.where("parent_id is null").select(F.col("theory_id").alias("id"), F.col("id").alias("node_id"))
    joined = affected.select("id", "summary").join(roots, "id").join(_top_titles(evidence, events, k), "node_id", "left")
    prompt = F.format_string("Theory: %s\nRefine it in the light of the evidence.\nEvidence: %s", "summary", F.coalesce("titles", F.lit("none")))
    return joined.select("node_id", prompt.alias("prompt"))


def parse_verdicts(responses: DataFrame, registry: DataFrame) -> DataFrame:
    """responses (request_id, lens, body) with verdict, severity, rationale and reason; reason is null where the response is accepted."""
    kind = "verdict string, severity double, rationale string, _corrupt string"
    lenses = F.broadcast(registry.select("lens", F.lit(True).alias("known")))
    read = responses.join(lenses, "lens", "left").withColumn("r", F.from_json("body", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    severity = F.col("r.severity")
    reason = (
        F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "bad_json").when(F.col("known").isNull(), "unknown_lens")
        .when(F.coalesce(~F.col("r.verdict").isin("pass", "concern", "fail", "insufficient"), F.lit(True)), "unknown_verdict")
        .when((F.col("r.verdict") != "insufficient") & F.coalesce(~severity.between(0, 1), F.lit(True)), "bad_severity")
    )
    ok = reason.isNull()
    return read.select("request_id", "lens", F.when(ok, F.col("r.verdict")).alias("verdict"), F.when(ok & (F.col("r.verdict") != "insufficient"), severity).alias("severity"), F.when(ok, F.col("r.rationale")).alias("rationale"), reason.alias("reason"))


def retry_ledger(attempts: DataFrame, base_seconds: int, max_attempts: int) -> DataFrame:
    """attempts (request_id, attempt, ok, at) to (request_id, attempt, status, next_at): by the latest attempt of each request."""
    latest = Window.partitionBy("request_id").orderBy(F.desc("attempt"))
    last = attempts.withColumn("n", F.row_number().over(latest)).where("n = 1")
    status = F.when(F.col("ok"), "done").when(F.col("attempt") < max_attempts, "retry").otherwise("dead")
    wait = F.timestamp_micros(F.unix_micros("at") + (F.lit(base_seconds * 1_000_000) * F.pow(F.lit(2.0), F.col("attempt") - 1)).cast("long"))
    return last.select("request_id", "attempt", status.alias("status"), F.when(status == "retry", wait).alias("next_at"))
