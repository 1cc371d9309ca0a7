"""The engine's tables over the given Parquet files, reads with declared columns, ingest, audits and listings."""

from __future__ import annotations

from functools import cached_property, reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hypotree import defaults as D
from hypotree.functions.expressions import text_hash, title
from hypotree.sources.sinks import checkpointed

if TYPE_CHECKING:
    from hypotree.operators.statistics import Statistics


def raw(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


class World:
    """World events, theory nodes, theories, labels and evidence of one folder; each worked out when first asked for."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @cached_property
    def events(self) -> DataFrame:
        docs = raw(self.spark, self.path, "documents").where("doc_id % 5 <> 0").select("doc_id", "source", "lang", title(F.col("text")).alias("title"), "text")  # titles before the joins, which need not move texts then
        seen = raw(self.spark, self.path, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("observed_at"))
        vectors = raw(self.spark, self.path, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        joined = docs.join(seen, "doc_id").join(vectors, "doc_id", "left")
        return joined.select(F.col("doc_id").alias("id"), "source", "lang", "title", F.col("text").alias("body"), "observed_at", "embedding")

    @cached_property
    def nodes(self) -> DataFrame:
        docs = raw(self.spark, self.path, "documents").where("doc_id % 5 = 0").select("doc_id", "lang", title(F.col("text")).alias("hypothesis"))
        vectors = raw(self.spark, self.path, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        theory = F.expr("(doc_id div 5) % 5")
        parent = F.when(F.expr("doc_id div 25 = 0"), None).otherwise(F.expr("((doc_id div 25 - 1) div 3) * 25 + ((doc_id div 5) % 5) * 5"))
        return docs.join(vectors, "doc_id").select(F.col("doc_id").alias("id"), theory.alias("theory_id"), parent.alias("parent_id"), "hypothesis", (F.expr("(doc_id * 7919) % 1000") / 1000.0).alias("score"), "lang", "embedding")

    @cached_property
    def theories(self) -> DataFrame:
        roots = self.nodes.where("parent_id is null").select(F.col("theory_id").alias("id"), (F.col("theory_id") * 5 + 1).alias("root_event_id"), F.col("hypothesis").alias("summary"))
        times = self.events.select(F.col("id").alias("root_event_id"), F.col("observed_at").alias("created_at"))
        return roots.join(times, "root_event_id", "left").select("id", "root_event_id", "summary", F.lit(None).cast("double").alias("confidence"), "created_at")

    @cached_property
    def labels(self) -> DataFrame:
        return raw(self.spark, self.path, "labels").select("doc_id", "quality")

    @cached_property
    def outcomes(self) -> DataFrame:
        return self.nodes.select(F.col("id").alias("node_id")).join(self.labels.select(F.col("doc_id").alias("node_id"), F.col("quality").alias("outcome")), "node_id")

    @cached_property
    def registry(self) -> DataFrame:
        return self.spark.createDataFrame(D.LENSES, "lens_no int, lens string, concern_at double, fail_at double, weight double")

    @cached_property
    def evidence(self) -> DataFrame:
        """A row for each link, written once. Its size grows with nodes times events: what needs sums or times only takes statistics or newest."""
        from hypotree.operators.similarity import link_evidence

        return checkpointed(link_evidence(self.nodes, self.events, D.TAU))

    @cached_property
    def node_rows(self) -> DataFrame:
        """Nodes without their vectors and texts: id, theory_id, parent_id, lang, score."""
        return checkpointed(self.nodes.select("id", "theory_id", "parent_id", "lang", "score"))

    @cached_property
    def event_rows(self) -> DataFrame:
        """Events without their vectors and texts: id, source, lang and the hash of the normalised text."""
        return checkpointed(self.events.select("id", "source", "lang", text_hash(F.col("body")).alias("hash")))

    @cached_property
    def planted(self) -> DataFrame:
        from hypotree.operators.statistics import planted_events

        return planted_events(self.event_rows)

    @cached_property
    def statistics(self) -> Statistics:
        """Of all evidence."""
        from hypotree.operators.statistics import of_links

        return of_links(self.nodes, self.events, self.planted)

    @cached_property
    def newest(self) -> DataFrame:
        """linked.newest_links() of all nodes and events."""
        from hypotree.operators.linked import newest_links

        return checkpointed(newest_links(self.nodes, self.events))

    @cached_property
    def facts(self) -> DataFrame:
        """statistics.node_facts() of all nodes: a row each, written once."""
        from hypotree.operators.statistics import node_facts

        return checkpointed(node_facts(self.node_rows, self.statistics, self.source_quality, self.class_priors))

    def _prior(self, by: str) -> DataFrame:
        told = self.event_rows.select("id", by).join(self.labels, F.col("id") == F.col("doc_id"), "left")
        return told.groupBy(by).agg(((F.count_if(F.col("quality") == 1) + 1) / (F.count("quality") + 2)).alias("r"))

    @cached_property
    def source_quality(self) -> DataFrame:
        """(source, r): the smoothed share of good ones among its labelled world events."""
        return self._prior("source")

    @cached_property
    def class_priors(self) -> DataFrame:
        """(lang, p): the same by reference class."""
        return self._prior("lang").withColumnRenamed("r", "p")


def scan_events(events: DataFrame) -> DataFrame:
    return events.select("id", "source", "title", F.char_length("body").alias("body_chars"), "observed_at", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"))


def theory_tables(theories: DataFrame, nodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    counted = nodes.groupBy(F.col("theory_id").alias("id")).agg(F.count("*").alias("n_nodes"))
    judged = verdicts.join(nodes.select(F.col("id").alias("node_id"), "theory_id"), "node_id").groupBy(F.col("theory_id").alias("id")).agg(F.count("*").alias("n_verdicts"))
    return theories.select("id", "summary").join(counted, "id", "left").join(judged, "id", "left").fillna(0, ["n_nodes", "n_verdicts"])


def ingest(existing: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """existing and the incoming rows with new ids; a missing time is the ingest time. Repeating an ingest changes nothing.

    Of incoming rows that repeat an id the latest stays (then the largest by the other columns).
    """
    fresh = incoming.withColumn("observed_at", F.coalesce("observed_at", F.lit(now).cast("timestamp"))).join(existing.select("id"), "id", "left_anti")
    latest = Window.partitionBy("id").orderBy(F.desc("observed_at"), *[F.desc(c) for c in fresh.columns if c not in ("id", "observed_at")])
    return existing.unionByName(fresh.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n"))


def fk_audit(events: DataFrame, theories: DataFrame, nodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(fk, orphans) for each of the four foreign keys; null keys aren't orphans."""

    def orphans(name: str, child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
        lost = child.select(F.col(key).alias("k")).where("k is not null").join(parent.select(F.col("id").alias("k")), "k", "left_anti")
        return lost.agg(F.count("*").alias("orphans")).select(F.lit(name).alias("fk"), "orphans")

    keys = [("theories.root_event_id", theories, "root_event_id", events), ("theory_nodes.theory_id", nodes, "theory_id", theories), ("theory_nodes.parent_id", nodes, "parent_id", nodes), ("lens_verdicts.node_id", verdicts, "node_id", nodes)]
    return reduce(DataFrame.unionByName, [orphans(*k) for k in keys])


def schema_audit(name: str, df: DataFrame, pk: list[str], dim: int | None = None) -> DataFrame:
    """Repeated keys, nulls outside the key, and with dim the vectors (embedding) that are null or of another length."""
    repeated = df.groupBy(*pk).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_pks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns if c not in pk], F.lit(0).cast("long"))
    vector = [F.count_if(F.col("embedding").isNull()), F.count_if(F.size("embedding") != dim)] if dim else [F.lit(0).cast("long")] * 2
    others = df.agg(nulls.alias("null_values"), vector[0].alias("null_vectors"), vector[1].alias("wrong_dims"))
    return repeated.crossJoin(others).select(F.lit(name).alias("table_name"), "n_rows", "duplicate_pks", "null_values", "null_vectors", "wrong_dims")  # one row each


def upsert(state: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of a key the newest by `order` stays; of equally new ones the largest by the other columns."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc(), *[F.desc(c) for c in state.columns if c not in (*keys, order)])
    return state.unionByName(updates).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def list_events(events: DataFrame, n: int, source: str | None = None, since: str | None = None) -> DataFrame:
    if source is not None:
        events = events.where(F.col("source") == source)
    if since is not None:
        events = events.where(F.col("observed_at") >= F.lit(since).cast("timestamp"))
    return events.select("id", "source", "title", "observed_at").orderBy(F.desc("observed_at"), "id").limit(n)


def query_theories(theories: DataFrame, events: DataFrame, *, root_event_id: int | None = None, least: float | None = None, words: str | None = None) -> DataFrame:
    if root_event_id is not None:
        theories = theories.where(F.col("root_event_id") == root_event_id)
    if least is not None:
        theories = theories.where(F.col("confidence") >= least)
    if words is not None:
        theories = theories.where(F.col("summary").contains(words))
    titles = events.select(F.col("id").alias("root_event_id"), F.col("title").alias("root_title"))
    return theories.join(titles, "root_event_id", "left").select("id", "root_event_id", "root_title", "summary", "confidence")


def active_theories(theories: DataFrame, nodes: DataFrame, newest: DataFrame, floor: float = D.ACTIVE_FLOOR) -> DataFrame:
    """Theories without a confidence or with one of at least floor, their node count and newest evidence time; newest: (node_id, newest) of nodes with evidence."""
    active = theories.where(F.col("confidence").isNull() | (F.col("confidence") >= floor))
    per = nodes.select("theory_id", F.col("id").alias("node_id")).join(newest.select("node_id", "newest"), "node_id", "left").groupBy(F.col("theory_id").alias("id")).agg(F.count("*").alias("n_nodes"), F.max("newest").alias("newest"))
    return active.join(per, "id", "left").select("id", "confidence", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), "newest")


def feed_counts(events: DataFrame, window: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("observed_at", window).alias("w"), "source").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "source", "n")


def copied_texts(events: DataFrame) -> DataFrame:
    """(hash) of normalised texts that two or more sources share."""
    return events.groupBy(text_hash(F.col("body")).alias("hash")).agg(F.count_distinct("source").alias("sources")).where("sources >= 2").select("hash")


def reembed_queue(rows: DataFrame, index: DataFrame, text: Column) -> DataFrame:
    """(id, reason): rows (id, embedding) that the index (id, text_hash) lacks or holds with another text, or that have no vector."""
    joined = rows.select("id", F.md5(text).alias("now"), F.col("embedding").isNull().alias("bare")).join(index.select("id", "text_hash"), "id", "left")
    reason = F.when(F.col("text_hash").isNull(), "missing").when(~F.col("now").eqNullSafe(F.col("text_hash")), "stale").when(F.col("bare"), "no_vector")
    return joined.select("id", reason.alias("reason")).where("reason is not null")
