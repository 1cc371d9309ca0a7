"""Streams: ingest with deduplication, windowed feeds, running evidence state, and refinement per micro-batch.

All run over what is there and end (availableNow); sinks and checkpoints lie in the shared folder. State is kept as parts: a
batch writes a folder of its own, which holds what it adds and which a second run of it replaces, so what a batch writes
follows the batch and depends on its number only. Parts are folded together eight at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hypotree.operators.linked import link_sums
from hypotree.operators.refine import affected_theories, rescored
from hypotree.operators.scoring import novelty
from hypotree.operators.statistics import SUMS, Statistics, of_links
from hypotree.sources.sinks import checkpointed, complete, dropped, exists, new_folder
from hypotree.sources.tables import World, raw

#: Parts that are folded into one, and runs of parts in the same way.
FOLD = 8


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """(id, observed_at) of the raw events table as a stream of files; time as a timestamp, which watermarks need."""
    source = f"{path}/events.parquet*"  # a pattern, as the table may be one file or a folder
    stream = spark.readStream.schema(raw(spark, path, "events").schema).option("maxFilesPerTrigger", 4).parquet(source)
    return stream.select(F.col("event_id").alias("id"), "event_type", F.col("ts").cast("timestamp").alias("observed_at"))


def _finish(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


class Parts:
    """A table to which each batch adds a part. Folder 0/n is batch n's; folder k/n holds the FOLD^k parts from n on, folded.

    A reader takes the largest complete folders, a few for each power of FOLD; a row is written again once for each power.
    """

    def __init__(self, spark: SparkSession, label: str, schema: T.StructType | str, fold: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        self.spark, self.fold, self.path = spark, fold, new_folder(spark, label)
        self.schema = spark.createDataFrame([], schema).schema
        self.end = 0

    def _folders(self, first: int, before: int, below: int = 64) -> list[str]:
        """Complete folders of the parts from first on, up to before, of levels under `below`."""
        out, at = [], first
        while at < before:
            level = max(k for k in range(below) if k == 0 or at % FOLD**k == 0 and at + FOLD**k <= before)
            while level and not complete(self.spark, f"{self.path}/{level}/{at}"):
                level -= 1
            if level or complete(self.spark, f"{self.path}/0/{at}"):
                out.append(f"{self.path}/{level}/{at}")
            at += FOLD**level
        return out

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, before: int | None = None) -> DataFrame:
        """The table after the batches below that number (all, if not given)."""
        return self.fold(self._read(self._folders(0, self.end if before is None else before)))

    def write(self, df: DataFrame, batch: int) -> None:
        kinds = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        df.select(*kinds).write.mode("overwrite").parquet(f"{self.path}/0/{batch}")
        self.end = max(self.end, batch + 1)
        level = max(k for k in range(64) if (batch + 1) % FOLD**k == 0)
        if level:
            first = batch + 1 - FOLD**level
            self.fold(self._read(self._folders(first, batch + 1, level))).select(*kinds).write.mode("overwrite").parquet(f"{self.path}/{level}/{first}")


def summed(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """A fold that adds up all columns but the keys."""
    return lambda df: df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in df.columns if c not in keys])


def latest(key: str, order: str) -> Callable[[DataFrame], DataFrame]:
    """A fold that keeps, of the rows of a key, the one of the highest `order`."""
    return lambda df: df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


class SeenIds:
    """The ids that earlier batches had, in folders by range of ids, so that a batch reads only those ranges that its own ids lie in."""

    def __init__(self, spark: SparkSession, span: int = 1 << 16) -> None:
        self.spark, self.span, self.path = spark, span, new_folder(spark, "seen")

    def earlier(self, buckets: list[int], batch: int) -> DataFrame:
        """(id) of the given ranges, of batches below that number."""
        folders = [f for f in (f"{self.path}/bucket={b}" for b in buckets) if exists(self.spark, f)]
        if not folders:
            return self.spark.createDataFrame([], "id long")
        return self.spark.read.schema("id long, bucket long, batch long").option("basePath", self.path).parquet(*folders).where(F.col("batch") < batch).select("id")

    def unseen(self, rows: DataFrame, batch: int) -> DataFrame:
        """rows, one for each id, without those whose id an earlier batch had; their ids count as seen from now on. Null ids always pass."""
        bucket = F.expr(f"id div {self.span}")
        own = [r.b for r in rows.where("id is not null").select(bucket.alias("b")).distinct().collect()]  # ranges, of which a batch has few
        fresh = checkpointed(rows.join(self.earlier(own, batch), "id", "left_anti"))
        ids = fresh.where("id is not null").select("id", bucket.alias("bucket"), F.lit(batch).cast("long").alias("batch")).repartition("bucket", F.pmod("id", F.lit(4)))
        ids.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)
        return fresh


def ingest_stream(spark: SparkSession, path: str, span: int = 1 << 16) -> DataFrame:
    """The table that a deduplicating ingest of the stream leaves: each batch adds the rows whose id no earlier batch had.

    There is no watermark, so late rows are kept however late; of a batch's rows that repeat an id the latest stays.
    """
    stream = event_stream(spark, path)
    rows, seen = Parts(spark, "ingest", stream.schema), SeenIds(spark, span)

    def add(batch: DataFrame, number: int) -> None:
        one_each = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), F.struct("observed_at", "event_type")).alias("r")).select("r.*")
        fresh = seen.unseen(one_each, number)
        rows.write(fresh, number)
        dropped(fresh)

    _finish(stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{rows.path}-state"))
    return rows.read()


class Feed(NamedTuple):
    """windows: (start, event_type, n) of closed windows. changes: (batch, start, event_type, n, correction): what each batch made known: windows
    as they close, and, as corrections, windows closed before that late rows added to. The last of a window's changes is its count.
    """

    windows: DataFrame
    changes: DataFrame


def feed(spark: SparkSession, path: str, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> Feed:
    """Counts of the stream by window. A window is closed when the newest time, less the delay, has passed its end; rows later than that still count."""
    kinds = "start timestamp, end timestamp, event_type string, n long"
    counts = Parts(spark, "feed-counts", kinds, summed("start", "end", "event_type"))
    times = Parts(spark, "feed-times", "newest timestamp", lambda df: df.agg(F.max("newest").alias("newest")))
    changes = Parts(spark, "feed-changes", "batch long, start timestamp, event_type string, n long, correction boolean")

    def closed(rows: DataFrame, newest: DataFrame, name: str) -> DataFrame:
        """rows with whether they are closed by that time; newest is one row."""
        passed = F.timestamp_micros(F.floor(F.unix_micros("newest") / 1000).cast("long") * 1000) - F.expr(f"interval {delay}")  # in milliseconds, as watermarks are
        return rows.crossJoin(F.broadcast(newest)).withColumn(name, F.coalesce(F.col("end") <= passed, F.lit(False))).drop("newest")

    def add(batch: DataFrame, number: int) -> None:
        window = F.window("observed_at", size, slide or size)
        part = batch.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")
        counts.write(part, number)
        times.write(batch.agg(F.max("observed_at").alias("newest")), number)
        before, now = times.read(number), times.read(number + 1)
        touched = counts._read([f"{counts.path}/0/{number}"]).select("start", "event_type", F.lit(True).alias("touched"))
        rows = closed(closed(counts.read(number + 1), before, "was"), now, "is").join(touched, ["start", "event_type"], "left").where("is and (touched or not was)")
        changes.write(rows.select(F.lit(number).alias("batch"), "start", "event_type", "n", F.col("was").alias("correction")), number)

    _finish(event_stream(spark, path).where("observed_at is not null").writeStream.foreachBatch(add).option("checkpointLocation", f"{counts.path}-state"))
    return Feed(closed(counts.read(), times.read(), "is").where("is").select("start", "event_type", "n"), changes.read())


def feed_windows(spark: SparkSession, path: str, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(start, event_type, n) of closed windows; every row counts, in whatever order files arrive."""
    return feed(spark, path, size, slide, delay).windows


def evidence_state(world: World) -> DataFrame:
    """(node_id, n_support, n_contra, s, c): sums over the evidence of arriving events; a batch writes the sums of its own.

    Sums of cos, which has nine digits, are whole billionths, so they don't depend on the order; they are rounded to six digits in the end.
    """
    state, seen = Parts(world.spark, "evidence-state", "node_id long, n_support long, n_contra long, s long, c long", summed("node_id")), SeenIds(world.spark)
    nodes = checkpointed(world.nodes.select("id", F.lit(None).cast("long").alias("parent_id"), "embedding"))

    def add(batch: DataFrame, number: int) -> None:
        new = seen.unseen(batch.select("id").distinct(), number)
        found = link_sums(nodes, world.events.select("id", "source", "embedding").join(new, "id", "left_semi"), "source")
        counts = [F.sum("n_support").alias("n_support"), F.sum(F.col("n") - F.col("n_support")).alias("n_contra")]
        state.write(found.groupBy("node_id").agg(*counts, F.sum("s").alias("s"), F.sum("c").alias("c")), number)
        dropped(new)

    _finish(event_stream(world.spark, world.path).writeStream.foreachBatch(add).option("checkpointLocation", f"{state.path}-state"))
    billionth = F.lit(Decimal("0.000000001"))
    return state.read().select("node_id", "n_support", "n_contra", *[F.round(F.col(c).cast("decimal(20,0)") * billionth, 6).cast("double").alias(c) for c in ("s", "c")])


def refine_stream(world: World, embedder: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node_id, resilience, plausibility, novelty, confidence) after all micro-batches, as by the whole board over all events.

    Each batch links its new events to the nodes, adds the sums of that evidence to the statistics so far, and scores the nodes of the
    theories that it bears on from the statistics. embedder: gives events (id, title, body) without a vector one, as (id, embedding);
    without it they bring no evidence.
    """
    spark, nodes = world.spark, checkpointed(world.nodes.select("id", "theory_id", "parent_id", "embedding"))
    sums = Parts(spark, "refine-sums", "node_id long, source string, n long, n_support long, s double, c double, planted double", summed("node_id", "source"))
    overlap = Parts(spark, "refine-overlap", "node_id long, both long, against long", summed("node_id"))
    assert [f.name for f in sums.schema][2:] == list(SUMS)
    scores = Parts(spark, "refine-scores", "node_id long, resilience double, plausibility double, novelty double, confidence double, scored_at long", latest("node_id", "scored_at"))
    seen, novel = SeenIds(spark), checkpointed(novelty(nodes))

    def refine(batch: DataFrame, number: int) -> None:
        new = seen.unseen(batch.select("id").distinct(), number)
        arrived = world.events.join(new, "id", "left_semi")
        if embedder is not None:
            made = embedder(arrived.where("embedding is null").select("id", "title", "body")).select("id", F.col("embedding").alias("made"))
            arrived = arrived.join(made, "id", "left").withColumn("embedding", F.coalesce("embedding", "made")).drop("made")
        arrived = checkpointed(arrived.select("id", "source", "embedding"))
        part = of_links(nodes, arrived, world.planted)
        sums.write(part.sums, number)
        overlap.write(part.overlap, number)
        stats = Statistics(sums.read(number + 1), overlap.read(number + 1))
        scored = rescored(world, stats, affected_theories(world.theories, world.node_rows, part.sums), novel)
        scores.write(scored.withColumn("scored_at", F.lit(number)), number)
        dropped(new, arrived)

    _finish(event_stream(spark, world.path).writeStream.foreachBatch(refine).option("checkpointLocation", f"{scores.path}-state"))
    return scores.read().drop("scored_at")
