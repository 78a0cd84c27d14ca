"""The crawl event stream: sources, counts, exactly-once enqueue, newest events, and the state store behind foreachBatch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions.scalars import visible_width
from arbora.operators import queue
from arbora.runtime import children, cut, exists, release, shared_folder
from arbora.sources.crawl import event_lines
from arbora.sources.model import EDGE_KEY, HISTORY

#: Events of each type that a monitor keeps.
RING = 9999
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, directory: str, files: int = 1) -> DataFrame:
    """Stream of the event files of a directory as (event_id, ts, user_id, event, value): purchases and views are done
    users, everything else is queued."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files).parquet(directory)
    return as_crawl_events(raw)


def as_crawl_events(raw: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type").isin("purchase", "view"), "user_done").otherwise("user_queued")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", kind.alias("event"), "value")


def demultiplex(events: DataFrame) -> dict[str, DataFrame]:
    return {kind: events.where(F.col("event") == kind) for kind in ("user_done", "user_queued")}


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count("*").alias("n"), F.count("user_id").alias("with_user"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per window of event time (an addition to the reference's event stream)."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width), "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event", "n")


def first_enqueue(events: DataFrame) -> DataFrame:
    """One row per queued user over the whole stream."""
    return events.where("event = 'user_queued' and user_id is not null").select("user_id").dropDuplicates(["user_id"])


def newest(events: DataFrame, most: int = RING) -> DataFrame:
    """The newest ``most`` events of each type, the last first.

    Counts per minute, added up before the shuffle, tell which minutes can hold one of them; only their events are sorted.
    """
    minute = F.date_trunc("minute", "ts")
    counts = events.groupBy(F.col("event").alias("e"), minute.alias("m")).agg(F.count("*").alias("n"))
    later = Window.partitionBy("e").orderBy(F.desc_nulls_last("m")).rowsBetween(Window.unboundedPreceding, -1)
    wanted = counts.select("e", "m", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("newer")).where(F.col("newer") < most)
    near = events.join(wanted, F.col("event").eqNullSafe(F.col("e")) & minute.eqNullSafe(F.col("m")), "left_semi")
    order = Window.partitionBy("event").orderBy(F.desc_nulls_last("ts"), F.desc_nulls_last("event_id"))
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def page(events: DataFrame, height: int, scroll: int = 0) -> DataFrame:
    """What a view of ``height`` rows shows of each type, ``scroll`` rows above the end."""
    return newest(events, height + scroll).where(F.col("place") > scroll)


def latest_status(snapshots: DataFrame) -> DataFrame:
    """The last snapshot (ts, ...) as a row: snapshots replace each other wholesale."""
    rest = [c for c in snapshots.columns if c != "ts"]
    return snapshots.agg(F.max_by(F.struct("ts", *rest), "ts").alias("s")).select("s.*")


def chained(done: DataFrame, queued: DataFrame) -> DataFrame:
    """Both kinds of events as one frame."""
    return done.unionByName(queued, allowMissingColumns=True)


def column_widths(events: DataFrame, most: int = 30) -> DataFrame:
    """One row (degree_width, login_width): the display columns that events (degree, login) of both kinds need, at least 3 and
    at most ``most``."""
    degree = F.max(visible_width(F.concat(F.col("degree").cast("string"), F.lit("°"))))
    login = F.max(visible_width(F.col("login")))
    return events.agg(F.greatest(F.lit(3), F.coalesce(degree, F.lit(0))).alias("degree_width"), F.least(F.coalesce(login, F.lit(0)), F.lit(most)).alias("login_width"))


def run_once(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drive a streaming frame over what is there and return what it gave, from files in the shared folder.

    Each batch writes a folder of its own number, so a replayed batch replaces its first try. In complete mode the last
    one is the result, otherwise all.
    """
    spark, root = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def each(batch: DataFrame, number: int) -> None:
        target = f"{root}/last" if mode == "complete" else f"{root}/all/{number}"
        batch.write.mode("overwrite").parquet(target)

    stream = df.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", f"{root}/state").foreachBatch(each)
    stream.trigger(availableNow=True).start().awaitTermination()
    empty = spark.createDataFrame([], df.schema)
    folder = f"{root}/last" if mode == "complete" else f"{root}/all"
    if not exists(spark, folder):
        return empty
    return spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(folder)


#: Pieces of the edge table that are rewritten on their own.
BUCKETS = 64


class EdgeStore:
    """Edges and their change log in Parquet folders of hash buckets, moved on by micro-batches.

    A batch rewrites the buckets it touches and then a small manifest that says which version of each bucket holds. The
    manifest is the commit: its number is the batch's, a replayed number is known, and a store opened again goes on
    from the last one.
    """

    def __init__(self, spark: SparkSession, root: str, edges: DataFrame | None = None):
        self.spark, self.root = spark, root
        done = [int(n) for n in children(spark, f"{root}/manifest") if exists(spark, f"{root}/manifest/{n}/_SUCCESS")]
        self.version = max(done, default=None)
        if self.version is None:
            if edges is None:
                raise ValueError("a new store needs its first edges")
            self._commit(-1, edges, {})
        else:
            self.held = {r.bucket: r.version for r in spark.read.json(f"{root}/manifest/{self.version}", "bucket int, version long").collect()}
            with_schema = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/edges")
            self.schema = with_schema.schema

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*EDGE_KEY), F.lit(BUCKETS)).cast("int"))

    def _commit(self, number: int, edges: DataFrame, held: dict[int, int]) -> None:
        self._bucketed(edges).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/edges/{number}")
        written = [int(n.removeprefix("_bucket=")) for n in children(self.spark, f"{self.root}/edges/{number}") if n.startswith("_bucket=")]
        self.held, self.version, self.schema = held | dict.fromkeys(written, number), number, edges.schema
        rows = list(self.held.items())
        self.spark.createDataFrame(rows, "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/{number}")

    def edges(self, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/edges/{v}/_bucket={b}" for b, v in self.held.items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def history(self) -> DataFrame:
        """The change log of all committed batches; empty before the first."""
        numbers = [n for n in children(self.spark, f"{self.root}/history") if int(n) <= self.version]
        if not numbers:
            return self.spark.createDataFrame([], HISTORY)
        return self.spark.read.schema(HISTORY).parquet(*[f"{self.root}/history/{n}" for n in numbers])

    def apply(self, batch: DataFrame, number: int) -> None:
        if number <= self.version:
            return
        rows = cut(self._bucketed(batch.select(*EDGE_KEY, "weight", "degree")))
        touched = [r._bucket for r in rows.select("_bucket").distinct().collect()]
        at = F.lit(self.spark.range(1).select(F.current_timestamp().alias("t")).first().t)
        edges, outcome = queue.upsert_edges(self.edges(touched), rows.drop("_bucket"), at)
        queue.history_of(outcome, at).write.mode("overwrite").parquet(f"{self.root}/history/{number}")
        self._commit(number, edges, self.held)
        release(rows)


def upsert_stream(batches: DataFrame, store: EdgeStore, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None):
    """The query that applies a stream of edge batches to a store; ``checkpoint`` keeps its place over restarts."""

    def each(batch: DataFrame, number: int) -> None:
        store.apply(batch, number)
        if then:
            then(batch, number)

    return batches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Watch:
    """The watch loop over an event stream: after every batch its event lines and a fresh status line, at the end a bye.

    Lines go to ``sink``, a function of a one-column frame and the batch number, in the order event, status; a batch comes per ``trigger``
    or as events arrive. Pausing stops the query and starting goes on from its checkpoint, so no event is lost however
    slow the reader is.
    """

    def __init__(self, events: DataFrame, status: Callable[[], DataFrame], sink: Callable[[DataFrame, str], None], checkpoint: str, trigger: str = "1 second"):
        self.events, self.status, self.sink = events, status, sink
        self.checkpoint, self.trigger, self.query = checkpoint, trigger, None

    def _status_line(self) -> DataFrame:
        return self.status().select(F.to_json(F.struct(F.lit("ok").alias("type"), F.struct("*").alias("data"))).alias("line"))

    def _each(self, batch: DataFrame, number: int) -> None:
        self.sink(event_lines(batch), f"{number:012}-event")
        self.sink(self._status_line(), f"{number:012}-status")

    def start(self) -> str:
        if self.query is not None and self.query.isActive:
            return "already running"
        writer = self.events.writeStream.foreachBatch(self._each).option("checkpointLocation", self.checkpoint)
        self.query = writer.trigger(processingTime=self.trigger).start()
        return "started"

    def pause(self) -> str:
        if self.query is None or not self.query.isActive:
            return "already paused"
        self.query.processAllAvailable()
        self.query.stop()
        return "paused"

    def stop(self) -> None:
        self.pause()
        bye = self.events.sparkSession.range(1).select(F.to_json(F.struct(F.lit("bye").alias("type"))).alias("line"))
        self.sink(bye, "bye")
