"""Crawl payloads, requests and responses as JSON, and the export document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.operators import users as U

PROFILE_JSON = "login string, id long, name string, avatar_url string, company string, location string, followers long, following long, public_repos long, created_at string, updated_at string"
SUMMARY_JSON = "array<struct<login:string,avatar_url:string>>"
EVENT_JSON = "event string, login string, degree int, new_connections long, following_count long, followers_count long, parent_login string"
REQUEST_JSON = "cmd string, watch boolean"
COMMANDS = ("status", "start", "pause")
PAGE_SIZE = 100


def read_table(spark: SparkSession, path: str, schema: str | None = None, form: str = "parquet") -> DataFrame:
    """A table of the store in any file format Spark reads, with a declared schema where the format has none."""
    reader = spark.read.format(form)
    return (reader.schema(schema) if schema else reader).load(path)


def write_table(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(form).save(path)


def parse_profiles(raw: DataFrame, column: str = "value") -> DataFrame:
    """Profile objects; missing counts are 0, rows that are no object or have no login are left out."""
    parsed = raw.select(F.from_json(column, PROFILE_JSON).alias("p")).select("p.*").where("login is not null")
    return parsed.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("followers", "following", "public_repos")})


def parse_pages(raw: DataFrame, key: str = "login", page: str = "page", column: str = "value") -> DataFrame:
    """(key, place, peer_login, avatar_url): listed users of paginated arrays, a row per page; pages behind the first
    empty or missing one are not read, as a reader that stops there would not."""
    pages = raw.select(F.col(key).alias("k"), F.col(page).alias("n"), F.from_json(column, SUMMARY_JSON).alias("items"))
    full = pages.where(F.size("items") > 0)
    # Pages count from 1: the run of full pages from the first is what can be told by counting.
    run = full.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("n"))).where("i = n")
    rows = run.select("k", "n", F.posexplode("items").alias("at", "peer"))
    return rows.select(F.col("k").alias(key), ((F.col("n") - 1) * PAGE_SIZE + F.col("at")).alias("place"), F.col("peer.login").alias("peer_login"), F.col("peer.avatar_url").alias("avatar_url"))


def parse_requests(raw: DataFrame, column: str = "value") -> DataFrame:
    """``raw`` with (cmd, watch, known) of its request lines; unreadable lines have a null cmd and are not known."""
    parsed = raw.withColumn("_r", F.from_json(column, REQUEST_JSON))
    parsed = parsed.withColumns({"cmd": F.col("_r.cmd"), "watch": F.coalesce(F.col("_r.watch"), F.lit(False))}).drop("_r")
    return parsed.withColumn("known", F.coalesce(F.col("cmd").isin(*COMMANDS), F.lit(False)))


def responses(requests: DataFrame, snapshot: DataFrame | None = None, order: str = "seq", paused: bool = False) -> DataFrame:
    """(order, line): the response to each of one server's requests, in their order.

    start and pause tell whether they changed anything; status gives the one row of ``snapshot``; other commands are
    errors. Requests are typed by people, so their order is no concern of size.
    """
    switch = F.when(F.col("cmd").isin("start", "pause"), F.col("cmd"))
    earlier = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    was = F.coalesce(F.last(switch, ignorenulls=True).over(earlier), F.lit("pause" if paused else "start"))
    said = F.when((F.col("cmd") == "start") & (was == "pause"), "started").when(F.col("cmd") == "start", "already running").when(was == "start", "paused").otherwise("already paused")
    told = requests.withColumn("msg", F.when(switch.isNotNull(), said))
    one = snapshot.select(F.struct("*").alias("status")) if snapshot is not None else requests.sparkSession.range(1).select(F.struct(F.lit(None).cast("string").alias("none")).alias("status"))
    line = (
        F.when(~F.col("known"), F.to_json(F.struct(F.lit("error").alias("type"), F.concat(F.lit("unknown command: "), F.coalesce("cmd", F.lit(""))).alias("msg"))))
        .when(F.col("cmd") == "status", F.to_json(F.struct(F.lit("ok").alias("type"), F.col("status").alias("data"))))
        .otherwise(F.to_json(F.struct(F.lit("ok").alias("type"), F.struct("msg").alias("data"))))
    )
    return told.join(F.broadcast(one)).select(order, line.alias("line"))


def event_lines(events: DataFrame) -> DataFrame:
    """(line) of each event as the protocol sends it; columns that are null are left out."""
    return events.select(F.to_json(F.struct(F.lit("event").alias("type"), F.struct("*").alias("data"))).alias("line"))


def parse_responses(raw: DataFrame, column: str = "value") -> DataFrame:
    """(type, data) of response lines, data as JSON text: what a client dispatches on."""
    return raw.select(F.get_json_object(column, "$.type").alias("type"), F.get_json_object(column, "$.data").alias("data")).where("type is not null")


def parse_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Crawl events by their tag; lines with another tag are ignored."""
    parsed = raw.select(F.from_json(column, EVENT_JSON).alias("e")).select("e.*")
    return parsed.where(F.col("event").isin("user_done", "user_queued"))


def export_lines(edges: DataFrame, users: DataFrame, profiles: DataFrame) -> DataFrame:
    """(kind, json): a line per user and per edge, nulls kept; the form that scales. ``export_document`` is the single document."""
    u = U.as_json(U.export_users(users, profiles)).select(F.lit("user").alias("kind"), "json")
    return u.unionByName(U.as_json(U.export_edges(edges, users)).select(F.lit("edge").alias("kind"), "json"))


def export_document(edges: DataFrame, users: DataFrame, profiles: DataFrame, path: str) -> tuple[int, int]:
    """Write one JSON document {users, edges} to the local file ``path``; number of users and edges.

    One document is one file, so its lines pass through the driver, a partition at a time. ``export_lines`` written as
    text is the form for large graphs.
    """
    counts = []
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for name, df in (("users", U.export_users(users, profiles).orderBy("login")), ("edges", U.export_edges(edges, users).orderBy("from", "to", "type"))):
            f.write(("" if name == "users" else ",") + f'"{name}":[')
            n = 0
            for row in U.as_json(df).toLocalIterator():
                f.write(("," if n else "") + row.json)
                n += 1
            f.write("]")
            counts.append(n)
        f.write("}\n")
    return counts[0], counts[1]


def stored_bytes(df: DataFrame) -> DataFrame:
    """One row: bytes of the files behind a file-based table."""
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))
