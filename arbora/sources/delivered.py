"""The graph store behind the delivered tables: users, profiles and edges without repeats, and the crawl state.

Deliveries repeat rows, bring older versions and arrive late; the newest version of a key counts. The same in SQL is
``plans.graph_queries.VIEWS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.users import PROFILE
from arbora.runtime import clean_text, table
from arbora.sources import model


def users(spark, d: str) -> DataFrame:
    """(id, login): one row per id; of different logins the smallest."""
    return table(spark, d, "users").where("id is not null and login is not null").groupBy("id").agg(F.min("login").alias("login"))


def edges(spark, d: str) -> DataFrame:
    """One row per (from_user_id, to_user_id, edge_type), the one seen last."""
    return model.latest_edges(table(spark, d, "edges"))


def follows(spark, d: str) -> DataFrame:
    return model.standing(table(spark, d, "edges"), "follows")


def profiles(spark, d: str) -> DataFrame:
    """The profile fetched last of every user."""
    newest = F.max(F.struct("fetched_at", *PROFILE)).alias("m")
    return table(spark, d, "user_profiles").where("user_id is not null").groupBy("user_id").agg(newest).select("user_id", *[f"m.{c}" for c in PROFILE], "m.fetched_at")


def crawl_state(spark, d: str) -> DataFrame:
    """A scope for every queued login, written as the user's login where there is one.

    Of several rows of a login the first counts. The queue tells neither states nor errors: both are derived from seq.
    """
    q = table(spark, d, "queue_items").select(clean_text(F.col("login")).alias("k"), "queued_at", "seq", "degree", "priority").where("k <> ''")
    rank = [x for c in ("queued_at", "seq") for x in (F.col(c).isNull(), F.col(c))]
    first = q.groupBy("k").agg(F.min(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], "seq", "degree", "priority")).alias("m")).select("k", "m.seq", "m.degree", "m.priority")
    named = users(spark, d).groupBy(F.lower("login").alias("l")).agg(F.min("login").alias("login"))
    r = F.col("seq") % 7
    return first.join(named, F.col("k") == F.col("l"), "left").select(
        F.lit("follow_crawler").alias("crawler_name"),
        F.coalesce("login", "k").alias("scope_key"),
        F.when(r <= 2, "pending").when(r == 3, "in_progress").when(r == 4, "done").when(r == 5, "retry").otherwise("error").alias("status"),
        "priority",
        F.coalesce("degree", F.lit(0)).alias("degree"),
        (F.col("seq") % 3).cast("int").alias("error_count"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(None).cast("timestamp").alias("crawled_at"),
        "seq",
    )


def edge_batch(spark, d: str) -> DataFrame:
    """The latest listing of edge_snapshots as a batch of edges seen again."""
    listed = table(spark, d, "edge_snapshots")
    last = listed.agg(F.max("snapshot_no").alias("last"))
    return listed.join(F.broadcast(last), F.col("snapshot_no") == F.col("last")).groupBy(*model.EDGE_KEY).agg(F.min("degree").alias("degree"), F.min("weight").alias("weight"))
