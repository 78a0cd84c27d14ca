"""Schemas of the graph store and the views every graph operator starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Following or followers from which on a user is a hub.
HUB_THRESHOLD = 5000


USERS = "id long not null, login string not null, discovered_at timestamp"
EDGES = "from_user_id long not null, to_user_id long not null, edge_type string not null, weight double, degree int, metadata string, is_active int not null, first_seen_at timestamp, last_seen_at timestamp, removed_at timestamp"
PROFILES = "user_id long not null, name string, avatar_url string, company string, location string, followers long, following long, public_repos long, created_at string, updated_at string, fetched_at timestamp"
HISTORY = "from_user_id long not null, to_user_id long not null, edge_type string not null, action string not null, recorded_at timestamp"
CRAWL_STATE = "crawler_name string not null, scope_key string not null, status string not null, priority string not null, degree int, error_count int, last_error string, crawled_at timestamp, seq long"
CONFIG = "key string not null, value string not null"
EDGE_KEY = ["from_user_id", "to_user_id", "edge_type"]
SCOPE_KEY = ["crawler_name", "scope_key"]


def active(edges: DataFrame) -> DataFrame:
    """Edges that stand now, of any type."""
    return edges.where("is_active = 1")


def follows(edges: DataFrame) -> DataFrame:
    """(from_user_id, to_user_id) of active follow edges; both conditions and the two columns reach the scan."""
    return edges.where("edge_type = 'follows' and is_active = 1").select("from_user_id", "to_user_id")


def latest_edges(delivered: DataFrame) -> DataFrame:
    """One row per edge key of an edge table delivered with repeats: the one seen last (ties: the largest columns)."""
    rest = [c for c in delivered.columns if c not in EDGE_KEY]
    newest = F.max(F.struct(F.col("last_seen_at").alias("_seen"), *rest)).alias("m")
    return delivered.groupBy(*EDGE_KEY).agg(newest).select(*EDGE_KEY, *[F.col(f"m.{c}") for c in rest])


def standing(delivered: DataFrame, edge_type: str) -> DataFrame:
    """(from_user_id, to_user_id): the edges of one type whose row seen last is active, from a table delivered with repeats.

    Keys and state are of fixed width, so rows are aggregated by hash before the shuffle: the last bit of the instant
    takes the state, and the largest wins.
    """
    seen = F.coalesce(F.unix_micros(F.col("last_seen_at").cast("timestamp")), F.lit(-(1 << 61)))
    state = (seen * 2 + F.when(F.col("is_active") == 1, 1).otherwise(0)).alias("s")
    rows = delivered.where(F.col("edge_type") == edge_type).select("from_user_id", "to_user_id", state)
    return rows.groupBy("from_user_id", "to_user_id").agg(F.max("s").alias("s")).where("pmod(s, 2) = 1").select("from_user_id", "to_user_id")


def as_of(edges: DataFrame, instant: str) -> DataFrame:
    """Edges that stood at an instant: seen by then and not removed by then."""
    at = F.lit(instant).cast("timestamp")
    return edges.where((F.col("first_seen_at") <= at) & (F.col("removed_at").isNull() | (F.col("removed_at") > at)))


def stale_profiles(profiles: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Profiles fetched more than ``days`` days before ``now``."""
    return profiles.where(F.col("fetched_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def is_hub(following, followers, threshold: int = HUB_THRESHOLD):
    return (following >= threshold) | (followers >= threshold)
