"""The crawl queue and the edge store as pure state transitions: (state, batch) to (state, log).

Each transition is one join of the state with its batch on the key, usable on tables and inside ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.runtime import numbered
from arbora.sources.model import EDGE_KEY, HUB_THRESHOLD, SCOPE_KEY, active, is_hub

CRAWLER = "follow_crawler"


def priority_rank(priority: Column) -> Column:
    """0 high, 1 normal, 2 low, null (first) for anything else."""
    return F.when(priority == "high", 0).when(priority == "normal", 1).when(priority == "low", 2)


def claim_order(state: DataFrame, crawler: str = CRAWLER) -> DataFrame:
    """Scopes that can be claimed, in order: pending before retry, then priority, errors and age. Retries count only
    where nothing is pending, which claiming from the top does by itself."""
    ready = state.where((F.col("crawler_name") == crawler) & F.col("status").isin("pending", "retry"))
    keys = [F.when(F.col("status") == "pending", 0).otherwise(1), priority_rank(F.col("priority")).asc_nulls_first(), F.col("error_count"), F.col("seq")]
    return ready.orderBy(*keys)


def claim_places(state: DataFrame, crawler: str = CRAWLER) -> DataFrame:
    """(scope_key, place) of all scopes that can be claimed, numbered in ``claim_order`` without sorting them in one task."""
    ready = state.where((F.col("crawler_name") == crawler) & F.col("status").isin("pending", "retry"))
    ranked = ready.select(F.when(F.col("status") == "pending", 0).otherwise(1).alias("waits"), priority_rank(F.col("priority")).alias("rank"), "error_count", "seq", "scope_key")
    return numbered(ranked, [], ["waits", "rank", "error_count", "seq", "scope_key"], "place").select("scope_key", "place")


def claim(state: DataFrame, count: int = 1, crawler: str = CRAWLER) -> tuple[DataFrame, DataFrame]:
    """(state with the first ``count`` scopes in progress, claimed keys). If anything is pending no retry is claimed."""
    pending = F.col("status") == "pending"
    some = state.where((F.col("crawler_name") == crawler) & pending).limit(1).select(F.lit(True).alias("some"))
    ready = claim_order(state, crawler).join(F.broadcast(some), how="left").where(pending | F.col("some").isNull()).drop("some")
    top = ready.orderBy(F.when(pending, 0).otherwise(1), priority_rank(F.col("priority")).asc_nulls_first(), "error_count", "seq").limit(count).select(*SCOPE_KEY)
    return _update(state, top, {"status": F.lit("in_progress")}), top


def _update(state: DataFrame, keys: DataFrame, changes: dict[str, Column], only: Column | None = None) -> DataFrame:
    hit = keys.select(*[F.col(k).alias(f"_{k}") for k in SCOPE_KEY]).distinct()
    joined = state.join(hit, [F.col(k) == F.col(f"_{k}") for k in SCOPE_KEY], "left")
    when = F.col(f"_{SCOPE_KEY[0]}").isNotNull() if only is None else F.col(f"_{SCOPE_KEY[0]}").isNotNull() & only
    return joined.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in changes.items()}).select(*state.columns)


def reset_to_retry(state: DataFrame, scope_key: str, message: str) -> DataFrame:
    """in_progress to retry with one more error; of this scope for every crawler."""
    hit = (F.col("scope_key") == scope_key) & (F.col("status") == "in_progress")
    return state.withColumns({"error_count": F.when(hit, F.col("error_count") + 1).otherwise(F.col("error_count")), "last_error": F.when(hit, F.lit(message)).otherwise(F.col("last_error")), "status": F.when(hit, F.lit("retry")).otherwise(F.col("status"))})


def mark_error(state: DataFrame, scope_key: str, message: str) -> DataFrame:
    hit = F.col("scope_key") == scope_key
    return state.withColumns({"last_error": F.when(hit, F.lit(message)).otherwise(F.col("last_error")), "status": F.when(hit, F.lit("error")).otherwise(F.col("status"))})


def set_priority(state: DataFrame, keys: DataFrame, priority: str) -> DataFrame:
    return _update(state, keys, {"priority": F.lit(priority)})


def mark_done(state: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    return _update(state, keys, {"status": F.lit("done"), "crawled_at": at})


def requeue(state: DataFrame, keys: DataFrame) -> DataFrame:
    return _update(state, keys, {"status": F.lit("pending")}, F.col("status") == "in_progress")


def enqueue(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, added): scopes of ``batch`` (crawler_name, scope_key, degree, priority, seq) that are not known yet.

    The first writer's degree and priority win, within the batch by seq. New scopes are numbered by their own seq.
    """
    first = F.min(F.struct("seq", "degree", "priority")).alias("m")
    fresh = batch.groupBy(*SCOPE_KEY).agg(first).select(*SCOPE_KEY, "m.*").join(state.select(*SCOPE_KEY), SCOPE_KEY, "left_anti")
    rows = fresh.select(*SCOPE_KEY, F.lit("pending").alias("status"), "priority", "degree", F.lit(0).alias("error_count"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("crawled_at"), "seq")
    return state.select(*rows.columns).unionByName(rows), rows


def recover(state: DataFrame) -> DataFrame:
    """After a crash: in_progress and retry to pending; errors stay counted."""
    return state.withColumn("status", F.when(F.col("status").isin("in_progress", "retry"), "pending").otherwise(F.col("status")))


def defer_hub_scopes(state: DataFrame, edges: DataFrame, users: DataFrame, profiles: DataFrame, threshold: int = HUB_THRESHOLD) -> DataFrame:
    """Pending scopes that somebody following at least ``threshold`` users follows get low priority; inactive follows count too."""
    big = profiles.where(F.col("following") >= threshold).select(F.col("user_id").alias("hub"))
    found = edges.where("edge_type = 'follows'").join(big, F.col("from_user_id") == F.col("hub"), "left_semi").select("to_user_id").distinct()
    logins = users.join(found, F.col("id") == F.col("to_user_id"), "left_semi").select(F.col("login").alias("deferred"))
    joined = state.join(logins, F.col("scope_key") == F.col("deferred"), "left")
    low = F.col("deferred").isNotNull() & (F.col("status") == "pending")
    return joined.withColumn("priority", F.when(low, "low").otherwise(F.col("priority"))).select(*state.columns)


def known_scopes(state: DataFrame, scopes: DataFrame) -> DataFrame:
    """The ``scopes`` (crawler_name, scope_key) that have a crawl state of any status."""
    return scopes.join(state.select(*SCOPE_KEY), SCOPE_KEY, "left_semi")


def pending_scopes(state: DataFrame, crawler: str = CRAWLER, limit: int = 0) -> DataFrame:
    """(scope_key) of the scopes still to be crawled, in no order; 0 as limit is all."""
    open_ = state.where((F.col("crawler_name") == crawler) & F.col("status").isin("pending", "retry", "in_progress")).select("scope_key")
    return open_.limit(limit) if limit else open_


def bootstrap(users: DataFrame, profiles: DataFrame, state: DataFrame, config: DataFrame, seed: DataFrame, crawler: str = CRAWLER) -> dict[str, DataFrame]:
    """The tables of a first run: the user of the one-row profile ``seed`` (login and profile columns), its scope of degree 0
    and its login under the key seed. If there is any user already, all stay as they are."""
    if not users.isEmpty():
        return {"users": users, "profiles": profiles, "state": state, "config": config}
    first = upsert_users(users, seed.select("login", F.lit(0).cast("long").alias("seq")))
    fetched = seed.join(first, "login").select(F.col("id").alias("user_id"), *[c for c in profiles.columns if c != "user_id"])
    scope = seed.select(F.lit(crawler).alias("crawler_name"), F.col("login").alias("scope_key"), F.lit(0).alias("degree"), F.lit("normal").alias("priority"), F.lit(0).cast("long").alias("seq"))
    named = seed.select(F.lit("seed").alias("key"), F.col("login").alias("value"))
    return {"users": first, "profiles": upsert_profiles(profiles, fetched), "state": enqueue(state, scope)[0], "config": set_config(config, named)}


def status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status", "priority").agg(F.count("*").alias("n"))


def previews(state: DataFrame, most: int = 5, crawler: str = CRAWLER) -> DataFrame:
    """(queue, place, login, degree): the next scopes of each pending priority, of retries and of errors."""
    pending = F.col("status") == "pending"
    queue = F.when(pending & F.col("priority").isin("high", "normal", "low"), F.col("priority")).when(F.col("status").isin("retry", "error"), F.col("status"))
    rows = state.where(F.col("crawler_name") == crawler).withColumn("queue", queue).where("queue is not null")
    order = Window.partitionBy("queue").orderBy(F.when(F.col("queue") == "error", 0).otherwise(F.col("error_count")), "seq")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("queue", "place", F.col("scope_key").alias("login"), "degree")


def status_snapshot(state: DataFrame, most: int = 5) -> DataFrame:
    """One row: counts of every state and of pending by priority, and the five previews as arrays."""
    count = lambda s, p=None: F.count_if((F.col("status") == s) & (F.lit(True) if p is None else F.col("priority") == p))
    counts = state.agg(*[count(s).alias(s) for s in ("pending", "in_progress", "done", "retry", "error")], *[count("pending", p).alias(f"pending_{p}") for p in ("high", "normal", "low")])
    grouped = previews(state, most).groupBy().pivot("queue", ["high", "normal", "low", "retry", "error"]).agg(F.array_sort(F.collect_list(F.struct("place", "login", "degree"))))
    return counts.join(grouped.select(*[F.col(c).alias(f"next_{c}") for c in grouped.columns]))


def upsert_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Users plus the unknown logins of ``logins`` (login, seq), numbered after the largest id in the order of seq.

    Ids are dense and the new logins are never sorted in one task.
    """
    fresh = logins.groupBy("login").agg(F.min("seq").alias("seq")).join(users.select("login"), "login", "left_anti")
    placed = numbered(fresh, [], ["seq", "login"], "place")
    top = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = placed.join(F.broadcast(top)).select((F.col("top") + F.col("place")).alias("id"), "login")
    return users.select("id", "login").unionByName(rows)


def upsert_profiles(profiles: DataFrame, fetched: DataFrame) -> DataFrame:
    """Profiles with those of ``fetched`` (same columns) in place of older ones; the latest fetch of a user wins."""
    both = profiles.unionByName(fetched)
    rest = [c for c in both.columns if c != "user_id"]
    newest = F.max(F.struct("fetched_at", *[c for c in rest if c != "fetched_at"])).alias("m")
    return both.groupBy("user_id").agg(newest).select("user_id", *[F.col(f"m.{c}") for c in rest])


def get_config(config: DataFrame, key: str) -> DataFrame:
    """(value) of a key; no row where it is unset."""
    return config.where(F.col("key") == key).select("value")


def set_config(config: DataFrame, changes: DataFrame) -> DataFrame:
    return config.join(changes.select("key"), "key", "left_anti").select("key", "value").unionByName(changes.select("key", "value"))


def upsert_edges(edges: DataFrame, batch: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(edges, outcome): an active edge seen again only moves last_seen_at; an inactive one becomes active; a new one is
    inserted. Weight and degree of known edges never change. outcome has (key, outcome) with new, reactivated, bumped.

    Repeats in the batch count once (smallest degree).
    """
    fresh = batch.groupBy(*EDGE_KEY).agg(F.min(F.struct("degree", "weight")).alias("m")).select(*[F.col(k).alias(f"b_{k}") for k in EDGE_KEY], F.col("m.degree").alias("b_degree"), F.col("m.weight").alias("b_weight"))
    joined = edges.join(fresh, [F.col(k) == F.col(f"b_{k}") for k in EDGE_KEY], "full")
    known, hit = F.col("from_user_id").isNotNull(), F.col("b_from_user_id").isNotNull()
    outcome = F.when(~known, "new").when(hit & (F.col("is_active") == 0), "reactivated").when(hit, "bumped")
    columns = {
        **{k: F.coalesce(k, f"b_{k}") for k in EDGE_KEY},
        "weight": F.when(known, F.col("weight")).otherwise(F.col("b_weight")),
        "degree": F.when(known, F.col("degree")).otherwise(F.col("b_degree")),
        "first_seen_at": F.when(known, F.col("first_seen_at")).otherwise(at),
        "last_seen_at": F.when(hit, at).otherwise(F.col("last_seen_at")),
    }
    if "removed_at" in edges.columns:
        columns["removed_at"] = F.when(hit, None).otherwise(F.col("removed_at"))
    columns["is_active"] = F.when(hit, 1).otherwise(F.col("is_active")).cast("int")
    # The outcome reads the old columns, so everything is computed in one projection.
    rest = [c for c in edges.columns if c not in columns]
    both = joined.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in edges.columns if c not in rest], *rest, outcome.alias("outcome"))
    return both.select(*edges.columns), both.where("outcome is not null").select(*EDGE_KEY, "outcome")


def history_of(outcome: DataFrame, at: Column) -> DataFrame:
    """The change log of an upsert: one 'added' for each new or reactivated edge."""
    return outcome.where("outcome <> 'bumped'").select(*EDGE_KEY, F.lit("added").alias("action"), at.alias("recorded_at"))


def resolve_profiles(scopes: DataFrame, cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """(login, following, followers, resolved): counts from the cache, else from the fetch, else unresolved (to retry)."""
    c = cached.select("login", F.col("following").alias("cf"), F.col("followers").alias("cg"))
    f = fetched.select("login", F.coalesce("following", F.lit(0)).alias("ff"), F.coalesce("followers", F.lit(0)).alias("fg"))
    joined = scopes.select("login").join(c, "login", "left").join(f, "login", "left")
    return joined.select("login", F.coalesce("cf", "ff").alias("following"), F.coalesce("cg", "fg").alias("followers"), F.coalesce("cf", "ff").isNotNull().alias("resolved"))


def crawl_step(state: DataFrame, users: DataFrame, edges: DataFrame, results: DataFrame, at: Column, threshold: int = HUB_THRESHOLD) -> dict[str, DataFrame]:
    """One batch of crawl results through the whole step.

    ``results`` has a row per claimed scope: login, following_count, followers_count, following and followers
    (arrays of struct<login, avatar_url>), seq. Hubs go back to the queue with low priority and are not expanded. Others
    give an edge per listed user in the right direction with the scope's degree, new users, new scopes one degree
    further out, and are done. Result: state, users, edges, history, events.
    """
    # A scope's degree is the least degree of active edges into it, 0 without any.
    hub = is_hub(F.col("following_count"), F.col("followers_count"), threshold)
    least = active(edges).groupBy("to_user_id").agg(F.min("degree").alias("d"))
    known = users.select(F.col("id").alias("uid"), F.col("login").alias("ulogin"))
    scopes = results.join(known, F.col("login") == F.col("ulogin"), "left").join(least, F.col("uid") == F.col("to_user_id"), "left")
    scopes = scopes.select("login", "following_count", "followers_count", "following", "followers", "seq", F.coalesce("d", F.lit(0)).cast("int").alias("degree"), hub.alias("hub"))
    open_ = scopes.where(~F.col("hub"))
    out = open_.select("login", "seq", "degree", F.posexplode("following").alias("place", "peer")).withColumn("side", F.lit(0))
    back = open_.select("login", "seq", "degree", F.posexplode("followers").alias("place", "peer")).withColumn("side", F.lit(1))
    listed = out.unionByName(back).select("login", "seq", "side", "place", "degree", F.col("peer.login").alias("peer"))
    order = F.struct("seq", "side", "place")
    named = listed.select(F.col("peer").alias("login"), order.alias("seq")).unionByName(open_.select("login", F.struct("seq", F.lit(-1).alias("side"), F.lit(-1).alias("place")).alias("seq")))
    new_users = upsert_users(users, named)
    ids = new_users.select("id", "login")
    pair = listed.join(ids.select(F.col("id").alias("a"), F.col("login").alias("al")), F.col("login") == F.col("al")).join(ids.select(F.col("id").alias("b"), F.col("login").alias("bl")), F.col("peer") == F.col("bl"))
    forth = F.col("side") == 0
    batch = pair.select(F.when(forth, F.col("a")).otherwise(F.col("b")).alias("from_user_id"), F.when(forth, F.col("b")).otherwise(F.col("a")).alias("to_user_id"), F.lit("follows").alias("edge_type"), F.lit(1.0).alias("weight"), (F.col("degree") + 1).alias("degree"))
    new_edges, outcome = upsert_edges(edges, batch, at)
    wanted = listed.select(F.lit(CRAWLER).alias("crawler_name"), F.col("peer").alias("scope_key"), (F.col("degree") + 1).alias("degree"), F.lit("normal").alias("priority"), (F.col("seq") * 1_000_000_000 + F.col("side") * 500_000_000 + F.col("place")).cast("long").alias("seq"), F.col("login").alias("parent"))
    queued, added = enqueue(state, wanted.drop("parent"))
    keys = lambda rows: rows.select(F.lit(CRAWLER).alias("crawler_name"), F.col("login").alias("scope_key"))
    deferred = requeue(set_priority(queued, keys(scopes.where("hub")), "low"), keys(scopes.where("hub")))
    after = mark_done(deferred, keys(open_), at)
    connections = listed.groupBy("login").agg(F.count("*").alias("new_connections"))
    done = open_.join(connections, "login", "left").select(F.lit("user_done").alias("event"), "login", "degree", F.coalesce("new_connections", F.lit(0)).alias("new_connections"), F.col("following_count").cast("long").alias("following_count"), F.col("followers_count").cast("long").alias("followers_count"), F.lit(None).cast("string").alias("parent_login"))
    first = wanted.groupBy("scope_key").agg(F.min(F.struct("seq", "parent")).getField("parent").alias("parent_login"))
    queued_events = added.join(first, "scope_key").select(F.lit("user_queued").alias("event"), F.col("scope_key").alias("login"), "degree", F.lit(None).cast("long").alias("new_connections"), F.lit(None).cast("long").alias("following_count"), F.lit(None).cast("long").alias("followers_count"), "parent_login")
    return {"state": after, "users": new_users, "edges": new_edges, "history": history_of(outcome, at), "events": done.unionByName(queued_events)}
