"""Lookups, lists, counts and recommendations over users, profiles and edges: plain relational plans.

Point lookups are filters that reach the scan; what an index would answer one by one is a single equi-join here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.runtime import scratch
from arbora.sources.model import active, follows

PROFILE = ["name", "company", "location", "followers", "following", "public_repos"]


def apply_limit(df: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows; 0 means all."""
    return df.limit(limit) if limit else df


def with_profiles(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """All users with their profile columns, null where none was fetched."""
    p = profiles.select("user_id", *PROFILE)
    return users.select("id", "login").join(p, F.col("id") == F.col("user_id"), "left").drop("user_id")


def by_login(users: DataFrame, profiles: DataFrame, login: str) -> DataFrame:
    """The user of exactly this login."""
    return with_profiles(users.where(F.col("login") == login), profiles)


def by_id(users: DataFrame, profiles: DataFrame, user_id: int) -> DataFrame:
    return with_profiles(users.where(F.col("id") == user_id), profiles)


def having_profile(users: DataFrame, profiles: DataFrame) -> DataFrame:
    return users.join(profiles.select("user_id"), F.col("id") == F.col("user_id"), "left_semi")


def like_regex(query: str, anchored: bool, escape: bool = True) -> str:
    """A LIKE pattern as regular expression, ASCII letters in either case; a backslash escapes if ``escape``."""
    out, chars = [], iter(query)
    for c in chars:
        if c == "\\" and escape:
            c = next(chars, "")
            out.append(_literal(c))
        else:
            out.append({"%": ".*", "_": "."}.get(c) or _literal(c))
    body = "".join(out)
    return f"(?s)^{body}.*$" if anchored else f"(?s)^.*{body}.*$"


def _literal(c: str) -> str:
    if c.isascii() and c.isalpha():
        return f"[{c.lower()}{c.upper()}]"
    return c if c.isalnum() or not c else "\\" + c


def search(users: DataFrame, profiles: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Users whose login contains the pattern (% and _ are wildcards), those beginning with it first, then by login."""
    found = with_profiles(users.where(F.col("login").rlike(like_regex(query, anchored=False))), profiles)
    first = F.when(F.col("login").rlike(like_regex(query, anchored=True, escape=False)), 0).otherwise(1)
    return apply_limit(found.orderBy(first, "login"), limit)


def edges_of(edges: DataFrame, user_id: int) -> DataFrame:
    """Active edges of any type at either end of which the user stands."""
    return active(edges).where((F.col("from_user_id") == user_id) | (F.col("to_user_id") == user_id))


def has_follow(edges: DataFrame, source: int, target: int) -> DataFrame:
    """One row: whether the directed follow stands."""
    hit = follows(edges).where((F.col("from_user_id") == source) & (F.col("to_user_id") == target))
    return hit.agg((F.count("*") > 0).alias("exists"))


def common(edges: DataFrame, users: DataFrame, a: int, b: int, side: str = "following", limit: int = 50) -> DataFrame:
    """Logins both users follow, or that follow both, by login. For a user and itself: all of them."""
    own, other = ("from_user_id", "to_user_id") if side == "following" else ("to_user_id", "from_user_id")
    mine = follows(edges).where(F.col(own).isin(a, b)).groupBy(other).agg(F.count_distinct(own).alias("n"))
    both = mine.where(F.col("n") == (1 if a == b else 2))
    return apply_limit(both.join(users, F.col(other) == F.col("id")).select("login").distinct().orderBy("login"), limit)


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs that follow each other. One grouping instead of a self-join."""
    f = follows(edges).where("from_user_id <> to_user_id")
    grouped = f.groupBy(F.least("from_user_id", "to_user_id").alias("a"), F.greatest("from_user_id", "to_user_id").alias("b"))
    return grouped.agg(F.count_distinct("from_user_id").alias("n")).where("n = 2").select("a", "b")


def one_sided(edges: DataFrame, user_id: int, side: str) -> DataFrame:
    """Ids the user follows without being followed ('following'), or the reverse ('followers')."""
    f = follows(edges)
    out = f.where(F.col("from_user_id") == user_id).select(F.col("to_user_id").alias("id"))
    back = f.where(F.col("to_user_id") == user_id).select(F.col("from_user_id").alias("id"))
    return out.exceptAll(back) if side == "following" else back.exceptAll(out)


def user_card(edges: DataFrame, users: DataFrame, profiles: DataFrame, login: str) -> DataFrame:
    """One row: profile, sorted following, followers and mutual logins, counts. A self-follow counts as following only.

    No row for an unknown login. The lists are those of one user.
    """
    me = users.where(F.col("login") == login).select(F.col("id").alias("me"))
    f = follows(edges)
    out = f.join(F.broadcast(me), F.col("from_user_id") == F.col("me")).select("me", F.col("to_user_id").alias("peer"), F.lit("out").alias("way"))
    back = f.join(F.broadcast(me), F.col("to_user_id") == F.col("me")).where("from_user_id <> me").select("me", F.col("from_user_id").alias("peer"), F.lit("in").alias("way"))
    named = out.unionByName(back).join(users, F.col("peer") == F.col("id")).groupBy("me").agg(
        F.sort_array(F.collect_set(F.when(F.col("way") == "out", F.col("login")))).alias("following_logins"),
        F.sort_array(F.collect_set(F.when(F.col("way") == "in", F.col("login")))).alias("follower_logins"),
    )
    empty = F.array().cast("array<string>")
    card = by_login(users, profiles, login).join(named, F.col("id") == F.col("me"), "left").drop("me")
    card = card.withColumns({c: F.coalesce(c, empty) for c in ("following_logins", "follower_logins")})
    crawled = profiles.select(F.col("user_id").alias("crawled")).distinct()
    return card.withColumns({"mutual_logins": F.array_sort(F.array_intersect("following_logins", "follower_logins")), "following_count": F.size("following_logins"), "follower_count": F.size("follower_logins")}).join(crawled, F.col("id") == F.col("crawled"), "left").withColumn("profile_crawled", F.col("crawled").isNotNull()).drop("crawled")


def following_counts(edges: DataFrame) -> DataFrame:
    return follows(edges).groupBy("from_user_id").agg(F.count("*").alias("following_count"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    """Distinct sources of active edges of any type per discovery degree."""
    return active(edges).where("degree is not null").groupBy("degree").agg(F.count_distinct("from_user_id").alias("users")).orderBy("degree")


def min_incoming_degree(edges: DataFrame, users: DataFrame) -> DataFrame:
    """(id, degree): the smallest degree of active edges into each user, 0 without any."""
    least = active(edges).groupBy("to_user_id").agg(F.min("degree").alias("degree"))
    return users.select("id").join(least, F.col("id") == F.col("to_user_id"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as double, 0 for a divisor of 0 or less."""
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(0.0))


def graph_counts(edges: DataFrame, users: DataFrame) -> DataFrame:
    """One row: users, edges, users with outgoing and incoming follows, density, mean degree."""
    e = follows(edges).agg(F.count("*").alias("edges"), F.count_distinct("from_user_id").alias("with_outgoing"), F.count_distinct("to_user_id").alias("with_incoming"))
    u = users.agg(F.count("*").alias("users"))
    n = F.col("users")
    return u.join(e).withColumns({"density": F.round(ratio(F.col("edges"), n * (n - 1)), 9), "avg_degree": F.round(ratio(F.col("edges"), n), 6)})


def stats(edges: DataFrame, users: DataFrame, state: DataFrame, components: DataFrame) -> DataFrame:
    """One row: ``graph_counts``, degree range, crawl counts, component count and share of the largest component."""
    span = degree_distribution(edges).agg(F.coalesce(F.min("degree"), F.lit(0)).alias("min_degree"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))
    queue = state.agg(*[F.count_if(F.col("status") == s).alias(f"{s}_scopes") for s in ("pending", "in_progress", "done", "retry", "error")])
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    parts = sizes.agg(F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    return graph_counts(edges, users).join(span).join(queue).join(parts).withColumn("largest_ratio", F.round(ratio(F.col("largest"), F.col("users")), 6)).drop("largest")


def inverse_log(count: Column) -> Column:
    """1 / ln(count) in IEEE arithmetic: infinite for 1."""
    return F.when(count == 1, F.lit(float("inf"))).otherwise(F.lit(1.0) / F.ln(count.cast("double")))


def suggest_all(edges: DataFrame, users_of: DataFrame | None = None) -> DataFrame:
    """(me, candidate, weight, via): weighted common neighbours of all users, or of those in ``users_of`` (column me).

    For y followed by me with at least one follow, each x that y follows, other than me and not yet followed, gains
    1 / ln(out-degree of y). via lists the ids of the y. The two-hop join is on y; a followed hub brings as many
    candidates as it follows, and AQE splits it.
    """
    f = follows(edges)
    counts = f.groupBy(F.col("from_user_id").alias("y")).agg(F.count("*").alias("n"))
    first = f.select(F.col("from_user_id").alias("me"), F.col("to_user_id").alias("y"))
    if users_of is not None:
        first = first.join(users_of.select("me"), "me", "left_semi")
    second = f.join(counts, F.col("from_user_id") == F.col("y")).select("y", F.col("to_user_id").alias("candidate"), inverse_log(F.col("n")).alias("gain"))
    paths = first.join(second, "y").where("candidate <> me")
    known = f.select(F.col("from_user_id").alias("me"), F.col("to_user_id").alias("candidate"))
    fresh = paths.join(known, ["me", "candidate"], "left_anti")
    return fresh.groupBy("me", "candidate").agg(F.sum("gain").alias("weight"), F.array_sort(F.collect_list("y")).alias("via"))


def suggest(edges: DataFrame, users: DataFrame, login: str, limit: int = 20) -> DataFrame:
    """(login, weight, via): recommendations for one user, the best first, then by login."""
    me = users.where(F.col("login") == login).select(F.col("id").alias("me"))
    scored = suggest_all(edges, me)
    named = scored.join(users, F.col("candidate") == F.col("id")).select("login", "weight", "via")
    return apply_limit(named.orderBy(F.desc("weight"), "login"), limit)


def suggest_summary(edges: DataFrame, users: DataFrame, login: str) -> DataFrame:
    """One row: on how many followed users the recommendations rest, and how many candidates there are."""
    me = users.where(F.col("login") == login).select(F.col("id").alias("me"))
    based = follows(edges).join(me, F.col("from_user_id") == F.col("me")).join(users.select("id"), F.col("to_user_id") == F.col("id"))
    return based.agg(F.count("*").alias("based_on")).join(suggest_all(edges, me).agg(F.count("*").alias("candidates")))


def co_targets(edges: DataFrame, edge_type: str, asked: DataFrame) -> DataFrame:
    """(a, b, n): how many targets of an edge type the users of ``asked`` (column a) share with each other user; the
    projection behind co-occurrence relations, searched for a stated set of users against all."""
    e = active(edges).where(F.col("edge_type") == edge_type).select("from_user_id", "to_user_id").distinct()
    left, right = e.select(F.col("from_user_id").alias("a"), "to_user_id"), e.select(F.col("from_user_id").alias("b"), "to_user_id")
    return left.join(asked, "a", "left_semi").join(right, "to_user_id").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def common_of_pairs(follows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, target): what both users of each of the given ``pairs`` (a, b) follow.

    The shorter of the two lists is laid out and looked up in the other, so a pair costs no more than the user who
    follows less: a hub's own list is laid out only for pairs of hubs.
    """
    rows = follows.select(F.col("from_user_id").alias("u"), F.col("to_user_id").alias("target")).distinct()
    counts = rows.groupBy("u").agg(F.count("*").alias("n"))
    sized = pairs.where("a <> b").distinct().join(counts.select(F.col("u").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("u").alias("b"), F.col("n").alias("nb")), "b")
    shorter = F.col("na") <= F.col("nb")
    asked = sized.select("a", "b", F.when(shorter, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(shorter, F.col("b")).otherwise(F.col("a")).alias("y"))
    laid = asked.join(rows.withColumnRenamed("u", "x"), "x")
    return laid.join(rows.withColumnRenamed("u", "y"), ["y", "target"]).select("a", "b", "target")


def export_users(users: DataFrame, profiles: DataFrame) -> DataFrame:
    return with_profiles(users, profiles)


def export_edges(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Active edges of any type by login; those with an unknown end are left out."""
    u = users.select("id", "login")
    a, b = u.select(F.col("id").alias("fi"), F.col("login").alias("from")), u.select(F.col("id").alias("ti"), F.col("login").alias("to"))
    return active(edges).join(a, F.col("from_user_id") == F.col("fi")).join(b, F.col("to_user_id") == F.col("ti")).select("from", "to", F.col("edge_type").alias("type"), "degree")


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as a JSON object with its nulls; infinite and undefined numbers become null."""
    odd = [c for c, kind in df.dtypes if kind in ("double", "float")]
    finite = df.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) for c in odd}) if odd else df
    return finite.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(scratch(df, column)))
