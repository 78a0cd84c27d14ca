"""Named queries of the graph engine over the delivered follow graph, and the SQL for each that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from arbora.functions import scalars as S
from arbora.operators import graph, queue, routes, structure
from arbora.operators import users as U
from arbora.runtime import shared_folder, table
from arbora.sources import crawl, delivered as X, model
from arbora.streaming import events as E

#: Logins of ids 4 (follows most) and 1 (followed most).
ME, STAR = "hub-1002b3", "hub-100000"
#: Searches over all users take those whose id is divisible by this as queries, against all rows.
EVERY = 50

VIEWS = r"""
usr AS (SELECT id, min(login) AS login FROM users WHERE id IS NOT NULL AND login IS NOT NULL GROUP BY 1),
edg AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY from_user_id, to_user_id, edge_type ORDER BY last_seen_at DESC NULLS LAST, weight DESC NULLS LAST, degree DESC NULLS LAST, metadata DESC NULLS LAST) AS rn FROM edges) x WHERE rn = 1),
fol AS (SELECT from_user_id, to_user_id FROM edg WHERE edge_type = 'follows' AND is_active = 1),
prof AS (SELECT * EXCLUDE rn FROM (SELECT user_id, name, company, location, followers, following, public_repos, fetched_at,
  row_number() OVER (PARTITION BY user_id ORDER BY fetched_at DESC NULLS LAST, name DESC NULLS LAST, company DESC NULLS LAST, location DESC NULLS LAST, followers DESC NULLS LAST, following DESC NULLS LAST, public_repos DESC NULLS LAST) AS rn
  FROM user_profiles WHERE user_id IS NOT NULL) x WHERE rn = 1),
card AS (SELECT u.id, u.login, p.name, p.company, p.location, p.followers, p.following, p.public_repos FROM usr u LEFT JOIN prof p ON u.id = p.user_id),
state AS (SELECT 'follow_crawler' AS crawler_name, coalesce(u.login, q.k) AS scope_key,
  CASE WHEN seq % 7 <= 2 THEN 'pending' WHEN seq % 7 = 3 THEN 'in_progress' WHEN seq % 7 = 4 THEN 'done' WHEN seq % 7 = 5 THEN 'retry' ELSE 'error' END AS status,
  priority, coalesce(degree, 0) AS degree, CAST(seq % 3 AS INTEGER) AS error_count, seq
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY queued_at NULLS LAST, seq NULLS LAST) AS rn
    FROM (SELECT *, lower(regexp_replace(login, '^\s+|\s+$', '', 'g')) AS k FROM queue_items) x WHERE k <> '') q
  LEFT JOIN (SELECT lower(login) AS l, min(login) AS login FROM usr GROUP BY 1) u ON u.l = q.k WHERE rn = 1),
batch AS (SELECT from_user_id, to_user_id, edge_type, min(degree) AS degree, min(weight) AS weight FROM edge_snapshots WHERE snapshot_no = (SELECT max(snapshot_no) FROM edge_snapshots) GROUP BY 1, 2, 3),
adj AS (SELECT from_user_id AS src, to_user_id AS dst, from_user_id AS pf, to_user_id AS pt, 0 AS side FROM fol
  UNION ALL SELECT to_user_id, from_user_id, from_user_id, to_user_id, 1 FROM fol),
rk AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY pf, pt, side) AS rank FROM adj)
"""
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Register a query under its function's name, with its SQL over VIEWS."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{VIEWS} {sql}"
        return f

    return register


def _at():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


def _users(s, d):
    return X.users(s, d), X.profiles(s, d)


# Lookups and lists


@query("SELECT * FROM card")
def users_with_profile(s, d):
    return U.with_profiles(*_users(s, d))


@query(f"SELECT * FROM card WHERE login = '{ME}'")
def user_lookup(s, d):
    return U.by_login(*_users(s, d), ME)


@query("SELECT * FROM card WHERE id = 4")
def user_by_id(s, d):
    return U.by_id(*_users(s, d), 4)


@query("SELECT id, login FROM usr WHERE id IN (SELECT user_id FROM prof)")
def users_having_profile(s, d):
    return U.having_profile(*_users(s, d))


@query("SELECT * FROM card WHERE login ILIKE '%b-100_%' ORDER BY CASE WHEN login ILIKE 'b-100_%' THEN 0 ELSE 1 END, login LIMIT 20")
def search_users(s, d):
    return U.search(*_users(s, d), "B-100_")


@query("SELECT from_user_id, to_user_id, edge_type, degree FROM edg WHERE is_active = 1 AND (from_user_id = 1 OR to_user_id = 1)")
def edges_of_user(s, d):
    return U.edges_of(X.edges(s, d), 1).select("from_user_id", "to_user_id", "edge_type", "degree")


@query("SELECT * FROM fol")
def follows_pairs(s, d):
    return X.follows(s, d)


@query("SELECT 1 AS source, 2 AS target, count(*) > 0 AS \"exists\" FROM fol WHERE from_user_id = 1 AND to_user_id = 2 UNION ALL SELECT m.f, m.t, true FROM (SELECT from_user_id AS f, to_user_id AS t FROM fol ORDER BY 1, 2 LIMIT 1) m")
def has_follows_edge(s, d):
    """Whether 1 follows 2, and whether the first pair of the table stands."""
    e = X.edges(s, d)
    first = model.follows(e).orderBy("from_user_id", "to_user_id").first()
    pairs = [(1, 2), (first.from_user_id, first.to_user_id)]
    one, two = (U.has_follow(e, a, b).select(F.lit(a).cast("long").alias("source"), F.lit(b).cast("long").alias("target"), "exists") for a, b in pairs)
    return one.unionByName(two)


@query("SELECT DISTINCT u.login FROM fol a JOIN fol b ON a.to_user_id = b.to_user_id AND a.from_user_id = 4 AND b.from_user_id = 5 JOIN usr u ON u.id = a.to_user_id ORDER BY 1 LIMIT 50")
def common_following(s, d):
    return U.common(X.edges(s, d), X.users(s, d), 4, 5, "following")


@query("SELECT DISTINCT u.login FROM fol a JOIN fol b ON a.from_user_id = b.from_user_id AND a.to_user_id = 1 AND b.to_user_id = 2 JOIN usr u ON u.id = a.from_user_id ORDER BY 1 LIMIT 50")
def common_followers(s, d):
    return U.common(X.edges(s, d), X.users(s, d), 1, 2, "followers")


@query("SELECT p.from_user_id AS a, p.to_user_id AS b, x.to_user_id AS target FROM fol p JOIN fol x ON x.from_user_id = p.from_user_id JOIN fol y ON y.from_user_id = p.to_user_id AND y.to_user_id = x.to_user_id WHERE p.from_user_id <> p.to_user_id")
def common_following_all(s, d):
    """What the two ends of every follow both follow."""
    return U.common_of_pairs(X.follows(s, d), X.follows(s, d).select(F.col("from_user_id").alias("a"), F.col("to_user_id").alias("b")))


@query("SELECT a.from_user_id AS a, a.to_user_id AS b FROM fol a JOIN fol b ON a.from_user_id = b.to_user_id AND a.to_user_id = b.from_user_id WHERE a.from_user_id < a.to_user_id")
def mutual_pairs(s, d):
    return U.mutual_pairs(X.edges(s, d))


@query("SELECT to_user_id AS id FROM fol WHERE from_user_id = 4 EXCEPT SELECT from_user_id FROM fol WHERE to_user_id = 4")
def following_only(s, d):
    return U.one_sided(X.edges(s, d), 4, "following")


@query("SELECT from_user_id AS id FROM fol WHERE to_user_id = 1 EXCEPT SELECT to_user_id FROM fol WHERE from_user_id = 1")
def followers_only(s, d):
    return U.one_sided(X.edges(s, d), 1, "followers")


_LOGINS = "array_to_string((SELECT list(u.login ORDER BY u.login) FROM fol f JOIN usr u ON u.id = f.{far} WHERE f.{own} = c.id AND f.from_user_id <> f.to_user_id{more}), ',')"


@query(f"""SELECT c.login, c.name, c.following, {_LOGINS.format(own="from_user_id", far="to_user_id", more="")} AS following_logins, {_LOGINS.format(own="to_user_id", far="from_user_id", more="")} AS follower_logins,
 {_LOGINS.format(own="from_user_id", far="to_user_id", more=" AND EXISTS (SELECT 1 FROM fol g WHERE g.from_user_id = f.to_user_id AND g.to_user_id = f.from_user_id)")} AS mutual_logins,
 (SELECT count(*) FROM fol f JOIN usr u ON u.id = f.to_user_id WHERE f.from_user_id = c.id) AS following_count, (SELECT count(*) FROM fol f JOIN usr u ON u.id = f.from_user_id WHERE f.to_user_id = c.id AND f.from_user_id <> c.id) AS follower_count,
 EXISTS (SELECT 1 FROM prof p WHERE p.user_id = c.id) AS profile_crawled FROM card c WHERE c.login = '{ME}'""")
def user_profile(s, d):
    card = U.user_card(X.edges(s, d), *_users(s, d), ME)
    joined = {c: F.when(F.size(c) > 0, F.array_join(c, ",")) for c in ("following_logins", "follower_logins", "mutual_logins")}
    return card.withColumns(joined).select("login", "name", "following", *joined, F.col("following_count").cast("long").alias("following_count"), F.col("follower_count").cast("long").alias("follower_count"), "profile_crawled")


# Counts


@query("SELECT degree, count(DISTINCT from_user_id) AS users FROM edg WHERE is_active = 1 AND degree IS NOT NULL GROUP BY 1")
def degree_dist(s, d):
    return U.degree_distribution(X.edges(s, d))


_COUNTS = "(SELECT count(*) FROM usr) AS users, (SELECT count(*) FROM fol) AS edges, (SELECT count(DISTINCT from_user_id) FROM fol) AS with_outgoing, (SELECT count(DISTINCT to_user_id) FROM fol) AS with_incoming"


@query(f"SELECT *, round(edges / (users * (users - 1.0)), 9) AS density, round(CAST(edges AS DOUBLE) / users, 6) AS avg_degree FROM (SELECT {_COUNTS}) x")
def graph_counts(s, d):
    return U.graph_counts(X.edges(s, d), X.users(s, d))


@query("SELECT from_user_id, count(*) AS following_count FROM fol GROUP BY 1")
def following_count(s, d):
    return U.following_counts(X.edges(s, d))


@query("SELECT u.id, coalesce(min(e.degree), 0) AS degree FROM usr u LEFT JOIN edg e ON e.to_user_id = u.id AND e.is_active = 1 GROUP BY 1")
def min_incoming_degree(s, d):
    return U.min_incoming_degree(X.edges(s, d), X.users(s, d))


_WCC = """, und AS (SELECT DISTINCT src AS x, dst AS y FROM adj WHERE src <> dst),
cc(id, c) USING KEY (id) AS (SELECT id, id FROM usr UNION (SELECT r.id, min(cc.c) FROM cc JOIN und ON und.x = cc.id JOIN recurring.cc r ON r.id = und.y WHERE cc.c < r.c GROUP BY r.id))"""


@query(f"{_WCC} SELECT id, c AS component FROM cc", recursive=True)
def wcc(s, d):
    return graph.components(X.users(s, d), X.follows(s, d))


@query(f"{_WCC} SELECT count(*) AS components, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS largest_ratio FROM (SELECT c, count(*) AS n FROM cc GROUP BY 1) x", recursive=True)
def wcc_summary(s, d):
    return graph.component_summary(graph.components(X.users(s, d), X.follows(s, d)))


@query(
    f"""{_WCC} SELECT *, round(edges / (users * (users - 1.0)), 9) AS density, round(CAST(edges AS DOUBLE) / users, 6) AS avg_degree,
 (SELECT min(degree) FROM edg WHERE is_active = 1) AS min_degree, (SELECT max(degree) FROM edg WHERE is_active = 1) AS max_degree,
 (SELECT count(*) FROM state WHERE status = 'pending') AS pending_scopes, (SELECT count(*) FROM state WHERE status = 'in_progress') AS in_progress_scopes, (SELECT count(*) FROM state WHERE status = 'done') AS done_scopes,
 (SELECT count(*) FROM state WHERE status = 'retry') AS retry_scopes, (SELECT count(*) FROM state WHERE status = 'error') AS error_scopes,
 (SELECT count(DISTINCT c) FROM cc) AS components, round((SELECT max(n) FROM (SELECT count(*) AS n FROM cc GROUP BY c) y) / CAST(users AS DOUBLE), 6) AS largest_ratio FROM (SELECT {_COUNTS}) x""",
    recursive=True,
)
def stats(s, d):
    parts = graph.components(X.users(s, d), X.follows(s, d))
    return U.stats(X.edges(s, d), X.users(s, d), X.crawl_state(s, d), parts)


# Recommendations

_SUGGEST = """, n AS (SELECT from_user_id AS y, count(*) AS n FROM fol GROUP BY 1),
hop AS (SELECT a.from_user_id AS me, b.to_user_id AS candidate, a.to_user_id AS y, CASE WHEN n.n = 1 THEN CAST('Infinity' AS DOUBLE) ELSE 1.0 / ln(n.n) END AS gain
  FROM fol a JOIN fol b ON a.to_user_id = b.from_user_id JOIN n ON n.y = b.from_user_id
  WHERE b.to_user_id <> a.from_user_id AND NOT EXISTS (SELECT 1 FROM fol k WHERE k.from_user_id = a.from_user_id AND k.to_user_id = b.to_user_id)),
sug AS (SELECT me, candidate, sum(gain) AS weight, list(y ORDER BY y) AS via FROM hop GROUP BY 1, 2)"""


@query(f"SELECT a.from_user_id AS me, a.to_user_id AS y, b.to_user_id AS x FROM fol a JOIN fol b ON a.to_user_id = b.from_user_id WHERE a.from_user_id % {EVERY} = 0")
def two_hop(s, d):
    f = X.follows(s, d)
    return f.where(F.col("from_user_id") % EVERY == 0).select(F.col("from_user_id").alias("me"), F.col("to_user_id").alias("y")).join(f.select(F.col("from_user_id").alias("y"), F.col("to_user_id").alias("x")), "y").select("me", "y", "x")


@query(f"{_SUGGEST} SELECT u.login, round(s.weight, 6) AS weight, array_to_string(s.via, ',') AS via FROM sug s JOIN usr u ON u.id = s.candidate WHERE s.me = 4 ORDER BY s.weight DESC, u.login LIMIT 20")
def suggest(s, d):
    return U.suggest(X.edges(s, d), X.users(s, d), ME).select("login", F.round("weight", 6).alias("weight"), F.array_join("via", ",").alias("via"))


@query(f"{_SUGGEST} SELECT me, candidate, round(weight, 6) AS weight, array_to_string(via, ',') AS via FROM sug WHERE me % {EVERY} = 0")
def suggest_all_candidates(s, d):
    asked = X.users(s, d).where(F.col("id") % EVERY == 0).select(F.col("id").alias("me"))
    return U.suggest_all(X.edges(s, d), asked).select("me", "candidate", F.round("weight", 6).alias("weight"), F.array_join("via", ",").alias("via"))


@query(f"{_SUGGEST} SELECT (SELECT count(*) FROM fol WHERE from_user_id = 4) AS based_on, (SELECT count(*) FROM sug WHERE me = 4) AS candidates")
def suggest_summary(s, d):
    return U.suggest_summary(X.edges(s, d), X.users(s, d), ME)


@query("SELECT a.from_user_id AS a, b.from_user_id AS b, count(*) AS n FROM edg a JOIN edg b ON a.to_user_id = b.to_user_id AND a.from_user_id <> b.from_user_id AND a.edge_type = 'starred' AND b.edge_type = 'starred' AND a.is_active = 1 AND b.is_active = 1 WHERE a.from_user_id % 50 = 0 GROUP BY 1, 2")
def co_starred(s, d):
    asked = X.users(s, d).where(F.col("id") % EVERY == 0).select(F.col("id").alias("a"))
    return U.co_targets(X.edges(s, d), "starred", asked)


# Traversals


@query("SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY pf, pt, side) AS INTEGER) AS rank FROM adj")
def adjacency_ranked(s, d):
    return graph.first_neighbours(graph.adjacency(X.follows(s, d)), 0).select("src", "dst", "rank")


@query("SELECT src, dst, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 50")
def neighbors_top50(s, d):
    return graph.first_neighbours(graph.adjacency(X.follows(s, d))).select("src", "dst", "rank")


_BFS = ", b(id, distance) AS (SELECT CAST(4 AS BIGINT), 0 UNION SELECT adj.dst, b.distance + 1 FROM b JOIN adj ON adj.src = b.id WHERE b.distance < 40), dist AS (SELECT id, min(distance) AS distance FROM b GROUP BY 1)"
# All shortest paths back from the targets; the smallest sequence of places is the one a queue finds first.
_WAYS = """, way(target, cur, path, places) AS (SELECT id, id, [id], CAST([] AS STRUCT(f BIGINT, t BIGINT, s INTEGER)[]) FROM goals UNION ALL
  SELECT w.target, adj.src, list_prepend(adj.src, w.path), list_prepend({'f': adj.pf, 't': adj.pt, 's': adj.side}, w.places)
  FROM way w JOIN dist dc ON dc.id = w.cur JOIN adj ON adj.dst = w.cur JOIN dist ds ON ds.id = adj.src WHERE dc.distance > 0 AND ds.distance = dc.distance - 1),
best AS (SELECT target, path FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY places) AS rn FROM way WHERE cur = 4) x WHERE rn = 1)"""
_FAR = ", goals AS (SELECT id FROM dist ORDER BY distance DESC, id LIMIT 1)"
_FUZZY = ", hits AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN login ILIKE 'hub%' THEN 0 ELSE 1 END, login) - 1 AS place FROM usr WHERE login ILIKE '%hub%' ORDER BY place LIMIT 20), goals AS (SELECT h.id FROM hits h JOIN dist USING (id))"


@query(f"{_BFS} SELECT * FROM dist", recursive=True)
def bfs_distance(s, d):
    return graph.distances(X.follows(s, d), 4)


def _farthest(s, d) -> int:
    """The user farthest from 4."""
    return graph.distances(X.follows(s, d), 4).orderBy(F.desc("distance"), "id").first().id


@query(f"{_BFS}{_FAR} SELECT distance AS hops FROM dist JOIN goals USING (id)", recursive=True)
def shortest_path_len(s, d):
    paths = graph.shortest_paths(X.follows(s, d), 4, [_farthest(s, d)])
    return paths.select((F.size("path") - 1).alias("hops"))


@query(f"{_BFS}{_FAR}{_WAYS} SELECT target, array_to_string(path, ',') AS path FROM best", recursive=True)
def shortest_path(s, d):
    return graph.shortest_paths(X.follows(s, d), 4, [_farthest(s, d)]).select("target", F.array_join("path", ",").alias("path"))


@query(f"{_BFS}{_FUZZY}{_WAYS} SELECT CAST(place AS INTEGER) AS path_no, array_to_string(path, ',') AS path, CAST(len(path) - 1 AS INTEGER) AS hops FROM best JOIN hits ON id = target", recursive=True)
def route_fuzzy(s, d):
    u, p = _users(s, d)
    out = routes.route(X.follows(s, d), u, p, ME, "hub", limit=0, fuzzy=True)
    return out.select("path_no", F.array_join("path", ",").alias("path"), "hops")


@query(
    f"""{_BFS}{_FAR}{_WAYS}, hop AS (SELECT path[i] AS a, path[i + 1] AS b, i - 1 AS hop FROM best, generate_series(1, len(path) - 1) g(i))
SELECT 0 AS path_no, CAST(hop AS INTEGER) AS hop, CASE WHEN EXISTS (SELECT 1 FROM fol WHERE from_user_id = a AND to_user_id = b) THEN a ELSE b END AS from_user_id,
 CASE WHEN EXISTS (SELECT 1 FROM fol WHERE from_user_id = a AND to_user_id = b) THEN b ELSE a END AS to_user_id FROM hop""",
    recursive=True,
)
def path_directed_edges(s, d):
    f = X.follows(s, d)
    return graph.directed_edges(graph.shortest_paths(f, 4, [_farthest(s, d)]).select(F.lit(0).alias("path_no"), "path"), f)


_PATHS = """, w AS (SELECT src, dst, rank FROM rk WHERE rank <= 50),
p(cur, path, ranks) AS (SELECT CAST(4 AS BIGINT), [CAST(4 AS BIGINT)], CAST([] AS BIGINT[]) UNION ALL
  SELECT w.dst, list_append(p.path, w.dst), list_append(p.ranks, w.rank) FROM p JOIN w ON w.src = p.cur WHERE p.cur <> 5 AND len(p.path) < 4 AND NOT list_contains(p.path, w.dst))"""


@query(f"{_PATHS} SELECT array_to_string(path, ',') AS path, array_to_string(ranks, ',') AS ranks FROM p WHERE cur = 5", recursive=True)
def all_paths(s, d):
    """All simple paths of at most four users from 4 to 5."""
    return graph.all_paths(X.follows(s, d), 4, 5, most_nodes=4).select(F.array_join("path", ",").alias("path"), F.array_join("ranks", ",").alias("ranks"))


# Structure


@query()
def bridges(s, d):
    """Compared with removing every user in turn in the tests; as SQL that is a search of the graph for each."""
    return structure.bridges(X.users(s, d), X.follows(s, d))


@query()
def bridge_cards(s, d):
    """The twenty users whose removal splits most."""
    u, p = _users(s, d)
    return structure.bridge_cards(structure.bridges(u, X.follows(s, d)), u, p)


@query("SELECT scope_key FROM state WHERE status IN ('pending', 'retry', 'in_progress')")
def pending_scopes(s, d):
    return queue.pending_scopes(X.crawl_state(s, d))


@query("SELECT login AS scope_key FROM usr WHERE login IN (SELECT scope_key FROM state)")
def has_crawl_state(s, d):
    """The users that are known to the queue."""
    return queue.known_scopes(X.crawl_state(s, d), X.users(s, d).select(F.lit(queue.CRAWLER).alias("crawler_name"), F.col("login").alias("scope_key"))).select("scope_key")


@query("SELECT u.id, u.login, 0 AS degree, 'pending' AS status, u.login AS seed FROM (SELECT 1 AS id, min(login) AS login FROM usr WHERE id = 4) u")
def seed_bootstrap(s, d):
    """An empty store with one seed."""
    u, p = _users(s, d)
    seed = U.by_id(u, p, 4).select("login", *U.PROFILE).withColumn("fetched_at", _at())
    state, config = X.crawl_state(s, d).limit(0), s.createDataFrame([], model.CONFIG.replace(" not null", ""))
    first = queue.bootstrap(u.limit(0), p.limit(0).select("user_id", *U.PROFILE, "fetched_at"), state, config, seed)
    scope = first["state"].select(F.col("scope_key").alias("login"), "degree", "status")
    return first["users"].join(scope, "login").join(queue.get_config(first["config"], "seed").withColumnRenamed("value", "seed")).select("id", "login", "degree", "status", "seed")


@query("SELECT in_degree, count(*) AS users FROM (SELECT count(*) AS in_degree FROM fol GROUP BY to_user_id) x GROUP BY 1")
def in_degree_histogram(s, d):
    return X.follows(s, d).groupBy("to_user_id").agg(F.count("*").alias("in_degree")).groupBy("in_degree").agg(F.count("*").alias("users"))


@query("SELECT DISTINCT c.login, (SELECT count(*) FROM fol a JOIN fol b ON a.from_user_id = b.to_user_id AND a.to_user_id = b.from_user_id WHERE a.from_user_id = c.id AND a.to_user_id <> c.id) AS mutual FROM usr c WHERE c.id IN (SELECT a.from_user_id FROM fol a JOIN fol b ON a.from_user_id = b.to_user_id AND a.to_user_id = b.from_user_id WHERE a.from_user_id <> a.to_user_id)")
def mutual_counts(s, d):
    """Users with mutual follows and how many they have."""
    pairs = U.mutual_pairs(X.edges(s, d))
    ends = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("id")), F.struct(F.col("b").alias("id")))))
    return ends.groupBy("id").agg(F.count("*").alias("mutual")).join(X.users(s, d), "id").select("login", "mutual")


@query()
def communities(s, d):
    return structure.communities(X.users(s, d), X.follows(s, d))


@query()
def community_reps(s, d):
    f, u = X.follows(s, d), X.users(s, d)
    cards = structure.community_cards(structure.communities(u, f), f, u)
    return cards.select("community", "members", "communities", F.array_join("representatives", ",").alias("representatives"))


@query()
def modularity(s, d):
    f, u = X.follows(s, d), X.users(s, d)
    return structure.modularity(f, structure.communities(u, f))


@query(
    f"""{_WCC}, k AS (SELECT src, count(*) AS k FROM adj GROUP BY 1)
SELECT round(sum((1.0 - ka.k * kb.k / (SELECT CAST(count(*) AS DOUBLE) FROM adj)) / (SELECT CAST(count(*) AS DOUBLE) FROM adj)), 6) AS modularity
FROM adj JOIN cc a ON a.id = adj.src JOIN cc b ON b.id = adj.dst JOIN k ka ON ka.src = adj.src JOIN k kb ON kb.src = adj.dst WHERE a.c = b.c""",
    recursive=True,
)
def modularity_by_label(s, d):
    f = X.follows(s, d)
    labels = graph.components(X.users(s, d), f).withColumnRenamed("component", "community")
    return structure.modularity(f, labels)


# Queue and store

_RANK = "CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 WHEN 'low' THEN 2 END"


@query(f"SELECT scope_key, row_number() OVER (ORDER BY CASE status WHEN 'pending' THEN 0 ELSE 1 END, {_RANK} NULLS FIRST, error_count, seq) AS place FROM state WHERE status IN ('pending', 'retry')")
def queue_claim_order(s, d):
    return queue.claim_places(X.crawl_state(s, d))


@query(f"SELECT scope_key, CASE WHEN scope_key IN (SELECT scope_key FROM state WHERE status = 'pending' ORDER BY {_RANK} NULLS FIRST, error_count, seq LIMIT 3) THEN 'in_progress' ELSE status END AS status FROM state")
def queue_claim(s, d):
    return queue.claim(X.crawl_state(s, d), 3)[0].select("scope_key", "status")


_QUEUE = "CASE WHEN status = 'pending' THEN priority WHEN status IN ('retry', 'error') THEN status END"


@query(f"SELECT q AS queue, CAST(place AS INTEGER) AS place, scope_key AS login, degree FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN q = 'error' THEN 0 ELSE error_count END, seq) AS place FROM (SELECT *, {_QUEUE} AS q FROM state) x WHERE q IS NOT NULL) y WHERE place <= 5")
def queue_preview(s, d):
    return queue.previews(X.crawl_state(s, d))


@query("SELECT status, priority, count(*) AS n FROM state GROUP BY 1, 2")
def status_counts(s, d):
    return queue.status_counts(X.crawl_state(s, d))


@query("SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'retry') AS retry, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'pending' AND priority = 'high') AS pending_high, count(*) FILTER (status = 'pending' AND priority = 'normal') AS pending_normal, count(*) FILTER (status = 'pending' AND priority = 'low') AS pending_low FROM state")
def status_snapshot(s, d):
    snap = queue.status_snapshot(X.crawl_state(s, d))
    return snap.drop(*[c for c in snap.columns if c.startswith("next_")])


@query("SELECT scope_key, CASE WHEN status = 'pending' AND scope_key IN (SELECT t.login FROM edg e JOIN usr t ON t.id = e.to_user_id JOIN prof p ON p.user_id = e.from_user_id WHERE e.edge_type = 'follows' AND p.following >= 5000) THEN 'low' ELSE priority END AS priority FROM state")
def hub_defer(s, d):
    return queue.defer_hub_scopes(X.crawl_state(s, d), X.edges(s, d), *_users(s, d)).select("scope_key", "priority")


@query("SELECT user_id, following >= 5000 OR followers >= 5000 AS hub FROM prof")
def hub_flags(s, d):
    return X.profiles(s, d).select("user_id", model.is_hub(F.col("following"), F.col("followers")).alias("hub"))


@query("SELECT scope_key, CASE WHEN status IN ('in_progress', 'retry') THEN 'pending' ELSE status END AS status, error_count FROM state")
def reset_in_progress(s, d):
    return queue.recover(X.crawl_state(s, d)).select("scope_key", "status", "error_count")


@query("SELECT login AS scope_key, 'pending' AS status FROM usr WHERE login NOT IN (SELECT scope_key FROM state) UNION ALL SELECT scope_key, status FROM state")
def pending_insert(s, d):
    batch = X.users(s, d).select(F.lit(queue.CRAWLER).alias("crawler_name"), F.col("login").alias("scope_key"), F.lit(1).alias("degree"), F.lit("normal").alias("priority"), F.col("id").alias("seq"))
    return queue.enqueue(X.crawl_state(s, d), batch)[0].select("scope_key", "status")


_UPSERT = """, m AS (SELECT coalesce(e.from_user_id, b.from_user_id) AS from_user_id, coalesce(e.to_user_id, b.to_user_id) AS to_user_id, coalesce(e.edge_type, b.edge_type) AS edge_type,
 CASE WHEN e.from_user_id IS NULL THEN b.degree ELSE e.degree END AS degree, CASE WHEN b.from_user_id IS NOT NULL THEN 1 ELSE e.is_active END AS is_active,
 CASE WHEN e.from_user_id IS NULL THEN 'new' WHEN b.from_user_id IS NOT NULL AND e.is_active = 0 THEN 'reactivated' WHEN b.from_user_id IS NOT NULL THEN 'bumped' END AS outcome
 FROM edg e FULL JOIN batch b ON e.from_user_id = b.from_user_id AND e.to_user_id = b.to_user_id AND e.edge_type = b.edge_type)"""


@query(f"{_UPSERT} SELECT from_user_id, to_user_id, edge_type, degree, is_active FROM m")
def edge_upsert(s, d):
    return queue.upsert_edges(X.edges(s, d), X.edge_batch(s, d), _at())[0].select("from_user_id", "to_user_id", "edge_type", "degree", "is_active")


@query(f"{_UPSERT} SELECT outcome, count(*) AS n FROM m WHERE outcome IS NOT NULL GROUP BY 1")
def edge_upsert_outcomes(s, d):
    return queue.upsert_edges(X.edges(s, d), X.edge_batch(s, d), _at())[1].groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"{_UPSERT} SELECT from_user_id, to_user_id, edge_type, degree, is_active FROM m")
def edge_store_batch(s, d):
    """The same batch put through the bucketed store, twice under one number as after a failure."""
    store = E.EdgeStore(s, f"{shared_folder(s)}/store-{uuid.uuid4().hex}", X.edges(s, d))
    for _ in range(2):
        store.apply(X.edge_batch(s, d), 0)
    return store.edges().select("from_user_id", "to_user_id", "edge_type", "degree", "is_active")


@query(f"{_UPSERT} SELECT from_user_id, to_user_id, edge_type, 'added' AS action FROM m WHERE outcome IN ('new', 'reactivated')")
def edge_history_delta(s, d):
    return queue.history_of(queue.upsert_edges(X.edges(s, d), X.edge_batch(s, d), _at())[1], _at()).drop("recorded_at")


_CURRENT = """SELECT from_user_id, to_user_id, edge_type FROM (SELECT DISTINCT from_user_id, to_user_id, edge_type, first_seen_at, removed_at FROM edges) x WHERE first_seen_at <= TIMESTAMP '2024-01-01 00:00:00' AND (removed_at IS NULL OR removed_at > TIMESTAMP '2024-01-01 00:00:00')"""


def edges_as_of(s, d):
    """The delivered edges that stood at the start of 2024."""
    return model.as_of(model.latest_edges(table(s, d, "edges")), "2024-01-01 00:00:00").select(*model.EDGE_KEY)


QUERIES["edges_as_of"], ORACLES["edges_as_of"] = edges_as_of, _CURRENT


def stale_profiles(s, d):
    """Users whose latest fetch was more than a week old at the start of 2024."""
    p = table(s, d, "user_profiles").groupBy("user_id").agg(F.max("fetched_at").alias("fetched_at"))
    return model.stale_profiles(p, "2024-01-01 00:00:00").select("user_id")


QUERIES["stale_profiles"] = stale_profiles
ORACLES["stale_profiles"] = "SELECT user_id FROM user_profiles GROUP BY 1 HAVING max(fetched_at) < TIMESTAMP '2023-12-25 00:00:00'"


@query("SELECT id + 0 AS id, login FROM usr UNION ALL SELECT (SELECT max(id) FROM usr) + row_number() OVER (ORDER BY s_suppkey), s_name FROM supplier")
def insert_users(s, d):
    return queue.upsert_users(X.users(s, d), table(s, d, "supplier").select(F.col("s_name").alias("login"), F.col("s_suppkey").alias("seq")))


@query("SELECT user_id, name, followers, epoch_us(fetched_at) AS fetched_us FROM prof")
def upsert_profiles(s, d):
    """All fetches as delivered, put over the ones of the store."""
    columns = ["user_id", *U.PROFILE, "fetched_at"]
    delivered = table(s, d, "user_profiles").select(*columns).where("user_id is not null")
    return queue.upsert_profiles(X.profiles(s, d).select(*columns), delivered).select("user_id", "name", "followers", F.unix_micros("fetched_at").alias("fetched_us"))


_SEEN = ", seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fetched_at DESC NULLS LAST, update_id DESC) AS rn FROM profile_updates WHERE user_id IS NOT NULL) x WHERE rn = 1)"


@query(f"{_SEEN} SELECT c.login, coalesce(c.following, CASE WHEN s.user_id IS NOT NULL THEN coalesce(s.following, 0) END) AS following, coalesce(c.followers, CASE WHEN s.user_id IS NOT NULL THEN coalesce(s.followers, 0) END) AS followers, c.following IS NOT NULL OR s.user_id IS NOT NULL AS resolved FROM card c LEFT JOIN seen s ON s.user_id = c.id")
def profile_resolution(s, d):
    """Every user's counts from the stored profile, else from the newest observation."""
    u, p = _users(s, d)
    newest = table(s, d, "profile_updates").where("user_id is not null").groupBy("user_id").agg(F.max(F.struct("fetched_at", "update_id", "following", "followers")).alias("m"))
    fetched = newest.join(u, F.col("user_id") == F.col("id")).select("login", "m.following", "m.followers")
    return queue.resolve_profiles(u, U.with_profiles(u, p).where("following is not null"), fetched)


def _crawl(s, d):
    """The follow lists of all users that follow or are followed as results of one crawl, over the users discovered so far.

    Lists are gathered only for users that are no hubs, so none is longer than the hub threshold.
    """
    f, every = X.follows(s, d), X.users(s, d)
    known = every.join(table(s, d, "users").where("discovered_at is not null").select("id").distinct(), "id", "left_semi")
    ends = f.select(F.inline(F.array(F.struct(F.col("from_user_id").alias("id"), F.col("to_user_id").alias("peer"), F.lit(0).alias("side")), F.struct(F.col("to_user_id").alias("id"), F.col("from_user_id").alias("peer"), F.lit(1).alias("side")))))
    counts = ends.groupBy("id").agg(F.count_if(F.col("side") == 0).alias("following_count"), F.count_if(F.col("side") == 1).alias("followers_count"))
    open_ = counts.where(~model.is_hub(F.col("following_count"), F.col("followers_count"))).select("id")
    names = every.select(F.col("id").alias("peer"), "login")
    summary = F.struct("login", F.lit(None).cast("string").alias("avatar_url"))
    lists = ends.join(open_, "id", "left_semi").join(names, "peer").groupBy("id").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == k, summary))).alias(c) for k, c in enumerate(("following", "followers"))])
    none = F.array().cast("array<struct<login:string,avatar_url:string>>")
    results = counts.join(every, "id").join(lists, "id", "left").select("login", "following_count", "followers_count", F.coalesce("following", none).alias("following"), F.coalesce("followers", none).alias("followers"), F.col("id").alias("seq"))
    return queue.crawl_step(X.crawl_state(s, d), known, X.edges(s, d), results, _at())


_CRAWL = """, ends AS (SELECT from_user_id AS id, to_user_id AS peer, 0 AS side FROM fol UNION ALL SELECT to_user_id, from_user_id, 1 FROM fol),
counts AS (SELECT id, count(*) FILTER (side = 0) AS following_count, count(*) FILTER (side = 1) AS followers_count FROM ends GROUP BY 1),
opened AS (SELECT u.* FROM usr u JOIN counts c USING (id) WHERE following_count < 5000 AND followers_count < 5000),
disc AS (SELECT DISTINCT id FROM users WHERE discovered_at IS NOT NULL)"""


@query(f"{_CRAWL} SELECT o.login, count(*) AS new_connections FROM opened o JOIN ends e USING (id) JOIN usr p ON p.id = e.peer GROUP BY 1")
def crawl_step_done(s, d):
    """New connections of each scope of a crawl batch."""
    return _crawl(s, d)["events"].where("event = 'user_done'").select("login", "new_connections")


@query(f"{_CRAWL} SELECT DISTINCT p.login FROM opened o JOIN ends e USING (id) JOIN usr p ON p.id = e.peer WHERE p.login NOT IN (SELECT scope_key FROM state)")
def crawl_step_queued(s, d):
    """Logins that the same batch puts into the queue."""
    return _crawl(s, d)["events"].where("event = 'user_queued'").select("login")


@query(f"{_CRAWL} SELECT count(*) AS users FROM (SELECT id FROM disc UNION SELECT id FROM opened UNION SELECT e.peer FROM opened o JOIN ends e USING (id) JOIN usr p ON p.id = e.peer) x")
def crawl_step_users(s, d):
    return _crawl(s, d)["users"].agg(F.count("*").alias("users"))


@query(f"{_CRAWL} SELECT status, count(*) AS n FROM (SELECT CASE WHEN s.scope_key IN (SELECT login FROM opened) THEN 'done' ELSE status END AS status FROM state s UNION ALL SELECT CASE WHEN q.login IN (SELECT login FROM opened) THEN 'done' ELSE 'pending' END FROM (SELECT DISTINCT p.login FROM opened o JOIN ends e USING (id) JOIN usr p ON p.id = e.peer WHERE p.login NOT IN (SELECT scope_key FROM state)) q) x GROUP BY 1")
def crawl_step_state(s, d):
    """Scopes per status after the batch."""
    return _crawl(s, d)["state"].groupBy("status").agg(F.count("*").alias("n"))


# Single transitions, on the scopes of the users that 4 follows where keys are asked for

_KEYS = ", keys AS (SELECT u.login AS k FROM fol JOIN usr u ON u.id = fol.to_user_id WHERE fol.from_user_id = 4)"


def _scopes(s, d):
    mine = X.follows(s, d).where("from_user_id = 4").select(F.col("to_user_id").alias("id"))
    return X.users(s, d).join(mine, "id").select(F.lit(queue.CRAWLER).alias("crawler_name"), F.col("login").alias("scope_key"))


@query(f"{_KEYS} SELECT scope_key, status, CASE WHEN scope_key IN (SELECT k FROM keys) THEN 'high' ELSE priority END AS priority FROM state")
def set_priority(s, d):
    return queue.set_priority(X.crawl_state(s, d), _scopes(s, d), "high").select("scope_key", "status", "priority")


@query(f"{_KEYS} SELECT scope_key, CASE WHEN scope_key IN (SELECT k FROM keys) THEN 'done' ELSE status END AS status, CASE WHEN scope_key IN (SELECT k FROM keys) THEN 1735689600000000 END AS crawled_us FROM state")
def mark_done(s, d):
    return queue.mark_done(X.crawl_state(s, d), _scopes(s, d), _at()).select("scope_key", "status", F.unix_micros("crawled_at").alias("crawled_us"))


@query(f"{_KEYS} SELECT scope_key, CASE WHEN status = 'in_progress' AND scope_key IN (SELECT k FROM keys) THEN 'pending' ELSE status END AS status FROM state")
def requeue_scopes(s, d):
    return queue.requeue(X.crawl_state(s, d), _scopes(s, d)).select("scope_key", "status")


_FIRST = "(SELECT min(scope_key) FROM state WHERE status = 'in_progress')"


def _first_running(s, d) -> str:
    return X.crawl_state(s, d).where("status = 'in_progress'").agg(F.min("scope_key")).first()[0]


@query(f"SELECT scope_key, CASE WHEN scope_key = {_FIRST} THEN 'retry' ELSE status END AS status, CASE WHEN scope_key = {_FIRST} THEN error_count + 1 ELSE error_count END AS error_count, CASE WHEN scope_key = {_FIRST} THEN 'timed out' END AS last_error FROM state")
def reset_to_retry(s, d):
    """The first running scope back to the queue with an error."""
    return queue.reset_to_retry(X.crawl_state(s, d), _first_running(s, d), "timed out").select("scope_key", "status", "error_count", "last_error")


@query(f"SELECT scope_key, CASE WHEN scope_key = {_FIRST} THEN 'error' ELSE status END AS status, CASE WHEN scope_key = {_FIRST} THEN 'gone' END AS last_error FROM state")
def mark_error(s, d):
    return queue.mark_error(X.crawl_state(s, d), _first_running(s, d), "gone").select("scope_key", "status", "last_error")


# Export, protocol


@query("SELECT login, id, name, company, location, coalesce(followers, 0) AS followers, coalesce(following, 0) AS following FROM card")
def profile_payloads(s, d):
    """All users as profile objects of the API, and read back."""
    raw = U.as_json(U.with_profiles(*_users(s, d)), "value")
    return crawl.parse_profiles(raw).select("login", "id", "name", "company", "location", "followers", "following")


@query("SELECT a.login, row_number() OVER (PARTITION BY a.id ORDER BY b.login) - 1 AS place, b.login AS peer_login FROM fol JOIN usr a ON a.id = fol.from_user_id JOIN usr b ON b.id = fol.to_user_id")
def paged_lists(s, d):
    """Every list of followed users as pages of the API, and read back."""
    u = X.users(s, d)
    named = X.follows(s, d).join(u.withColumnsRenamed({"id": "from_user_id", "login": "owner"}), "from_user_id").join(u.withColumnsRenamed({"id": "to_user_id", "login": "peer"}), "to_user_id")
    page = F.floor((F.col("n") - 1) / crawl.PAGE_SIZE) + 1
    placed = queue.numbered(named.select("owner", "peer"), ["owner"], ["peer"], "n").withColumn("page", page.cast("int"))
    item = F.struct("n", F.struct(F.col("peer").alias("login"), F.lit(None).cast("string").alias("avatar_url")).alias("u"))
    pages = placed.groupBy(F.col("owner").alias("login"), "page").agg(F.to_json(F.array_sort(F.collect_list(item)).getField("u")).alias("value"))
    return crawl.parse_pages(pages).select("login", F.col("place").cast("long").alias("place"), "peer_login")


@query("""SELECT CAST(to_json({'id': id, 'login': login, 'name': name, 'company': company, 'location': location, 'followers': followers, 'following': following, 'public_repos': public_repos}) AS VARCHAR) AS json FROM card""")
def json_lines(s, d):
    return U.as_json(U.with_profiles(*_users(s, d)))


@query("SELECT id, login, name, company, location, followers, following, public_repos FROM card")
def export_users(s, d):
    return U.export_users(*_users(s, d))


@query('SELECT a.login AS "from", b.login AS "to", e.edge_type AS type, e.degree FROM edg e JOIN usr a ON a.id = e.from_user_id JOIN usr b ON b.id = e.to_user_id WHERE e.is_active = 1')
def export_edges(s, d):
    return U.export_edges(X.edges(s, d), X.users(s, d))


@query("""SELECT 'user' AS kind, CAST(to_json({'id': id, 'login': login, 'name': name, 'company': company, 'location': location, 'followers': followers, 'following': following, 'public_repos': public_repos}) AS VARCHAR) AS json FROM card
UNION ALL SELECT 'edge', CAST(to_json({'from': a.login, 'to': b.login, 'type': e.edge_type, 'degree': e.degree}) AS VARCHAR) FROM edg e JOIN usr a ON a.id = e.from_user_id JOIN usr b ON b.id = e.to_user_id WHERE e.is_active = 1""")
def export_json(s, d):
    return crawl.export_lines(X.edges(s, d), *_users(s, d))


@query()
def storage_bytes(s, d):
    return crawl.stored_bytes(s.read.parquet(f"{d}/edges.parquet"))


# Scalars over the orders and profiles


@query("SELECT user_id, format('{:,}', followers) AS text FROM prof")
def fmt_num(s, d):
    return X.profiles(s, d).select("user_id", S.num(F.col("followers")).alias("text"))


@query("SELECT user_id, CASE WHEN followers >= 3600 THEN (followers // 3600) || 'h ' || (followers % 3600 // 60) || 'm ' || (followers % 60) || 's' WHEN followers >= 60 THEN (followers // 60) || 'm ' || (followers % 60) || 's' ELSE followers || 's' END AS text FROM prof")
def fmt_uptime(s, d):
    return X.profiles(s, d).select("user_id", S.uptime(F.col("followers")).alias("text"))


@query("SELECT user_id, repeat('█', greatest(CAST(floor(CAST(followers AS DOUBLE) / (SELECT max(followers) FROM prof) * 30) AS INTEGER), 1)) AS text FROM prof")
def bar(s, d):
    p = X.profiles(s, d)
    return p.join(F.broadcast(p.agg(F.max("followers").alias("most")))).select("user_id", S.bar(F.col("followers"), F.col("most"), 30).alias("text"))


@query("SELECT user_id, repeat('█', least(CAST(floor(following / 5000.0 * 20) AS INTEGER), 20)) AS text, CASE WHEN following / 5000.0 > 0.66 THEN 'high' WHEN following / 5000.0 > 0.33 THEN 'middle' ELSE 'low' END AS colour FROM prof")
def weight_bar(s, d):
    v, most = F.col("following").cast("double"), F.lit(5000.0)
    return X.profiles(s, d).select("user_id", S.weight_bar(v, most, 20).alias("text"), S.weight_colour(v, most).alias("colour"))


@query("""SELECT user_id, CASE WHEN followers / 1e6 > 0.001 THEN 'high' WHEN followers / 1e6 > 0.0001 THEN 'middle' ELSE 'low' END || ' ' || printf('%.6f', followers / 1e6) AS density,
 CASE WHEN followers >= 1000 THEN 'high' WHEN followers >= 100 THEN 'middle' ELSE 'low' END || ' ' || followers AS impact,
 CASE WHEN followers / 1e4 > 0.5 THEN 'high' WHEN followers / 1e4 > 0.3 THEN 'middle' ELSE 'low' END || ' ' || printf('%.4f', followers / 1e4) AS modularity,
 CASE WHEN followers >= 1000 THEN 'ample' WHEN followers >= 100 THEN 'low' ELSE 'critical' END AS quota FROM prof""")
def thresholds(s, d):
    n = F.col("followers")
    return X.profiles(s, d).select("user_id", S.density_bucket(n / 1e6).alias("density"), S.impact_bucket(n).alias("impact"), S.modularity_bucket(n / 1e4).alias("modularity"), S.quota_bucket(n).alias("quota"))


# Display columns in SQL: letters without marks, wide ones twice.
_WIDTH = "(length_grapheme({c}) + length(regexp_replace({c}, '[^\\x{{1100}}-\\x{{115F}}\\x{{2E80}}-\\x{{A4CF}}\\x{{AC00}}-\\x{{D7A3}}\\x{{F900}}-\\x{{FAFF}}\\x{{FE30}}-\\x{{FE6F}}\\x{{FF00}}-\\x{{FF60}}\\x{{FFE0}}-\\x{{FFE6}}]', '', 'g')))"
_BLANKS = f"repeat(' ', greatest(10 - {_WIDTH.format(c='location')}, 0))"


@query(f"SELECT user_id, CASE WHEN length_grapheme(name) <= 12 THEN name ELSE left_grapheme(name, 11) || '…' END AS short, location || {_BLANKS} AS wide, {_BLANKS} || location AS right, {_WIDTH.format(c='name')} AS width FROM prof")
def truncate(s, d):
    return X.profiles(s, d).select("user_id", S.truncate(F.col("name"), 12).alias("short"), S.pad_right(F.col("location"), 10).alias("wide"), S.pad_left(F.col("location"), 10).alias("right"), S.visible_width(F.col("name")).cast("long").alias("width"))


@query("SELECT update_id, substr(updated_at, 1, 10) AS day FROM profile_updates")
def date_prefix(s, d):
    return table(s, d, "profile_updates").select("update_id", S.date_prefix(F.col("updated_at")).alias("day"))


@query("SELECT user_id, CASE WHEN followers * 1000 > 1000000 THEN printf('%.1f', followers / 1000.0) || ' MB' ELSE followers || ' KB' END AS text FROM prof")
def file_size(s, d):
    return X.profiles(s, d).select("user_id", S.file_size(F.col("followers") * 1000).alias("text"))


@query("SELECT user_id, printf('%.1f', followers / 10000.0 * 100.0) || '%' AS share, printf('%.2f', CAST(followers AS DOUBLE)) AS number, greatest(followers - following, 0) AS rest FROM prof")
def number_texts(s, d):
    n = F.col("followers")
    return X.profiles(s, d).select("user_id", S.percent(n / 10000.0).alias("share"), S.two_decimals(n.cast("double")).alias("number"), S.saturating_minus(n, F.col("following")).alias("rest"))


@query("SELECT user_id, strftime(make_timestamp(followers * 1000000), '%H:%M:%S') || ' (' || CASE WHEN greatest(followers - 1000, 0) < 60 THEN greatest(followers - 1000, 0) || 's' WHEN followers - 1000 < 3600 THEN ((followers - 1000) // 60) || 'm ' || ((followers - 1000) % 60) || 's' ELSE ((followers - 1000) // 3600) || 'h ' || ((followers - 1000) % 3600 // 60) || 'm' END || ')' AS text FROM prof WHERE followers > 0")
def quota_reset(s, d):
    return X.profiles(s, d).where("followers > 0").select("user_id", S.quota_reset(F.col("followers"), F.lit(1000)).alias("text"))


@query("SELECT a.login || ' → ' || b.login AS text FROM fol f JOIN usr a ON a.id = f.from_user_id JOIN usr b ON b.id = f.to_user_id")
def edge_texts(s, d):
    e = U.export_edges(X.edges(s, d), X.users(s, d)).where("type = 'follows'")
    return e.select(S.directed_edge(F.col("from"), F.col("to")).alias("text"))


@query("SELECT user_id, CASE WHEN len(l) > 2 THEN array_to_string(l[:2], ' · ') || ' · … ' || (len(l) - 2) || ' more' ELSE array_to_string(l, ' · ') END AS text, greatest(len(l) - 1, 0) AS hops FROM (SELECT user_id, list_filter([name, company, location], lambda x: x IS NOT NULL) AS l FROM prof) x")
def chain_texts(s, d):
    """What is known of each user as a chain of at most two texts and a count of the rest."""
    known = F.array_compact(F.array("name", "company", "location"))
    return X.profiles(s, d).select("user_id", S.path_chain(S.listed(known, 2)).alias("text"), S.hops(known).cast("long").alias("hops"))


@query("SELECT max(seq) AS seq, arg_max(status, seq) AS status FROM state")
def latest_status(s, d):
    """The last of a row of snapshots, which replace each other."""
    return E.latest_status(X.crawl_state(s, d).select(F.col("seq").alias("ts"), "status")).select(F.col("ts").alias("seq"), "status")


# Event stream: driven over the event file with availableNow, compared with the batch form

_EVENTS = ", ev AS (SELECT event_id, ts, user_id, CASE WHEN event_type IN ('purchase', 'view') THEN 'user_done' ELSE 'user_queued' END AS event FROM events)"


@query(f"{_EVENTS} SELECT event, count(*) AS n, count(user_id) AS with_user FROM ev GROUP BY 1")
def stream_event_counts(s, d):
    return E.run_once(E.event_counts(E.read_events(s, d)), "stream_event_counts")


@query(f"{_EVENTS} SELECT DISTINCT user_id FROM ev WHERE event = 'user_queued' AND user_id IS NOT NULL")
def stream_dedup_enqueue(s, d):
    return E.run_once(E.first_enqueue(E.read_events(s, d)), "stream_dedup_enqueue", "append")


@query(f"{_EVENTS} SELECT date_trunc('hour', ts) AS start, event, count(*) AS n FROM ev GROUP BY 1, 2")
def stream_windowed_counts(s, d):
    return E.run_once(E.windowed_counts(E.read_events(s, d)), "stream_windowed_counts")


@query(f"{_EVENTS} SELECT event_id, user_id, event FROM ev")
def event_concat(s, d):
    """Both kinds of events taken apart and put together again."""
    apart = E.demultiplex(E.as_crawl_events(table(s, d, "events")))
    return E.chained(apart["user_done"], apart["user_queued"]).select("event_id", "user_id", "event")


@query("SELECT greatest(3, max(length(degree || '°'))) AS degree_width, least(max(length(scope_key)), 30) AS login_width FROM state")
def column_widths(s, d):
    return E.column_widths(X.crawl_state(s, d).select("degree", F.col("scope_key").alias("login")))


@query(f"{_EVENTS} SELECT event, event_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY ts DESC, event_id DESC) AS place FROM ev) x WHERE place <= 9999")
def ring_buffer_latest(s, d):
    return E.newest(E.as_crawl_events(table(s, d, "events"))).select("event", "event_id", "place")


@query(f"{_EVENTS} SELECT event, event_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY ts DESC, event_id DESC) AS place FROM ev) x WHERE place > 10 AND place <= 30")
def event_page(s, d):
    return E.page(E.as_crawl_events(table(s, d, "events")), 20, 10).select("event", "event_id", "place")
