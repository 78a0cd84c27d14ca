"""The pN queries of the core: hierarchies, hot keys, attribute history, snapshot changes, and the SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.operators import hierarchy, history, hotkeys, snapshots
from arbora.runtime import table

TRACKED = ["is_active", "first_seen_at", "removed_at"]
EDGE_KEY = ["from_user_id", "to_user_id", "edge_type"]


def p1_found(spark, d):
    nodes = hierarchy.hierarchy(table(spark, d, "queue_items"))
    return nodes.select(F.col("node").alias("login"), F.col("root").alias("root_login"), F.col("depth").cast("int").alias("depth"))


def p1_paths(spark, d):
    """Path and depth of every tree login."""
    nodes = hierarchy.hierarchy(table(spark, d, "queue_items"), with_paths=True)
    return nodes.where("path is not null").select(F.col("node").alias("login"), F.array_join("path", "/").alias("path"), F.col("depth").cast("int").alias("depth"))


def p1_descendants(spark, d):
    """Every (ancestor, descendant, distance)."""
    return hierarchy.descendants(hierarchy.hierarchy(table(spark, d, "queue_items"), with_paths=True))


def p1_subtree_sizes(spark, d):
    """Nodes of the subtree of every tree login, itself included."""
    nodes = hierarchy.hierarchy(table(spark, d, "queue_items"), with_sizes=True)
    return nodes.where("not in_loop").select("node", "subtree_size")


def p4_found(spark, d):
    return hotkeys.heavy_users(table(spark, d, "edges"))


def p4_users(spark, d):
    """Rows, distinct partners and latest last_seen_at of every user on either side."""
    out = hotkeys.both_sides(table(spark, d, "edges"))
    return out.select("side", "user_id", "rows", "partners", F.unix_micros("latest_seen_at").alias("latest_us"))


def p4_degree_mode(spark, d):
    """Most frequent degree among the edges into each user."""
    return hotkeys.modes(table(spark, d, "edges"), "to_user_id", "degree")


def p4_degree_median(spark, d):
    """Lower median of the degree of the edges into each user."""
    return hotkeys.percentiles(table(spark, d, "edges"), "to_user_id", "degree", 0.5)


def _versions(spark, d):
    return history.history(table(spark, d, "profile_updates"), "user_id", history.iso_instant(F.col("updated_at")), ["followers", "following"], ["fetched_at", "update_id"])


def _seconds(micros):
    return F.floor(F.col(micros) / F.lit(1_000_000)).cast("long")


def p5_found(spark, d):
    return _versions(spark, d).select("user_id", _seconds("valid_from").alias("valid_from"), F.coalesce(_seconds("valid_to"), F.lit(-1)).alias("valid_to"))


def p5_versions(spark, d):
    """The versions with their values."""
    return _versions(spark, d).select("user_id", "followers", "following", _seconds("valid_from").alias("valid_from"), F.coalesce(_seconds("valid_to"), F.lit(-1)).alias("valid_to"))


def p6_found(spark, d):
    return snapshots.snapshot_changes(table(spark, d, "edge_snapshots"), "snapshot_no", EDGE_KEY, TRACKED, "last_seen_at")


def p6_counts(spark, d):
    """Changes of each kind per snapshot."""
    return p6_found(spark, d).groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n"))


_LINKS = r"""
r AS (SELECT node, parent FROM (
  SELECT lower(regexp_replace(login, '^\s+|\s+$', '', 'g')) AS node, lower(regexp_replace(parent_login, '^\s+|\s+$', '', 'g')) AS parent,
         row_number() OVER (PARTITION BY lower(regexp_replace(login, '^\s+|\s+$', '', 'g')) ORDER BY queued_at NULLS LAST, seq NULLS LAST) AS rn
  FROM queue_items WHERE login IS NOT NULL) x WHERE rn = 1 AND node <> ''),
l AS (SELECT r.node, k.node AS parent FROM r LEFT JOIN r k ON r.parent = k.node),
up AS (
  SELECT node, node AS cur, [node] AS path, false AS looped FROM l
  UNION ALL
  SELECT u.node, l.parent, list_append(u.path, l.parent), list_contains(u.path, l.parent)
  FROM up u JOIN l ON l.node = u.cur WHERE l.parent IS NOT NULL AND NOT u.looped),
tops AS (SELECT node, max_by(path, len(path)) AS path, bool_or(looped) AS looped FROM up GROUP BY node)
"""

_VERSIONS = """
o AS (SELECT user_id, followers, following, fetched_at, update_id,
  epoch_us(CAST(CASE WHEN regexp_matches(substr(updated_at, 11), '(Z|[+-][0-9:]+)$') THEN updated_at ELSE updated_at || 'Z' END AS TIMESTAMPTZ)) AS us
  FROM profile_updates WHERE updated_at IS NOT NULL),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, us ORDER BY fetched_at DESC NULLS LAST, update_id DESC NULLS LAST) AS rn FROM o) x WHERE rn = 1),
g AS (SELECT *, lag(followers) OVER w AS pf, lag(following) OVER w AS pg, row_number() OVER w AS i FROM d WINDOW w AS (PARTITION BY user_id ORDER BY us)),
s AS (SELECT * FROM g WHERE i = 1 OR followers IS DISTINCT FROM pf OR following IS DISTINCT FROM pg),
v AS (SELECT user_id, followers, following, us // 1000000 AS valid_from, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us) // 1000000, -1) AS valid_to FROM s)
"""

_CHANGES = """
n AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS after FROM (SELECT DISTINCT snapshot_no FROM edge_snapshots) x),
e AS (SELECT DISTINCT snapshot_no, from_user_id, to_user_id, edge_type, is_active, first_seen_at, removed_at FROM edge_snapshots),
a AS (SELECT e.*, n.snapshot_no AS pair FROM e JOIN n USING (snapshot_no) WHERE n.before IS NOT NULL),
b AS (SELECT e.*, n.after AS pair FROM e JOIN n USING (snapshot_no) WHERE n.after IS NOT NULL),
c AS (SELECT coalesce(a.pair, b.pair) AS snapshot_no, coalesce(a.from_user_id, b.from_user_id) AS from_user_id, coalesce(a.to_user_id, b.to_user_id) AS to_user_id,
  coalesce(a.edge_type, b.edge_type) AS edge_type,
  CASE WHEN b.pair IS NULL THEN 'added' WHEN a.pair IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM a FULL JOIN b ON a.pair = b.pair AND a.from_user_id = b.from_user_id AND a.to_user_id = b.to_user_id AND a.edge_type = b.edge_type
  WHERE a.pair IS NULL OR b.pair IS NULL OR a.is_active IS DISTINCT FROM b.is_active OR a.first_seen_at IS DISTINCT FROM b.first_seen_at OR a.removed_at IS DISTINCT FROM b.removed_at)
"""

_SIDES = """
u AS (SELECT 'from' AS side, from_user_id AS user_id, to_user_id AS partner, last_seen_at FROM edges
  UNION ALL SELECT 'to', to_user_id, from_user_id, last_seen_at FROM edges),
p AS (SELECT side, user_id, count(*) AS "rows", count(DISTINCT partner) AS partners, max(last_seen_at) AS latest FROM u WHERE user_id IS NOT NULL GROUP BY 1, 2)
"""

_WEIGHED = """
w AS (SELECT to_user_id, degree, count(*) AS n FROM edges WHERE degree IS NOT NULL GROUP BY 1, 2)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_paths": p1_paths,
    "p1_descendants": p1_descendants,
    "p1_subtree_sizes": p1_subtree_sizes,
    "p4_found": p4_found,
    "p4_users": p4_users,
    "p4_degree_mode": p4_degree_mode,
    "p4_degree_median": p4_degree_median,
    "p5_found": p5_found,
    "p5_versions": p5_versions,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
}

ORACLES = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT node AS login, CASE WHEN looped THEN list_min(path[list_position(path, path[-1]):]) ELSE path[-1] END AS root_login, CAST(CASE WHEN looped THEN -1 ELSE len(path) - 1 END AS INTEGER) AS depth FROM tops",
    "p1_paths": f"WITH RECURSIVE {_LINKS} SELECT node AS login, array_to_string(list_reverse(path), '/') AS path, CAST(len(path) - 1 AS INTEGER) AS depth FROM tops WHERE NOT looped",
    "p1_descendants": f"WITH RECURSIVE {_LINKS}, f AS (SELECT node, path, unnest(generate_series(2, len(path))) AS i FROM tops WHERE NOT looped) SELECT path[i] AS ancestor, node AS descendant, CAST(i - 1 AS BIGINT) AS distance FROM f",
    "p1_subtree_sizes": f"WITH RECURSIVE {_LINKS} SELECT node, count(*) AS subtree_size FROM (SELECT unnest(path) AS node FROM tops WHERE NOT looped) x GROUP BY 1",
    "p4_found": f'WITH {_SIDES} SELECT side, user_id FROM p WHERE "rows" >= 0.02 * (SELECT count(*) FROM edges)',
    "p4_users": f'WITH {_SIDES} SELECT side, user_id, "rows", partners, epoch_us(latest) AS latest_us FROM p',
    "p4_degree_mode": f"WITH {_WEIGHED} SELECT to_user_id, degree AS mode, n AS mode_rows FROM (SELECT *, row_number() OVER (PARTITION BY to_user_id ORDER BY n DESC, degree) AS rn FROM w) x WHERE rn = 1",
    "p4_degree_median": "SELECT to_user_id, quantile_disc(degree, 0.5) AS percentile, count(*) AS \"rows\" FROM edges WHERE degree IS NOT NULL GROUP BY 1",
    "p5_found": f"WITH {_VERSIONS} SELECT user_id, valid_from, valid_to FROM v",
    "p5_versions": f"WITH {_VERSIONS} SELECT user_id, followers, following, valid_from, valid_to FROM v",
    "p6_found": f"WITH {_CHANGES} SELECT * FROM c",
    "p6_counts": f"WITH {_CHANGES} SELECT snapshot_no, change_kind, count(*) AS n FROM c GROUP BY 1, 2",
}
