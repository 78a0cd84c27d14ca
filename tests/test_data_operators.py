"""Hierarchy, hot keys, history and snapshots: nulls, ties, repeats, empty tables, clashing columns."""

import random

from pyspark.sql import functions as F

from arbora.operators import hierarchy, history, hotkeys, snapshots

QUEUE = "seq long, login string, parent_login string, queued_at timestamp, node string, up string, path string"


def queue(spark, links):
    rows = [(i, a, b, None, "x", "y", "z") for i, (a, b) in enumerate(links)]
    return spark.createDataFrame(rows, QUEUE).withColumn("queued_at", F.timestamp_seconds(F.col("seq") + 10))


def walked(links):
    parent = dict(links)
    out = {}
    for x in parent:
        path, y = [x], x
        while parent[y] is not None and parent[y] not in path:
            y = parent[y]
            path.append(y)
        if parent[y] is None:
            out[x] = (y, len(path) - 1, "/".join(path[::-1]))
        else:
            out[x] = (min(path[path.index(parent[y]) :]), -1, None)
    return out


def result(spark, links, residue=0):
    raw = hierarchy.normalized_links(queue(spark, links), "login", "parent_login", ["queued_at", "seq"])
    nodes = hierarchy.peel(raw, with_sizes=True, with_paths=True, residue=residue)
    below = {}
    for r in nodes.collect():
        for x in r.path or []:
            below[x] = below.get(x, 0) + 1
    assert {r.node: r.subtree_size for r in nodes.collect()} == {r.node: below.get(r.node) for r in nodes.collect()}
    return {r.node: (r.root, r.depth, "/".join(r.path) if r.path else None) for r in nodes.collect()}


def test_trees_chains_and_loops(spark):
    links = [("r", None), *[(f"c{i:03}", f"c{i - 1:03}" if i else "r") for i in range(45)], *[(f"leaf{i}", "r") for i in range(20)]]
    links += [("self", "self"), ("below", "self"), ("m1", "m2"), ("m2", "m3"), ("m3", "m1"), ("t1", "m2"), ("t2", "t1"), ("a", "b"), ("b", "a")]
    links += [(f"ring{i}", f"ring{(i + 1) % 9}") for i in range(9)] + [("hang", "ring4")]
    random.Random(3).shuffle(links)
    for residue in (0, 30, 10**6):
        assert result(spark, links, residue) == walked(links)


def test_written_tables_can_be_stacked_and_released(spark):
    from arbora.runtime import children, cut, release, shared_folder, stacked

    folder = shared_folder(spark)
    before = len(children(spark, folder))
    parts = [cut(spark.range(n, n + 3)) for n in (0, 10)]
    assert sorted(r.id for r in stacked(parts).collect()) == [0, 1, 2, 10, 11, 12]
    assert len(children(spark, folder)) == before + 2
    release(parts[0])
    assert len(children(spark, folder)) == before + 1 and parts[1].count() == 3 and cut(spark.range(0)).count() == 0


def test_estimates_do_not_grow_over_cuts(spark):
    from arbora.runtime import cut

    df = cut(spark.range(50).withColumn("v", F.col("id") % 7))
    for _ in range(30):
        df = cut(df.join(df.select(F.col("id").alias("i")), F.col("v") == F.col("i")).select("id", "v"))
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length() < 64


def test_random_forest_matches_walk(spark):
    rnd = random.Random(5)
    links = [(f"n{i}", None if i < 3 else f"n{rnd.randrange(max(0, i - 4), min(60, i + 2))}") for i in range(60)]
    assert result(spark, links) == walked(links)


def test_spelling_ties_blanks_and_unknown_parents(spark):
    links = [(" Root\t", "  "), ("ROOT", "kid"), ("kid", " rOOt "), ("kid", "other"), (None, "root"), ("  ", "root"), ("far", "never queued")]
    assert result(spark, links) == {"root": ("root", 0, "root"), "kid": ("root", 1, "root/kid"), "far": ("far", 0, "far")}


def test_empty_hierarchy(spark):
    assert result(spark, []) == {}


def test_descendants_and_sizes(spark):
    nodes = hierarchy.hierarchy(queue(spark, [("a", None), ("b", "a"), ("c", "b"), ("l", "l")]), with_sizes=True, with_paths=True)
    assert {tuple(r) for r in hierarchy.descendants(nodes).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert {(r.node, r.subtree_size) for r in nodes.collect()} == {("a", 3), ("b", 2), ("c", 1), ("l", None)}


def test_hot_keys(spark):
    rows = [(1, i % 7, "2024-01-01") for i in range(90)] + [(2, 1, None), (None, 1, "2024-02-01"), (3, None, "2024-03-01")]
    edges = spark.createDataFrame(rows, "from_user_id long, to_user_id long, last_seen_at string")
    got = {(r.side, r.user_id): (r.rows, r.partners, r.latest_seen_at) for r in hotkeys.both_sides(edges).collect()}
    assert got["from", 1] == (90, 7, "2024-01-01") and got["from", 2] == (1, 1, None) and got["from", 3] == (1, 0, "2024-03-01")
    assert got["to", 1] == (13 + 2, 2, "2024-02-01") and ("from", None) not in got
    assert {tuple(r) for r in hotkeys.heavy_users(edges, 0.9).collect()} == {("from", 1)}
    assert hotkeys.heavy_users(edges.limit(0)).count() == 0


def test_modes_and_percentiles_of_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [("hot", rnd.randrange(50)) for _ in range(3000)] + [("a", 5), ("a", 5), ("a", 3), ("b", None), (None, 4)]
    df = spark.createDataFrame(rows, "k string, v int")
    hot = sorted(v for k, v in rows if k == "hot")
    for share in (0.1, 0.5, 0.9):
        got = {r.k: r.percentile for r in hotkeys.percentiles(df, "k", "v", share).collect()}
        assert got["hot"] == hot[-(-int(share * 10) * len(hot) // 10) - 1] and got[None] == 4 and "b" not in got
    got = {r.k: (r.mode, r.mode_rows) for r in hotkeys.modes(df, "k", "v").collect()}
    assert got["a"] == (5, 2) and got["hot"][1] == max(hot.count(v) for v in set(hot))


UPDATES = "update_id long, user_id long, followers long, following long, updated_at string, fetched_at timestamp, k string, at string"


def updates(spark, rows):
    df = spark.createDataFrame([(i, u, a, b, t, None, "x", "y") for i, (u, a, b, t, _) in enumerate(rows)], UPDATES)
    fetched = spark.createDataFrame([(i, f) for i, (*_, f) in enumerate(rows)], "update_id long, f long")
    return df.join(fetched, "update_id").withColumn("fetched_at", F.timestamp_seconds("f")).drop("f")


def versions(spark, rows, build=history.history, **more):
    got = build(updates(spark, rows), "user_id", history.iso_instant(F.col("updated_at")), ["followers", "following"], ["fetched_at", "update_id"], **more)
    return sorted(((r.user_id, r.followers, r.following, r.valid_from // 10**6, r.valid_to and r.valid_to // 10**6) for r in got.collect()), key=lambda r: (r[0], r[3]))


def test_versions(spark):
    rows = [
        (1, 5, 5, "1970-01-01T00:00:10Z", 1),
        (1, 6, 5, "1970-01-01 00:00:20", 1),
        (1, 7, 5, "1970-01-01T01:00:20+01:00", 2),  # the same instant, fetched later
        (1, 7, 5, "1970-01-01T00:00:30.000Z", 1),  # no change
        (1, None, 5, "1970-01-20T00:00:00Z", 1),  # another bucket, a null
        (1, None, 5, "1970-01-20T00:00:01Z", None),
        (1, 7, 5, None, 1),
        (1, 7, 5, "never", 1),
        (None, 1, 1, "1970-01-01T00:00:10Z", 1),
        (2, 1, 1, "1969-12-31T19:00:00-05:00", 1),
    ]
    want = [(1, 5, 5, 10, 20), (1, 7, 5, 20, 19 * 86400), (1, None, 5, 19 * 86400, None), (2, 1, 1, 0, None)]
    for build in (history.history, history.versions):
        assert versions(spark, rows, build) == want
        assert versions(spark, [], build) == []


def test_merging_periods_gives_the_versions(spark):
    rnd = random.Random(2)
    rows = [(u, rnd.choice([None, 1, 2]), 1, f"2024-01-{1 + rnd.randrange(28):02}T00:00:{rnd.randrange(60):02}Z", i) for i, u in enumerate(rnd.choices((1, 1, 1, 2, 3), k=300))]
    want = versions(spark, rows, history.versions)
    assert len(want) > 100
    for periods in (1, 2, 7):
        assert versions(spark, rows, periods=periods) == want


def test_merge_versions(spark):
    old = spark.createDataFrame([(1, "a", 0, None), (2, "b", 0, None), (3, None, 0, None), (4, "x", 0, 5), (4, "y", 5, None)], "id long, v string, valid_from long, valid_to long")
    new = spark.createDataFrame([(1, "a", 9, None), (2, "c", 9, None), (3, None, 9, 11), (3, "n", 11, None), (5, "e", 9, None), (5, "e", 9, None), (None, "z", 9, None)], "id long, v string, valid_from long, valid_to long")
    got = sorted(map(tuple, history.merge_versions(old, new, "id", ["v"]).collect()), key=str)
    assert got == sorted([(1, "a", 0, None), (2, "b", 0, 9), (2, "c", 9, None), (3, None, 0, 11), (3, "n", 11, None), (4, "x", 0, 5), (4, "y", 5, None), (5, "e", 9, None)], key=str)


def test_snapshot_changes(spark):
    cols = "snapshot_no int, k1 long, k2 string, v int, seen long, pair string, sign string"
    rows = [(1, 1, "a", 1, 0), (1, 2, "a", 1, 0), (1, 3, "a", None, 0), (1, 4, None, 1, 0), (1, 1, "a", 1, 0)]
    rows += [(4, 1, "a", 2, 0), (4, 3, "a", None, 9), (4, 5, "a", 1, 0), (4, 5, "a", 1, 0), (4, 4, None, 1, 1), (None, 9, "a", 1, 1)]
    rows += [(6, 1, "a", 2, 0), (6, 3, "a", 3, 0), (6, 5, "a", 1, 0), (6, 4, None, 1, 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], cols)
    got = {tuple(r) for r in snapshots.snapshot_changes(df, "snapshot_no", ["k1", "k2"], ["v"], "seen").collect()}
    assert got == {(4, 1, "a", "changed"), (4, 2, "a", "removed"), (4, 5, "a", "added"), (6, 3, "a", "changed")}
    assert snapshots.snapshot_changes(df.where("snapshot_no = 1"), "snapshot_no", ["k1", "k2"], ["v"]).count() == 0
